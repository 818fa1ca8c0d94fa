"""Toxicity by a bidirectional gated recurrent network over text windows (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of, short_batches

#: Words of a window, and words from one window's start to the next's.
WINDOW, STRIDE = 48, 36
#: Longer runs of word characters are cut into words of so many.
WORD_CHARS = 48
#: Units of a direction, size of the word and of the character vector, and the
#: number of hashed word and character n-gram rows.
UNITS, WORD_DIM, CHAR_DIM, WORD_ROWS, CHAR_ROWS = 16, 12, 12, 1 << 14, 1 << 14
#: Bytes of a character n-gram.
NGRAMS = (3, 4, 5)
#: At most so many labelled documents of either class are learned from, all of their windows.
TRAIN_ROWS = 1200
THRESHOLD = 0.3
SEED = 9
#: Slope and offset of a network that learned nothing: no text is toxic then.
NOTHING = (0.0, -30.0)

_WORDS = re.compile(r"\w{1,%d}" % WORD_CHARS)
_U = np.uint64


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Features:
    """Numbers the distinct words of a batch and hashes each and its n-grams."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def ids(self, tokens: list[str]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(w, len(number)) for w in tokens], np.int32)

    def hashed(self, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word row of each word, n-gram rows of all words end to end, and where each starts.
        Words are hashed ``step`` at a time, which bounds what is held beside the result."""
        known = list(self.number)
        parts = [_hashed(known[i : i + step]) for i in range(0, max(1, len(known)), step)]
        whole, grams, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        return whole, grams, np.concatenate([[0], np.cumsum(count)])


def _hashed(known: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, n-gram rows end to end, and n-grams of each of some words."""
    coded = [f"<{w}>".encode("utf-8", "surrogatepass") for w in known]
    data = np.frombuffer(b"".join(coded) + b"\0" * max(NGRAMS), np.uint8).astype(_U)
    size = np.array([len(c) for c in coded], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    with np.errstate(over="ignore"):
        rolling, grams = np.zeros(len(data) - max(NGRAMS), _U), []
        owner = np.repeat(np.arange(len(coded), dtype=np.int32), size)
        left = np.repeat(ends, size) - np.arange(len(owner))
        for j in range(max(NGRAMS)):
            rolling = rolling * _U(0x100000001B3) + data[j : j + len(rolling)] + _U(1)
            if j + 1 in NGRAMS:
                ok = left >= j + 1
                grams.append((owner[ok], _row(rolling[ok], j + 1, CHAR_ROWS).astype(np.int32)))
        # a word's own hash: the sum of its bytes' hashes, each mixed with its place
        place = np.arange(len(owner)) - np.repeat(starts, size)
        mixed = _mix(data[: len(owner)] + _U(257) * place.astype(_U))
        whole = _row(np.add.reduceat(mixed, starts), 1, WORD_ROWS) if len(coded) else np.zeros(0, np.int64)
    own = np.concatenate([g[0] for g in grams])
    order = np.argsort(own, kind="stable")
    return whole, np.concatenate([g[1] for g in grams])[order], np.bincount(own, minlength=len(coded))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _row(h: np.ndarray, salt: int, rows: int) -> np.ndarray:
    return (_mix(h * _U(2 * salt + 1) + _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.int64) % rows


def windows(ids: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> list[np.ndarray]:
    """All overlapping windows; they cover every word, and an empty text has an empty one."""
    last = max(0, len(ids) - size)
    return [ids[at : at + size] for at in [*range(0, last, stride), last]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, np.float64), -30, 30)))


def _gather(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values of each index."""
    return np.stack([np.bincount(index, v, rows) for v in values.T], 1).astype(np.float32)


class Network:
    """Word and character vectors, a gated recurrent unit each way, attention pooling.

    The input of a word is its row of a hashed word table beside the mean of the
    rows of its hashed byte n-grams. Both directions' states are weighed by a
    softmax over the window and summed; a linear layer gives the logit.
    """

    def __init__(self, seed: int = SEED, p: dict[str, np.ndarray] | None = None):
        if p is not None:
            self.p = p
            return
        r, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, UNITS
        init = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"E": init(WORD_ROWS, WORD_DIM, k=0.1), "C": init(CHAR_ROWS, CHAR_DIM, k=0.3), "a": init(2 * h, k=0.3), "o": init(2 * h, k=0.3), "ob": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": init(d, 3 * h, k=d**-0.5), f"U{way}": init(h, 3 * h, k=h**-0.5), f"b{way}": np.zeros(3 * h, np.float32)}

    def inputs(self, hashed: tuple) -> np.ndarray:
        whole, grams, at = hashed
        n = len(whole)
        x = np.zeros((n, WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = self.p["E"][whole]
        count = np.diff(at)
        some = np.flatnonzero(count)
        if len(some):
            x[some, WORD_DIM:] = np.add.reduceat(self.p["C"][grams], at[:-1][some], axis=0) / count[some, None]
        return x

    def _way(self, px: np.ndarray, idx: np.ndarray, length: np.ndarray, way: str, keep: bool):
        """States of one direction, [time, window, unit]; padding leaves the state."""
        n, t = idx.shape
        h, U = np.zeros((n, UNITS), np.float32), self.p[f"U{way}"]
        Uzr, Un = np.ascontiguousarray(U[:, : 2 * UNITS]), np.ascontiguousarray(U[:, 2 * UNITS :])
        out, saved = np.empty((t, n, UNITS), np.float32), []
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            x = px[idx[:, s]]
            zr = x[:, : 2 * UNITS] + h @ Uzr
            np.negative(zr, out=zr)
            np.exp(np.minimum(zr, 30, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            rh = r * h
            c = np.tanh(x[:, 2 * UNITS :] + rh @ Un)
            new = h + z * (c - h)
            on = (s < length)[:, None]
            if keep:
                saved.append((s, h, z, r, c, rh, on))
            h = np.where(on, new, h)
            out[s] = h
        return out, saved

    def forward(self, x: np.ndarray, idx: np.ndarray, length: np.ndarray, keep: bool = False):
        both, saved = [], {}
        for way in "fb":
            px = x @ self.p[f"W{way}"] + self.p[f"b{way}"]
            out, saved[way] = self._way(px, idx, length, way, keep)
            both.append(out)
        states = np.concatenate(both, 2)
        score = states @ self.p["a"]
        score = np.where(np.arange(idx.shape[1])[:, None] < np.maximum(length, 1), score, -1e9)
        score = np.exp(score - score.max(0))
        score /= score.sum(0)
        pooled = np.einsum("tn,tnk->nk", score, states)
        logit = pooled @ self.p["o"] + self.p["ob"]
        return (logit, states, score, pooled, saved) if keep else logit

    def gradient(self, x: np.ndarray, hashed: tuple, idx: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        logit, states, score, pooled, saved = self.forward(x, idx, length, keep=True)
        p, n = _sigmoid(logit), len(y)
        loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        dl = ((p - y) / n).astype(np.float32)
        g = {"o": pooled.T @ dl, "ob": dl.sum(keepdims=True)}
        dpool = dl[:, None] * self.p["o"]
        ds = np.einsum("nk,tnk->tn", dpool, states)
        ds = score * (ds - (score * ds).sum(0))
        dstates = score[:, :, None] * dpool + ds[:, :, None] * self.p["a"]
        g["a"] = np.einsum("tn,tnk->k", ds, states)
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            dU, inner = np.zeros_like(self.p[f"U{way}"]), np.empty((*idx.T.shape, 3 * UNITS), np.float32)
            U, carry = self.p[f"U{way}"], np.zeros((n, UNITS), np.float32)
            for s, h, z, r, c, rh, on in reversed(saved[way]):
                carry = carry + dstates[s, :, k * UNITS : (k + 1) * UNITS]
                d = np.where(on, carry, 0)
                dc = d * z * (1 - c * c)
                drh = dc @ U[:, 2 * UNITS :].T
                dzr = np.concatenate([d * (c - h) * z * (1 - z), drh * h * r * (1 - r)], 1)
                dU[:, 2 * UNITS :] += rh.T @ dc
                dU[:, : 2 * UNITS] += h.T @ dzr
                inner[s, :, : 2 * UNITS], inner[s, :, 2 * UNITS :] = dzr, dc
                carry = np.where(on, d * (1 - z) + drh * r + dzr @ U[:, : 2 * UNITS].T, carry)
            dpx = _gather(idx.T.ravel(), inner.reshape(-1, 3 * UNITS), len(x))
            g |= {f"U{way}": dU, f"W{way}": x.T @ dpx, f"b{way}": dpx.sum(0)}
            dx += dpx @ self.p[f"W{way}"].T
        whole, grams, at = hashed
        count = np.diff(at)
        g["E"] = _gather(whole, dx[:, :WORD_DIM], WORD_ROWS)
        g["C"] = _gather(grams, np.repeat(dx[:, WORD_DIM:] / np.maximum(count, 1)[:, None], count, axis=0), CHAR_ROWS)
        return loss, g


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in parts])
    idx = np.zeros((len(parts), max(1, int(length.max(initial=0)))), np.int64)
    for i, p in enumerate(parts):
        idx[i, : len(p)] = p
    return idx, length


def score_texts(net: Network, texts: list[str | None], scale: tuple[float, float] = (1.0, 0.0), chunk: int = 1024) -> np.ndarray:
    """Highest window probability of each text; all of its windows are scored.

    Windows pass in chunks sorted by length, so memory follows the chunk and the
    distinct words of the texts given.
    """
    f = Features()
    parts, owner = [], []
    for i, t in enumerate(texts):
        own = windows(f.ids(words(t)))
        parts += own
        owner += [i] * len(own)
    if not f.number:
        f.ids([""])
    x, owner = net.inputs(f.hashed()), np.array(owner)
    order = np.argsort([len(p) for p in parts], kind="stable")
    logit = np.empty(len(parts), np.float32)
    for at in range(0, len(order), chunk):
        own = order[at : at + chunk]
        logit[own] = net.forward(x, *_padded([parts[i] for i in own]))
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, logit)
    return _sigmoid(scale[0] * best + scale[1])


def _platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of ``y``, with targets pulled
    in by one row of each class, so that separable classes have a finite one."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, b = np.stack([np.clip(logit, -12, 12), np.ones_like(logit)], 1), np.array([1.0, 0.0])
    weight = weight / weight.sum()

    def loss(b: np.ndarray) -> float:
        q = np.clip(_sigmoid(x @ b), 1e-9, 1 - 1e-9)
        return float(-(weight * (t * np.log(q) + (1 - t) * np.log(1 - q))).sum() + 1e-4 * ((b - [1, 0]) ** 2).sum())

    for _ in range(40):
        q = _sigmoid(x @ b)
        g = x.T @ (weight * (q - t)) + 2e-4 * (b - [1, 0])
        step = np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + 2e-4 * np.eye(2), g)
        while np.abs(step).max() > 1e-6 and loss(b - step) > loss(b):
            step = step / 2
        b = b - step
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def train(texts: list[str | None], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = SEED, epochs: int = 6, batch: int = 32, steps: int = 400, rate: float = 0.02) -> tuple[Network, tuple[float, float]]:
    """A network and the slope and offset that turn its logit into a probability.

    A label is of a whole text, not of a window: of a toxic text only the window
    that scores highest counts, of another the highest and one at random; all of
    a text's windows are looked at in each step. Texts are met from short to long
    in the first two epochs, when a window is most of a text; few texts are met
    more often, for ``steps`` updates. A fifth of the texts is kept out of learning;
    its best windows set slope and offset, the classes (0, 1) weighed as they
    stand in the whole table.
    """
    r, net, f = np.random.default_rng(seed), Network(seed), Features()
    y = np.array(labels, np.float32)
    parts = [windows(f.ids(words(t))) for t in texts]
    if not f.number or len(set(y.tolist())) < 2:
        return net, NOTHING
    kept = r.random(len(y)) >= 1 / 5
    hashed = f.hashed()
    whole, grams, at = hashed
    m, v, step = {k: np.zeros_like(p) for k, p in net.p.items()}, {k: np.zeros_like(p) for k, p in net.p.items()}, 0
    learn = np.flatnonzero(kept)
    by_length = learn[np.argsort([len(parts[i]) for i in learn], kind="stable")]

    def subset(tried: list[np.ndarray]) -> tuple[tuple, list[np.ndarray]]:
        """The features of the words of some windows alone, and the windows by them."""
        used = np.unique(np.concatenate([*tried, np.zeros(1, np.int32)]))
        back[used] = np.arange(len(used))
        sizes = at[used + 1] - at[used]
        flat = np.repeat(at[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return (whole[used], grams[flat], np.concatenate([[0], np.cumsum(sizes)])), [back[p] for p in tried]

    def looked(tried: list[np.ndarray]) -> np.ndarray:
        sub, near = subset(tried)
        return net.forward(net.inputs(sub), *_padded(near))

    back = np.zeros(len(whole), np.int64)
    epochs = max(epochs, -(-steps * batch // len(learn)))
    for epoch in range(epochs):
        line = by_length if epoch < 2 else r.permutation(learn)
        for b in range(0, len(line), batch):
            docs = line[b : b + batch]
            tried = [(i, p) for i in docs for p in parts[i]]
            owner = np.array([i for i, _ in tried])
            logit = np.concatenate([looked([p for _, p in tried[c : c + 1024]]) for c in range(0, len(tried), 1024)])
            pick = []
            for i in docs:
                own = np.flatnonzero(owner == i)
                pick.append(own[logit[own].argmax()])
                if y[i] == 0:
                    pick.append(r.choice(own))
            pick = np.array(pick)
            sub, near = subset([tried[i][1] for i in pick])
            _, g = net.gradient(net.inputs(sub), sub, *_padded(near), y[owner[pick]])
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.9 * epoch / epochs)
            for k, grad in g.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                net.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    rest = np.flatnonzero(~kept) if len(set(y[~kept].tolist())) == 2 else np.arange(len(y))
    p = score_texts(net, [texts[i] for i in rest])
    logit = np.log(np.clip(p, 1e-12, 1)) - np.log(np.clip(1 - p, 1e-12, 1))
    return net, _platt(logit, y[rest], np.where(y[rest] > 0, weights[1], weights[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list, list, tuple[float, float]]:
    """Texts, labels and class weights that the network learns from: at most ``rows`` of
    each class, of labelled ids outside the held-out fold.

    Those are the ids of least keyed hash, by exact rank among ids whose hash alone
    leaves about twice as many. Of several texts of one id that of least hash is
    taken, before texts move, so what comes to the driver is bounded whatever
    repeats. An id with labels of both kinds counts as toxic; null ids teach nothing.
    """
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = cut(own.where(fold_of(F.col("doc_id")) != 2).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    drawn = own.limit(0).select("doc_id", "toxic")
    for k, n in sorted(sizes.items()):
        few = own.where((F.col("toxic") == k) & (F.col("h") / 2.0**64 + 0.5 < (2.0 * rows + 50) / n))
        drawn = drawn.unionByName(few.orderBy("h", "doc_id").limit(rows).select("doc_id", "toxic"))
    # at most 2 * rows ids: sent to the texts, which then stay where they are
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(cut(drawn)), "doc_id")
    found = met.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text").collect()
    found = sorted(found, key=lambda r: r["doc_id"])
    drawn_of = lambda k: max(1, sum(r["toxic"] == k for r in found))
    return [r["text"] for r in found], [r["toxic"] for r in found], tuple(sizes.get(k, 1) / drawn_of(k) for k in (0, 1))


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, names: tuple[str, str] = ("tox_score", "tox_predicted")) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` with the score (0 to 1) and the
    prediction (1 at THRESHOLD or more) under ``names``, one row for each. The names
    must be new: a clash with an existing column is an error.

    The network is fit on the driver on a bounded labelled sample of at most
    ``2 * train_rows`` documents and sent to the executors; its size is fixed. Every
    window of every whole text is scored, also in learning. Null and empty texts
    score like one empty window; without both classes among the labels nothing is
    learned, and all scores are next to 0. Repeated rows stay rows of their own with equal
    scores; null ids are scored like others.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    spark = docs.sparkSession
    short_batches(spark, 128)
    net, scale = train(*labelled_sample(docs, labels, train_rows))
    model = spark.sparkContext.broadcast((net.p, scale))  # plain values

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, scale = Network(p=model.value[0]), model.value[1]
        for texts in batches:
            yield pd.Series(score_texts(net, texts.tolist(), scale))

    out = docs.withColumn(names[0], scored(F.col("text").cast("string")))
    return out.withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))
