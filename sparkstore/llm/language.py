"""Language identification by sparse multinomial logistic regression (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fold_of, fresh, short_batches

#: Characters of an n-gram, and the number of hashed n-gram rows.
NGRAMS, ROWS = (1, 2, 3), 1 << 14
#: Distinct documents that the weights are fit on: of one language, and of all
#: together, where each language still has at least one.
TRAIN_ROWS, ALL_ROWS = 600, 60_000
#: Follow-the-regularised-leader: learning rate, its offset, and both penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-4, 1e-4, 4
UNKNOWN = "und"
#: Characters that are counted at once; bounds memory for long texts.
BLOCK = 1 << 18
SEED = 3

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    # the pattern also takes numerals such as a half, which are no letters
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


class Counter:
    """Counts the hashed character n-grams of a text.

    Letters count in lower case; every run of other characters is one space, also
    at both ends, so that n-grams know where words begin and end.
    """

    def __init__(self):
        self.letter = np.array([chr(i).isalpha() for i in range(1 << 16)])
        self.letter[-1] = True  # stands for all characters beyond the first plane

    def __call__(self, text: str) -> np.ndarray:
        out, carry = None, np.array([32], np.uint32)
        for at in range(0, max(1, len(text)), BLOCK):
            part = text[at : at + BLOCK].lower()
            if at + BLOCK >= len(text):
                part += " "
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = self.letter[np.minimum(code, 0xFFFF)]
            code = np.concatenate([carry, np.where(letter, code, np.uint32(32))])
            keep = code != 32
            keep[1:] |= keep[:-1]
            keep[0] = True
            code = code[keep]
            h, wide, found = code, code, []
            for n in range(1, min(max(NGRAMS), len(code)) + 1):
                if n > 1:
                    h = h[:-1] * np.uint32(0x9E3779B1) + wide[n - 1 :]
                if n in NGRAMS:
                    first = max(0, len(carry) - n + 1)  # those that end in the carry were counted
                    found.append(h[first:] * np.uint32(0x85EBCA6B) >> np.uint32(18))
            count = np.bincount(np.concatenate(found), minlength=ROWS)
            out = count if out is None else out + count
            carry = code[-(max(NGRAMS) - 1) :]
        return out


def weigh(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and TF-IDF values, of unit length, of the n-grams that occur."""
    at = np.flatnonzero(count)
    x = np.log1p(count[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def inverse(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Smoothed inverse document frequencies of n-gram rows."""
    return np.log((1 + n_docs) / (1 + df)) + 1


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, float]:
    """Weights [n-gram row, class], the last row the bias, and a temperature.

    FTRL-Proximal for each coordinate: z gathers gradients less what they moved
    the weight by, n their squares; a weight is zero while |z| <= L1. A fifth of
    the rows is kept out and sets the temperature of least log loss.
    """
    r = np.random.default_rng(SEED)
    z, n = np.zeros((ROWS + 1, classes)), np.zeros((ROWS + 1, classes))
    rows = [(np.append(at, ROWS), np.append(x, 1.0)) for at, x in rows]

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    kept = r.random(len(rows)) < 0.2 if len(rows) >= 10 * classes else np.zeros(len(rows), bool)
    for _ in range(EPOCHS):
        for i in r.permutation(np.flatnonzero(~kept)):
            at, x = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    if not kept.any():
        return w, 1.0
    logit = np.array([rows[i][1] @ w[rows[i][0]] for i in np.flatnonzero(kept)])
    own, grid = y[kept], np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logit / t)[np.arange(len(own)), own], 1e-12)).mean() for t in grid]
    return w, float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, temperature: float, idf: np.ndarray):
        self.languages, self.weights, self.temperature, self.idf = languages, weights.astype(np.float32), temperature, idf.astype(np.float32)

    def predict(self, counter: Counter, text: str | None) -> tuple[str, float]:
        """Language and its calibrated probability; und and 0 without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = weigh(counter(text), self.idf)
        p = _softmax((x @ self.weights[at] + self.weights[ROWS]).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def sample(own: DataFrame, sizes: dict[str, int], rows: int) -> DataFrame:
    """``(lang, h, text)``: the ``rows`` texts of least hash ``h`` of each language of
    ``own(lang, h, text)``, equal ones once; ``sizes`` are its distinct texts.

    Ranks are exact, and taken among texts whose hash alone leaves about twice as
    many, so no window holds a language. A repeated text is one before texts move.
    What is broadcast has a row for each language, which the driver has listed.
    """
    u = F.col("h") / 2.0**64 + 0.5
    share = own.sparkSession.createDataFrame([(k, min(1.0, (2.0 * rows + 50) / n)) for k, n in sizes.items()], "lang string, share double")
    few = own.select("lang", "h").join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "h").distinct()
    line = Window.partitionBy("lang").orderBy("h")
    drawn = cut(few.withColumn("r", F.row_number().over(line)).where(F.col("r") <= rows).select("lang", "h"))
    return own.join(drawn, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, all_rows: int = ALL_ROWS) -> Model:
    """A model of ``docs(doc_id, text, lang)`` outside the held-out fold; every language learns.

    Document frequencies are counted over all of those documents, in one pass;
    weights are fit on at most ``train_rows`` of each language and, where there
    are many languages, ``all_rows`` together or one of each: those of least keyed
    hash of id and text, repeated rows once. Their weighted n-grams alone come to
    the driver. Null ids are ids; null texts and texts without a letter teach nothing.
    """
    short_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold_of(F.col("doc_id")), F.lit(0)) != 2))
    own = own.select("lang", "text", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((ROWS + 1, 1)), 1.0, np.ones(ROWS))
    rows = max(1, min(train_rows, all_rows // len(languages)))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, total, rows = Counter(), np.zeros(ROWS, np.int64), 0
        for part in batches:
            for text in part["text"]:
                if has_letter(text):
                    total += counter(text) > 0
                    rows += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"row": np.append(at, -1), "n": np.append(total[at], rows)})

    found = own.select("text").mapInPandas(frequencies, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
    df, n_docs = np.zeros(ROWS), 0
    for r in found:
        if r["row"] < 0:
            n_docs = r["n"]
        else:
            df[r["row"]] = r["n"]
    idf = inverse(df, n_docs)
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter()
        for part in batches:
            out = [(h, lang, *weigh(counter(t), idf)) for h, t, lang in zip(part["h"], part["text"], part["lang"], strict=True) if has_letter(t)]
            if out:
                h, lang, at, x = zip(*out, strict=True)
                yield pd.DataFrame({"h": h, "lang": lang, "at": [a.astype(np.int32) for a in at], "x": [v.astype(np.float32) for v in x]})

    drawn = sample(own, sizes, rows).mapInPandas(vectors, "h long, lang string, at array<int>, x array<float>").collect()
    drawn.sort(key=lambda r: (r["h"], r["lang"], r["at"]))
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[r["lang"]] for r in drawn], int)
    w, t = fit([(np.array(r["at"], np.int64), np.array(r["x"], np.float64)) for r in drawn], y, len(languages))
    return Model(languages, w, t, idf)


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs(text, ...)`` with the predicted language and its probability
    under ``names``, which must be new: a clash with an existing column is an error.

    Whole texts count, whatever their length. The language is ``und`` with score 0
    for texts that are null or have no letter, and for all without a language to
    learn from. Of equal probabilities the first language in code-point order wins.
    Equal texts get equal results; one row for each, repeated rows too.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values

    @F.pandas_udf("lang string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter, own = Counter(), Model(**sent.value)
        for texts in batches:
            yield pd.DataFrame([own.predict(counter, t) for t in texts], columns=["lang", "score"])

    own = fresh("told")
    out = docs.withColumn(own, told(F.col("text").cast("string")))
    return out.withColumn(names[0], F.col(f"{own}.lang")).withColumn(names[1], F.col(f"{own}.score")).drop(own)
