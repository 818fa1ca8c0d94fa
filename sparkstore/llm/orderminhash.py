"""Document fingerprints by order MinHash (operator 2)."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches

#: Characters of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K, PICKED, TUPLES = 8, 2, 48
#: Hex digits that a tuple takes in the fingerprint.
DIGITS = 8
#: k-mers that meet all hash functions at once; bounds memory for long texts.
BLOCK = 1 << 11
#: Of n rows there are about sqrt(n) / PART ordered parts, so that with n both the
#: number of parts and their rows grow, and neither alone.
PART = 6

#: Columns of the order of rows.
KEY = ["last", "down", "h1", "h2"]

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _keys(tuples: int) -> np.ndarray:
    """One key for each function: the hash of x is h(x) XOR key, h a 32-bit mix."""
    return (_mix(np.arange(1, tuples + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32)


def kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of the k-mers of code points, in text order; of a shorter
    text the whole is the only one, and an empty text has none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    if not len(code):
        return code
    k = min(k, len(code))
    with np.errstate(over="ignore"):
        # a polynomial of the window; windows of 1, 2, 4 ... are put together
        part, base, h, width = code, 0x9E3779B97F4A7C15, None, 0
        for bit in range(k.bit_length()):
            if k >> bit & 1:
                n = 1 << bit
                h = part if h is None else h[: len(h) - n] * _U(base) + part[width:]
                width += n
            if k >> bit + 1:
                part = part[: -(1 << bit)] * _U(base) + part[1 << bit :]
                base = base * base % 2**64
    return _mix(h)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each value came before, for values in text order.

    Values and positions are sorted as one number, position last: values lose
    their low bits for it, fewer than leave distinct k-mers of one text distinct.
    """
    bits = _U(max(1, len(h).bit_length()))
    packed = np.sort((h >> bits << bits) | np.arange(len(h), dtype=_U))
    at, value = packed & ((_U(1) << bits) - _U(1)), packed >> bits
    line = np.arange(len(h))
    fresh = np.ones(len(h), bool)
    np.not_equal(value[1:], value[:-1], out=fresh[1:])
    out = np.empty(len(h), _U)
    out[at.astype(np.int64)] = line - np.maximum.accumulate(np.where(fresh, line, 0))
    return out


class Signer:
    """Signs texts: one 32-bit value for each of ``tuples`` hash functions, which
    picks the ``picked`` numbered k-mers of least hash and hashes them in the
    order in which they stand.

    A null text is an empty one; all of its values are zero.
    """

    def __init__(self, k: int = K, picked: int = PICKED, tuples: int = TUPLES):
        self.k, self.picked, self.tuples = k, picked, tuples
        self.keys, self.rows = _keys(tuples)[:, None], np.arange(tuples)
        self.room = np.empty(tuples * BLOCK, np.uint32)

    def __call__(self, text: str | None) -> np.ndarray:
        h = kmers(text or "", self.k)
        if not len(h):
            return np.zeros(self.tuples, np.uint32)
        with np.errstate(over="ignore"):
            return self._sign(h)

    def _sign(self, h: np.ndarray) -> np.ndarray:
        numbered = (_mix(h + occurrences(h) * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32)
        picked, best = min(self.picked, len(h)), []
        for at in range(0, len(h), BLOCK):
            block = numbered[at : at + BLOCK]
            y = np.bitwise_xor(block, self.keys, out=self.room[: self.tuples * len(block)].reshape(self.tuples, -1))
            for _ in range(min(picked, len(block))):
                i = y.argmin(1)
                best.append(i + at)
                y[self.rows, i] = np.uint32(0xFFFFFFFF)
        best = np.stack(best, 1)
        if best.shape[1] > picked:
            rank = np.argsort(numbered[best] ^ self.keys, axis=1, kind="stable")[:, :picked]
            best = np.take_along_axis(best, rank, 1)
        best.sort(axis=1)  # text order
        out = np.zeros(self.tuples, _U)
        for j in range(best.shape[1]):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[best[:, j]] + _U(j + 1))
        return (out >> _U(32)).astype(np.uint32)


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values: 1 for equal texts, near 0 for unrelated ones."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, k: int = K, picked: int = PICKED, tuples: int = TUPLES) -> DataFrame:
    """``(doc_id, fingerprint)``, one row for each row of ``docs(doc_id, text)``; equal
    texts have equal fingerprints, null texts that of the empty text. Repeated rows and
    null ids stay rows of their own; other columns are ignored; no rows give no rows."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sign = Signer(k, picked, tuples)
        for texts in batches:
            yield pd.Series([hexed(sign(t)) for t in texts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), signed("text").alias("fingerprint"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``(last, down, h1, h2, doc_id, text)``: ascending, the first four are the order of
    rows by descending doc_id, null ids last, rows of one id by hash of their text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.col("doc_id").isNull().cast("long").alias("last"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down")]
    return own.select(*key, F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "doc_id", "text")


def _place(heads: list[tuple]):
    """Number of the part of each key, and of the part before it if it is that part's head."""

    @F.pandas_udf("array<struct<part:int,role:int>>")
    def place(last: pd.Series, down: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
        out = []
        for key in zip(last.tolist(), down.tolist(), h1.tolist(), h2.tolist(), strict=True):
            part = max(0, bisect.bisect_right(heads, key) - 1)
            to = [{"part": part, "role": 0}]
            if key == heads[part]:  # the first part's head follows the last part's rows
                to.append({"part": (part - 1) % len(heads), "role": 1})
            out.append(to)
        return pd.Series(out, dtype=object)

    return place(*KEY)


def edited(docs: DataFrame, k: int = K, picked: int = PICKED, tuples: int = TUPLES, parts: int | None = None) -> DataFrame:
    """Each text of ``docs(doc_id, text)`` against an edited form of it and the next text.

    The next text is that of the next row by descending doc_id (null ids last, rows
    of one id by hash of their text), after the last that of the first. The edited
    text is the text with its last third (code points, rounded down) replaced by as
    many or all of the first of the next text. Gives ``(doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    Keys alone are laid in ranges first; the heads of the ranges, about sqrt(n) / PART
    of them, then deal the texts, which are shuffled once: to their range, the heads
    also to the range before. Ranges go by id and text, so no id is one range, and
    equal rows, whose next text is their own but for the last, are one row with a
    count before they move. Null texts are empty; a single row is its own next; no
    rows give no rows; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    rows = _keyed(docs)
    keys = cut(rows.groupBy(*KEY).agg(F.count("*").alias("m")))
    n = keys.count()
    parts = max(1, int(n**0.5 / PART)) if parts is None else parts
    line = [F.col(c) for c in KEY]
    ranged = keys.repartitionByRange(parts, *line).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEY)).alias("head"))
    heads = sorted(tuple(r["head"]) for r in ranged.collect())
    again = cut(keys.where("m > 1"))
    if again.isEmpty():
        single = rows.withColumn("m", F.lit(1).cast("long"))
    else:
        many = rows.join(again, KEY).groupBy(*KEY, "m").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
        single = rows.join(again, KEY, "left_anti").withColumn("m", F.lit(1).cast("long")).unionByName(many)
    dealt = single.withColumn("to", _place(heads)) if heads else single.withColumn("to", F.array().cast("array<struct<part:int,role:int>>"))
    dealt = dealt.select(*KEY, "doc_id", "text", "m", F.inline("to").alias("part", "role"))
    # a partition for each part: hashing part numbers would lay several on one
    dealt = dealt.repartitionById(max(1, len(heads)), F.col("part")).sortWithinPartitions("part", "role", *KEY)
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "m", "part", "role")  # pandas would turn ids with nulls to doubles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign, last, out = Signer(k, picked, tuples), None, []
        for rows in batches:
            for i, t, m, p, role in zip(rows["doc_id"], rows["text"], rows["m"], rows["part"], rows["role"], strict=True):
                sig = sign(t) if role == 0 or last is not None else None
                if last is not None and last[0] == p:
                    out.append(row(sign, last, t, sig))
                last = (p, i, t, sig) if role == 0 else None
                if role == 0 and m > 1:  # all but the last of equal rows come before another
                    same = row(sign, last, t, sig)
                    for at in range(0, m - 1, BLOCK):
                        yield pd.DataFrame([same] * min(BLOCK, m - 1 - at))
            if out:
                yield pd.DataFrame(out)
                out = []

    def row(sign: Signer, last: tuple, t: str, sig: np.ndarray) -> dict:
        _, i, own, own_sig = last
        n = len(own)
        changed = own[: n - n // 3] + t[: n // 3]
        changed_sig = own_sig if changed == own else sign(changed)
        return {
            "doc_id": i, "n_chars": n, "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": hexed(own_sig),
            "edited_fingerprint": hexed(changed_sig), "near_edited": likeness(own_sig, changed_sig), "near_next": likeness(own_sig, sig),
        }

    told = dealt.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return told.withColumn("doc_id", F.col("doc_id").cast("long"))
