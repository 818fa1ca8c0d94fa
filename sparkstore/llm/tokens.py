"""Token counts by sections, attributed through character offsets (operator 10)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches

#: How a byte-pair vocabulary's texts are cut before merging (a fixed value of it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: To which section a token goes that crosses boundaries.
RULES = ("first", "last", "most")


class Encoder:
    """Encodes texts and knows the bytes of each token; one for each process."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        import tiktoken
        from tiktoken import registry

        name = f"{hash(data)}/{pattern}"
        if name not in registry.ENCODINGS:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            coding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            coding.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                coding.token_bytes[i] = len(token)
            registry.ENCODINGS[name] = coding
        self.coding = registry.ENCODINGS[name]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes; special strings are ordinary text."""
        ids = self.coding.encode_to_numpy(text, disallowed_special=())
        return np.cumsum(self.coding.token_bytes[ids])

    def count(self, text: str) -> int:
        """Tokens of a text; special strings are ordinary text."""
        return len(self.coding.encode_to_numpy(text, disallowed_special=()))


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those touch another section too.

    Tokens are the spans between ``ends``, sections those between ``bounds`` (the
    first 0, the last the length, both in bytes); both are sorted, so the interval
    join is two searches. A crossing token goes to the section of its first byte,
    of its last, or of most of its bytes (the earliest of equal ones). Empty
    sections get none; every token is counted once.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    inner, n = bounds[1:-1], len(bounds) - 1
    first, last = np.searchsorted(inner, starts, "right"), np.searchsorted(inner, ends - 1, "right")
    own = last.copy() if rule == "last" else first.copy()
    crossing = first != last
    if rule == "most":
        for i in np.flatnonzero(crossing):
            s = np.arange(first[i], last[i] + 1)
            own[i] = s[(np.minimum(bounds[s + 1], ends[i]) - np.maximum(bounds[s], starts[i])).argmax()]
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def _vocabulary(spark: SparkSession, tokenizer: str):
    """The file of byte-pair ranks, read by the driver and sent; its size is fixed."""
    if not os.path.isfile(tokenizer):
        raise FileNotFoundError(f"{tokenizer}: no vocabulary file of byte-pair ranks is there")
    with open(tokenizer, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_count(spark: SparkSession, text: Column, tokenizer: str, pattern: str = PATTERN) -> Column:
    """Number of tokens of a whole text by the vocabulary in the file ``tokenizer``; 0 for null."""
    short_batches(spark)
    vocabulary = _vocabulary(spark, tokenizer)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary.value, pattern)
        for texts in batches:
            yield pd.Series([encoder.count(t) if t else 0 for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, tokenizer: str, fields: Sequence[str] = ("text",), by: str = "line", joiner: str = "\n", rule: str = "most", pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, section, field, start, n_chars, n_tokens, n_crossing)``: a row for each
    section of each row of ``docs``.

    A row's fields (null: empty), put together with ``joiner``, are one document
    that is encoded once and whole. Sections are its lines, each with its line
    end, or the fields, each with the joiner after it (``by`` "line" or "field");
    an empty document is one empty section. ``start`` and ``n_chars`` are code
    points; n_tokens of a document's sections add up to its tokens; n_crossing are
    those of them that also touch another section, dealt by ``rule`` (see
    ``attribute``). ``field`` is the number of the field in which it starts.
    ``tokenizer`` is the path of a vocabulary file, read by the driver and sent. Repeated rows and null ids stay rows of their own.
    """
    if rule not in RULES or by not in ("line", "field"):
        raise ValueError(f"unknown rule {rule!r} or sections {by!r}")
    spark = docs.sparkSession
    short_batches(spark)
    vocabulary = _vocabulary(spark, tokenizer)
    names = [f"t{i}" for i in range(len(fields))]
    own = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(fields, names, strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary.value, pattern)
        for rows in batches:
            ids, counts, flat = [], [], {c: [] for c in ("field", "start", "n_chars", "n_tokens", "n_crossing")}
            for doc_id, *texts in rows[["doc_id", *names]].itertuples(index=False, name=None):
                text = joiner.join(texts)
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                edges = np.cumsum([len((t + joiner).encode("utf-8", "surrogatepass")) for t in texts[:-1]], dtype=np.int64)
                bounds = np.flatnonzero(data == 10) + 1 if by == "line" else edges
                bounds = np.concatenate([[0], bounds[bounds < len(data)] if by == "line" else bounds, [len(data)]]).astype(np.int64)
                tokens, crossing = attribute(encoder.ends(text), bounds, rule)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                ids.append(doc_id)
                counts.append(len(bounds) - 1)
                for c, v in zip(flat, (np.searchsorted(edges, bounds[:-1], "right"), chars[:-1], np.diff(chars), tokens, crossing), strict=True):
                    flat[c].append(v)
            if ids:
                section = np.concatenate([np.arange(n) for n in counts])
                yield pd.DataFrame({"doc_id": np.repeat(np.array(ids, object), counts), "section": section, **{c: np.concatenate(v) for c, v in flat.items()}})

    told = own.mapInPandas(run, "doc_id string, section long, field long, start long, n_chars long, n_tokens long, n_crossing long")
    return told.withColumn("doc_id", F.col("doc_id").cast("long"))
