"""COPY/LITERAL deltas against one base or several, byte level, Arrow-batched."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded

#: Modulus of the weak checksum (fixed value).
MODULUS = 65521
#: Bytes of an anchor; tags of the two delta formats (fixed values).
BLOCK = 64
LITERAL, COPY, COPY_FROM = 0, 1, 2
#: Bounds of a several-base delta.
MAX_BASES, MAX_ANCHORS, MAX_BYTES = 4, 16, 8 << 20
#: Bytes of pairs that a Python worker is sent at once.
PAIR_BATCH = 8 << 20
#: Places of a target that are looked at together, most bits of the table of anchors, and odd
#: factors of its hash.
STEP, MOST_BITS, FACTORS = 1 << 16, 22, (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    for i in range(10):
        if at + i >= len(data):
            raise ValueError("varint is cut off")
        n |= (data[at + i] & 0x7F) << 7 * i
        if data[at + i] < 0x80:
            return n, at + i + 1
    raise ValueError("varint is too long")


def _common(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common run of a[i:] and b[j:]: slices that double, then halve."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 64
    while step:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        else:
            step = min(step // 2, most - n) if step > 1 else 0
    return n


def _anchored(index: dict[bytes, list[tuple[int, int]]], target: bytes, block: int) -> Callable[[int, int], Sequence[int]]:
    """A function of (from, to): those places of the target, rising, whose block may be in the
    index. None that is in it is left out; first and last eight bytes are hashed all at once."""
    if block < 8 or not index:
        return range if index else lambda start, stop: []
    bits = min(MOST_BITS, max(12, (64 * len(index)).bit_length()))
    hashed = lambda head, tail: (head * FACTORS[0] ^ tail * FACTORS[1]) >> np.uint64(64 - bits)
    keys = np.frombuffer(b"".join(index), np.uint8).reshape(-1, block)
    seen = np.zeros(1 << bits, bool)
    seen[hashed(*[np.ascontiguousarray(x).view("<u8").ravel() for x in (keys[:, :8], keys[:, -8:])])] = True
    # eight bytes from each place on
    words = np.ndarray(max(0, len(target) - 7), "<u8", target, strides=(1,)) if len(target) >= 8 else np.zeros(0, "<u8")

    def may(start: int, stop: int) -> list[int]:
        return (np.flatnonzero(seen[hashed(words[start:stop], words[start + block - 8 : stop + block - 8])]) + start).tolist()

    return may


def encode(bases: Sequence[bytes], target: bytes, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """Operations that make ``target`` from ``bases``, and bytes copied from each.

    Anchors are the blocks at multiples of ``block`` in each base, keyed by
    themselves. With one base a place takes its first anchor's run; with several
    the longest run among the first MAX_ANCHORS, of equal ones that of the first
    base, then of the lowest offset.
    """
    many = len(bases) > 1
    if len(bases) > MAX_BASES or sum(map(len, bases)) > MAX_BYTES:
        raise ValueError("bases pass the bounds of a delta")
    index: dict[bytes, list[tuple[int, int]]] = {}
    for slot, base in enumerate(bases):
        for at in range(0, len(base) - block + 1, block):
            found = index.setdefault(base[at : at + block], [])
            if len(found) < (MAX_ANCHORS if many else 1):
                found.append((slot, at))
    out, copied, start, at = bytearray(), [0] * len(bases), 0, 0

    def literal(to: int) -> None:
        if to > start:
            out.append(LITERAL)
            out.extend(put_varint(to - start) + target[start:to])

    may, upto, near, i = _anchored(index, target, block), 0, [], 0
    while at + block <= len(target):
        if at >= upto:
            upto = min(at + STEP, len(target) - block + 1)
            near, i = may(at, upto), 0
        i = bisect_left(near, at, i)
        if i == len(near):
            at = upto
            continue
        at = near[i]
        found = index.get(target[at : at + block])
        if not found:
            at += 1
            continue
        n, slot, base_at = max(((_common(bases[s], o, target, at), -s, -o) for s, o in found))
        literal(at)
        if many:
            out.append(COPY_FROM)
            out.extend(put_varint(-slot))
        else:
            out.append(COPY)
        out.extend(put_varint(-base_at) + put_varint(n))
        copied[-slot] += n
        at += n
        start = at
    literal(len(target))
    return bytes(out), copied


def decode(bases: Sequence[bytes], payload: bytes, most: int = 16 << 20) -> bytes:
    """The target again; raises ValueError on anything out of bounds."""
    out, at = bytearray(), 0
    while at < len(payload):
        tag, at = payload[at], at + 1
        slot = 0
        if tag == COPY_FROM:
            slot, at = get_varint(payload, at)
        if tag == LITERAL:
            n, at = get_varint(payload, at)
            piece = payload[at : at + n]
            at += n
        elif tag in (COPY, COPY_FROM) and slot < len(bases):
            base_at, at = get_varint(payload, at)
            n, at = get_varint(payload, at)
            piece = bases[slot][base_at : base_at + n]
        else:
            raise ValueError("unknown operation or base")
        if len(piece) != n or len(out) + n > most:
            raise ValueError("operation is out of bounds")
        out += piece
    return bytes(out)


def used_bases(copied: F.Column) -> F.Column:
    """Slots that a several-base delta copies from."""
    return F.filter(F.sequence(F.lit(0), F.size(copied) - 1), lambda i: F.get(copied, i) > 0)


def _delta(bases, target) -> tuple[bytes | None, list[int] | None, str | None]:
    if bases is None or target is None or any(x is None for x in bases):
        return None, None, "null"
    try:
        return *encode([bytes(x) for x in bases], bytes(target)), None
    except ValueError as e:
        return None, None, str(e)


def deltas(pairs: DataFrame) -> DataFrame:
    """Adds ``delta`` and ``copied`` to ``pairs(bases array<binary>, target binary)``.

    A pair beyond the bounds, or with a null part, is refused in its own row: both
    are null, and ``refused`` says why; the other pairs of the query stand.
    """

    @F.pandas_udf("delta binary, copied array<long>, refused string")
    def run(bases: pd.Series, target: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_delta(*x) for x in zip(bases, target, strict=True)], columns=["delta", "copied", "refused"])

    # not deterministic, so that a filter on what comes out does not make it twice
    told = bounded(pairs, PAIR_BATCH).withColumn("__r", run.asNondeterministic()("bases", "target"))
    return told.select(*pairs.columns, "__r.*")


def _again(bases, payload) -> bytes | None:
    try:
        return None if bases is None or payload is None else decode([bytes(x) for x in bases], bytes(payload))
    except ValueError:
        return None


def restored(pairs: DataFrame) -> DataFrame:
    """Adds ``again``, the target that ``bases`` and ``delta`` give; null where there is no
    delta, or one that does not fit its bases or its bounds."""

    @F.pandas_udf("binary")
    def run(bases: pd.Series, delta: pd.Series) -> pd.Series:
        return pd.Series([_again(*x) for x in zip(bases, delta, strict=True)], dtype=object)

    return bounded(pairs, PAIR_BATCH).withColumn("again", run("bases", "delta"))


def round_trips(pairs: DataFrame) -> DataFrame:
    """``restored(deltas(pairs))`` in one pass, so that a task has one Python worker, which is
    sent the bases once."""

    @F.pandas_udf("delta binary, copied array<long>, refused string, again binary")
    def run(bases: pd.Series, target: pd.Series) -> pd.DataFrame:
        def one(b, t):
            told = _delta(b, t)
            return *told, _again(b, told[0])

        return pd.DataFrame([one(*x) for x in zip(bases, target, strict=True)], columns=["delta", "copied", "refused", "again"])

    # not deterministic, so that a filter on what comes out does not make it twice
    told = bounded(pairs, PAIR_BATCH).withColumn("__r", run.asNondeterministic()("bases", "target"))
    return told.select(*pairs.columns, "__r.*")


def weak_checksum(data: bytes) -> tuple[int, int]:
    """Rolling checksum (a, b) of a block modulo MODULUS: the sum of its bytes, and the sum
    of those sums."""
    block = np.frombuffer(data, np.uint8).astype(np.int64)
    return int(block.sum() % MODULUS), int((block * np.arange(len(block), 0, -1)).sum() % MODULUS)


def roll(state: tuple[int, int], out: int, into: int, block: int) -> tuple[int, int]:
    """The checksum one byte further: ``out`` leaves the block, ``into`` joins it."""
    a = (state[0] - out + into) % MODULUS
    return a, (state[1] - block * out + a) % MODULUS


def weak_checksums(data: bytes, block: int = BLOCK) -> np.ndarray:
    """``b << 16 | a`` of the block at every position, all at once by prefix sums."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(x) < block:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(x)])
    placed = np.concatenate([[0], np.cumsum(x * np.arange(len(x)))])
    at = np.arange(len(x) - block + 1)
    a = total[at + block] - total[at]
    b = (at + block) * a - (placed[at + block] - placed[at])
    return (b % MODULUS) << 16 | a % MODULUS


def compacted(bases: Sequence[bytes], target: bytes, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """Encodes, drops the bases that give nothing, or less than their contribution floor,
    and encodes again until none goes: the delta, and the numbers of those that stay."""
    slots = list(range(len(bases)))
    floor = least_contribution(len(target))
    while True:
        payload, copied = encode([bases[i] for i in slots], target, block)
        kept = [i for i, n in zip(slots, copied, strict=True) if n > 0 and (floor is None or n >= floor)]
        if len(kept) == len(slots) or not kept:
            return payload, slots
        slots = kept


def least_contribution(size: int) -> int | None:
    """``contribution_floor`` of one size."""
    return None if size < 1024 else max(256, size // 8) if size < 32768 else max(4096, size // 20)


def admissible(saving: F.Column, copied: F.Column, direct: F.Column, size: F.Column) -> F.Column:
    """Whether a delta is worth its dependency: what it saves and what it copies."""
    return (saving >= F.greatest(F.lit(128), F.floor(direct / 50))) & (copied >= F.floor(size / 4))


def contribution_floor(size: F.Column) -> F.Column:
    """Bytes that a base must give to a target of ``size``; null: none is enough."""
    return F.when(size < 1024, None).when(size < 32768, F.greatest(F.lit(256), F.floor(size / 8))).otherwise(F.greatest(F.lit(4096), F.floor(size / 20)))
