"""Content-defined chunks: cuts hang on the bytes before them, not on offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..shared import bounded

#: Seed of the gear table, and the chunk sizes of the store.
SEED = 20_240_601
MIN_SIZE, AVG_SIZE, MAX_SIZE = 128 << 10, 512 << 10, 2 << 20
#: Positions tested at once.
BLOCK = 1 << 20

_U = np.uint64


def gear(seed: int = SEED) -> np.ndarray:
    """256 numbers of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        z = _U(seed) + np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def _zero(data: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Whether the low ``bits`` of the rolling sum are zero at each byte.

    The sum shifts by one a byte, so its low bits hang on the last ``bits`` bytes
    alone: it is put together by doubling, for all positions at once. The first
    positions of ``data`` count as if nothing came before.
    """
    h, width, tail = table[data], 1, None
    out, shift = np.zeros(len(data), _U), 0
    with np.errstate(over="ignore"):
        for bit in range(bits.bit_length()):
            if bits >> bit & 1:
                moved = h << _U(shift)
                out[shift:] += moved[: len(moved) - shift] if shift else moved
                shift += width
                tail = shift
            grown = h.copy()
            grown[width:] += h[:-width] << _U(width)
            h, width = grown, width * 2
    assert tail == bits
    return out & _U((1 << bits) - 1) == 0


def cuts(data: bytes, min_size: int = MIN_SIZE, avg_size: int = AVG_SIZE, max_size: int = MAX_SIZE, table: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of ``data``; none for nothing.

    A chunk skips ``min_size`` bytes, where the sum begins anew; up to ``avg_size``
    it ends only where one bit more is zero than the average needs, beyond at one
    less; ``max_size`` ends it in any case.
    """
    if not 0 < min_size <= avg_size <= max_size or avg_size & (avg_size - 1):
        raise ValueError("sizes must rise, the average be a power of two")
    table = gear() if table is None else table
    bits, view = avg_size.bit_length() - 1, np.frombuffer(data, np.uint8)
    out, start = [], 0
    while start < len(data):
        hard, begin = min(len(data), start + max_size), start + min_size
        end = hard
        at = begin
        while at < hard and end == hard:
            # the sum restarts at begin: only later blocks see bytes before theirs
            back = min(at - begin, bits + 1)
            stop = min(hard, at + (BLOCK if at > begin else max(2 * avg_size, 1)))
            part = view[at - back : stop]
            place = np.arange(at, stop)
            hit = np.where(place < start + avg_size, _zero(part, table, bits + 1)[back:], _zero(part, table, max(1, bits - 1))[back:])
            first = int(hit.argmax()) if hit.any() else -1
            if first >= 0:
                end = at + first + 1
                break
            at = stop
        out.append(end)
        start = end
    return out


def chunks(members: DataFrame, min_size: int = MIN_SIZE, avg_size: int = AVG_SIZE, max_size: int = MAX_SIZE, seed: int = SEED) -> DataFrame:
    """``(path, seq, off, len, sha)`` of the content-defined chunks of each member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = gear(seed)
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["data"], strict=True):
                data, off = bytes(data), 0
                for seq, end in enumerate(cuts(data, min_size, avg_size, max_size, table)):
                    out.append((path, seq, off, end - off, hashlib.sha256(data[off:end]).hexdigest()))
                    off = end
            yield pd.DataFrame(out, columns=["path", "seq", "off", "len", "sha"])

    return bounded(members.select("path", "data")).mapInPandas(run, "path string, seq long, off long, len long, sha string")
