"""Column functions: paths, sizes, times and chunk positions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that mark text (fixed values of the format).
TEXT_EXTENSIONS = (".py", ".md", ".json", ".txt", ".toml", ".yaml", ".yml", ".sh", ".example", ".ini", ".cfg", ".csv", ".xml", ".html", ".css", ".js", ".ts")


def content(text: Column) -> Column:
    """The bytes of a text; null for null."""
    return text.cast("binary")


def sha(data: Column) -> Column:
    return F.sha2(data, 256)


def size_bucket(n: Column) -> Column:
    """Bit length less one, 0 for nothing."""
    return F.greatest(F.lit(0), F.length(F.bin(n)) - 1)


def canonical(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_fault(path: Column, max_bytes: int = 1 << 20) -> Column:
    """Why a path may not be stored, or null: the first rule that it breaks."""
    p = canonical(path)
    parts = F.split(p, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.instr(p, "\x00") > 0, "nul")
        .when(F.octet_length(p) > max_bytes, "too_long")
        .when(F.substring(p, 1, 1) == "/", "absolute")
        .when(F.exists(parts, lambda x: x.isin("", ".", "..")), "unsafe_part")
    )


def extension(path: Column) -> Column:
    """Lower-case suffix of the last part, with its dot; a leading dot is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def is_text(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def dos_date(ts: Column) -> Column:
    """16-bit date of a ZIP entry; years stay within 1980 and 2107."""
    year = F.least(F.greatest(F.year(ts), F.lit(1980)), F.lit(2107)) - 1980
    return (year * 512 + F.month(ts) * 32 + F.dayofmonth(ts)).cast("long")


def dos_time(ts: Column) -> Column:
    """16-bit time of a ZIP entry, two seconds a step."""
    return (F.hour(ts) * 2048 + F.minute(ts) * 32 + F.floor(F.second(ts) / 2)).cast("long")


def fixed_chunks(size: Column, chunk: int) -> Column:
    """Array of (seq, off, len) that tile ``size`` bytes; empty for nothing."""
    count = F.ceil(size / chunk).cast("long")
    at = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(at, lambda i: F.struct(i.alias("seq"), (i * chunk).alias("off"), F.least(F.lit(chunk).cast("long"), size - i * chunk).alias("len")))


def varint(n: Column) -> Column:
    """LEB128 bytes of a non-negative long, in hex: seven bits a byte, lowest first."""
    groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")
    digits = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.call_function("shiftright", n, i * 7) % 128 + F.when(i < groups - 1, 128).otherwise(0))
    return F.lower(F.array_join(F.transform(digits, lambda d: F.lpad(F.hex(d), 2, "0")), ""))
