"""The CRC audit of whole documents against zlib."""

import zlib

from sparkstore.operators import verify
from sparkstore.plans.queries import QUERIES


def test_documents_with_damage_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["crc_audit"](spark, sf).select("doc_id", "crc", "found").collect())
    data = {r.doc_id: (r.text or "").encode() for r in docs if r.doc_id % 10 == 0}
    assert got == sorted((i, zlib.crc32(d), zlib.crc32(d + b"!")) for i, d in data.items()) and got


def test_mismatches_against_zlib(spark):
    data = [b"", b"abc", "é漢".encode(), b"x" * 70000]
    rows = [(i, bytearray(d), c) for i, d in enumerate(data) for c in (zlib.crc32(d), zlib.crc32(d) ^ 1, None)]
    got = verify.crc_mismatches(spark.createDataFrame(rows, "i long, data binary, crc long")).collect()
    assert len(got) == 8 and all(r.found == zlib.crc32(bytes(r.data)) != r.crc for r in got)
