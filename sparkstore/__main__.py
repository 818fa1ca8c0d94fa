"""Commands on a store: python -m sparkstore COMMAND STORE ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources
from .store import Store

COMMANDS = {
    "create": ["tree"], "info": [], "list": [], "verify": [], "preflight": [], "cat": ["path"], "range": ["path", "start", "length"], "extract": ["folder"],
    "export-zip": ["target"], "update": ["tree"], "delete": ["path"], "rename": ["path", "new"], "recover-blobs": [], "compact": ["folder"], "generations": [], "children": ["path"],
}


def _flags(name: str, p: argparse.ArgumentParser) -> None:
    if name in ("create", "update"):
        p.add_argument("--reproducible", action="store_true", help="no owners, all times $SOURCE_DATE_EPOCH or 0")
        p.add_argument("--train", action="store_true", help="train a dictionary on the small files first")
        p.add_argument("--level", type=int)
    if name in ("create", "update", "extract"):
        p.add_argument("--no-metadata", action="store_true")
    if name == "extract":
        p.add_argument("--max-bytes", type=int)
        p.add_argument("--unsafe-symlinks", action="store_true")
    if name == "export-zip":
        p.add_argument("--level", type=int, default=6)
    if name in ("cat", "range"):
        p.add_argument("-o", "--output")
    if name == "recover-blobs":
        p.add_argument("--magic", default="PAR1", help="what a record begins with")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="sparkstore")
    sub = top.add_subparsers(dest="command", required=True)
    for name, more in COMMANDS.items():
        p = sub.add_parser(name)
        for a in ["store", *more]:
            p.add_argument(a, type=int if a in ("start", "length") else str)
        p.add_argument("--generation", type=int)
        _flags(name, p)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("sparkstore").getOrCreate()
    s = Store(spark, a.store, a.generation)
    try:
        return run(a, s, spark)
    except KeyError as e:
        print(f"no entry {e}", file=sys.stderr)
    except (ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
    return 2


def run(a: argparse.Namespace, s: Store, spark: SparkSession) -> int:
    if a.command in ("create", "update"):
        epoch = int(os.environ.get("SOURCE_DATE_EPOCH", "0")) * 1_000_000_000
        print(s.build(a.tree, not a.no_metadata, a.reproducible, epoch, a.level, a.train))
    elif a.command == "info":
        print(json.dumps(s.info().first().asDict(), indent=1))
    elif a.command == "generations":
        s.generations().orderBy("gen").show(truncate=False)
    elif a.command in ("list", "children"):
        for r in (s.entries() if a.command == "list" else s.children(a.path)).orderBy("path").toLocalIterator():
            print(f"{r['kind']:<8} {r['size']:>12} {r['path']}" + (f" -> {r['target']}" if r["target"] else ""))
    elif a.command in ("verify", "preflight"):
        bad = (s.verify().select("path", F.lit("hash").alias("rule")) if a.command == "verify" else s.preflight().select(F.col("subject").alias("path"), "rule")).collect()
        print("\n".join(f"{r['path']}: {r['rule']}" for r in bad) or "sound")
        return int(bool(bad))
    elif a.command in ("cat", "range"):
        row = s.read(*((a.start, a.length) if a.command == "range" else (0, None)), path=a.path).first()
        if row is None or row["data"] is None:
            raise ValueError(f"{a.path!r} is no file, or damaged")
        if a.output:
            with open(a.output, "wb") as f:
                f.write(bytes(row["data"]))
        else:
            sys.stdout.buffer.write(bytes(row["data"]))
    elif a.command == "extract":
        print(s.extract(a.folder, not a.no_metadata, a.max_bytes, a.unsafe_symlinks))
    elif a.command == "export-zip":
        print(s.export_zip(a.target, a.level))
    elif a.command == "delete":
        print(s.delete(a.path))
    elif a.command == "rename":
        print(s.rename(a.path, a.new))
    elif a.command == "recover-blobs":
        files = sources.tree(spark, a.store)
        sources.salvage(files, a.magic.encode(), 24).show(truncate=False)
    elif a.command == "compact":
        print(s.compact(a.folder))
    return 0


if __name__ == "__main__":
    sys.exit(main())
