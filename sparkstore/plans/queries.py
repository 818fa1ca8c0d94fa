"""Registered queries of the content store, and the same rows as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import content, dos_date, dos_time, extension, path_fault, canonical, sha, size_bucket, varint
from ..operators import chunking, codecs, containers, content as store, delta, extents, gate, graph, journal, packing, planning, recipes, resemblance, splice, validate, verify
from ..shared import cut

CHUNK = 4096
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The members of documents, as SQL.
DOCS = """m AS (SELECT concat_ws('/', coalesce(lang, '_'), coalesce(source, '_'), doc_id || '.txt') AS path, doc_id, lang, source,
  encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents)"""
PAGES = """p AS (SELECT regexp_replace(coalesce(url, ''), '^[a-z]+://', '') || '#' || page_id || '.html' AS path, page_id,
  encode(coalesce(html, '')) AS data, octet_length(encode(coalesce(html, '')))::BIGINT AS size FROM pages)"""
JOURNAL = """j AS (SELECT event_id AS gen, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, user_id,
  'u' || user_id || '/' || (event_id % 7) AS path, sha256(props) AS sha, length(props)::BIGINT AS size FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _journal(spark: SparkSession, sf: str) -> DataFrame:
    e = sources.table(spark, sf, "events")
    path = F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), F.col("event_id") % 7)
    return e.select(F.col("event_id").alias("gen"), F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"), "user_id", path.alias("path"), F.sha2("props", 256).alias("sha"), F.length("props").cast("long").alias("size"))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return sources.documents(spark, sf).select("path", "data", "size").unionByName(sources.pages(spark, sf).select("path", "data", "size"))


@query(f"""WITH {DOCS}, u AS (SELECT lang, sha256(data) AS sha, count(*) AS n, min(size) AS size FROM m GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS logical_files, sum(n * size)::BIGINT AS logical_bytes, count(*)::BIGINT AS unique_blobs,
  sum(size)::BIGINT AS unique_bytes, (sum(n * size) - sum(size))::BIGINT AS saved_bytes FROM u GROUP BY 1""")
def dedup_report(spark, sf):
    return store.dedup_report(sources.documents(spark, sf), "lang")


@query(f"""WITH {DOCS}, {PAGES}, b AS (SELECT path, data, size FROM m UNION ALL SELECT path, data, size FROM p),
u AS (SELECT sha256(data) AS sha, min(size) AS usize, count(*) AS refs FROM b GROUP BY 1)
SELECT row_number() OVER (ORDER BY sha) - 1 AS blob_id, sha, usize, refs::BIGINT AS refs,
  coalesce(sum(usize + 64) OVER (ORDER BY sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM u""")
def content_blob_index(spark, sf):
    return store.layout(store.intern(_both(spark, sf)))


@query(f"""WITH {DOCS} SELECT sha256(data) AS sha, min(size)::BIGINT AS usize, count(*)::BIGINT AS refs, min(path) AS first_path,
  (min(size) * (count(*) - 1))::BIGINT AS saved FROM m GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicate_groups(spark, sf):
    return store.duplicates(sources.documents(spark, sf))


#: Faults that are put into paths, by page number.
_PATHS = """v AS (SELECT page_id, CASE page_id % 9
  WHEN 0 THEN '/' || path WHEN 1 THEN replace(path, '/', '//') WHEN 2 THEN '../' || path WHEN 3 THEN replace(path, '/', chr(92))
  WHEN 4 THEN './' || path WHEN 5 THEN '' ELSE path END AS path FROM p)"""


def _paths(spark, sf):
    p, n = sources.pages(spark, sf).select("page_id", "path"), F.col("page_id") % 9
    path = F.col("path")
    fault = F.when(n == 0, F.concat(F.lit("/"), path)).when(n == 1, F.replace(path, F.lit("/"), F.lit("//"))).when(n == 2, F.concat(F.lit("../"), path))
    fault = fault.when(n == 3, F.replace(path, F.lit("/"), F.lit("\\"))).when(n == 4, F.concat(F.lit("./"), path)).when(n == 5, "").otherwise(path)
    return p.select("page_id", fault.alias("path"))


@query(f"""WITH {PAGES}, {_PATHS} SELECT page_id, replace(path, chr(92), '/') AS path FROM v
WHERE path <> '' AND left(replace(path, chr(92), '/'), 1) <> '/' AND NOT list_has_any(string_split(replace(path, chr(92), '/'), '/'), ['', '.', '..'])""")
def canonical_paths(spark, sf):
    return _paths(spark, sf).where(path_fault(F.col("path")).isNull()).select("page_id", canonical(F.col("path")).alias("path"))


@query(f"""WITH {PAGES}, {_PATHS} SELECT * FROM (SELECT page_id, CASE WHEN path = '' THEN 'empty' WHEN left(replace(path, chr(92), '/'), 1) = '/' THEN 'absolute'
  WHEN list_has_any(string_split(replace(path, chr(92), '/'), '/'), ['', '.', '..']) THEN 'unsafe_part' END AS fault FROM v) WHERE fault IS NOT NULL""")
def path_violations(spark, sf):
    return _paths(spark, sf).select("page_id", path_fault(F.col("path")).alias("fault")).where("fault IS NOT NULL")


@query(f"""WITH {DOCS}, {PAGES}, b AS (SELECT path, size FROM m UNION ALL SELECT path, size FROM p),
x AS (SELECT lower(regexp_extract(string_split(path, '/')[-1], '^\\.*[^.].*?(\\.[^.]*)$', 1)) AS ext, size FROM b),
f AS (SELECT CASE WHEN ext IN ('.py','.md','.json','.txt','.toml','.yaml','.yml','.sh','.example','.ini','.cfg','.csv','.xml','.html','.css','.js','.ts') THEN 'text' ELSE 'other' END AS family, ext, size FROM x)
SELECT coalesce(family, '*') AS family, coalesce(ext, '*') AS ext, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY ROLLUP (family, ext)""")
def extension_census(spark, sf):
    return store.extension_census(_both(spark, sf))


_CHUNKS = f"""{DOCS}, c AS (SELECT path, data, size, unnest(range(0, size, {CHUNK})) AS off FROM m),
k AS (SELECT path, (off // {CHUNK})::BIGINT AS seq, off::BIGINT AS off, least({CHUNK}, size - off)::BIGINT AS len, sha256(data[off + 1 : least(off + {CHUNK}, size)]) AS sha FROM c)"""


@query(f"WITH {_CHUNKS} SELECT * FROM k")
def fixed_chunk_map(spark, sf):
    return extents.chunk_map(sources.documents(spark, sf), CHUNK)


@query(f"""WITH {_CHUNKS}, u AS (SELECT sha, len, count(*) AS n FROM k GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS chunks, count(*)::BIGINT AS unique_chunks, sum(n * len)::BIGINT AS bytes, sum(len)::BIGINT AS unique_bytes FROM u""")
def chunk_dedup(spark, sf):
    return extents.chunk_dedup(extents.chunk_map(sources.documents(spark, sf), CHUNK))


def _requests(members: DataFrame) -> DataFrame:
    """One byte range of each member that is not empty, from its number and size."""
    start = (F.col("doc_id") * 7919) % F.col("size")
    return members.where("size > 0").select("path", start.alias("start"), F.least(F.lit(5000).cast("long"), F.col("size") - start).alias("length"))


_REQ = "q AS (SELECT path, (doc_id * 7919) % size AS start, least(5000, size - (doc_id * 7919) % size)::BIGINT AS length, data, size FROM m WHERE size > 0)"


@query(f"""WITH {DOCS}, {_REQ} SELECT path, start, length, sha256(data[start + 1 : start + length]) AS sha,
  ((start + length - 1) // {CHUNK} - start // {CHUNK} + 1)::BIGINT AS touched FROM q""")
def range_read(spark, sf):
    m = sources.documents(spark, sf)
    # the extents of one member stand in its row: a range touches them without a shuffle of payloads
    chunk = extents.fixed_chunks(F.col("size"), CHUNK)
    start, end = (F.col("doc_id") * 7919) % F.col("size"), None
    q = m.where("size > 0").withColumn("start", start).withColumn("length", F.least(F.lit(5000).cast("long"), F.col("size") - F.col("start")))
    end = F.col("start") + F.col("length")
    met = F.filter(chunk, lambda c: (c["off"] < end) & (c["off"] + c["len"] > F.col("start")))
    part = lambda c: F.substring("data", (F.greatest(c["off"], F.col("start")) + 1).cast("int"), (F.least(c["off"] + c["len"], end) - F.greatest(c["off"], F.col("start"))).cast("int"))
    whole = F.aggregate(F.transform(met, part), F.lit(b""), lambda a, b: F.concat(a, b))
    return q.select("path", "start", "length", sha(whole).alias("sha"), F.size(met).cast("long").alias("touched"))


@query(f"""WITH {_CHUNKS}, {_REQ}, t AS (SELECT q.path, k.len, least(off + len, start + length) - greatest(off, start) AS take FROM q JOIN k USING (path) WHERE off < start + length AND off + len > start)
SELECT count(*)::BIGINT AS extents, sum(len)::BIGINT AS decoded, sum(take)::BIGINT AS wanted, sum(len) / sum(take) AS ratio FROM t""")
def range_touch_ratio(spark, sf):
    m = sources.documents(spark, sf).select("path", "doc_id", "size")
    parts = m.select("path", F.inline(extents.fixed_chunks(F.col("size"), CHUNK)))
    met = extents.overlaps(parts, _requests(m), "path")
    return met.agg(F.count("*").alias("extents"), F.sum("len").alias("decoded"), F.sum("take").alias("wanted"), (F.sum("len") / F.sum("take")).alias("ratio"))


@query("""WITH t AS (SELECT conv_id, turn, encode(coalesce(text, '')) AS data FROM conversations)
SELECT conv_id, count(*)::BIGINT AS chunks, sum(octet_length(data))::BIGINT AS size, sha256(unhex(string_agg(hex(data), '' ORDER BY turn))) AS sha FROM t GROUP BY 1""")
def turn_chunk_reassembly(spark, sf):
    t = sources.table(spark, sf, "conversations").select("conv_id", "turn", content(F.coalesce("text", F.lit(""))).alias("data"))
    joined = F.expr("listagg(data, x'') WITHIN GROUP (ORDER BY turn)")
    return t.groupBy("conv_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).cast("long").alias("size"), sha(joined).alias("sha"))


_LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS len,
  (coalesce(sum(l_quantity::BIGINT + l_partkey % 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + l_partkey % 10)::BIGINT AS off FROM lineitem)"""


@query(f"""WITH {_LINES}, t AS (SELECT l_orderkey, sum(greatest(0, least(off + len, 90) - greatest(off, 10))) AS got, max(off + len) AS size FROM l GROUP BY 1)
SELECT l_orderkey, greatest(0, least(size, 90) - 10)::BIGINT AS length, got::BIGINT AS data_bytes, (greatest(0, least(size, 90) - 10) - got)::BIGINT AS zero_bytes FROM t""")
def sparse_zero_fill_range(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    hole = F.col("l_partkey") % 10
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.col("l_quantity").cast("long") + hole).over(before), F.lit(0)) + hole
    x = l.select("l_orderkey", F.col("l_quantity").cast("long").alias("len"), off.alias("off"))
    got = F.greatest(F.lit(0), F.least(F.col("off") + F.col("len"), F.lit(90)) - F.greatest("off", F.lit(10)))
    t = x.groupBy("l_orderkey").agg(F.sum(got).alias("data_bytes"), F.max(F.col("off") + F.col("len")).alias("end"))
    length = F.greatest(F.lit(0), F.least("end", F.lit(90)) - 10)
    return t.select("l_orderkey", length.cast("long").alias("length"), "data_bytes", (length - F.col("data_bytes")).cast("long").alias("zero_bytes"))


@query(f"""WITH {_LINES}, g AS (SELECT l_orderkey, off - coalesce(max(off + len) OVER (PARTITION BY l_orderkey ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hole FROM l)
SELECT l_orderkey, count(*) FILTER (hole > 0)::BIGINT AS holes, sum(greatest(hole, 0))::BIGINT AS hole_bytes, count(*) FILTER (hole < 0)::BIGINT AS overlaps FROM g GROUP BY 1""")
def sparse_extent_check(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    hole = F.col("l_partkey") % 10
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.col("l_quantity").cast("long") + hole).over(before), F.lit(0)) + hole
    g = extents.gaps(l.select("l_orderkey", F.col("l_quantity").cast("long").alias("len"), off.alias("off")), "l_orderkey")
    return g.groupBy("l_orderkey").agg(F.count_if(F.col("hole") > 0).alias("holes"), F.sum(F.greatest("hole", F.lit(0))).alias("hole_bytes"), F.count_if(F.col("hole") < 0).alias("overlaps"))


@query("""WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS len FROM conversations),
s AS (SELECT conv_id, (turn * 2)::BIGINT AS seq, 30::BIGINT AS len, 'literal' AS part FROM t UNION ALL SELECT conv_id, turn * 2 + 1, len, 'payload' FROM t
  UNION ALL SELECT conv_id, max(turn) * 2 + 2, 22, 'literal' FROM t GROUP BY 1)
SELECT conv_id, seq, len, part, coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s""")
def recipe_projection_plan(spark, sf):
    t = sources.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), F.octet_length(content(F.coalesce("text", F.lit("")))).cast("long").alias("len"))
    head = t.select("conv_id", "seq", F.lit(30).cast("long").alias("len"))
    tail = t.groupBy("conv_id").agg((F.max("seq") + 1).alias("seq"), F.lit(22).cast("long").alias("len"))
    return extents.recipe_segments(head.unionByName(tail), t, "conv_id")


@query(f"""WITH {DOCS}, b AS (SELECT doc_id, size, sha256(data) AS sha, sha256(data || encode(CASE WHEN doc_id % 10 = 0 THEN '!' ELSE '' END)) AS stored FROM m)
SELECT doc_id, size, sha FROM b WHERE sha <> stored""")
def verify_members(spark, sf):
    m = sources.documents(spark, sf)
    stored = F.when(F.col("doc_id") % 10 == 0, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))
    rows = m.select("doc_id", "size", stored.alias("data"), sha(F.col("data")).alias("declared"), F.crc32("data").alias("crc")).withColumnRenamed("declared", "sha")
    return verify.mismatches(rows).select("doc_id", "size", "sha")


@query()
def crc_audit(spark, sf):
    """All documents against a stored CRC, that of every tenth is wrong."""
    m = sources.documents(spark, sf)
    stored = F.when(F.col("doc_id") % 10 == 0, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))
    return verify.crc_mismatches(m.select("doc_id", "size", stored.alias("data"), F.crc32("data").alias("crc"))).select("doc_id", "size", "crc", "found")


@query(f"""WITH {DOCS} SELECT source, count(*)::BIGINT AS files, sha256(unhex(string_agg(lpad(hex(octet_length(encode(path))), 8, '0') || hex(encode(path)) || '46' || lpad(hex(size), 16, '0') || sha256(data), '' ORDER BY string_split(path, '/')))) AS digest FROM m GROUP BY 1""")
def tree_digest_by_source(spark, sf):
    m = sources.documents(spark, sf)
    return verify.tree_digest(m.select("source", "path", F.lit("file").alias("kind"), "size", sha(F.col("data")).alias("detail")), "source")


@query(f"""WITH {DOCS} SELECT lang, count(*)::BIGINT AS files, sha256(unhex(string_agg(lpad(hex(octet_length(encode(path))), 8, '0') || hex(encode(path)) || lpad(hex(size), 16, '0') || hex(data), '' ORDER BY string_split(path, '/')))) AS digest FROM m GROUP BY 1""")
def content_digest_by_lang(spark, sf):
    return verify.content_digest(sources.documents(spark, sf), "lang")


@query(f"""WITH RECURSIVE {DOCS}, lv AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, sha256(unhex('00' || sha256(data))) AS h FROM m
  UNION ALL SELECT lang, i // 2, (n + 1) // 2, sha256(unhex('01' || min_by(h, i) || max_by(h, i))) FROM lv WHERE n > 1 GROUP BY lang, i // 2, n)
SELECT lang, h AS root FROM lv WHERE n = 1""")
def merkle_root_by_lang(spark, sf):
    leaves = sources.documents(spark, sf).select("lang", "doc_id", sha(F.col("data")).alias("leaf"))
    return verify.merkle_roots(leaves, "lang", "doc_id")


@query(f"WITH {JOURNAL}, r AS (SELECT path, max_by(struct_pack(gen, op, sha, size), gen) AS r FROM j GROUP BY 1) SELECT path, r.gen, r.sha, r.size FROM r WHERE r.op = 'put'")
def journal_replay(spark, sf):
    return journal.replay(_journal(spark, sf))


@query(f"""WITH {JOURNAL}, x AS (SELECT max(gen) // 2 AS g FROM j), r AS (SELECT path, max_by(struct_pack(gen, op, sha, size), gen) AS r FROM j, x WHERE gen <= g GROUP BY 1)
SELECT path, r.gen, r.sha, r.size FROM r WHERE r.op = 'put'""")
def journal_as_of(spark, sf):
    j = _journal(spark, sf)
    return journal.replay(j, j.agg(F.floor(F.max("gen") / 2)).first()[0])


@query(f"""WITH {JOURNAL}, n AS (SELECT user_id, gen, row_number() OVER (PARTITION BY user_id ORDER BY gen) - 1 AS n FROM j)
SELECT user_id, gen, (n % 64)::BIGINT AS depth, n % 64 = 0 AS full FROM n""")
def journal_checkpoint_depths(spark, sf):
    return journal.checkpoints(_journal(spark, sf), "user_id")


@query(f"""WITH {JOURNAL}, n AS (SELECT user_id, gen, row_number() OVER (PARTITION BY user_id ORDER BY gen) - 1 AS n, gen % 97 <> 0 AS committed FROM j),
c AS (SELECT *, n // 16 AS chain FROM n), b AS (SELECT *, max(CASE WHEN committed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, chain ORDER BY gen) AS bad FROM c)
SELECT user_id, max(gen)::BIGINT AS gen FROM b WHERE bad = 0 GROUP BY 1""")
def recover_generation(spark, sf):
    g = journal.checkpoints(_journal(spark, sf), "user_id", depth=15).withColumn("committed", F.col("gen") % 97 != 0)
    return journal.newest_valid(g, "user_id")


@query(f"""WITH RECURSIVE {JOURNAL}, o AS (SELECT user_id, path, gen, sha, 'u' || user_id || '/' || ((gen + 3) % 7) AS new, CASE WHEN gen % 5 = 0 AND op = 'put' THEN 'ren' ELSE op END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY gen) AS i FROM j),
s AS (SELECT user_id, 0::BIGINT AS i, []::STRUCT(path VARCHAR, gen BIGINT, sha VARCHAR)[] AS live FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT s.user_id, o.i, CASE o.op WHEN 'put' THEN list_append(list_filter(live, lambda x: x.path <> o.path), struct_pack(path := o.path, gen := o.gen, sha := o.sha))
    WHEN 'del' THEN list_filter(live, lambda x: x.path <> o.path)
    ELSE list_transform(CASE WHEN len(list_filter(live, lambda x: x.path = o.path)) > 0 THEN list_filter(live, lambda x: x.path <> o.new) ELSE live END,
      lambda x: CASE WHEN x.path = o.path THEN struct_pack(path := o.new, gen := x.gen, sha := x.sha) ELSE x END) END
  FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1),
l AS (SELECT user_id, max_by(live, i) AS live FROM s GROUP BY 1), u AS (SELECT user_id, unnest(live) AS x FROM l)
SELECT user_id::VARCHAR AS user_id, x.path AS path, x.gen AS gen, x.sha AS sha FROM u""")
def journal_replay_renames(spark, sf):
    e = F.col("gen") % 5 == 0
    j = _journal(spark, sf).withColumn("new_path", F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), (F.col("gen") + 3) % 7))
    return journal.replay_renames(j.withColumn("op", F.when(e & (F.col("op") == "put"), "ren").otherwise(F.col("op"))), "user_id")


@query(f"""WITH {JOURNAL}, r AS (SELECT path, max_by(struct_pack(op, sha), gen) AS r FROM j GROUP BY 1), a AS (SELECT DISTINCT r.sha AS sha FROM r WHERE r.op = 'put'),
b AS (SELECT sha, max(size) AS size FROM j WHERE op = 'put' GROUP BY 1)
SELECT b.sha IN (SELECT sha FROM a) AS live, count(*)::BIGINT AS blobs, sum(size)::BIGINT AS bytes FROM b GROUP BY 1""")
def compact_live_blobs(spark, sf):
    j = _journal(spark, sf)
    blobs = j.where("op = 'put'").groupBy("sha").agg(F.max("size").alias("size"))
    kept = journal.compact(journal.replay(j), blobs).withColumn("live", F.lit(True))
    gone = journal.new_blobs(blobs, journal.replay(j).select("sha").distinct()).withColumn("live", F.lit(False))
    return kept.unionByName(gone).groupBy("live").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id - 1 END AS target FROM documents),
r AS (SELECT doc_id, target, 1 AS d FROM l WHERE target IS NOT NULL UNION ALL SELECT r.doc_id, l.target, d + 1 FROM r JOIN l ON l.doc_id = r.target WHERE l.target IS NOT NULL)
SELECT doc_id::VARCHAR AS path, max_by(target, d)::VARCHAR AS target FROM r GROUP BY 1""")
def hardlink_closure(spark, sf):
    d = sources.table(spark, sf, "documents").where(F.col("doc_id") % 11 != 0)
    return journal.closure(d.select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") - 1).cast("string").alias("target")))


@query("""WITH o AS (SELECT o_orderpriority AS own, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1), c AS (SELECT own FROM o ORDER BY n DESC, f LIMIT 1)
SELECT o_orderstatus, CASE WHEN o_orderpriority = own THEN 'common' ELSE o_orderpriority END AS owner, count(*)::BIGINT AS rows FROM orders, c GROUP BY 1, 2""")
def owner_modal_overlay(spark, sf):
    o = sources.table(spark, sf, "orders")
    common = store.modal_owner(o, "o_orderpriority", "o_orderkey").first()["common"]
    owner = F.when(F.col("o_orderpriority") == common, "common").otherwise(F.col("o_orderpriority"))
    return o.groupBy("o_orderstatus", owner.alias("owner")).agg(F.count("*").alias("rows"))


def _greedy_sql(items: str, by: str, limit: int) -> str:
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY size, sha) AS i FROM {items}),
g AS (SELECT {by}, sha, size, i, 0::BIGINT AS pack, 0::BIGINT AS off FROM s WHERE i = 1
  UNION ALL SELECT s.{by}, s.sha, s.size, s.i, CASE WHEN g.off + g.size + s.size > {limit} THEN g.pack + 1 ELSE g.pack END,
    CASE WHEN g.off + g.size + s.size > {limit} THEN 0 ELSE g.off + g.size END FROM g JOIN s ON s.{by} = g.{by} AND s.i = g.i + 1)"""


_SMALL = f"""{DOCS}, {PAGES}, b AS (SELECT path, data, size FROM m UNION ALL SELECT path, data, size FROM p),
x AS (SELECT lower(regexp_extract(string_split(path, '/')[-1], '^\\.*[^.].*?(\\.[^.]*)$', 1)) AS ext, sha256(data) AS sha, min(size) AS size FROM b WHERE size <= {packing.PACK_MEMBER} GROUP BY 1, 2)"""


def _small(spark, sf):
    """Small contents by the hint of their extension."""
    m = _both(spark, sf).where(F.col("size") <= packing.PACK_MEMBER)
    return cut(m.groupBy(extension(F.col("path")).alias("ext"), sha(F.col("data")).alias("sha")).agg(F.min("size").alias("size")))


@query(f"WITH RECURSIVE {_SMALL}, {_greedy_sql('x', 'ext', packing.PACK_TARGET)} SELECT ext, sha, size, pack, off FROM g")
def micro_pack_assignment(spark, sf):
    return packing.greedy(_small(spark, sf), "ext", ["size", "sha"], "size", packing.PACK_TARGET).select("ext", "sha", "size", "pack", "off")


@query(f"""WITH RECURSIVE {_SMALL}, {_greedy_sql('x', 'ext', 65536)}, k AS (SELECT ext, pack, sum(size) AS bytes, count(*) AS n, sum(greatest(1, size)) AS w, min(greatest(1, size)) AS l FROM g GROUP BY 1, 2)
SELECT ext, count(*)::BIGINT AS packs, sum(bytes * n)::BIGINT AS decoded, sum(bytes * n) / sum(w) AS amplification, max(bytes / l) AS worst FROM k GROUP BY 1""")
def pack_read_amplification(spark, sf):
    return packing.amplification(packing.greedy(_small(spark, sf), "ext", ["size", "sha"], "size", 65536), ["ext"], "size")


_LIMITS = [n * 1024 for n in (64, 128, 256, 512, 1024, 2048)]


def _plans(spark, sf):
    """Costs of all members packed in the order of likeness, at each limit, and apart."""
    d = sources.documents(spark, sf)
    keys = resemblance.similarity_order(resemblance.sketches(_nodes(spark, sf)))
    rows = cut(d.select("lang", F.col("doc_id").alias("id"), "size").join(keys, "id"))
    plans = packing.independent(rows, "lang", "size")
    for n in _LIMITS:
        k = packing.greedy(rows, "lang", ["key", "id"], "size", n).groupBy("lang", "pack").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), F.col("size"))).alias("w"))
        plans = plans.unionByName(k.groupBy("lang").agg(F.lit(n).cast("long").alias("plan_limit"), F.sum(F.col("bytes") + 64).cast("long").alias("cost"), (F.sum(F.col("bytes") * F.col("n")) / F.sum("w")).alias("amplification")))
    return plans


@query(f"""WITH {_LINES}, o AS (SELECT l_orderkey, off, len, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l)
SELECT l_orderkey, bool_and(b = off) AND max(off + len) = sum(len) AS dense, count(*)::BIGINT AS members FROM o GROUP BY 1""")
def implicit_pack_index(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    hole = F.col("l_partkey") % 10
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.col("l_quantity").cast("long") + hole).over(before), F.lit(0)) + hole
    return packing.dense(l.select("l_orderkey", F.col("l_quantity").cast("long").alias("len"), off.alias("off")), "l_orderkey")


def _nodes(spark, sf):
    d = sources.documents(spark, sf)
    return d.select(F.col("doc_id").alias("id"), "data", "size")


_SKETCH = f"""{DOCS}, r AS (SELECT doc_id AS id, data, size, greatest(64, (size + 7) // 8) AS region FROM m),
bd AS (SELECT *, unnest(range(8)) AS band FROM r),
se AS (SELECT *, least(size, region * band) AS st, CASE WHEN band = 7 THEN size ELSE least(size, region * (band + 1)) END AS en FROM bd),
sh AS (SELECT id, size, band, st, en, data, unnest(CASE WHEN st >= en THEN [NULL] ELSE range(st, greatest(st, en - 64) + 1, 32) END) AS pos FROM se),
k AS (SELECT id, size, greatest(0, length(bin(size)) - 1)::BIGINT AS size_bucket, band::INT AS band, coalesce(min(left(sha256(data[pos + 1 : least(en, pos + 64)]), 16)), repeat('0', 16)) AS feature FROM sh GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_SKETCH} SELECT * FROM k")
def similarity_sketches(spark, sf):
    return resemblance.sketches(_nodes(spark, sf))


def _lsh_sql(rows: str, key: str, on: str) -> str:
    return f"""pr AS (SELECT t.id AS target, b.id AS base, row_number() OVER (PARTITION BY t.id, {key}, b.size_bucket ORDER BY b.id DESC) AS r
  FROM {rows} t JOIN {rows} b ON {on} AND abs(t.size_bucket - b.size_bucket) <= 1 AND b.id < t.id),
c AS (SELECT target, base, count(*) AS shared FROM pr WHERE r <= 48 GROUP BY 1, 2)"""


@query(f"""WITH {_SKETCH}, {_lsh_sql('k', 't.band, t.feature', 't.band = b.band AND t.feature = b.feature')},
n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY shared DESC, base) AS n FROM c) SELECT target, base, shared::BIGINT AS shared FROM n WHERE n <= 8""")
def lsh_candidate_edges(spark, sf):
    return resemblance.candidates(cut(resemblance.sketches(_nodes(spark, sf))))


@query(f"""WITH {_SKETCH}, z AS (SELECT DISTINCT id, size_bucket, feature FROM k WHERE feature <> repeat('0', 16)), {_lsh_sql('z', 't.feature', 't.feature = b.feature')},
n AS (SELECT c.*, row_number() OVER (PARTITION BY target ORDER BY shared DESC, abs(a.size - b.size), base) AS n FROM c JOIN m a ON a.doc_id = target JOIN m b ON b.doc_id = base)
SELECT target, base, shared::BIGINT AS shared FROM n WHERE n <= 16""")
def lsh_position_independent(spark, sf):
    return resemblance.moved_candidates(cut(resemblance.sketches(_nodes(spark, sf))))


@query(f"WITH {_SKETCH} SELECT id, lpad(size_bucket::VARCHAR, 3, '0') || ':' || string_agg(feature, '' ORDER BY band) AS key FROM k GROUP BY id, size_bucket")
def similarity_order(spark, sf):
    return resemblance.similarity_order(resemblance.sketches(_nodes(spark, sf)))


_PLANS = (
    _SKETCH
    + """, o AS (SELECT id, lpad(size_bucket::VARCHAR, 3, '0') || ':' || string_agg(feature, '' ORDER BY band) AS key FROM k GROUP BY id, size_bucket),
q AS (SELECT lang, id, size, row_number() OVER (PARTITION BY lang ORDER BY key, id) AS i FROM o JOIN m ON doc_id = id)"""
    + "".join(
        f""", g{n} AS (SELECT lang, size, i, 0::BIGINT AS pack, 0::BIGINT AS off FROM q WHERE i = 1 UNION ALL SELECT q.lang, q.size, q.i,
  CASE WHEN g.off + g.size + q.size > {n} THEN g.pack + 1 ELSE g.pack END, CASE WHEN g.off + g.size + q.size > {n} THEN 0 ELSE g.off + g.size END
  FROM g{n} g JOIN q ON q.lang IS NOT DISTINCT FROM g.lang AND q.i = g.i + 1)"""
        for n in _LIMITS
    )
    + f""", kk AS ({" UNION ALL ".join(f"SELECT {n} AS lim, lang, pack, sum(size) AS bytes, count(*) AS n, sum(greatest(1, size)) AS w FROM g{n} GROUP BY 2, 3" for n in _LIMITS)}),
t AS (SELECT lang, lim, sum(bytes + 64) AS cost, sum(bytes * n) / sum(w) AS amp FROM kk GROUP BY 1, 2 UNION ALL SELECT lang, 0, sum(size + 64), 1.0 FROM q GROUP BY 1),
b AS (SELECT lang, arg_min(struct_pack(lim, cost, amp), struct_pack(o := amp > 8, cost, amp, lim)) AS b, arg_min(struct_pack(lim, cost, amp), lim) FILTER (lim = 524288 AND amp <= 8) AS u FROM t GROUP BY 1),
c AS (SELECT lang, CASE WHEN b.amp <= 8 AND b.lim > 524288 AND u IS NOT NULL AND u.cost - b.cost < greatest(1024, u.cost // 1000) THEN u ELSE b END AS c FROM b)
SELECT lang, c.lim::BIGINT AS plan_limit, c.cost::BIGINT AS cost, c.amp AS amplification, c.amp <= 8 AS feasible FROM c"""
)


@query(f"WITH RECURSIVE {_PLANS}")
def pack_plan_choice(spark, sf):
    return packing.choose(_plans(spark, sf), "lang", strict=True)


def _measured(spark, sf, made=delta.deltas):
    """Candidate edges with their deltas: ``(target, base, bases, data, delta, copied, refused)``, and
    what else ``made`` adds."""
    nodes = _nodes(spark, sf)
    edges = resemblance.candidates(cut(resemblance.sketches(nodes)))
    t, b = nodes.select(F.col("id").alias("target"), "data"), nodes.select(F.col("id").alias("base"), F.array("data").alias("bases"))
    pairs = edges.join(t, "target").join(b, "base").select(F.col("target").alias("id"), "base", "bases", F.col("data").alias("target"))
    return made(pairs).withColumnRenamed("target", "data").withColumnRenamed("id", "target")


_EDGES = _SKETCH + """, pr AS (SELECT t.id AS target, b.id AS base, row_number() OVER (PARTITION BY t.id, t.band, t.feature, b.size_bucket ORDER BY b.id DESC) AS r
  FROM k t JOIN k b ON t.band = b.band AND t.feature = b.feature AND abs(t.size_bucket - b.size_bucket) <= 1 AND b.id < t.id),
c AS (SELECT target, base, count(*) AS shared FROM pr WHERE r <= 48 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY shared DESC, base) AS n FROM c), ed AS (SELECT target, base FROM n WHERE n <= 8)"""


@query(f"WITH {_EDGES} SELECT target, base, size, sha256(data) AS sha, true AS bounded FROM ed JOIN m ON doc_id = target")
def delta_roundtrip(spark, sf):
    """Each candidate edge's target, made again from its base and the delta: size and hash are
    those of what came out. A delta is never longer than its target by more than its frame."""
    told = _measured(spark, sf, delta.round_trips)
    return told.select("target", "base", F.octet_length("again").cast("long").alias("size"), sha(F.col("again")).alias("sha"), (F.octet_length("delta") <= F.octet_length("data") + 11).alias("bounded"))


@query()
def delta_bytes(spark, sf):
    told = _measured(spark, sf, delta.round_trips)
    return told.select("target", "base", F.octet_length("delta").cast("long").alias("delta_bytes"), F.get("copied", F.lit(0)).alias("copied"), (F.col("again") == F.col("data")).alias("equal"))


@query()
def mosaic_roundtrip(spark, sf):
    nodes = _nodes(spark, sf)
    edges = resemblance.moved_candidates(cut(resemblance.sketches(nodes)))
    line = Window.partitionBy("target").orderBy(F.desc("shared"), "base")
    few = edges.withColumn("slot", F.row_number().over(line)).where(F.col("slot") <= delta.MAX_BASES)
    given = few.join(nodes.select(F.col("id").alias("base"), "data"), "base").groupBy("target").agg(F.sort_array(F.collect_list(F.struct("slot", "data"))).alias("b")).where(F.size("b") > 1)
    pairs = given.join(nodes.select(F.col("id").alias("target"), F.col("data").alias("own")), "target").select(F.col("target").alias("id"), F.transform("b", lambda x: x["data"]).alias("bases"), F.col("own").alias("target"))
    told = delta.round_trips(pairs)
    return told.select("id", F.size("bases").cast("long").alias("bases"), F.size(delta.used_bases(F.col("copied"))).cast("long").alias("used"), F.octet_length("delta").cast("long").alias("delta_bytes"), (F.col("again") == F.col("target")).alias("equal"))


@query()
def central_bases(spark, sf):
    size = F.octet_length("data").cast("long")
    edges = cut(_measured(spark, sf).select("target", "base", (size - F.octet_length("delta")).alias("saving"), F.get("copied", F.lit(0)).alias("copied"), size.alias("size")).where(delta.admissible(F.col("saving"), F.col("copied"), F.col("size"), F.col("size"))))
    return resemblance.central_bases(edges)


_CHOICE = """e AS (SELECT o_orderkey % 997 + 2000 AS target, o_custkey % 300 AS base, max(floor(o_totalprice)::BIGINT % 1000 + 1) AS saving FROM orders GROUP BY 1, 2)"""


@query(f"""WITH {_CHOICE} SELECT target, arg_min(base, struct_pack(s := -saving, w := -w, base)) AS base, max(saving) AS saving FROM e JOIN (SELECT base, sum(saving) AS w FROM e GROUP BY 1) USING (base) GROUP BY 1""")
def base_choice(spark, sf):
    """Bases that are no targets: each target takes the one that saves most on it."""
    o = sources.table(spark, sf, "orders")
    e = o.select((F.col("o_orderkey") % 997 + 2000).alias("target"), (F.col("o_custkey") % 300).alias("base"), (F.floor("o_totalprice") % 1000 + 1).alias("saving"))
    return resemblance.central_bases(e)


@query()
def codec_tournament(spark, sf):
    m = sources.documents(spark, sf).select("path", sha(F.col("data")).alias("sha"), "data")
    # of equal contents the first path's: chosen by hashes, so that payloads stay where they are
    first = m.groupBy("sha").agg(F.min("path").alias("path"))
    return codecs.tournament(codecs.trials(m.join(first, ["sha", "path"], "left_semi")))


_PLACES = """w AS (SELECT item_id, text, length(text) AS n FROM benchmark WHERE length(text) >= 32),
f AS (SELECT d.doc_id, w.item_id, w.n, unnest(list_filter(range(0, length(d.text) - w.n + 1), lambda i: d.text[i + 1 : i + w.n] = w.text)) AS "at" FROM documents d JOIN w ON contains(d.text, w.text))"""


def _kids(spark, sf):
    return sources.table(spark, sf, "benchmark").where(F.length("text") >= 32).select("item_id", F.col("text").alias("kid"))


@query(f'WITH {_PLACES} SELECT doc_id, item_id, "at"::BIGINT AS "at" FROM f')
def splice_containment(spark, sf):
    return splice.contained(sources.table(spark, sf, "documents").select("doc_id", "text"), _kids(spark, sf))


@query(f"""WITH RECURSIVE {_PLACES}, o AS (SELECT doc_id, item_id, "at", n, row_number() OVER (PARTITION BY doc_id ORDER BY "at", n DESC, item_id) AS i FROM f),
g AS (SELECT doc_id, item_id, "at", n, i, "at" + n AS fin, true AS taken FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.item_id, o."at", o.n, o.i,
  CASE WHEN o."at" >= g.fin THEN o."at" + o.n ELSE g.fin END, o."at" >= g.fin FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS whole FROM g WHERE taken)
SELECT doc_id, item_id, "at"::BIGINT AS "at", n::BIGINT AS len FROM t WHERE whole >= 200""")
def spliced_spans(spark, sf):
    kids = _kids(spark, sf)
    found = splice.contained(sources.table(spark, sf, "documents").select("doc_id", "text"), kids)
    return splice.spliced(found, kids.select("item_id", F.length("kid").alias("len")), 200)


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderkey % 23 AS f FROM orders)
SELECT rule, subject, 1::BIGINT AS n FROM (
  SELECT 'path_unsafe' AS rule, '/o' || k AS subject, f FROM e WHERE f = 1
  UNION ALL SELECT 'size_negative', 'o' || k, f FROM e WHERE f = 2
  UNION ALL SELECT 'codec_unknown', k::VARCHAR, f FROM e WHERE f = 3
  UNION ALL SELECT 'extent_gap', 'o' || k, f FROM e WHERE f = 4
  UNION ALL SELECT 'extent_total', 'o' || k, f FROM e WHERE f IN (2, 5)
  UNION ALL SELECT 'blob_missing', 'o' || k, f FROM e WHERE f = 6
  UNION ALL SELECT 'slice_outside', 'o' || k, f FROM e WHERE f = 7
  UNION ALL SELECT 'hardlink_missing', 'o' || k, f FROM e WHERE f = 8
  UNION ALL SELECT 'raw_size', k::VARCHAR, f FROM e WHERE f = 9) WHERE NOT (rule = 'extent_total' AND f = 2)""")
def preflight_violations(spark, sf):
    """A sound catalog of one entry an order, broken by order number."""
    e = sources.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 23).alias("f"))
    path = F.concat(F.when(F.col("f") == 1, "/o").otherwise("o"), F.col("k"))
    entries = e.select(path.alias("path"), F.when(F.col("f") == 8, validate.HARDLINK).otherwise(validate.FILE).alias("kind"), F.when(F.col("f") == 2, -1).when(F.col("f") == 5, 99).otherwise(100).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), F.lit("nowhere").alias("link_target"))
    blobs = e.where("f != 6").select(F.col("k").alias("blob_id"), F.lit(100).cast("long").alias("usize"), F.when(F.col("f") == 9, 50).otherwise(100).cast("long").alias("csize"), F.when(F.col("f") == 3, 9).otherwise(0).cast("long").alias("codec"))
    parts = e.where("f NOT IN (8)").select(path.alias("path"), F.lit(0).cast("long").alias("seq"), F.when(F.col("f") == 4, 1).otherwise(0).cast("long").alias("off"), F.lit(100).cast("long").alias("len"), F.col("k").alias("blob_id"), F.when(F.col("f") == 7, 1).otherwise(0).cast("long").alias("blob_off"))
    return validate.violations(entries, blobs, parts)


@query("""SELECT o_orderkey, ((least(greatest(year(o_orderdate), 1980), 2107) - 1980) * 512 + month(o_orderdate) * 32 + day(o_orderdate))::BIGINT AS dos_date,
  (hour(o_orderdate) * 2048 + minute(o_orderdate) * 32 + second(o_orderdate) // 2)::BIGINT AS dos_time FROM orders""")
def dos_timestamps(spark, sf):
    return sources.table(spark, sf, "orders").select("o_orderkey", dos_date(F.col("o_orderdate")).alias("dos_date"), dos_time(F.col("o_orderdate")).alias("dos_time"))


_RUNS = """r AS (SELECT p_brand AS corpus, p_size % 4 AS run, p_type AS layer, p_retailprice / 100 AS seconds, length(p_brand)::BIGINT * 10 AS bytes FROM part)"""


def _runs(spark, sf):
    return sources.table(spark, sf, "part").select(F.col("p_brand").alias("corpus"), (F.col("p_size") % 4).alias("run"), F.col("p_type").alias("layer"), (F.col("p_retailprice") / 100).alias("seconds"), (F.length("p_brand") * 10).cast("long").alias("bytes"))


@query(f"""WITH {_RUNS}, e AS (SELECT corpus, layer, run, median(seconds) AS m, min(bytes) AS lo, max(bytes) AS hi FROM r GROUP BY 1, 2, 3)
SELECT corpus, layer, median(m) AS seconds, min(lo)::BIGINT AS bytes, min(lo) = max(hi) AS stable FROM e GROUP BY 1, 2""")
def run_medians(spark, sf):
    return gate.medians(_runs(spark, sf), ["corpus", "layer"])


@query(f"""WITH {_RUNS}, a AS (SELECT corpus, layer, median(seconds) AS s, min(bytes) AS b FROM r WHERE run < 2 GROUP BY 1, 2), c AS (SELECT corpus, layer, median(seconds) AS s, min(bytes) AS b FROM r WHERE run >= 2 GROUP BY 1, 2)
SELECT corpus, layer, a.b::BIGINT AS b0, c.b::BIGINT AS b1, CASE WHEN a.b IS NULL OR c.b IS NULL THEN 'missing' WHEN c.b > a.b THEN 'fail'
  WHEN c.s - a.s > a.s * 0.05 AND (c.s - a.s) * 1000 > 3 THEN 'fail' WHEN c.b < a.b OR c.s < a.s THEN 'improved' WHEN c.s > a.s THEN 'observed' ELSE 'pass' END AS verdict
FROM a FULL JOIN c USING (corpus, layer)""")
def release_gate(spark, sf):
    r = _runs(spark, sf)
    side = lambda c: r.where(c).groupBy("corpus", "layer").agg(F.median("seconds").alias("seconds"), F.min("bytes").alias("bytes"))
    return gate.verdicts(side("run < 2"), side("run >= 2"), ["corpus", "layer"])


@query("""SELECT event_id, greatest(0, length(bin(event_id)) - 1)::BIGINT AS bucket, CASE WHEN event_id < 128 THEN lower(lpad(hex(event_id), 2, '0'))
  WHEN event_id < 16384 THEN lower(lpad(hex(event_id % 128 + 128), 2, '0') || lpad(hex(event_id // 128), 2, '0'))
  ELSE lower(lpad(hex(event_id % 128 + 128), 2, '0') || lpad(hex(event_id // 128 % 128 + 128), 2, '0') || lpad(hex(event_id // 16384), 2, '0')) END AS varint FROM events""")
def varint_and_buckets(spark, sf):
    return sources.table(spark, sf, "events").select("event_id", size_bucket(F.col("event_id")).cast("long").alias("bucket"), varint(F.col("event_id")).alias("varint"))


def _gear_sql() -> str:
    return "[" + ", ".join(f"{int(x) & (1 << 34) - 1}" for x in chunking.gear()) + "]::UBIGINT[]"


#: The rolling sum at a byte hangs on the bytes back to the start of its window, and only its low bits count.
_CUTS = f"""WITH RECURSIVE g AS (SELECT {_gear_sql()} AS t), {DOCS}, d AS (SELECT path, data, size FROM m WHERE size <= 3000),
b AS (SELECT path, i, t[('0x' || hex(data[i + 1 : i + 1]))::INT + 1] AS v FROM (SELECT path, data, unnest(range(0, size)) AS i FROM d), g),
h AS (SELECT x.path, x.i, list(x.v ORDER BY x.i) OVER (PARTITION BY x.path ORDER BY x.i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS vs FROM b x),
s AS (SELECT path, list(struct_pack(i, vs) ORDER BY i) AS hs FROM h GROUP BY 1),
c AS (SELECT path, size, data, hs, 0::BIGINT AS off, -1::BIGINT AS seq, 0::BIGINT AS len FROM d LEFT JOIN s USING (path)
  UNION ALL SELECT path, size, data, hs, off + len, seq + 1, coalesce(
    list_min(list_transform(list_filter(range(off + len + 64, least(size, off + len + 1024)), lambda i:
      (list_sum(list_transform(range(1, least(9, i - off - len - 64 + 1) + 1), lambda k: (hs[i + 1].vs[-k] * (1::UBIGINT << (k - 1)::UBIGINT)) % 512)) % CASE WHEN i < off + len + 256 THEN 512 ELSE 128 END) = 0),
      lambda i: i + 1)), least(size, off + len + 1024)) - off - len FROM c WHERE off + len < size)"""


@query(f"{_CUTS} SELECT path, seq, off, len, sha256(data[off + 1 : off + len]) AS sha FROM c WHERE seq >= 0")
def content_defined_chunks(spark, sf):
    """Chunks of 64, 256 and 1,024 bytes of the shorter members: a chunk's end hangs on the bytes before it."""
    m = sources.documents(spark, sf).where("size <= 3000")
    return chunking.chunks(m, 64, 256, 1024)


@query(f"WITH {DOCS} SELECT path, size, sha256(data) AS sha, true AS tiles FROM m")
def chunks_tile_members(spark, sf):
    """Content-defined chunks of 256, 1,024 and 8,192 bytes; each member is made of its own."""
    m = sources.documents(spark, sf)
    c = chunking.chunks(m, 256, 1024, 8192)
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fits = c.withColumn("fits", F.coalesce(F.sum("len").over(before), F.lit(0)) == F.col("off"))
    made = fits.groupBy("path").agg(F.sum("len").alias("total"), F.every((F.col("fits")) & (F.col("len") <= 8192)).alias("ok"))
    told = m.select("path", "size", sha(F.col("data")).alias("sha")).join(made, "path", "left")
    return told.select("path", "size", "sha", ((F.coalesce("total", F.lit(0)) == F.col("size")) & F.coalesce("ok", F.lit(True))).alias("tiles"))


@query()
def zip_export_plan(spark, sf):
    return recipes.export_plan(sources.documents(spark, sf))


@query(f"WITH {DOCS} SELECT count(*)::BIGINT AS entries, sum(size)::BIGINT AS bytes, count(DISTINCT source)::BIGINT AS owners FROM m")
def store_info(spark, sf):
    m = sources.documents(spark, sf)
    return m.agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.countDistinct("source").alias("owners"))


_FIRST = "(SELECT min(lang) AS l FROM documents)"


@query(f"""WITH {DOCS} SELECT path, size, len(string_split(path, '/')) = 2 AS child FROM m, {_FIRST} WHERE starts_with(path, l || '/')""")
def list_children(spark, sf):
    """Files anywhere below the first language's directory, and which are right below it."""
    m = sources.documents(spark, sf).select("path", "size")
    at = sources.table(spark, sf, "documents").agg(F.min("lang")).first()[0]
    own = sources.children(m, at).select("path", F.lit(True).alias("child"))
    return sources.descendants(m, at).join(own, "path", "left").select("path", "size", F.coalesce("child", F.lit(False)).alias("child"))


_PROGRAMS = """p0 AS (SELECT l_partkey AS base, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS target, (l_quantity * 10)::BIGINT AS raw, 300 + l_orderkey % 700 AS target_len FROM lineitem)"""


def _programs(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    return l.select(F.col("l_partkey").alias("base"), n.cast("long").alias("target"), (F.col("l_quantity") * 10).cast("long").alias("raw"), (F.col("l_orderkey") % 700 + 300).alias("target_len"))


@query(f"""WITH RECURSIVE {_PROGRAMS}, g AS (SELECT base, target, raw, target_len, 0::BIGINT AS pack, raw AS used, target_len::DOUBLE AS least FROM p0 WHERE target = 1
  UNION ALL SELECT p.base, p.target, p.raw, p.target_len, CASE WHEN g.used + p.raw > 4096 OR (g.used + p.raw) / least(g.least, p.target_len) > 2 THEN pack + 1 ELSE pack END,
    CASE WHEN g.used + p.raw > 4096 OR (g.used + p.raw) / least(g.least, p.target_len) > 2 THEN p.raw ELSE g.used + p.raw END,
    CASE WHEN g.used + p.raw > 4096 OR (g.used + p.raw) / least(g.least, p.target_len) > 2 THEN p.target_len ELSE least(g.least, p.target_len) END
  FROM g JOIN p0 p ON p.base = g.base AND p.target = g.target + 1)
SELECT base, target, raw, target_len, pack FROM g""")
def residual_pack_plan(spark, sf):
    return planning.residual_packs(_programs(spark, sf), 4096)


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS target, l_suppkey % 40 AS pack, (l_suppkey % 40 + 1) * 100 AS pack_bytes FROM lineitem)
SELECT target, (sum(pack_bytes) + 50) / 1000 AS amplification, count(*)::BIGINT AS packs FROM r GROUP BY 1""")
def mosaic_read_amplification(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    recipes_ = l.select(F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("base"), F.lit(50).alias("delta_len"), F.lit(1000).alias("target_len"))
    s = sources.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return planning.mosaic_amplification(recipes_, s.withColumn("pack", F.col("id") % 40).withColumn("pack_bytes", (F.col("pack") + 1) * 100))


@query("""WITH r AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, floor(o_totalprice)::BIGINT AS bytes, floor(o_totalprice / 3)::BIGINT + 1 AS least FROM orders)
SELECT a.g, a.pos::BIGINT AS pos, b.pos::BIGINT AS pos2, (a.bytes + b.bytes)::BIGINT AS total FROM r a JOIN r b ON a.g = b.g AND b.pos - a.pos BETWEEN 1 AND 8
WHERE a.bytes + b.bytes <= 2097152 AND (a.bytes + b.bytes) / least(a.least, b.least) <= 8""")
def pair_fusion_candidates(spark, sf):
    o = sources.table(spark, sf, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    near = lambda c: F.floor(c).cast("long")
    return planning.fusion_candidates(o.select(F.col("o_custkey").alias("g"), n.alias("pos"), near(F.col("o_totalprice")).alias("bytes"), (near(F.col("o_totalprice") / 3) + 1).alias("least")), "g")


@query("""WITH p AS (SELECT l_returnflag || l_linestatus AS corpus, 'p' || l_linenumber % 3 AS plan, sum(l_suppkey % 7)::BIGINT AS bytes FROM lineitem GROUP BY 1, 2)
SELECT corpus, arg_min(plan, struct_pack(bytes, n := plan <> 'p1', plan)) AS plan, min(bytes) AS bytes FROM p GROUP BY 1""")
def plan_portfolio(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    p = l.groupBy(F.concat("l_returnflag", "l_linestatus").alias("corpus"), F.concat(F.lit("p"), F.col("l_linenumber") % 3).alias("plan")).agg(F.sum(F.col("l_suppkey") % 7).alias("bytes"))
    return planning.portfolio(p, "corpus", "p1")


@query("""WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS len FROM conversations),
o AS (SELECT conv_id, turn, len, coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN conv_id % 5 = 0 THEN turn % 2 ELSE 0 END AS off FROM t)
SELECT conv_id, NOT (conv_id % 5 = 0 AND count(*) > 1) AND min(len) > 0 AS whole FROM o GROUP BY 1""")
def projection_coverage(spark, sf):
    t = sources.table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length(content(F.coalesce("text", F.lit("")))).cast("long").alias("len"))
    o = extents.offsets(t, "conv_id", "turn", "len")
    size = F.sum("len").over(Window.partitionBy("conv_id"))
    return planning.coverage(o.withColumn("size", size).withColumn("off", F.col("off") + F.when(F.col("conv_id") % 5 == 0, F.col("turn") % 2).otherwise(0)), "conv_id", "size")


@query("""WITH e AS (SELECT l_orderkey % 1000 AS target, l_partkey % 300 + 900 AS base FROM lineitem)
SELECT DISTINCT target, 'base_not_direct' AS fault FROM e WHERE base IN (SELECT target FROM e)
UNION SELECT target, 'base_twice' FROM e GROUP BY target, base HAVING count(*) > 1
UNION SELECT target, 'too_many_bases' FROM e GROUP BY target HAVING count(DISTINCT base) > 4""")
def depth_violations(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    return planning.depth_faults(l.select((F.col("l_orderkey") % 1000).alias("target"), (F.col("l_partkey") % 300 + 900).alias("base")))


@query("""SELECT p_partkey, CASE WHEN p_size * 20 + 32 < p_partkey % 900 * 0.92 THEN 2 WHEN p_size * 22 + 16 < p_partkey % 900 THEN 3 WHEN p_size * 21 + 16 < p_partkey % 900 THEN 1 ELSE 0 END::BIGINT AS codec FROM part""")
def update_codec_rule(spark, sf):
    n = F.col("p_size")
    p = sources.table(spark, sf, "part").select("p_partkey", (n * 20).alias("audio"), (n * 22).alias("dict"), (n * 21).alias("plain"), (F.col("p_partkey") % 900).alias("raw"))
    return planning.update_codec(p).select("p_partkey", "codec")


@query("""WITH c AS (SELECT c_custkey AS k, 'd' || c_custkey % 50 || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/f' || c_custkey END AS path,
  CASE WHEN c_custkey % 2 = 0 THEN 'symlink' ELSE 'file' END AS kind, CASE c_custkey % 7 WHEN 1 THEN '/etc' WHEN 2 THEN '../x' ELSE 'ok' END AS target FROM customer)
SELECT path, 'target' AS fault FROM c WHERE kind = 'symlink' AND target IN ('/etc', '../x')
UNION ALL SELECT path, 'parent' FROM c WHERE kind = 'symlink' AND path IN (SELECT string_split(path, '/')[1] FROM c WHERE contains(path, '/'))""")
def unsafe_symlinks(spark, sf):
    k = F.col("c_custkey")
    path = F.concat(F.lit("d"), k % 50, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/f"), k)))
    target = F.when(k % 7 == 1, "/etc").when(k % 7 == 2, "../x").otherwise("ok")
    c = sources.table(spark, sf, "customer").select(path.alias("path"), F.when(k % 2 == 0, "symlink").otherwise("file").alias("kind"), target.alias("target"))
    return planning.unsafe_links(c)


_LISTING = """ls AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN '.h' ELSE '_d' || c_nationkey END || '/' || CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE '' END || c_custkey AS path,
  ['f', 'f', 'f', 'f', 'd', 'l', 'o'][c_custkey % 7 + 1] AS mode, c_custkey % 2 AS dev, c_custkey % 400 AS ino FROM customer)"""


def _listing(spark, sf):
    k = F.col("c_custkey")
    path = F.concat(F.when(k % 10 == 0, ".h").otherwise(F.concat(F.lit("_d"), "c_nationkey")), F.lit("/"), F.when(k % 3 == 0, ".").otherwise(""), k)
    mode = F.get(F.array(*map(F.lit, "ffffdlo")), (k % 7).cast("int"))
    return sources.table(spark, sf, "customer").select(path.alias("path"), mode.alias("mode"), (k % 2).alias("dev"), (k % 400).alias("ino"), k.alias("size"), k.alias("uid"))


@query(f"""WITH {_LISTING}, f AS (SELECT *, first_value(path) OVER (PARTITION BY dev, ino ORDER BY string_split(path, '/')) AS t FROM ls WHERE mode = 'f')
SELECT path, CASE WHEN t = path THEN 'file' ELSE 'hardlink' END AS kind, CASE WHEN t <> path THEN t END AS target, k AS size FROM f
UNION ALL SELECT path, CASE mode WHEN 'd' THEN 'dir' ELSE 'symlink' END, NULL, k FROM ls WHERE mode IN ('d', 'l')""")
def tree_scan(spark, sf):
    """Kinds of a listing with hidden names: a later path of an inode is a link to the first."""
    return sources.classify(_listing(spark, sf)).select("path", "kind", "target", "size")


_TREE = """e AS (SELECT 'd' || c_custkey % 50 || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/f' || c_custkey END AS path,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'symlink' ELSE 'dir' END ELSE ['file', 'file', 'symlink', 'hardlink'][c_custkey % 4 + 1] END AS kind,
  CASE c_custkey % 7 WHEN 1 THEN '/etc' WHEN 2 THEN '../x' ELSE 'ok' END AS target, c_custkey AS size FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey <= 150)"""


def _tree(spark, sf):
    k = F.col("c_custkey")
    path = F.concat(F.lit("d"), k % 50, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/f"), k)))
    kind = F.when(k % 3 == 0, F.when(k % 2 == 0, "symlink").otherwise("dir")).otherwise(F.get(F.array(*map(F.lit, ("file", "file", "symlink", "hardlink"))), (k % 4).cast("int")))
    target = F.when(k % 7 == 1, "/etc").when(k % 7 == 2, "../x").otherwise("ok")
    return sources.table(spark, sf, "customer").where((k % 3 != 0) | (k <= 150)).select(path.alias("path"), kind.alias("kind"), target.alias("target"), k.alias("size"))


@query(f"""WITH {_TREE}, u AS (SELECT path FROM e WHERE kind = 'symlink' AND target IN ('/etc', '../x') UNION SELECT path FROM e WHERE kind = 'symlink' AND path IN (SELECT string_split(path, '/')[1] FROM e WHERE contains(path, '/')))
SELECT CASE kind WHEN 'dir' THEN 0 WHEN 'file' THEN 1 WHEN 'hardlink' THEN 2 ELSE 3 END::BIGINT AS stage, path,
  CASE WHEN path IN (SELECT path FROM u) THEN 'skip' WHEN kind = 'dir' THEN 'make' WHEN kind = 'file' THEN 'write' ELSE 'link' END AS action FROM e
UNION ALL SELECT 4, path, 'metadata' FROM e WHERE kind = 'dir'""")
def extract_plan(spark, sf):
    return planning.extract_plan(_tree(spark, sf), 1 << 50)


_SPARSE = """t AS (SELECT conv_id, turn, encode(coalesce(text, '')) AS data, (conv_id + turn * 7) % 40 AS hole FROM conversations),
x AS (SELECT *, (coalesce(sum(octet_length(data) + hole) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + hole)::BIGINT AS off FROM t),
w AS (SELECT conv_id, unhex(string_agg(repeat('00', hole::INT) || hex(data), '' ORDER BY turn) || repeat('00', 25)) AS whole FROM t GROUP BY 1)"""


def _sparse(spark, sf):
    t = sources.table(spark, sf, "conversations").select(F.col("conv_id"), F.col("turn").alias("seq"), content(F.coalesce("text", F.lit(""))).alias("data"), ((F.col("conv_id") + F.col("turn") * 7) % 40).alias("hole"))
    n = F.octet_length("data").cast("long")
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    x = t.withColumn("off", F.coalesce(F.sum(n + F.col("hole")).over(before), F.lit(0)) + F.col("hole")).withColumn("len", n)
    return x, x.groupBy("conv_id").agg((F.max(F.col("off") + F.col("len")) + 25).alias("size"))


@query(f"""WITH {_SPARSE}, r AS (SELECT conv_id, whole, (conv_id * 13) % 200 AS start, 300 AS want, octet_length(whole) AS size FROM w)
SELECT conv_id, start, least(want, size - start)::BIGINT AS length, sha256(whole[start + 1 : start + want]) AS sha FROM r WHERE start < size""")
def sparse_range_bytes(spark, sf):
    """Ranges of members with holes: the holes are zeros."""
    parts, sizes = _sparse(spark, sf)
    asked = sizes.select("conv_id", (F.col("conv_id") * 13 % 200).alias("start"), F.lit(300).cast("long").alias("length"))
    plan = extents.filled_ranges(parts.select("conv_id", "seq", "off", "len"), asked, sizes, "conv_id")
    return extents.read_sparse(plan, parts.select("conv_id", "seq", "data"), "conv_id").select("conv_id", "start", "length", sha(F.col("data")).alias("sha"))


@query(f"WITH {_SPARSE} SELECT conv_id::VARCHAR AS conv_id, sha256(whole) AS sha FROM w")
def sparse_hashes(spark, sf):
    parts, sizes = _sparse(spark, sf)
    return extents.sparse_hash(parts.select("conv_id", "seq", "off", "len", "data"), sizes, "conv_id")


@query("""WITH k AS (SELECT l_partkey % 50 AS content, l_suppkey % 9 AS stream, count(*) AS n, min(l_quantity::BIGINT) AS size, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY n DESC, size, f) AS r FROM k) SELECT content, stream, n::BIGINT AS n, size FROM r WHERE r = 1""")
def canonical_stream(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    kinds = l.select((F.col("l_partkey") % 50).alias("content"), (F.col("l_suppkey") % 9).alias("stream"), F.col("l_quantity").cast("long").alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return codecs.canonical_stream(kinds).select("content", "stream", "n", "size")


@query("""WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS len FROM conversations),
s AS (SELECT conv_id, (turn * 2)::BIGINT AS seq, 30::BIGINT AS len FROM t UNION ALL SELECT conv_id, turn * 2 + 1, len FROM t UNION ALL SELECT conv_id, max(turn) * 2 + 2, 22 FROM t GROUP BY 1),
o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s),
q AS (SELECT DISTINCT conv_id, (conv_id * 31) % 500 AS start, 900::BIGINT AS length FROM t)
SELECT q.conv_id, start, length, seq, greatest(start - off, 0)::BIGINT AS part_off, greatest(off - start, 0)::BIGINT AS out_off, (least(off + len, start + length) - greatest(off, start))::BIGINT AS take
FROM q JOIN o USING (conv_id) WHERE off < start + length AND off + len > start AND len > 0""")
def vzip_range(spark, sf):
    """What a byte range of a container reads of its literals and payloads."""
    parts = recipe_projection_plan(spark, sf).select("conv_id", "seq", "off", "len")
    asked = parts.select("conv_id").distinct().select("conv_id", (F.col("conv_id") * 31 % 500).alias("start"), F.lit(900).cast("long").alias("length"))
    return recipes.range_plan(parts, asked, "conv_id")


@query("""WITH b AS (SELECT p_partkey AS k, 100 + p_partkey % 300 AS raw, CASE p_partkey % 11 WHEN 0 THEN 'dictionary' WHEN 1 THEN 'retained' ELSE 'content' END AS role, p_partkey % 13 = 0 AS canonical, 400 AS stream FROM part),
t AS (SELECT k, raw, u AS trial, [1, 1, 3, 4][u + 1] AS codec, 40 + (k * (u + 3)) % 350 AS total FROM b, range(4) r(u)),
w AS (SELECT k, min(raw) AS raw, arg_min(codec, struct_pack(total, trial)) AS c, min(total) AS total FROM t GROUP BY 1)
SELECT k::VARCHAR AS sha, CASE WHEN role <> 'content' THEN 0 WHEN canonical THEN 4 WHEN total + 16 < w.raw THEN c ELSE 0 END::BIGINT AS codec,
  CASE WHEN role <> 'content' THEN b.raw WHEN canonical THEN stream WHEN total + 16 < w.raw THEN total ELSE b.raw END::BIGINT AS stored FROM b JOIN w USING (k)""")
def codec_choice(spark, sf):
    """The codec of each content: bypass rules first, then the contest of given trials."""
    k = F.col("p_partkey")
    b = sources.table(spark, sf, "part").select(k.cast("string").alias("sha"), k.alias("k"), (k % 300 + 100).alias("raw"), F.when(k % 11 == 0, "dictionary").when(k % 11 == 1, "retained").otherwise("content").alias("role"), (k % 13 == 0).alias("canonical"), F.lit(400).cast("long").alias("stream"))
    t = b.select("sha", "k", "raw", F.explode(F.array(*map(F.lit, range(4)))).alias("trial"))
    t = t.select("sha", "raw", "trial", F.get(F.array(*map(F.lit, (1, 1, 3, 4))), F.col("trial")).alias("codec"), (F.col("k") * (F.col("trial") + 3) % 350 + 40).alias("total"))
    return codecs.decide(b, t)


@query("""SELECT p_partkey::VARCHAR AS path, CASE WHEN p_size * 20 + 4 < p_partkey % 900 THEN 8 ELSE 0 END::BIGINT AS method, CASE WHEN p_size * 20 + 4 < p_partkey % 900 THEN p_size * 20 ELSE p_partkey % 900 END::BIGINT AS csize FROM part""")
def zip_export_choice(spark, sf):
    p = sources.table(spark, sf, "part")
    return recipes.export_choice(p.select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % 900).alias("size"), (F.col("p_size") * 20).cast("long").alias("packed")))


_STREAMS = """st AS (SELECT 'o' || l_orderkey % 400 AS container, row_number() OVER (PARTITION BY l_orderkey % 400 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey % 700 AS content,
  (l_partkey % 700) * 3 + 1 AS stream, (l_partkey % 700) * 11 + 50 AS len FROM lineitem),
lo AS (SELECT 'p' || p_partkey AS path, p_partkey % 1500 AS content, p_size * 100 AS size FROM part)"""


def _streams(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    line = Window.partitionBy(F.col("l_orderkey") % 400).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    c = F.col("l_partkey") % 700
    st = l.select(F.concat(F.lit("o"), F.col("l_orderkey") % 400).alias("container"), F.row_number().over(line).alias("seq"), c.alias("content"), (c * 3 + 1).alias("stream"), (c * 11 + 50).alias("len"))
    p = sources.table(spark, sf, "part")
    return st, p.select(F.concat(F.lit("p"), "p_partkey").alias("path"), (F.col("p_partkey") % 1500).alias("content"), (F.col("p_size") * 100).cast("long").alias("size"))


_FEDERATE = f"""{_STREAMS}, ow AS (SELECT container, stream, max(len) AS len, count(*) AS n FROM st GROUP BY 1, 2), sp AS (SELECT stream, count(*) AS c FROM ow GROUP BY 1),
su AS (SELECT container, sum(len * (n - 1)) AS local_dup, sum(CASE WHEN c > 1 THEN len ELSE 0 END) AS shared FROM ow JOIN sp USING (stream) GROUP BY 1),
ex AS (SELECT container, sum(len) AS external FROM (SELECT container, content, arg_min(len, seq) AS len FROM st WHERE content IN (SELECT content FROM lo) GROUP BY 1, 2) GROUP BY 1),
fe AS (SELECT container, local_dup::BIGINT AS local_dup, shared::BIGINT AS shared, coalesce(external, 0)::BIGINT AS external, local_dup >= 60000 OR shared >= 400000 OR coalesce(external, 0) >= 350000 AS admitted FROM su LEFT JOIN ex USING (container))"""


@query(f"WITH {_FEDERATE} SELECT * FROM fe")
def container_federation(spark, sf):
    st, lo = _streams(spark, sf)
    return containers.federate(st, lo, 60000, 400000, 350000)


@query(f"""WITH {_FEDERATE}, ke AS (SELECT content, min(struct_pack(csize := len, stream)) AS b FROM st WHERE container IN (SELECT container FROM fe WHERE admitted) GROUP BY 1)
SELECT path, b.stream AS stream, b.csize AS csize FROM lo JOIN ke USING (content) WHERE size >= 1000""")
def derived_files(spark, sf):
    st, lo = _streams(spark, sf)
    return containers.derived(st, containers.federate(st, lo, 60000, 400000, 350000), lo, 1000)


@query("""WITH t AS (SELECT p_brand AS family, 32768 << (p_size % 5) AS lim, sum(p_partkey % 5000)::BIGINT AS cost FROM part GROUP BY 1, 2),
b AS (SELECT family, min(struct_pack(cost, lim)) AS b, min(cost) FILTER (lim = 32768) AS base FROM t GROUP BY 1)
SELECT family, CASE WHEN base - b.cost >= greatest(2048, floor(base * 0.005)) THEN b.lim ELSE 32768 END::BIGINT AS pack_limit FROM b""")
def family_pack_limits(spark, sf):
    p = sources.table(spark, sf, "part")
    lim = F.get(F.array(*[F.lit(32768 << i) for i in range(5)]), F.col("p_size") % 5)
    return containers.family_limits(p.groupBy(F.col("p_brand").alias("family"), lim.alias("pack_limit")).agg(F.sum(F.col("p_partkey") % 5000).alias("cost"), F.lit(2).alias("members")))


@query("""WITH a AS (SELECT DISTINCT c_nationkey * 7 % 40 AS corpus FROM customer), b AS (SELECT DISTINCT s_nationkey * 3 % 40 AS corpus FROM supplier)
SELECT corpus, 'missing' AS side FROM (SELECT corpus FROM a EXCEPT SELECT corpus FROM b) UNION ALL SELECT corpus, 'new' FROM (SELECT corpus FROM b EXCEPT SELECT corpus FROM a)""")
def corpus_difference(spark, sf):
    a = sources.table(spark, sf, "customer").select((F.col("c_nationkey") * 7 % 40).alias("corpus")).distinct()
    b = sources.table(spark, sf, "supplier").select((F.col("s_nationkey") * 3 % 40).alias("corpus")).distinct()
    return gate.set_difference(a, b)


@query("""SELECT l_returnflag AS corpus, sum(l_partkey)::BIGINT AS base, sum(l_suppkey)::BIGINT AS candidate, count(*) FILTER (l_suppkey < l_partkey)::BIGINT AS improved, count(*) FILTER (l_suppkey > l_partkey)::BIGINT AS regressed,
  sum(l_suppkey) / sum(l_partkey) AS ratio FROM lineitem GROUP BY 1""")
def portfolio_totals(spark, sf):
    l = sources.table(spark, sf, "lineitem")
    return planning.totals(l.select(F.col("l_returnflag").alias("corpus"), F.col("l_partkey").alias("base"), F.col("l_suppkey").alias("candidate")), "corpus")


_ROOTS = """r AS (SELECT o_custkey AS target, o_orderkey AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rank FROM orders)"""


@query(f"""WITH {_ROOTS}, f AS MATERIALIZED (SELECT target, base, rank + 0 AS rank FROM r WHERE rank + 0 < 5), x2 AS (SELECT a.target, b.rank AS top, [a.base, b.base] AS bases FROM f a JOIN f b ON a.target = b.target AND b.rank > a.rank),
x3 AS (SELECT x.target, c.rank AS top, list_append(x.bases, c.base) AS bases FROM x2 x JOIN f c ON c.target = x.target AND c.rank > x.top), x4 AS (SELECT x.target, list_append(x.bases, c.base) AS bases FROM x3 x JOIN f c ON c.target = x.target AND c.rank > x.top),
s AS (SELECT target, bases FROM x2 UNION ALL SELECT target, bases FROM x3 UNION ALL SELECT target, bases FROM x4),
t AS (SELECT target, bases, (list_sum(bases) % 97)::BIGINT AS cost, (list_sum(bases) % 5)::BIGINT AS copied FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cost, copied DESC, bases) AS n FROM t)
SELECT target, array_to_string(bases, ',') AS bases, cost, copied FROM b WHERE n = 1""")
def subset_tournament(spark, sf):
    """Sets of two to four of five bases of a target, the cheapest by given costs."""
    o = sources.table(spark, sf, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    sets = planning.subset_choice(o.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("base"), n.alias("rank")), most=5)
    whole = F.aggregate("bases", F.lit(0).cast("long"), lambda a, x: a + x)
    best = planning.best_subset(sets.select("target", "bases", (whole % 97).alias("cost"), (whole % 5).alias("copied")))
    return best.select("target", F.array_join(F.col("bases").cast("array<string>"), ",").alias("bases"), "cost", "copied")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey * 40 < 1024 THEN NULL WHEN l_partkey * 40 < 32768 THEN greatest(256, l_partkey * 40 // 8) ELSE greatest(4096, l_partkey * 40 // 20) END::BIGINT AS least,
  l_suppkey >= greatest(128, l_partkey // 50) AND l_quantity * 100 >= l_orderkey % 9000 // 4 AS admissible FROM lineitem""")
def dependency_rules(spark, sf):
    """What a base must give at least, and whether a delta pays."""
    l = sources.table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", delta.contribution_floor(F.col("l_partkey") * 40).cast("long").alias("least"), delta.admissible(F.col("l_suppkey"), F.col("l_quantity") * 100, F.col("l_partkey"), F.col("l_orderkey") % 9000).alias("admissible"))


_GENS = """ge AS (SELECT event_id AS gen, CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 331 = 1 THEN -5 WHEN event_id % 517 = 3 THEN event_id + 1 WHEN event_id % 517 = 4 THEN event_id - 1 ELSE event_id - 1 END AS prev, event_id % 40 = 0 AS full FROM events)"""


@query(f"""WITH RECURSIVE {_GENS}, c AS (SELECT gen, gen AS pos, 0 AS d FROM ge UNION ALL SELECT c.gen, ge.prev, d + 1 FROM c JOIN ge ON ge.gen = c.pos WHERE NOT ge.full AND d < 60),
l AS (SELECT gen, arg_max(pos, d) AS pos, max(d) AS d FROM c GROUP BY 1)
SELECT l.gen, CASE WHEN ge.full THEN d END::BIGINT AS depth, CASE WHEN ge.gen IS NULL THEN 'broken' WHEN d >= 60 THEN 'cycle' WHEN d > 30 THEN 'too_deep' END AS fault FROM l LEFT JOIN ge ON ge.gen = l.pos""")
def generation_chains(spark, sf):
    e = sources.table(spark, sf, "events").select(F.col("event_id").alias("gen"))
    g = F.col("gen")
    prev = F.when(g % 40 == 0, None).when(g % 331 == 1, -5).when(g % 517 == 3, g + 1).otherwise(g - 1)
    return journal.chain_depths(e.select("gen", prev.cast("long").alias("prev"), (g % 40 == 0).alias("full")), 30).select("gen", "depth", "fault")


@query("""SELECT 'o' || o_orderkey AS path, o_orderkey % 70 AS ref, (o_orderkey % 70) * 3 AS csize FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 4 = 0 AND o_orderkey % 70 % 5 = 4""")
def deflate_reuse(spark, sf):
    """Entries whose stored stream an export takes as it is."""
    k = F.col("o_orderkey")
    e = sources.table(spark, sf, "orders").select(F.concat(F.lit("o"), k).alias("path"), F.get(F.array(*map(F.lit, ("file", "symlink", "dir"))), (k % 3).cast("int")).alias("kind"), F.when(k % 4 == 0, "blob").otherwise("cdc").alias("storage"), (k % 70).alias("ref"))
    blobs = spark.range(70).select(F.col("id").alias("blob_id"), (F.col("id") * 3).alias("csize"), (F.col("id") % 5).alias("codec"))
    return recipes.reusable(e, blobs)


_RECORDS = """re AS (SELECT p_partkey AS k, (p_partkey * 1000 - CASE WHEN p_partkey % 29 = 0 THEN 900 ELSE 0 END)::BIGINT AS pos, CASE WHEN p_partkey % 31 = 0 THEN 9 ELSE p_partkey % 2 END AS codec,
  CASE WHEN p_partkey % 37 = 0 THEN 9000000 ELSE 500 END AS usize, CASE WHEN p_partkey % 41 = 0 THEN -1 ELSE 400 END AS csize, (SELECT max(p_partkey) * 1000 FROM part) AS fin FROM part)"""


@query(f"""WITH {_RECORDS}, o AS (SELECT *, max(pos + 53 + csize) OVER (ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM re)
SELECT rule, k::VARCHAR AS subject FROM (SELECT k, unnest([CASE WHEN pos < 0 OR pos + 53 + csize > fin THEN 'record_outside' END, CASE WHEN codec = 9 THEN 'record_codec' END, CASE WHEN usize > 8388608 THEN 'record_raw' END,
  CASE WHEN csize < 0 THEN 'record_packed' END, CASE WHEN pos < coalesce(before, 0) THEN 'record_overlap' END]) AS rule FROM o) WHERE rule IS NOT NULL""")
def record_preflight(spark, sf):
    p, k = sources.table(spark, sf, "part"), F.col("p_partkey")
    end = p.agg(F.max("p_partkey")).first()[0] * 1000
    rows = p.select(k.alias("record_id"), (k * 1000 - F.when(k % 29 == 0, 900).otherwise(0)).alias("at"), F.lit(53).alias("header"), F.when(k % 31 == 0, 9).otherwise(k % 2).alias("codec"), F.when(k % 37 == 0, 9000000).otherwise(500).alias("usize"), F.when(k % 41 == 0, -1).otherwise(400).alias("csize"))
    return validate.record_faults(rows, end)


@query("""WITH h AS (SELECT p_partkey AS k, p_partkey % 43 AS f FROM part) SELECT k::VARCHAR AS subject, CASE f WHEN 1 THEN 'header_missing' WHEN 2 THEN 'header_magic' WHEN 3 THEN 'header_flags' WHEN 4 THEN 'header_differs' WHEN 5 THEN 'header_differs' ELSE 'header_outside' END AS rule FROM h WHERE f BETWEEN 1 AND 6""")
def header_cross_check(spark, sf):
    """Record headers against the index, each way of being wrong by part number."""
    p, k = sources.table(spark, sf, "part"), F.col("p_partkey")
    f = k % 43
    blobs = p.select(k.alias("blob_id"), F.lit(100).alias("usize"), F.lit(90).alias("csize"), F.lit(1).alias("codec"))
    headers = p.where(f != 1).select(k.alias("blob_id"), F.when(f == 6, 1 << 40).otherwise(k).alias("at"), (f != 2).alias("magic"), F.when(f == 3, 1).otherwise(0).alias("flags"), F.when(f == 4, 0).otherwise(1).alias("codec"), F.lit(100).alias("usize"), F.when(f == 5, 91).otherwise(90).alias("csize"), F.lit(0).alias("meta_len"))
    return validate.header_faults(blobs, headers, 1 << 40)


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 53 AS f FROM orders)
SELECT rule, k::VARCHAR AS subject FROM r JOIN (VALUES (1, 'recipe_method'), (2, 'recipe_mode'), (3, 'recipe_level'), (4, 'recipe_raw_missing'), (5, 'recipe_stream_missing'), (6, 'recipe_literals'), (7, 'recipe_size'), (7, 'recipe_entry_size'),
  (8, 'recipe_literal_negative'), (9, 'recipe_skeleton'), (10, 'recipe_stored_size'), (11, 'recipe_no_level')) v(f, rule) USING (f)""")
def recipe_preflight(spark, sf):
    """Recipes of one payload, each broken in one way by order number."""
    o, k = sources.table(spark, sf, "orders"), F.col("o_orderkey")
    f = k % 53
    # literals 30 and 22, or what the number breaks; a payload of 60 bytes
    literals = F.when(f == 6, F.array(F.lit(52))).when(f == 8, F.array(F.lit(60), F.lit(-8))).otherwise(F.array(F.lit(30), F.lit(22))).cast("array<long>")
    rec = o.select(k.alias("recipe_id"), F.concat(F.lit("o"), k).alias("path"), F.when(f == 7, 113).otherwise(112).cast("long").alias("size"), literals.alias("literals"), F.when(f == 9, 2).otherwise(1).alias("skeleton"))
    stored = f == 10
    pay = o.select(k.alias("recipe_id"), F.lit(0).alias("seq"), F.when(f == 4, 99).otherwise(3).alias("raw_ref"), F.when(f == 1, 5).when(stored, 0).otherwise(8).alias("method"), F.when(f == 2, 7).when(f == 5, 1).when(f == 11, 2).otherwise(0).alias("mode"), F.when(f == 5, 98).otherwise(4).alias("stream_ref"), F.lit(60).cast("long").alias("csize"), F.when(f == 3, 12).when(f == 11, -1).otherwise(6).alias("level"))
    blobs = spark.createDataFrame([(1, 52), (2, 51), (3, 200), (4, 60)], "blob_id long, usize long")
    entries = o.select(F.concat(F.lit("o"), k).alias("path"), F.lit(112).cast("long").alias("size"))
    return validate.recipe_faults(rec, pay, blobs, entries, validate.limits())


@query(f"""WITH {_TREE} SELECT count(*) FILTER (kind = 'file')::BIGINT AS files, count(*) FILTER (kind = 'dir')::BIGINT AS dirs, count(*) FILTER (kind = 'symlink')::BIGINT AS symlinks, count(*) FILTER (kind = 'hardlink')::BIGINT AS hardlinks, sum(size)::BIGINT AS logical_bytes,
  (SELECT count(*) FROM part)::BIGINT AS blobs, (SELECT sum(p_size) FROM part)::BIGINT AS blob_bytes FROM e""")
def preflight_summary(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in (("file", validate.FILE), ("dir", validate.DIR), ("symlink", validate.SYMLINK), ("hardlink", validate.HARDLINK)) for x in kv])
    e = _tree(spark, sf).select("path", F.element_at(names, F.col("kind")).alias("kind"), "size")
    return validate.summary(e, sources.table(spark, sf, "part").select(F.col("p_partkey").alias("blob_id"), F.col("p_size").alias("usize")))


@query(f"WITH {DOCS} SELECT path, size, sha256(data) AS sha FROM m")
def graph_roundtrip(spark, sf):
    """All documents through the graph: cut, packed, kept as deltas, and taken out again; the
    hash is of what came out."""
    out = graph.extract(graph.build(sources.documents(spark, sf)))
    return out.select("path", F.octet_length("data").cast("long").alias("size"), sha(F.col("data")).alias("sha"))


@query()
def fused_pairs(spark, sf):
    """The disjoint pairs of neighbouring records that merge, by what they are together."""
    pairs = pair_fusion_candidates(spark, sf)
    return planning.fuse(pairs.withColumn("gain", planning.PAIR_BYTES - F.col("total")), "g")


@query(f"""WITH RECURSIVE {_PROGRAMS}, g AS (SELECT base, target, raw, target_len, 0::BIGINT AS pack, raw AS used, target_len::DOUBLE AS least FROM p0 WHERE target = 1
  UNION ALL SELECT p.base, p.target, p.raw, p.target_len, CASE WHEN g.used + p.raw > 4096 OR (g.used + p.raw) / least(g.least, p.target_len) > 2 THEN pack + 1 ELSE pack END,
    CASE WHEN g.used + p.raw > 4096 OR (g.used + p.raw) / least(g.least, p.target_len) > 2 THEN p.raw ELSE g.used + p.raw END,
    CASE WHEN g.used + p.raw > 4096 OR (g.used + p.raw) / least(g.least, p.target_len) > 2 THEN p.target_len ELSE least(g.least, p.target_len) END
  FROM g JOIN p0 p ON p.base = g.base AND p.target = g.target + 1)
SELECT base, pack, count(*)::BIGINT AS members, sum(raw)::BIGINT AS raw, (count(*) - 1) * 64 AS net, sum(raw) / min(target_len) AS amp FROM g GROUP BY 1, 2 HAVING count(*) >= 2 AND (count(*) - 1) * 64 >= 128""")
def residual_packs_kept(spark, sf):
    return planning.kept_packs(planning.residual_packs(_programs(spark, sf), 4096), ["base", "pack"])
