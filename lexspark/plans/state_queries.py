"""Registered queries: streams with state, upserted tables, an extractor hook, an index that is refreshed, calibrated contents pages."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from lexspark.operators import hooks, toc_pages
from lexspark.plans import book_queries, more_queries, record_queries
from lexspark.plans import sql as Q
from lexspark.sources import derived, index
from lexspark.sources.shared import new_folder
from lexspark.sources.std_corpus import std_corpus
from lexspark.streaming import events as E
from lexspark.streaming import lifecycle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


@contextmanager
def _rocksdb(spark):
    """The session with the state store that keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    lifecycle.use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def _drained(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query(record_queries.ORACLES["run_states"])
def streamed_run_states(spark, sf_dir):
    """ST5: the life of runs from a stream with keyed state, equal to the batch."""
    top = new_folder(spark, "runs")
    with _rocksdb(spark):
        rows = lifecycle.run_updates(derived.parts_stream(spark, sf_dir))
        _drained(rows.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{top}/out/b={n}")).option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start())
    last = spark.read.schema(lifecycle.RUN).parquet(f"{top}/out").groupBy("run_id").agg(F.max_by(F.struct("state", "n_events", "artifacts"), "version").alias("x"))
    return last.select("run_id", "x.state", "x.n_events", F.array_join("x.artifacts", ",").alias("artifacts"))


@query(record_queries.ORACLES["latest_states"])
def upserted_states(spark, sf_dir):
    """ST4: last snapshots in a table that a stream keeps."""
    top = new_folder(spark, "states")
    _drained(lifecycle.upsert(derived.parts_stream(spark, sf_dir), f"{top}/t", f"{top}/check", lifecycle.state_part, lifecycle.state_merge))
    return lifecycle.current(spark, f"{top}/t", lifecycle.state_merge).select("run_id", "last.data", "last.seq")


@query(record_queries.ORACLES["call_telemetry"])
def upserted_telemetry(spark, sf_dir):
    """ST6: telemetry of calls in a table that a stream keeps."""
    kind = F.when(F.col("event") == "error", "retry").when(F.col("event") == "ping", "poll")
    rows = derived.parts_stream(spark, sf_dir).select(F.col("run_id").alias("call_id"), kind.alias("kind"), (F.col("seq") % 97 == 0).alias("exhausted"), F.col("event").alias("state"), "seq", F.col("seq").alias("t"))
    top = new_folder(spark, "calls")
    _drained(lifecycle.upsert(rows, f"{top}/t", f"{top}/check", lifecycle.telemetry_part, lifecycle.telemetry_merge))
    return lifecycle.telemetry(lifecycle.current(spark, f"{top}/t", lifecycle.telemetry_merge))


_PY_NUMBER = r"[A-Z]{2,4}(?:/[A-Z])? ?[0-9]+(?:\\.[0-9]+)*[-—–][0-9]{4}"


def numbers_in(text):
    """The default extractor's two labelled numbers, as a caller's own extractor would give them."""
    for cls, lead in (("标准号", "标准正式编号："), ("代替标准号", "代替")):
        for m in re.finditer(f"{lead}({_PY_NUMBER})", text):
            yield cls, m.group(1), m.start(1)


@query(more_queries.ORACLES["found_spans"])
def hooked_spans(spark, sf_dir):
    """Spans of a caller's extractor over overlapping chunks."""
    found = hooks.extracted(std_corpus(spark, sf_dir), numbers_in, size=1500, buffer=200)
    return found.select("doc_id", "cls", "txt", (F.col("start_pos") + 1).alias("start_pos"))


@query(f"WITH {Q.LINES}, {book_queries._BOOK} SELECT doc_id AS book, chunk_id, title, scope, content, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::INT AS cut_by FROM chunks")
def refreshed_index(spark, sf_dir):
    """An index refreshed after a third of its books changed and some went: only what changed is cut again."""
    path = new_folder(spark, "index")
    books = std_corpus(spark, sf_dir).select(F.col("doc_id").alias("book"), "text")
    before = books.withColumn("text", F.when(F.col("book") % 3 == 0, F.concat("text", F.lit("# 旧章\nold\n"))).otherwise(F.col("text")))
    gone = books.where("book % 10 = 1").withColumn("book", -F.col("book"))
    index.refresh(before.unionByName(gone), path)
    index.refresh(books, path)
    return index.load(spark, path).select("book", "chunk_id", "title", "scope", "content", "cut_by")


_MATCHES = """SELECT l_orderkey // 16 AS doc_id, CAST(l_orderkey * 8 + l_linenumber AS INT) AS toc_idx, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey % 9 AS VARCHAR(20)) END AS number,
  CASE l_partkey % 7 WHEN 0 THEN '前言' WHEN 4 THEN '附录A' WHEN 5 THEN '目次' WHEN 6 THEN '引 言' ELSE '要求' END AS title, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_linenumber + l_orderkey // 16 % 3 + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS INT) END AS page, l_suppkey % 5 = 0 AS bookmark_match,
  CASE l_partkey % 7 WHEN 0 THEN 'foreword' WHEN 6 THEN 'introduction' WHEN 3 THEN 'toc' ELSE 'other_body' END AS h_scope, CASE WHEN l_partkey % 7 = 4 THEN 'appendix_title' ELSE 'chapter' END AS h_role,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(l_linenumber + 2 AS INT) END AS h_page, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS h_table_breaks, l_suppkey % 10 = 0 AS h_bookmarked FROM {lineitem}"""
_TOC_SQL = f"""WITH m AS ({derived.duck(_MATCHES, 'lineitem')}), a AS (SELECT doc_id, min(h_page) AS fp, min(h_page) FILTER (h_scope = 'other_body') AS fb FROM m GROUP BY doc_id),
k AS (SELECT m.*, fp, fb, replace(title, ' ', '') AS key, CASE WHEN number = '' AND l.key2 IN ('前言', '引言') THEN 'roman' ELSE 'arabic' END AS scheme, CASE WHEN h_page IS NULL OR h_scope = 'toc' THEN NULL WHEN h_scope IN ('foreword', 'introduction') THEN 'roman' ELSE 'arabic' END AS hs,
  CASE WHEN h_scope = 'toc' THEN h_page WHEN h_scope IN ('foreword', 'introduction') THEN h_page - fp + 1 ELSE h_page - coalesce(fb, 1) + 1 END AS lp, h_table_breaks > 0 AND NOT h_bookmarked AND h_scope <> 'toc' AS shaky FROM m JOIN a USING (doc_id), (SELECT 1) z, LATERAL (SELECT replace(m.title, ' ', '') AS key2) l),
c AS (SELECT doc_id, scheme, list(DISTINCT page - lp) AS ds FROM k WHERE scheme = hs AND page IS NOT NULL AND (bookmark_match OR NOT shaky) GROUP BY ALL),
v AS (SELECT k.*, c.ds IS NOT NULL AND len(c.ds) = 1 AS cal, lp + CASE WHEN len(c.ds) = 1 THEN c.ds[1] ELSE 0 END AS lg,
  key <> '目次' AND h_scope <> 'toc' AND CASE WHEN k.scheme = 'roman' THEN h_scope IN ('foreword', 'introduction') WHEN number <> '' THEN true WHEN starts_with(key, '附录') THEN h_role = 'appendix_title' ELSE false END AS looked FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.scheme = k.hs),
s AS (SELECT doc_id, scheme, list(DISTINCT lg - page) AS rs FROM v WHERE looked AND NOT cal AND lg IS NOT NULL AND page IS NOT NULL GROUP BY ALL),
j AS (SELECT v.*, lg - CASE WHEN len(s.rs) = 1 THEN s.rs[1] ELSE 0 END AS bp FROM v LEFT JOIN s ON s.doc_id = v.doc_id AND s.scheme = v.scheme),
w AS (SELECT doc_id, toc_idx, page, h_page AS raw_page, bp::BIGINT AS body_page, CASE WHEN NOT looked THEN 'out_of_scope' WHEN page IS NULL OR h_page IS NULL OR hs <> scheme THEN 'skipped' WHEN bp <> page AND shaky AND NOT cal THEN 'unreliable' WHEN bp <> page THEN 'fail' ELSE 'pass' END AS verdict FROM j)"""


def _toc_verdicts(spark, sf_dir):
    rows = spark.sql(_MATCHES.replace("VARCHAR(20)", "STRING").replace("//", "div"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    heads = rows.select("doc_id", F.col("h_scope").alias("scope"), F.col("h_page").alias("page"))
    return rows, toc_pages.verdicts(rows, toc_pages.anchors(heads, heads))


@query(f"{_TOC_SQL} SELECT * FROM w")
def toc_page_verdicts(spark, sf_dir):
    """Contents pages against headings' logical pages, calibrated by trusted pairs."""
    judged = _toc_verdicts(spark, sf_dir)[1]
    return judged.select("doc_id", "toc_idx", "page", "raw_page", F.col("body_page").cast("long").alias("body_page"), "verdict")


@query(f"{_TOC_SQL}, e AS (SELECT doc_id, count(*) AS n, count(*) FILTER (l_linenumber = 7) AS u FROM (SELECT l_orderkey // 16 AS doc_id, l_linenumber FROM lineitem) GROUP BY doc_id UNION ALL SELECT -p_partkey, 0, 0 FROM part WHERE p_partkey % 9 = 0), p AS (SELECT doc_id, count(*) FILTER (verdict <> 'out_of_scope') AS c, count(*) FILTER (verdict = 'fail') AS f, count(*) FILTER (verdict = 'skipped') AS s, count(*) FILTER (verdict = 'unreliable') AS r, count(*) FILTER (verdict = 'out_of_scope') AS o FROM w GROUP BY doc_id) SELECT doc_id, CASE WHEN n = 0 THEN 'insufficient_context' WHEN f > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce(c, 0) AS checked, coalesce(f, 0) AS failed, coalesce(s, 0) + u AS skipped, coalesce(r, 0) AS unreliable, coalesce(o, 0) AS out_of_scope FROM e LEFT JOIN p USING (doc_id)")
def toc_page_evaluations(spark, sf_dir):
    """A document's contents pages in numbers; one without a contents row lacks context."""
    rows, judged = _toc_verdicts(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr("l_orderkey div 16").alias("doc_id"), "l_linenumber")
    entries = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("l_linenumber") == 7).alias("n_unmatched"))
    none = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 9 = 0").select((-F.col("p_partkey")).alias("doc_id"), F.lit(0).cast("long").alias("n_entries"), F.lit(0).cast("long").alias("n_unmatched"))
    return toc_pages.evaluation(entries.unionByName(none), judged)
