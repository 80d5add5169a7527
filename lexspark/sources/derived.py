"""Issue, message and span tables derived row by row from the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ISSUES = """
SELECT event_id, user_id AS doc_id, event_id AS ord,
  CASE event_id % 7 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'warn' WHEN 3 THEN 'insufficient_context' WHEN 4 THEN 'info' WHEN 5 THEN 'llm_error' ELSE 'not_ready' END AS status,
  CASE event_id % 6 WHEN 0 THEN '严重' WHEN 1 THEN '中度' WHEN 2 THEN '轻度' WHEN 3 THEN '提示' WHEN 4 THEN 'major' ELSE NULL END AS severity,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS scope,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'format' ELSE 'content_llm' END AS audit_track,
  event_type || '-' || CAST(event_id % 11 AS VARCHAR(20)) AS rule_name
FROM {events}
"""
PARTS = """
SELECT event_id AS seq, user_id AS run_id, ts,
  CASE event_id % 8 WHEN 0 THEN 'custom' WHEN 1 THEN 'messages' WHEN 2 THEN 'updates' WHEN 3 THEN 'values' WHEN 4 THEN 'error' WHEN 5 THEN 'end' WHEN 6 THEN 'values' ELSE 'ping' END AS event,
  CASE event_id % 10 WHEN 0 THEN '{{"todos": [1]}}' WHEN 1 THEN '{{"a": {{"__interrupt__": true}}}}' ELSE '{{"id": ' || CAST(event_id AS VARCHAR(20)) || '}}' END AS data,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'm' || CAST(event_id % 50 AS VARCHAR(20)) END AS message_id,
  'a' || CAST(event_id % 3 AS VARCHAR(20)) AS artifact_id
FROM {events}
"""
SPANS = """
SELECT c_nationkey AS doc_id, c_custkey AS seq,
  CASE c_custkey % 5 WHEN 0 THEN '标准号' WHEN 1 THEN 'ICS' WHEN 2 THEN '引用文件' WHEN 3 THEN '代替标准号' ELSE 'other' END AS cls,
  CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE CASE c_custkey % 3 WHEN 0 THEN 'GB ' WHEN 1 THEN 'GH/T ' ELSE 'DB11/T ' END || CAST(1000 + c_custkey % 17 AS VARCHAR(20)) || '-2020' END AS txt,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey * 37) % 1000 END AS start_pos
FROM {customer}
"""


def _pick(of: str, values: list[str]) -> str:
    """One of ``values`` by the number ``of``, in SQL that both engines read."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE ({of}) % {len(values)} {cases} END"


_PIECES = [f"'{x}'" for x in (
    "GB/T 2-2020 ", "本标准代替 GB/T 15034—1994《导则》。", "本文件与GB/T 1-2000相比主要变化如下 ", "国家标准 ", "行业标准 ", "ICS 67.080.10 ", "CCS B 31 ", "B 31 ", "地方标准 DB11/T 30.2—2019 ",
    "NY/T 5010-2016, ", "GH/T A-1.3—2001x ", "GB 7718-2011被代替 ", "很长的一段与编号无关的说明文字，足足超过二十个字才算数。",
)] + ["chr(10) || 'GB/T' || chr(10)", "''"]
_HEADERS = [f"'{x}'" for x in (
    "ICS 67.080.10", "ICS 03.220", "国际标准分类 11", "B 31", "CCS X01", "GB", "DB/T", "中华人民共和国国家标准", "某某行业标准", "GB/T 15034—2009", "DB11/T 1.2-20", "代替 GB/T 15034—1994", "替代Q/X 1-88", "2009年", "  ", "no kind of header",
)]
#: Texts and header blocks of covers, put together by numbers, so that every kind meets every other at every place.
COVERS = f"SELECT page_id AS doc_id, {' || '.join(_pick(f'page_id * {m} + page_id // {d} + {a}', _PIECES) for m, d, a in ((7, 3, 0), (4, 7, 3), (11, 5, 1), (2, 11, 8)))} AS text FROM {{pages}}"
HEADERS = f"SELECT page_id AS doc_id, 0 AS page_idx, idx, CASE WHEN (page_id + idx) % 9 = 4 THEN 'footer' ELSE 'header' END AS type, CAST((idx * (page_id % 5 + 1) + page_id // 64) % 7 AS INT) AS index, {_pick('page_id * (2 * idx + 3) + page_id // 17 * idx + idx * idx', _HEADERS)} AS text FROM {{pages}} CROSS JOIN (SELECT CAST(n AS INT) AS idx FROM (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) x) y"


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, COVERS.replace("//", "div"), "pages")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, HEADERS.replace("//", "div"), "pages")


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace("VARCHAR(20)", "STRING"), **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ISSUES, "events")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PARTS, "events")


def parts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`parts` as a stream over the same table."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: a path must be a folder
    return spark.sql(PARTS.replace("VARCHAR(20)", "STRING"), events=events)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SPANS, "customer")


def duck(sql: str, name: str) -> str:
    return sql.replace("{{", "<<").replace("}}", ">>").replace(f"{{{name}}}", name).replace("<<", "{").replace(">>", "}")
