"""A corpus of standard-style documents, derived row by row from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL that Spark and DuckDB read alike but for the marks in angle brackets.  ``k`` picks the parts that a document has.
#: Lines are dealt to the seven parts by their number modulo 7, so every line of a text is somewhere: those of a part that
#: a document does not have go to chapter 5.
SQL = """
SELECT doc_id, file_name,
  '标准正式编号：GB/T ' || CAST(1000 + k AS VARCHAR(20)) || '-' || CAST(2000 + k % 25 AS VARCHAR(20)) || chr(10)
  || CASE WHEN k % 3 = 0 THEN '代替GB/T ' || CAST(1000 + k AS VARCHAR(20)) || '-' || CAST(1990 + k % 9 AS VARCHAR(20)) || chr(10) ELSE '' END
  || CASE WHEN k % 4 <> 3 THEN '# 目次' || chr(10) || '前言 I' || chr(10) || '1 范围 1' || chr(10) || '2 规范性引用文件 1' || chr(10) || '3 术语和定义 ' || CAST(2 + k % 3 AS VARCHAR(20)) || chr(10) ELSE '' END
  || CASE WHEN k % 5 <> 4 THEN '# 前言' || chr(10) || p1 || chr(10) ELSE '' END
  || '# 1 范围' || chr(10) || p2 || chr(10)
  || CASE WHEN k % 6 <> 5 THEN '# 2 规范性引用文件' || chr(10) || p3 || chr(10) ELSE '' END
  || CASE WHEN k % 7 <> 6 THEN CASE WHEN k % 10 = 0 THEN '# 4 术语和定义' ELSE '# 3 术语和定义' END || chr(10) || p4 || chr(10) ELSE '' END
  || '# 5 要求' || chr(10) || p5 || chr(10)
  || CASE WHEN k % 5 = 4 THEN p1 || chr(10) ELSE '' END
  || CASE WHEN k % 6 = 5 THEN p3 || chr(10) ELSE '' END
  || CASE WHEN k % 7 = 6 THEN p4 || chr(10) ELSE '' END
  || CASE WHEN k % 2 <> 0 THEN p6 || chr(10) || p7 || chr(10) ELSE '' END
  || CASE WHEN k % 11 = 0 THEN '```' || chr(10) || 'x = 1' || chr(10) || chr(10) || 'y = 2' || chr(10) || '```' || chr(10) ELSE '' END
  || CASE WHEN k % 8 = 0 THEN '5.1 一般要求' || chr(10) || '应符合下列要求。' || chr(10) || '5.1.1' || chr(10) || '5.1.2 特殊要求' || chr(10) ELSE '' END
  || CASE WHEN k % 2 = 0 THEN '# 附录 A' || chr(10) || p6 || chr(10) || '# 说明' || chr(10) || p7 || chr(10) ELSE '' END AS text
FROM (SELECT doc_id, doc_id AS k, source || '_' || CAST(doc_id AS VARCHAR(20)) || '.md' AS file_name, <parts>
  FROM (SELECT doc_id, source, <lines> AS ls FROM {documents}) x) d
"""


def _dialect(lines: str, part: str, first: int) -> str:
    parts = ", ".join(f"{part.format((i + first) % 7)} AS p{i + 1}" for i in range(7))
    return SQL.replace("<lines>", lines).replace("<parts>", parts)


SPARK_SQL = _dialect("split(coalesce(text, ''), '\\n')", "array_join(filter(ls, (x, i) -> i % 7 = {}), chr(10))", 0).replace("VARCHAR(20)", "STRING")
DUCK_SQL = _dialect("string_split(coalesce(text, ''), chr(10))", "array_to_string(list_filter(ls, lambda x, i: i % 7 = {}), chr(10))", 1).replace("{documents}", "documents")

#: (chunk_id, title, scope, content, analysis_mode, targets joined by comma)
RULES = (
    ("N-01", "范围", "scope", "应写明适用对象和界限。 scope", "local", "scope"),
    ("N-02", "规范性引用文件", "normative_references", "应列出引用的文件。 references", "local", "normative_references"),
    ("N-03", "术语和定义", "terms_definitions", "应给出术语，或说明没有术语。 terms", "local", "terms_definitions"),
    ("N-04", "前言", "foreword", "应写明起草依据。 foreword", "local", "foreword"),
    ("N-05", "目次", "toc", "应与正文标题一致。 toc", "cross_section", "toc,scope,terms_definitions"),
    ("N-06", "附录", "appendix", "应在正文中提及。 appendix", "cross_section", "appendix,other_body"),
    ("N-07", "全文", "full_document", "用语应统一。 all", "full_document", ""),
    ("N-08", "章编号", "format", "应连续编号。 format", "deterministic", "scope,normative_references"),
)


def rules_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + f", {i})" for i, r in enumerate(RULES))
    return f"SELECT * FROM (VALUES {rows}) AS r(chunk_id, title, scope, content, analysis_mode, targets, ord)"


def std_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_SQL, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def rules(spark: SparkSession) -> DataFrame:
    """The rule book as rows, with targets as an array."""
    return spark.sql(rules_sql()).withColumn("target_scopes", F.when(F.col("targets") == "", F.array().cast("array<string>")).otherwise(F.split("targets", ",")))
