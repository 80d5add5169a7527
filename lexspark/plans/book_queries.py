"""Registered queries: rule books, image names, contents lists, dense and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import images, metadata, review, rulebook
from lexspark.operators import segment as S
from lexspark.plans import sql as Q
from lexspark.sources import derived
from lexspark.sources.std_corpus import std_corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


_TITLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(replace(title, ' ', ''), '{w}')" for w in words) + f" THEN '{scope}'" for scope, words in rulebook.TITLE_SCOPES) + " ELSE 'other_body' END"
_BOOK = f"""m0 AS (SELECT *, regexp_extract(line, '^(#{{1,2}})[\\x09-\\x0D\\x20]+(.+?)[\\x09-\\x0D\\x20]*$', 1) AS mark, {Q.strip("regexp_extract(line, '^(#{1,2})[\\x09-\\x0D\\x20]+(.+?)[\\x09-\\x0D\\x20]*$', 2)")} AS own FROM ln),
m1 AS (SELECT *, sum((mark <> '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM m0),
m2 AS (SELECT *, max(own) OVER (PARTITION BY doc_id, sec) AS title FROM m1 WHERE sec > 0),
m3 AS (SELECT *, {Q.strip('line')} = '' AND sum(starts_with({Q.strip('line')}, '```')::INT) OVER (PARTITION BY doc_id, sec ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 = 0 AS gap FROM m2 WHERE mark = ''),
m4 AS (SELECT *, sum(gap::INT) OVER (PARTITION BY doc_id, sec ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS para FROM m3),
m5 AS (SELECT doc_id, sec, title, para, {Q.strip("string_agg(line, chr(10) ORDER BY line_no)")} AS content FROM m4 WHERE NOT gap GROUP BY ALL),
chunks AS (SELECT doc_id, format('RAG-{{:04d}}', row_number() OVER (PARTITION BY doc_id ORDER BY sec, para)) AS chunk_id, title, {_TITLE} AS scope, content, '#' || title || '-p' || row_number() OVER (PARTITION BY doc_id, sec ORDER BY para) AS source_ref FROM m5 WHERE content <> '')"""


def _chunks(spark, sf_dir):
    return rulebook.rule_chunks(S.lines(std_corpus(spark, sf_dir)))


@query(f"WITH {Q.LINES}, {_BOOK} SELECT doc_id, chunk_id, title, scope, content, source_ref FROM chunks")
def rule_chunks(spark, sf_dir):
    """Every document read as a rule book."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk_id", "title", "scope", "content", "source_ref")


@query(f"WITH {Q.LINES}, {_BOOK} SELECT 'scope' AS kind, scope AS value, count(*) AS n FROM chunks GROUP BY scope UNION ALL SELECT 'mode', 'local', count(*) FROM chunks")
def rule_distribution(spark, sf_dir):
    """G4, D19."""
    return rulebook.distribution(_chunks(spark, sf_dir))


@query(f"WITH {Q.LINES}, {_BOOK} SELECT doc_id, sha256(string_agg(content, chr(10) ORDER BY chunk_id)) AS rules_hash, count(*) AS n_rules FROM chunks GROUP BY doc_id")
def rules_hashes(spark, sf_dir):
    """G21, G23."""
    return rulebook.rules_hash(_chunks(spark, sf_dir))


@query(f"WITH {Q.LINES}, {_BOOK} SELECT doc_id, chunk_id FROM chunks WHERE scope IN ('scope', 'foreword')")
def partial_rules(spark, sf_dir):
    """Rules of a review of two scopes."""
    return rulebook.rules_for_mode(rulebook.content_rules(_chunks(spark, sf_dir)), ["scope", "foreword"], False).select("doc_id", "chunk_id")


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE strlen(text) <= 100")
def short_texts(spark, sf_dir):
    """Texts that a cap of 100 bytes leaves whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(T.truncate_bytes(F.col("text"), 100) == F.col("text")).select("doc_id", F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, text, strlen(text)::INT AS bytes FROM (SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE substr(text, 1, list_max(list_filter(range(249, 1001), lambda k: strlen(substr(text, 1, k)) <= 1000))) END AS text FROM documents)")
def truncated_texts(spark, sf_dir):
    """Every text cut at 1000 bytes, no character cut in two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.truncate_bytes(F.col("text"), 1000).alias("text")).withColumn("bytes", F.octet_length("text"))


@query(f"WITH {Q.LINES} SELECT doc_id, CASE WHEN strpos(text, chr(10) || '# 4 ') > 1 THEN substr(text, 1, strpos(text, chr(10) || '# 4 ')) ELSE text END AS text FROM corpus")
def front_matter(spark, sf_dir):
    """P3."""
    return std_corpus(spark, sf_dir).select("doc_id", T.front_matter(F.col("text")).alias("text"))


def _content_lists(spark, sf_dir):
    """A content list of every line of a text, each followed by an image or a table."""
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    block = lambda kind, text, path, fig, tab: F.struct(F.lit(kind).alias("type"), text.alias("text"), path.alias("img_path"), fig.alias("image_caption"), tab.alias("table_caption"))

    def around(line, i):
        path = lambda k: F.concat(F.lit(f"images/{k}"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"), F.lit(".jpg"))
        lettered, figure = block("image", none, path("a"), F.array(F.lit("a）")), empty), block("image", none, path("b"), F.array(F.concat(F.lit("图"), F.col("source"))), empty)
        table = block("table", none, path("c"), empty, F.array(F.lit("note"), F.concat(F.lit("表"), F.col("source"))))
        return F.array(block("text", line, none, empty, empty), F.when(i % 4 == 0, lettered).when(i % 4 == 1, figure).when(i % 4 == 2, table).otherwise(block("image", none, path("d"), empty, empty)))

    listed = F.to_json(F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), around)))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.concat(F.lit('{"items": '), listed, F.lit("}"))).alias("content_list"))


@query(f"""WITH l AS (SELECT doc_id, source, i, {Q.strip("ls[i + 1]")} AS s FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(0, len(ls))) AS u(i)),
t AS (SELECT *, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM l)
SELECT doc_id, CASE i % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || doc_id || '_' || i || '.jpg' AS old_name, CASE i % 4 WHEN 0 THEN regexp_replace(r, '[。，、；：,.;:!?！？]+$', '') || 'a）' WHEN 1 THEN '图' || source ELSE '表' || source END AS suggested FROM t WHERE i % 4 IN (1, 2) OR (i % 4 = 0 AND r IS NOT NULL)""")
def image_names(spark, sf_dir):
    """Names from captions, or from the last text before, over all lines."""
    return images.image_names(images.content_blocks(_content_lists(spark, sf_dir))).drop("ord")


@query(f"""WITH corpus AS ({derived.duck(derived.COVERS, 'pages')}), {Q.cover('corpus')}, r AS (SELECT *, 'X' || replaced AS num, CASE WHEN doc_id % 3 = 0 THEN '行业标准' ELSE '' END AS lvl FROM cover)
SELECT doc_id, '标准号' AS field, number AS hint, num AS actual FROM r WHERE number <> '' UNION ALL SELECT doc_id, '标准层级', hierarchy, lvl FROM r WHERE hierarchy <> '' AND lvl <> '' AND hierarchy <> lvl""")
def hint_conflicts(spark, sf_dir):
    """Cover and record disagree."""
    cover = derived.covers(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in metadata.cover_fields(F.col("text")).items()])
    record = cover.select("doc_id", F.concat(F.lit("X"), "replaced").alias("标准号"), F.when(F.col("doc_id") % 3 == 0, "行业标准").otherwise("").alias("标准层级"))
    return metadata.hint_conflicts(record, cover.select("doc_id", "number", "hierarchy")).select("doc_id", "field", "hint", "actual")


@query(f"WITH corpus AS ({derived.duck(derived.COVERS, 'pages')}), {Q.cover('corpus')} SELECT doc_id, replaced AS replaced0, coalesce(nullif(replaced, ''), number) AS filled FROM cover")
def filled_blanks(spark, sf_dir):
    """J8."""
    cover = derived.covers(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in metadata.cover_fields(F.col("text")).items()])
    got = metadata.fill_blank(cover.select("doc_id", F.col("replaced").alias("v")), cover.select("doc_id", F.col("number").alias("v")), "doc_id", ["v"])
    return cover.select("doc_id", F.col("replaced").alias("replaced0")).join(got.withColumnRenamed("v", "filled"), "doc_id")


_ROUND = "CASE WHEN analysis_mode IN ('full_document', 'cross_section') THEN true WHEN analysis_mode = 'deterministic' THEN false ELSE n >= 40 END"


@query(Q.over_sections(f"SELECT doc_id, chunk_id AS rule_id, 'insufficient_context' AS status, 1::INT AS round FROM one WHERE {_ROUND} UNION ALL SELECT w.doc_id, r.chunk_id, 'insufficient_context', 2 FROM (SELECT doc_id, sum(length(text)) + 2 * (count(*) - 1) AS n FROM scopes WHERE scope <> 'end' GROUP BY doc_id) w CROSS JOIN rules r WHERE w.doc_id IN (SELECT doc_id FROM one WHERE {_ROUND}) AND {_ROUND}", f"rules AS ({Q.RULES}), one AS (SELECT c.doc_id, r.chunk_id, r.analysis_mode, coalesce(length(s.text), 0) AS n FROM corpus c CROSS JOIN rules r LEFT JOIN scopes s ON s.doc_id = c.doc_id AND s.scope = r.scope)"))
def review_loop(spark, sf_dir):
    """Plans judged offline, then judged again in full where context was missing."""
    from lexspark.sources.std_corpus import rules

    docs = std_corpus(spark, sf_dir)
    zoned = S.zones(S.lines(docs))
    scopes = S.scope_text(zoned)
    return review.run_review(docs.select("doc_id"), scopes, rules(spark))


_MARKED = "CASE WHEN line LIKE '# %' THEN CASE line_no % 3 WHEN 0 THEN '## [ab-' || CAST(line_no % 100 AS VARCHAR(20)) || '] ' WHEN 1 THEN '### ' ELSE '#### R_' || CAST(line_no % 10 AS VARCHAR(20)) || ' ' END || substr(line, 3) ELSE line END"
_RULE_TITLE = Q.strip(r"regexp_extract(line, '^#{2,6}[\x09-\x0D\x20]*([^#\x09-\x0D\x20].*?)[\x09-\x0D\x20]*$', 1)")


@query(f"""WITH {Q.LINES}, k0 AS (SELECT doc_id, line_no, {_MARKED} AS line FROM ln), k1 AS (SELECT *, {_RULE_TITLE} AS title FROM k0),
k2 AS (SELECT *, sum((title <> '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM k1),
k3 AS (SELECT doc_id, n, max(title) AS title, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (title = ''), '') AS body FROM k2 WHERE n > 0 GROUP BY doc_id, n)
SELECT doc_id, coalesce(nullif(upper(regexp_extract(title, '(?i)([A-Z]{{1,4}}[-_][0-9]{{1,4}})', 1)), ''), format('R-{{:03d}}', n::INT)) AS rule_id, coalesce(nullif({Q.strip("regexp_replace(title, '^[\\[【]?[A-Za-z0-9_.-]+[\\]】]?[\\x09-\\x0D\\x20]*', '')")}, ''), title) AS rule_name, {Q.strip('body')} AS text FROM k3""".replace("\\\\", "\\"))
def rule_headings(spark, sf_dir):
    """The other form of a book: a rule at each heading of level two to six, by the id in its title or its number."""
    rows = S.lines(std_corpus(spark, sf_dir)).select("doc_id", "line_no", F.expr(_MARKED.replace("VARCHAR(20)", "STRING")).alias("line"))
    return rulebook.rule_headings(rows)
