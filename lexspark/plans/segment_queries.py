"""Registered queries: lines, sections, scopes, retrieval and coverage over the standard corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import retrieve as R
from lexspark.operators import review
from lexspark.operators import segment as S
from lexspark.plans import sql as Q
from lexspark.sources.std_corpus import rules, std_corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _zoned(spark, sf_dir):
    return S.zones(S.lines(std_corpus(spark, sf_dir)))


def _scopes(spark, sf_dir):
    return S.scope_text(_zoned(spark, sf_dir))


_REQ = f"rules AS ({Q.RULES}), targets AS (SELECT unnest(CASE WHEN targets = '' THEN [scope] ELSE string_split(targets, ',') END) AS scope, chunk_id, title, content, ord FROM rules), required AS (SELECT scope, arg_min(chunk_id, ord) AS rule_id, arg_min(title, ord) AS rule_name FROM targets GROUP BY scope)"
_COVER = f"{_REQ}, missing AS (SELECT c.doc_id, r.scope, r.rule_id, r.rule_name FROM corpus c, required r WHERE NOT EXISTS (SELECT 1 FROM scopes s WHERE s.doc_id = c.doc_id AND s.scope = r.scope))"


@query(Q.over_sections("SELECT rule_id, scope, count(*) AS documents FROM missing GROUP BY rule_id, scope", _COVER))
def coverage_warnings(spark, sf_dir):
    """rules' required scopes that documents lack, counted by rule."""
    found = review.coverage_issues(std_corpus(spark, sf_dir).select("doc_id"), S.held_scopes(_zoned(spark, sf_dir)), rules(spark))
    return found.groupBy("rule_id", "scope").agg(F.count(F.lit(1)).alias("documents"))


@query(Q.over_sections("SELECT doc_id, scope, rule_id, rule_name, 'COVERAGE-' || rule_id || '-' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY scope)::VARCHAR, 3, '0') AS issue_id, 'warn' AS status FROM missing", _COVER))
def coverage_issues(spark, sf_dir):
    """One warning for each required scope that a document lacks."""
    return review.coverage_issues(std_corpus(spark, sf_dir).select("doc_id"), S.held_scopes(_zoned(spark, sf_dir)), rules(spark)).select("doc_id", "scope", "rule_id", "rule_name", "issue_id", "status")


@query(Q.over_lines("SELECT doc_id, line_no, line FROM ln"))
def explode_lines(spark, sf_dir):
    """P1."""
    return S.lines(std_corpus(spark, sf_dir))


@query(Q.over_lines("SELECT doc_id, line_no, line FROM ln WHERE line_no BETWEEN 3 AND 6"))
def slice_lines(spark, sf_dir):
    """P2."""
    return S.slice_lines(S.lines(std_corpus(spark, sf_dir)), 3, 6)


@query(Q.over_zones("SELECT doc_id, line_no, head, kind FROM h2 WHERE head <> ''"))
def headings(spark, sf_dir):
    """D1, D2, F5, F6."""
    rows = S.lines(std_corpus(spark, sf_dir)).withColumn("head", T.heading_content(F.col("line")))
    return rows.where("head <> ''").select("doc_id", "line_no", "head", T.classify(F.col("head")).alias("kind"))


@query(Q.over_zones("SELECT doc_id, min(line_no) FILTER (toc_title) AS toc_start, min(line_no) FILTER (zone = 'body') AS body_start FROM zoned GROUP BY doc_id"))
def body_start(spark, sf_dir):
    """Where contents and body begin."""
    return _zoned(spark, sf_dir).groupBy("doc_id").agg(F.min(F.when(F.col("_toc_title"), F.col("line_no"))).alias("toc_start"), F.min(F.when(F.col("zone") == "body", F.col("line_no"))).alias("body_start"))


@query(Q.over_sections("SELECT doc_id, ord, scope, heading, text, line_start, line_end FROM sections"))
def sections(spark, sf_dir):
    """D8, D9, D10, D13, W1, W2."""
    return S.sections(_zoned(spark, sf_dir))


@query(Q.over_sections("SELECT doc_id, scope, text FROM scopes"))
def scope_texts(spark, sf_dir):
    """Text by scope, ``end`` included."""
    return _scopes(spark, sf_dir)


@query(Q.over_sections(f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM (SELECT *, coalesce(min(CASE WHEN scope = 'scope' THEN ord END) OVER (PARTITION BY doc_id), 0) AS f FROM sections) WHERE scope IN ({Q.BODY}) AND ord >= f GROUP BY doc_id"))
def body_texts(spark, sf_dir):
    """D12."""
    return S.body_text(S.sections(_zoned(spark, sf_dir)))


@query(Q.over_sections("SELECT doc_id, count(DISTINCT scope) AS filled, sum(length(text))::BIGINT AS chars FROM scopes GROUP BY doc_id"))
def scope_maps(spark, sf_dir):
    """The scope map and the lengths in it."""
    m = S.scope_map(_scopes(spark, sf_dir))
    return m.select("doc_id", F.size(F.map_filter("scopes", lambda k, v: v != "")).cast("long").alias("filled"), F.aggregate(F.map_values("scopes"), F.lit(0).cast("long"), lambda s, v: s + F.length(v)).alias("chars"))


@query(Q.over_zones("SELECT doc_id, zone, min(line_no) AS line_start, max(line_no) AS line_end FROM zoned WHERE held <> '' GROUP BY doc_id, zone"))
def line_ranges(spark, sf_dir):
    """D13."""
    return S.line_ranges(_zoned(spark, sf_dir))


_ITEM = Q.strip(Q.sub(Q.strip(Q.sub("(CASE WHEN starts_with(held, '#') THEN head ELSE held END)", r"(?i)\.{3,}[\x09-\x0D\x20]*(?:[0-9]+|[IVXLCM]+)[\x09-\x0D\x20]*$")), r"(?i)[\x09-\x0D\x20]+(?:[0-9]+|[IVXLCM]+)[\x09-\x0D\x20]*$"))


@query(Q.over_zones(f"SELECT * FROM (SELECT doc_id, line_no, {Q.squeeze(_ITEM)} AS title FROM zoned WHERE zone = 'toc' AND held <> '' AND NOT toc_title AND (NOT starts_with(held, '#') OR head <> '')) WHERE title <> ''"))
def toc_items(spark, sf_dir):
    """D21."""
    return S.toc_items(_zoned(spark, sf_dir))


@query(Q.over_lines(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS para, text FROM (
SELECT doc_id, para, string_agg(line, chr(10) ORDER BY line_no) AS text FROM (
  SELECT *, sum(gap::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS para FROM (
    SELECT *, {Q.strip('line')} = '' AND sum(starts_with({Q.strip('line')}, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 = 0 AS gap FROM ln))
WHERE NOT gap GROUP BY doc_id, para)"""))
def fenced_paragraphs(spark, sf_dir):
    """Blank lines inside a code fence don't part paragraphs."""
    return S.paragraphs(S.lines(std_corpus(spark, sf_dir))).select("doc_id", "para", "text")


@query(Q.over_sections("SELECT doc_id, string_agg('# ' || scope || chr(10) || text, chr(10) || chr(10) ORDER BY CASE scope WHEN 'foreword' THEN 1 WHEN 'scope' THEN 2 ELSE 3 END) AS text FROM scopes WHERE scope IN ('foreword', 'scope', 'appendix') GROUP BY doc_id"))
def restricted_view(spark, sf_dir):
    """Three active scopes in canonical order, with headers."""
    return S.restrict(_scopes(spark, sf_dir), ["scope", "appendix", "foreword"], partial=True)


@query(Q.over_sections("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS ord, scope, heading FROM (SELECT doc_id, CASE scope WHEN 'cover' THEN -2 ELSE -1 END AS o, scope, scope AS heading FROM scopes WHERE scope IN ('cover', 'toc') UNION ALL SELECT doc_id, ord, scope, heading FROM sections)"))
def ordered_units(spark, sf_dir):
    """D24."""
    return S.units(_zoned(spark, sf_dir)).select("doc_id", "ord", "scope", "heading")


_BUDGET = """SELECT doc_id, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS taken, sum(n)::BIGINT AS chars FROM (
  SELECT *, max((total > 2200 AND i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS over FROM (
    SELECT doc_id, ord, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM sections))
WHERE over = 0 GROUP BY doc_id"""


@query(Q.over_sections(_BUDGET))
def character_budget(spark, sf_dir):
    """Sections while the running total fits, at least one."""
    kept = review.within_budget(S.sections(_zoned(spark, sf_dir)), 2200)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("taken"), F.sum(F.length("text")).cast("long").alias("chars"))


_PRESENT = f"rules AS ({Q.RULES}), want AS (SELECT * FROM rules WHERE analysis_mode = 'local'), lacks AS (SELECT c.doc_id, w.chunk_id, w.scope, w.ord FROM corpus c, want w WHERE NOT EXISTS (SELECT 1 FROM scopes s WHERE s.doc_id = c.doc_id AND s.scope = w.scope))"


@query(Q.over_sections("SELECT doc_id, chunk_id AS rule_id, scope, 'insufficient_context' AS status, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS issue_no FROM lacks", _PRESENT))
def presence_issues(spark, sf_dir):
    """Local rules whose scope has no text."""
    return review.presence_issues(std_corpus(spark, sf_dir).select("doc_id"), rules(spark), S.held_scopes(_zoned(spark, sf_dir))).select("doc_id", "rule_id", "scope", "status", "issue_no")


_PLAN = f"rules AS ({Q.RULES}), plan AS (SELECT c.doc_id, r.chunk_id, r.analysis_mode, coalesce(length(s.text), 0) AS n FROM corpus c CROSS JOIN rules r LEFT JOIN scopes s ON s.doc_id = c.doc_id AND s.scope = r.scope)"


@query(Q.over_sections("SELECT chunk_id, CASE WHEN analysis_mode = 'full_document' THEN 'full_document' WHEN analysis_mode = 'cross_section' THEN 'cross_section' WHEN analysis_mode = 'deterministic' OR n < 40 THEN 'skip' WHEN n > 3600 THEN 'window' ELSE 'single' END AS strategy, count(*) AS plans FROM plan GROUP BY ALL", _PLAN))
def strategy_counts(spark, sf_dir):
    """How each rule would be judged, by context length."""
    plans = review.plans(std_corpus(spark, sf_dir).select("doc_id"), rules(spark), S.scope_sizes(_zoned(spark, sf_dir)))
    return plans.groupBy("chunk_id", "strategy").agg(F.count(F.lit(1)).alias("plans"))


_TFIDF = """tok AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
n AS (SELECT count(*) AS n FROM benchmark),
weights AS (SELECT term, count(*) AS df, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM post GROUP BY term)"""
_INDEX = """raw AS (SELECT id, term, tf * idf AS w FROM post JOIN weights USING (term)),
idx AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
qtok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents WHERE doc_id % 20 = 0),
qraw AS (SELECT id, term, count(*) * any_value(idf) AS w FROM qtok JOIN weights USING (term) GROUP BY id, term),
qv AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM qraw),
score AS (SELECT q.id AS query_id, i.id, round(sum(q.w * i.w), 6) AS score FROM qv q JOIN idx i USING (term) GROUP BY q.id, i.id)"""


def _index(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    post = R.postings(bench, "item_id", "text")
    return post, R.idf(post, bench.agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_TFIDF} SELECT term, df, round(idf, 6) AS idf FROM weights")
def inverse_frequencies(spark, sf_dir):
    """R2, R3."""
    return _index(spark, sf_dir)[1].select("term", "df", F.round("idf", 6).alias("idf"))


_SPACED = """stok AS (SELECT item_id AS id, unnest(list_filter(string_split_regex(lower(text), '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{3000}]+'), lambda x: x <> '')) AS term FROM benchmark),
sw AS (SELECT term, count(DISTINCT id) AS df, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(DISTINCT id))) + 1 AS idf FROM stok GROUP BY term)""".replace("\\\\", "\\")


def _spaced(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return bench, R.idf(R.postings(bench, "item_id", "text", "spaces"), bench.agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_SPACED} SELECT term, df, round(idf, 6) AS idf FROM sw")
def spaced_frequencies(spark, sf_dir):
    """R2: terms between white space, as the fallback index has them."""
    return _spaced(spark, sf_dir)[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_SPACED}, d AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text), '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{3000}}]+'), lambda x: x <> '') AS ts FROM benchmark),
q AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{3000}}]+'), lambda x: x <> '') AS ts FROM documents WHERE doc_id % 20 = 0),
dv AS (SELECT d.id, i AS pos, coalesce(idf, 1.0)::DOUBLE AS w FROM d, unnest(range(1, least(32, len(ts)) + 1)) AS u(i) LEFT JOIN sw ON sw.term = ts[i]),
qv AS (SELECT q.id, i AS pos, len(list_filter(ts, lambda x: x = ts[i])) * coalesce(idf, 1.0)::DOUBLE AS w FROM q, unnest(range(1, least(32, len(ts)) + 1)) AS u(i) LEFT JOIN sw ON sw.term = ts[i]),
s AS (SELECT a.id AS query_id, b.id, round(sum(a.w * b.w) / sqrt(any_value(a.n)) / sqrt(any_value(b.n)), 6) AS score FROM (SELECT *, sum(w * w) OVER (PARTITION BY id) AS n FROM qv) a JOIN (SELECT *, sum(w * w) OVER (PARTITION BY id) AS n FROM dv) b USING (pos) GROUP BY ALL)
SELECT query_id, count(*) AS n, max(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5 GROUP BY query_id""".replace("\\\\", "\\"))
def positional_top_k(spark, sf_dir):
    """Vectors by position, the fallback's slots, every twentieth document against all items."""
    bench, weights = _spaced(spark, sf_dir)
    ask = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 20 = 0")
    top = R.positional_search(R.positional(ask, "doc_id", "text", weights, 32, counted=True), R.positional(bench, "item_id", "text", weights, 32), 5)
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def _asked(spark, sf_dir):
    """The stated query set and the whole index, as vectors."""
    post, weights = _index(spark, sf_dir)
    ask = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 20 = 0")
    return R.tfidf(R.postings(ask, "doc_id", "text"), weights), R.tfidf(post, weights)


@query(f"WITH {_TFIDF}, {_INDEX} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM score) WHERE rank <= 8")
def cosine_top_k(spark, sf_dir):
    """R4, R5, L1, W3."""
    return R.search(*_asked(spark, sf_dir), 8)


@query(f"WITH {_TFIDF}, {_INDEX}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM score), b AS (SELECT * FROM a WHERE r <= 24 AND id % 3 = 0) SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 8")
def search_post_filter(spark, sf_dir):
    """Over-fetch, then match, then k."""
    return R.search_post_filter(*_asked(spark, sf_dir), F.col("id") % 3 == 0, 8)


@query(f"WITH {_TFIDF}, {_INDEX}, b AS (SELECT * FROM score WHERE id % 3 = 0) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 8 AND score > 0")
def search_pre_filter(spark, sf_dir):
    """Match, then k, then scores above zero."""
    return R.search_pre_filter(*_asked(spark, sf_dir), F.col("id") % 3 == 0, 8)


@query(f"WITH {_TFIDF}, {_INDEX}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM score) SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY r) AS ids, count(*) AS n FROM a WHERE r <= 8 GROUP BY query_id")
def retrieval_trace(spark, sf_dir):
    """Ids that each query got."""
    top = R.search(*_asked(spark, sf_dir), 8)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


@query("""SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) <= 5""")
def dense_top_k(spark, sf_dir):
    """Cosine of dense vectors, every twentieth row against all rows of its label."""
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vec.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return R.dense_search(rows, rows.where("id % 20 = 0"), 5)
