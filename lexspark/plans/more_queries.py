"""Registered queries: scope keys, retrieval by scope, contexts, numbering, pages, records, artifacts, messages, scans and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import audit, full_review, images, metadata, nested, numbering, records, rulebook, scopes
from lexspark.operators import retrieve as R
from lexspark.operators import segment as S
from lexspark.plans import book_queries, record_queries
from lexspark.plans import sql as Q
from lexspark.sources import derived, files, sinks
from lexspark.sources.shared import dealt, new_folder
from lexspark.sources.std_corpus import rules, std_corpus
from lexspark.streaming import events as E

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zoned(spark, sf_dir):
    return S.zones(S.lines(std_corpus(spark, sf_dir)))


_ORDER = "CASE scope " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(T.SCOPES)) + " END"
_ALIAS = "CASE v " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scopes.ALIASES.items()) + " ELSE v END"


@query(f"""WITH k AS (SELECT doc_id, [CASE doc_id % 4 WHEN 0 THEN '术语' WHEN 1 THEN ' 范围 ' WHEN 2 THEN '' ELSE 'own' END, CASE doc_id % 3 WHEN 0 THEN 'scope' WHEN 1 THEN '术语和定义' ELSE NULL END, ' 目录', lang] AS ks FROM documents),
n AS (SELECT doc_id, list_transform(list_filter(list_transform(ks, lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), lambda v: {_ALIAS}) AS l FROM k)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS keys FROM n""")
def normalized_keys(spark, sf_dir):
    """P5: names of scopes to keys, without blanks and repeats, in order of first use."""
    k = F.col("doc_id")
    keys = F.array(F.when(k % 4 == 0, "术语").when(k % 4 == 1, " 范围 ").when(k % 4 == 2, "").otherwise("own"), F.when(k % 3 == 0, "scope").when(k % 3 == 1, "术语和定义"), F.lit(" 目录"), F.col("lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(scopes.normalize_keys(keys), ",").alias("keys"))


@query(Q.over_sections("SELECT c.doc_id, coalesce(s.keys, 'full_document') AS keys, s.keys IS NULL AS warned FROM corpus c LEFT JOIN (SELECT doc_id, string_agg(scope, ',' ORDER BY scope) AS keys FROM scopes WHERE scope IN ('toc', 'references', 'appendix') GROUP BY doc_id) s USING (doc_id)"))
def selected_scopes(spark, sf_dir):
    """Requested entries of the scope map, or the whole document and a warning."""
    maps = S.scope_map(S.scope_text(_zoned(spark, sf_dir))).join(std_corpus(spark, sf_dir).select("doc_id", "text"), "doc_id")
    out = scopes.select_scopes(maps, ["toc", "references", "appendix"])
    return out.select("doc_id", F.array_join(F.array_sort(F.map_keys("selected")), ",").alias("keys"), F.col("warning").isNotNull().alias("warned"))


@query(Q.over_sections(f"""SELECT b.doc_id, string_agg(scope, ',' ORDER BY {_ORDER}) AS expanded, coalesce(string_agg(scope, ',' ORDER BY {_ORDER}) FILTER (NOT own), '') AS added FROM (
SELECT doc_id, scope, bool_or(own) AS own FROM (SELECT doc_id, scope, true AS own FROM scopes UNION ALL SELECT DISTINCT s.doc_id, t.scope, false FROM scopes s JOIN aims a ON s.scope = a.scope JOIN aims t ON a.chunk_id = t.chunk_id) GROUP BY ALL) b GROUP BY b.doc_id""", f"rules AS ({Q.RULES}), aims AS (SELECT chunk_id, unnest(string_split(targets, ',')) AS scope FROM rules WHERE analysis_mode = 'cross_section')"))
def expanded_scopes(spark, sf_dir):
    """A document's scopes joined by the targets of cross-section rules that aim at one of them."""
    keys = S.held_scopes(_zoned(spark, sf_dir)).withColumnRenamed("scopes", "keys")
    out = scopes.expand_scopes(keys, rules(spark))
    return out.select("doc_id", F.array_join("expanded", ",").alias("expanded"), F.array_join("added", ",").alias("added"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'full' WHEN 1 THEN 'content' WHEN 2 THEN 'format' WHEN 3 THEN 'partial' WHEN 4 THEN 'chapters' WHEN 5 THEN 'format_partial' WHEN 6 THEN event_type ELSE NULL END AS mode, event_id % 3 <> 0 AS has_content, event_id % 5 <> 0 AS has_source, event_id % 7 <> 0 AS given FROM events),
m AS (SELECT *, coalesce(mode IN ('full', 'content', 'partial', 'chapters'), false) AS content, coalesce(mode IN ('full', 'format', 'format_partial'), false) AS formal, coalesce(mode IN ('partial', 'chapters', 'format_partial'), false) AS partial FROM r)
SELECT event_id, content, formal AND NOT content AS format_only, partial, CASE WHEN NOT content AND NOT formal THEN 'unknown mode' WHEN content AND NOT has_content THEN 'content is missing' WHEN formal AND NOT has_source THEN 'source is missing' WHEN partial AND NOT given THEN 'scopes are missing' END AS error FROM m""")
def review_modes(spark, sf_dir):
    """What a request asks for, and what it lacks."""
    e = F.col("event_id")
    mode = F.when(e % 8 == 6, F.col("event_type"))
    for i, m in enumerate(("full", "content", "format", "partial", "chapters", "format_partial")):
        mode = F.when(e % 8 == i, m).otherwise(mode)
    none = F.array().cast("array<string>")
    asked = _table(spark, sf_dir, "events").select("event_id", mode.alias("mode"), (e % 3 != 0).alias("has_content"), (e % 5 != 0).alias("has_source"), F.when(e % 7 != 0, F.array(F.lit("scope"))).otherwise(none).alias("scopes"))
    return scopes.resolve_mode(asked).select("event_id", "content", "format_only", "partial", "error")


@query(Q.over_sections(f"""SELECT doc_id, string_agg(scope, ',' ORDER BY {_ORDER}) AS scopes FROM (SELECT *, scope IN ('foreword', CASE doc_id % 3 WHEN 0 THEN 'appendix' WHEN 1 THEN 'index' ELSE 'toc' END) AS hit, bool_or(scope IN ('foreword', CASE doc_id % 3 WHEN 0 THEN 'appendix' WHEN 1 THEN 'index' ELSE 'toc' END)) OVER (PARTITION BY doc_id) AS anyhit FROM scopes) WHERE hit OR NOT anyhit GROUP BY doc_id"""))
def requested_scopes(spark, sf_dir):
    """Active scopes that are requested, all of them where none is."""
    wanted = F.array(F.lit("foreword"), F.when(F.col("doc_id") % 3 == 0, "appendix").when(F.col("doc_id") % 3 == 1, "index").otherwise("toc"))
    rows = S.held_scopes(_zoned(spark, sf_dir)).select("doc_id", F.col("scopes").alias("active"), wanted.alias("requested"))
    return scopes.active_scopes(rows).select("doc_id", F.array_join(scopes.canonical(F.col("scopes")), ",").alias("scopes"))


_SEARCH = f"""rules AS ({Q.RULES}), rtok AS (SELECT chunk_id AS id, unnest(regexp_extract_all(lower(title || chr(10) || content || chr(10) || scope), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM rules),
rpost AS (SELECT id, term, count(*) AS tf FROM rtok GROUP BY ALL), rw AS (SELECT term, ln((1 + (SELECT count(*) FROM rules)) / (1 + count(*))) + 1 AS idf FROM rpost GROUP BY term),
ridx AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM rpost JOIN rw USING (term)),
sq AS (SELECT scope, idf / sqrt(sum(idf * idf) OVER (PARTITION BY scope)) AS w, term FROM (SELECT DISTINCT scope, scope AS term FROM rules) JOIN rw USING (term)),
hits AS (SELECT q.scope, i.id AS chunk_id, round(sum(q.w * i.w), 6) AS score FROM sq q JOIN ridx i USING (term) GROUP BY ALL)"""


def _hits(spark):
    """(scope, chunk_id, score): a search of the rules for every scope that a rule names: a handful of rows."""
    book = rules(spark)
    post = R.postings(book.select("chunk_id", F.concat_ws("\n", "title", "content", "scope").alias("text")), "chunk_id", "text")
    weights = R.idf(post, book.agg(F.count(F.lit(1)).alias("n")))
    asked = R.postings(book.select("scope").distinct().withColumn("text", F.col("scope")), "scope", "text")
    return R.cosine_search(R.tfidf(asked, weights), R.tfidf(post, weights)).select(F.col("query_id").alias("scope"), F.col("id").alias("chunk_id"), "score")


_FITS = "r.targets = '' OR list_contains(string_split(r.targets, ','), h.scope) OR r.scope = h.scope"


@query(Q.over_sections(f"SELECT doc_id, chunk_id, scope AS matched_scope, rank FROM (SELECT s.doc_id, t.*, row_number() OVER (PARTITION BY s.doc_id, t.chunk_id ORDER BY {_ORDER.replace('scope', 's.scope', 1)}) AS f FROM scopes s JOIN top t USING (scope)) WHERE f = 1", f"{_SEARCH}, top AS (SELECT * FROM (SELECT h.scope, h.chunk_id, row_number() OVER (PARTITION BY h.scope ORDER BY score DESC, h.chunk_id) AS rank FROM hits h JOIN rules r USING (chunk_id) WHERE r.analysis_mode <> 'full_document' AND ({_FITS})) WHERE rank <= 8)"))
def scope_rules(spark, sf_dir):
    """The best rules of each scope that a document has; a rule stays with its first scope."""
    held = S.held_scopes(_zoned(spark, sf_dir)).select("doc_id", F.explode("scopes").alias("scope"))
    return scopes.retrieve_rules(held, _hits(spark), rules(spark), 8)


_PICKS = f"""{_SEARCH}, top AS (SELECT * FROM (SELECT h.scope, h.chunk_id, row_number() OVER (PARTITION BY h.scope ORDER BY score DESC, h.chunk_id) AS rank FROM hits h JOIN rules r USING (chunk_id) WHERE r.analysis_mode <> 'full_document' AND ({_FITS})) WHERE rank <= 8),
wide AS (SELECT DISTINCT h.chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, chunk_id) AS rank FROM hits WHERE scope IN ({', '.join(repr(s) for s in scopes.WIDENED)})) h JOIN rules r USING (chunk_id) WHERE rank <= 8 AND r.analysis_mode <> 'full_document' AND ({_FITS})),
pick1 AS (SELECT DISTINCT s.doc_id, t.chunk_id FROM scopes s JOIN top t USING (scope) UNION SELECT doc_id, chunk_id FROM corpus, rules WHERE analysis_mode = 'full_document'),
un AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS ord, scope, length(coalesce(nullif(heading, ''), scope)) AS t, length(text) AS n FROM (SELECT doc_id, CASE scope WHEN 'cover' THEN -2 ELSE -1 END AS o, scope, scope AS heading, text FROM scopes WHERE scope IN ('cover', 'toc') UNION ALL SELECT doc_id, ord, scope, heading, text FROM sections)),
met AS (SELECT u.*, w.chunk_id, CASE WHEN list_contains(targets, scope) OR (scope IN ({Q.BODY}) AND (list_has_any(targets, [{Q.BODY}]) OR list_contains(targets, 'body'))) THEN 0 WHEN scope IN ('foreword', 'introduction') THEN 1 WHEN scope IN ({Q.END}, 'end') THEN 2 ELSE 3 END AS tier FROM un u, (SELECT chunk_id, CASE WHEN targets = '' THEN []::VARCHAR[] ELSE string_split(targets, ',') END AS targets FROM rules) w),
taken AS (SELECT *, max((CASE WHEN tier = 0 THEN total > 2200 AND i > 1 WHEN tier = 3 THEN i > 1 ELSE total - n > 2200 END)::INT) OVER (PARTITION BY doc_id, chunk_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS over FROM (
    SELECT *, sum(n) OVER (PARTITION BY doc_id, chunk_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY ord) AS i FROM (SELECT *, min(tier) OVER (PARTITION BY doc_id, chunk_id) AS best FROM met) WHERE tier = best)),
ctx AS (SELECT doc_id, chunk_id, CASE WHEN max(tier) = 3 THEN least(max(n), 2200) ELSE sum(n + t + 4) + 2 * (count(*) - 1) END AS len FROM taken WHERE over = 0 GROUP BY ALL),
how AS (SELECT c.doc_id, r.chunk_id, r.scope, CASE WHEN analysis_mode IN ('full_document', 'cross_section') THEN analysis_mode WHEN analysis_mode = 'deterministic' OR coalesce(len, 0) < 40 THEN 'skip' WHEN analysis_mode = 'local' AND len > 3600 THEN 'window' ELSE 'single' END AS strategy FROM corpus c CROSS JOIN rules r LEFT JOIN ctx ON ctx.doc_id = c.doc_id AND ctx.chunk_id = r.chunk_id),
one AS (SELECT h.* FROM how h JOIN pick1 p ON p.doc_id = h.doc_id AND p.chunk_id = h.chunk_id WHERE strategy <> 'skip'),
two AS (SELECT h.* FROM how h JOIN (SELECT DISTINCT doc_id FROM one) d USING (doc_id) WHERE strategy <> 'skip' AND (chunk_id IN (SELECT chunk_id FROM wide) OR chunk_id IN (SELECT chunk_id FROM rules WHERE analysis_mode = 'full_document'))),
need AS (SELECT p.doc_id, u.s AS scope, arg_min(r.chunk_id, r.ord) AS chunk_id FROM pick1 p JOIN rules r USING (chunk_id), LATERAL (SELECT unnest(CASE WHEN targets = '' THEN [scope] ELSE string_split(targets, ',') END) AS s) u GROUP BY ALL)"""


@query(Q.over_sections("SELECT doc_id, chunk_id AS rule_id, scope, 'insufficient_context' AS status, strategy, 1::INT AS round FROM one UNION ALL SELECT doc_id, chunk_id, scope, 'insufficient_context', strategy, 2 FROM two UNION ALL SELECT doc_id, chunk_id, scope, 'warn', 'scope_coverage', 1 FROM need WHERE NOT EXISTS (SELECT 1 FROM scopes s WHERE s.doc_id = need.doc_id AND s.scope = need.scope)", _PICKS))
def full_reviews(spark, sf_dir):
    """A review from documents to issues: retrieved rules, contexts chosen by length, judged offline, coverage, a widened second round."""
    zoned = _zoned(spark, sf_dir)
    found = full_review.full_review(S.units(zoned), S.held_scopes(zoned), rules(spark), _hits(spark))
    return found.select("doc_id", "rule_id", "scope", "status", "strategy", "round")


@query(f"WITH {Q.LINES}, rules AS ({Q.RULES}) SELECT doc_id, chunk_id, 'full_document' AS matched_scope FROM corpus, rules WHERE analysis_mode = 'full_document'")
def document_rules(spark, sf_dir):
    """Rules of the whole document."""
    return scopes.full_document_rules(std_corpus(spark, sf_dir), rules(spark))


@query(Q.over_sections("SELECT doc_id, chunk_id, 'full_document' AS matched_scope FROM (SELECT doc_id FROM scopes GROUP BY doc_id HAVING count(*) FILTER (scope = 'appendix') = 0) d, (SELECT chunk_id FROM top UNION ALL SELECT chunk_id FROM rules WHERE analysis_mode = 'full_document') t", f"{_SEARCH}, best AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, chunk_id) AS rank FROM hits WHERE scope IN ({', '.join(repr(s) for s in scopes.WIDENED)})), top AS (SELECT DISTINCT h.chunk_id FROM best h JOIN rules r USING (chunk_id) WHERE rank <= 8 AND r.analysis_mode <> 'full_document' AND ({_FITS}))"))
def widened_rules(spark, sf_dir):
    """Rules for documents that are reviewed again, over the fixed scopes whether or not they have them."""
    held = S.held_scopes(_zoned(spark, sf_dir))
    again = held.where(~F.array_contains("scopes", "appendix")).select("doc_id")
    return scopes.retrieve_again(again, _hits(spark), rules(spark))


@query("""WITH q AS (SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS w FROM documents WHERE doc_id % 20 = 0 AND doc_id % 40 <> 0),
r AS (SELECT item_id AS chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS w FROM benchmark) SELECT DISTINCT query_id, chunk_id, 0.5::DOUBLE AS score FROM q JOIN r USING (w)""")
def keyword_hits(spark, sf_dir):
    """Rules that share a word with a query which the search found nothing for."""
    ask = _table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    found = ask.where("query_id % 40 = 0").select("query_id")
    book = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.lit("").alias("title"), F.col("text").alias("content"), F.lit("").alias("scope"))
    return scopes.keyword_search(ask, book, found)


@query("""SELECT a.vec_id AS query_id, count(*) AS n, round(max(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id""")
def positional_scores(spark, sf_dir):
    """Inner products by position, every twentieth row against all rows of its label."""
    vec = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return R.best_products(vec, vec.where("id % 20 = 0"))


@query(Q.over_sections(f"""SELECT doc_id, chunk_id, count(*) AS n_units, sum(CASE WHEN tier = 3 THEN least(n, 2200) ELSE n END)::BIGINT AS chars, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS taken FROM (
  SELECT *, max((CASE WHEN tier = 0 THEN total > 2200 AND i > 1 WHEN tier = 3 THEN i > 1 ELSE total - n > 2200 END)::INT) OVER (PARTITION BY doc_id, chunk_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS over FROM (
    SELECT *, sum(n) OVER (PARTITION BY doc_id, chunk_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY ord) AS i FROM (SELECT *, min(tier) OVER (PARTITION BY doc_id, chunk_id) AS best FROM met) WHERE tier = best)) WHERE over = 0 GROUP BY doc_id, chunk_id""", f"""rules AS ({Q.RULES}), want AS (SELECT chunk_id, CASE WHEN targets = '' THEN []::VARCHAR[] ELSE string_split(targets, ',') END AS targets FROM rules),
un AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS ord, scope, length(text) AS n FROM (SELECT doc_id, CASE scope WHEN 'cover' THEN -2 ELSE -1 END AS o, scope, text FROM scopes WHERE scope IN ('cover', 'toc') UNION ALL SELECT doc_id, ord, scope, text FROM sections)),
met AS (SELECT u.*, w.chunk_id, CASE WHEN list_contains(targets, scope) OR (scope IN ({Q.BODY}) AND (list_has_any(targets, [{Q.BODY}]) OR list_contains(targets, 'body'))) THEN 0 WHEN scope IN ('foreword', 'introduction') THEN 1 WHEN scope IN ({Q.END}, 'end') THEN 2 ELSE 3 END AS tier FROM un u, want w)"""))
def rule_contexts(spark, sf_dir):
    """The units that a rule's judge reads, within the budget, with the fallbacks."""
    chars = F.when(T.strip(F.col("text")) == "", 0).otherwise(F.length("text"))  # a context is chosen by lengths, so no text meets the rules
    units = S.units(_zoned(spark, sf_dir)).select("doc_id", "ord", "scope", chars.alias("chars"))
    plans = std_corpus(spark, sf_dir).select("doc_id").crossJoin(F.broadcast(rules(spark).select("chunk_id", F.col("target_scopes").alias("targets"))))
    kept = scopes.context_units(plans, units, 2200)
    return kept.groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.when(F.col("_best") == 3, F.least("chars", F.lit(2200))).otherwise(F.col("chars"))).cast("long").alias("chars"), F.array_join(F.array_sort(F.collect_list("ord")).cast("array<string>"), ",").alias("taken"))


@query(f"WITH {Q.LINES}, {book_queries._BOOK}, t AS (SELECT *, arg_max(own, sec) FILTER (mark = '#') OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS h1 FROM m1 WHERE mark <> ''), h AS (SELECT doc_id, sec, mark, h1 FROM t), k AS (SELECT c.*, h.mark, h.h1 FROM chunks c JOIN (SELECT doc_id, sec, para, row_number() OVER (PARTITION BY doc_id ORDER BY sec, para) AS r FROM m5 WHERE content <> '') x ON x.doc_id = c.doc_id AND format('RAG-{{:04d}}', x.r) = c.chunk_id JOIN h ON h.doc_id = x.doc_id AND h.sec = x.sec) SELECT doc_id, chunk_id, concat_ws(chr(10), title, content, scope, 'local', scope, scope || ' ' || title || CASE WHEN mark = '##' AND h1 IS NOT NULL AND h1 <> title AND h1 <> scope THEN ' ' || h1 ELSE '' END) AS text FROM k")
def retrieval_texts(spark, sf_dir):
    """What the index reads of a rule."""
    return rulebook.rule_chunks(S.lines(std_corpus(spark, sf_dir))).select("doc_id", "chunk_id", rulebook.retrieval_text().alias("text"))


_LIST = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS idx, l_returnflag AS list_id, (l_partkey % 3)::INT AS level FROM lineitem"


_DEEP = "SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)::INT AS idx, l_returnflag AS list_id, CASE WHEN l_partkey % 5 = 0 THEN l_orderkey % 9 ELSE l_partkey % 3 END::INT AS level FROM lineitem"


@query(f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, list_id ORDER BY idx) AS n FROM ({_DEEP})),
c AS (SELECT doc_id, list_id, 0::BIGINT AS n, 0 AS idx, 0 AS level, list_transform(range(0, 9), lambda k: NULL::INT) AS held FROM l WHERE n = 1
  UNION ALL SELECT l.doc_id, l.list_id, l.n, l.idx, l.level, list_transform(range(0, 9), lambda k: CASE WHEN k > l.level THEN NULL WHEN k = l.level THEN coalesce(c.held[k + 1], CASE WHEN k = 1 THEN 3 ELSE 1 END - 1) + 1 ELSE coalesce(c.held[k + 1], CASE WHEN k = 1 THEN 3 ELSE 1 END) END)
  FROM c JOIN l ON l.doc_id = c.doc_id AND l.list_id = c.list_id AND l.n = c.n + 1)
SELECT doc_id, idx, array_to_string(held[1:level + 1], '.') AS number FROM c WHERE n > 0""")
def list_numbers(spark, sf_dir):
    """Counters of lists of up to nine levels, written as decimals; the SQL counts row by row."""
    idx = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    level = F.when(F.col("l_partkey") % 5 == 0, F.col("l_orderkey") % 9).otherwise(F.col("l_partkey") % 3)
    lines = dealt(_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"), "l_suppkey")
    rows = lines.select(F.col("l_suppkey").alias("doc_id"), idx.alias("idx"), F.col("l_returnflag").alias("list_id"), level.cast("int").alias("level"), F.array(F.lit(1), F.lit(3), F.lit(1)).alias("start"))
    return numbering.list_numbers(rows).select("doc_id", "idx", F.array_join(F.col("numbers").cast("array<string>"), ".").alias("number"))


@query(f"""WITH l AS ({_LIST}), c AS (SELECT doc_id, idx, level = 0 AS ch, CASE WHEN level = 0 THEN idx::VARCHAR ELSE (idx % 3 + 1) || '.' || level END AS number FROM l),
s AS (SELECT *, last_value(CASE WHEN ch THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cur FROM c)
SELECT doc_id, idx, CASE WHEN NOT ch AND cur IS NOT NULL AND string_split(number, '.')[1] <> cur THEN cur || substr(number, strpos(number, '.')) ELSE number END AS number FROM s""")
def corrected_numbers(spark, sf_dir):
    """First parts of numbers set to the current chapter."""
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    level = F.col("l_partkey") % 3
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), idx.alias("idx"), level.alias("level"))
    number = F.when(F.col("level") == 0, F.col("idx").cast("string")).otherwise(F.concat_ws(".", (F.col("idx") % 3 + 1).cast("string"), F.col("level").cast("string")))
    return numbering.correct_numbering(rows.select("doc_id", "idx", (F.col("level") == 0).alias("is_chapter"), number.alias("number"))).select("doc_id", "idx", "number")


@query("""WITH RECURSIVE s AS (SELECT p_partkey % 5 AS doc_id, p_partkey // 5 AS style, CASE WHEN p_partkey // 5 % 40 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 5 + 1 + p_partkey % 20 ELSE -1 END ELSE p_partkey // 5 - 1 END AS based_on, CASE WHEN p_size % 23 = 0 THEN p_brand END AS font, CASE WHEN p_size % 37 = 0 THEN p_size END AS size FROM part),
c AS (SELECT doc_id, style, style AS at, 0 AS d, [style] AS seen FROM s UNION ALL SELECT c.doc_id, c.style, s.based_on, d + 1, list_append(seen, s.based_on) FROM c JOIN s ON s.doc_id = c.doc_id AND s.style = c.at WHERE s.based_on IS NOT NULL AND NOT list_contains(seen, s.based_on))
SELECT c.doc_id, c.style, arg_min(font, d) FILTER (font IS NOT NULL) AS font, arg_min(size, d) FILTER (size IS NOT NULL) AS size FROM c JOIN s ON s.doc_id = c.doc_id AND s.style = c.at GROUP BY ALL""")
def inherited_styles(spark, sf_dir):
    """Attributes along chains of forty styles and more, cycles and styles that are missing included; the SQL has no cap."""
    key, st = F.col("p_partkey"), F.expr("p_partkey div 5")
    above = F.when(st % 40 == 0, F.when(key % 2 == 0, st + 1 + key % 20).otherwise(-1)).otherwise(st - 1)
    rows = _table(spark, sf_dir, "part").select((key % 5).alias("doc_id"), st.alias("style"), above.alias("based_on"), F.when(F.col("p_size") % 23 == 0, F.col("p_brand")).alias("font"), F.when(F.col("p_size") % 37 == 0, F.col("p_size")).alias("size"))
    return numbering.resolve_inheritance(rows, ["font", "size"])


_PAGED = "pg AS (SELECT doc_id, ((line_no - 1) // 8 + 1)::INT AS page, string_agg(replace(line, '# ', ''), chr(10) ORDER BY line_no) AS text FROM ln GROUP BY ALL)"


def _pages(spark, sf_dir):
    rows = S.lines(std_corpus(spark, sf_dir)).withColumn("page", F.floor((F.col("line_no") - 1) / 8).cast("int") + 1)
    text = F.array_join(F.sort_array(F.collect_list(F.struct("line_no", F.replace("line", F.lit("# "), F.lit("")).alias("line")))).getField("line"), "\n")
    return rows.groupBy("doc_id", "page").agg(text.alias("text"))


@query(f"WITH {Q.LINES}, {_PAGED} SELECT doc_id, min(page)::INT AS toc_page FROM pg WHERE page <= 8 AND regexp_matches(text, '(?m)^[\\x09\\x20]*目[\\x20]*[次录][\\x20]*$') GROUP BY doc_id")
def toc_pages(spark, sf_dir):
    """The page that the contents are on."""
    return numbering.toc_page(_pages(spark, sf_dir))


@query(f"WITH {Q.LINES}, {_PAGED} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pg WHERE {Q.strip('text')} <> '' AND page >= 1 + doc_id % 2 GROUP BY doc_id")
def text_views(spark, sf_dir):
    """Pages from a first one on, joined in order."""
    return numbering.text_view(_pages(spark, sf_dir), 1 + F.col("doc_id") % 2)


@query(f"WITH {Q.LINES}, {_PAGED} SELECT doc_id, page, count(*) AS lines, sum(length({Q.strip('l')}))::BIGINT AS chars FROM (SELECT doc_id, page, unnest(string_split_regex(text, '\\r\\n|[\\n\\x0B\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS l FROM pg) WHERE {Q.strip('l')} <> '' AND NOT regexp_matches(l, '\\.{{4,}}') GROUP BY ALL")
def page_line_counts(spark, sf_dir):
    """Lines of paged text without blanks and dot leaders."""
    return numbering.page_lines(_pages(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("SELECT l_orderkey AS doc_id, l_linenumber::INT AS page, arg_max(l_quantity::INT::VARCHAR, (l_extendedprice, l_quantity)) AS label FROM lineitem WHERE l_extendedprice >= 100000 * 0.82 AND regexp_matches(l_quantity::INT::VARCHAR, '^[0-9]{1,4}$') GROUP BY ALL")
def footer_pages(spark, sf_dir):
    """The lowest number at the foot of a page."""
    spans = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_extendedprice").alias("y"), F.lit(100000.0).alias("height"), F.col("l_quantity").cast("int").cast("string").alias("text"))
    return numbering.footer_page(spans)


@query(f"WITH {Q.LINES}, {Q.HEAD}, {record_queries._FACTS} SELECT doc_id, idx, CASE WHEN regexp_matches(h, '^[0-9]') OR idx % 3 = 0 THEN h ELSE idx || ' ' || h END AS display, CASE WHEN scope IN ('cover', 'toc', 'foreword', 'introduction') THEN 'roman' ELSE 'arabic' END AS page_scheme FROM facts WHERE role <> 'paragraph'")
def display_headings(spark, sf_dir):
    """Headings with their list numbers in front, and how their pages are counted."""
    rows = record_queries._facts(spark, sf_dir).where("role <> 'paragraph'")
    number = F.when(F.col("idx") % 3 == 0, "").otherwise(F.concat(F.col("idx").cast("string"), F.lit(".")))
    return rows.select("doc_id", "idx", numbering.display_heading(F.col("display_heading"), number).alias("display"), numbering.page_scheme(F.col("scope")).alias("page_scheme"))


_MATCHED = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS toc_idx, l_returnflag AS page_scheme, (l_quantity % 5)::BIGINT AS toc_page, l_suppkey % 4 AS raw_page, l_partkey AS heading_idx FROM lineitem"


def _matched(spark, sf_dir):
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), idx.alias("toc_idx"), F.col("l_returnflag").alias("page_scheme"), (F.col("l_quantity") % 5).cast("long").alias("toc_page"), (F.col("l_suppkey") % 4).alias("raw_page"), F.col("l_partkey").alias("heading_idx"))


@query(f"WITH m AS ({_MATCHED}), b AS (SELECT *, raw_page - min(raw_page) OVER (PARTITION BY doc_id, page_scheme) + 1 AS body_page FROM m), d AS (SELECT *, toc_page - body_page AS d FROM b), o AS (SELECT *, min(d) OVER w = max(d) OVER w AS same FROM d WINDOW w AS (PARTITION BY doc_id, page_scheme)) SELECT doc_id, toc_idx, toc_page, body_page FROM o WHERE d <> 0 AND NOT same")
def toc_page_checks(spark, sf_dir):
    """Contents pages that the body does not bear out."""
    return numbering.check_toc_pages(_matched(spark, sf_dir))


@query(f"WITH m AS ({_MATCHED}) SELECT doc_id, coalesce(bool_or(back), false) AS mismatch FROM (SELECT doc_id, heading_idx < lag(heading_idx) OVER (PARTITION BY doc_id ORDER BY toc_idx) AS back FROM m) GROUP BY doc_id")
def order_mismatches(spark, sf_dir):
    """Matched headings that leave the order of the contents."""
    return numbering.order_mismatch(_matched(spark, sf_dir))


@query(f"WITH {Q.LINES}, {Q.HEAD}, {record_queries._FACTS} SELECT doc_id, 'paragraph' AS kind, count(*) AS facts, sum(length(text_excerpt))::BIGINT AS chars FROM facts GROUP BY doc_id")
def facts_summaries(spark, sf_dir):
    """Facts and characters of a document, excerpts at most 300 long as their rule has it."""
    return audit.facts_summary(record_queries._facts(spark, sf_dir))


@query(f"WITH {Q.LINES}, h AS (SELECT doc_id, line_no, {Q.strip('line')} AS held FROM ln) SELECT doc_id, line_no, heading FROM (SELECT doc_id, line_no, {Q.squeeze('(CASE WHEN starts_with(held, chr(35)) THEN ' + Q.sub('held', '^#[\\x09-\\x0D\\x20]*') + ' ELSE held END)')} AS heading FROM h WHERE starts_with(held, '#') OR regexp_matches(held, '^[0-9]+(\\.[0-9]+)*[\\x09-\\x0D\\x20]+')) WHERE heading <> ''")
def body_headings(spark, sf_dir):
    """Lines with a heading mark or a number in front."""
    return S.body_headings(std_corpus(spark, sf_dir))


_FALL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(title, '{w}')" for w in words) + f" THEN '{scope}'" for scope, words in S.FALLBACK_WORDS) + " ELSE 'other_body' END"


@query(f"WITH {Q.LINES}, t AS (SELECT *, {Q.strip(chr(114) + 'egexp_extract(line, ' + chr(39) + '^#{1,6}[' + chr(92) + 'x09-' + chr(92) + 'x0D' + chr(92) + 'x20]+(.+?)[' + chr(92) + 'x09-' + chr(92) + 'x0D' + chr(92) + 'x20]*$' + chr(39) + ', 1)')} AS own FROM ln), s AS (SELECT *, sum((own <> '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM t), r AS (SELECT doc_id, sec, max(own) AS title, {Q.strip('string_agg(line, chr(10) ORDER BY line_no)')} AS text FROM s WHERE sec > 0 GROUP BY ALL) SELECT doc_id, scope, arg_min(text, sec) AS text FROM (SELECT *, {_FALL} AS scope FROM r) GROUP BY ALL")
def fallback_scopes(spark, sf_dir):
    """The first region of each class, by headings alone."""
    return S.fallback_split(S.lines(std_corpus(spark, sf_dir)))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, 'GB/T ' || (1000 + doc_id) || '-2020' AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'GB-T-' || (1000 + doc_id) || '-2020' END AS base_name, '/threads/t%20' || doc_id || '/artifacts/a%2F' || doc_id AS url,
 '位置=L' || doc_id || '，样式=' || CASE WHEN doc_id % 2 = 0 THEN '未命名样式' ELSE source END AS location, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '标准号：' || n || chr(10) || chr(10) END || t AS covered,
 doc_id::VARCHAR AS looked_up, (CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END)::BIGINT AS picked, 'bm' || doc_id || ',x' AS refs, try_cast(CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'x' || doc_id END AS BIGINT) AS number, doc_id % 2 = 0 AS flag, source || '_' || doc_id AS component FROM d""")
def record_fields(spark, sf_dir):
    """names, links, texts and values of a record."""
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    number = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("GB/T "), (1000 + k).cast("string"), F.lit("-2020")))
    json = F.to_json(F.struct(F.struct(k.alias("b")).alias("a")))
    items = F.array(F.struct(F.lit("first").alias("id"), F.lit(1).cast("long").alias("v")), F.struct(F.concat(F.lit("d"), (k % 4).cast("string")).alias("id"), F.lit(2).cast("long").alias("v")))
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        records.base_name(number, F.col("source")).alias("base_name"),
        records.download_url(F.concat(F.lit("t "), s), F.concat(F.lit("a/"), s)).alias("url"),
        records.location_text(F.concat(F.lit("L"), s), F.when(k % 2 == 0, "").otherwise(F.col("source"))).alias("location"),
        records.prepend_cover(F.coalesce("text", F.lit("")), {"标准号": number}).alias("covered"),
        records.dotted(json, "a.b").alias("looked_up"),
        records.pick(items, F.lit("d1"))["v"].alias("picked"),
        F.array_join(T.page_refs(F.concat(F.lit(" PAGEREF bm"), s, F.lit(" \\h  pageref x\\h"))), ",").alias("refs"),
        T.safe_long(F.when(k % 2 == 0, s).otherwise(F.concat(F.lit("x"), s))).alias("number"),
        T.safe_bool(F.when(k % 2 == 0, " Yes").otherwise("off")).alias("flag"),
        T.file_component(F.concat("source", F.lit("?"), s, F.lit(". "))).alias("component"),
    )


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bad fields: id' WHEN 3 THEN 'no object' WHEN 4 THEN 'bad fields: price, tags[1], m.b, s.n' WHEN 5 THEN 'bad fields: tags' END AS error, CASE WHEN event_id % 6 IN (1, 2, 5) THEN event_id END AS id,
CASE WHEN event_id % 6 = 2 THEN (event_id % 1000 + 0.25)::DECIMAL(10, 2) END AS price, CASE event_id % 6 WHEN 2 THEN 'a,7' WHEN 4 THEN '1,' END AS tags, CASE event_id % 6 WHEN 2 THEN 9 END AS n FROM events""")
def validated_records(spark, sf_dir):
    """Records read by a schema of any types, values coerced, and the paths that do not fit."""
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"id": "'), s, F.lit('", "price": "'), (e % 1000).cast("string"), F.lit('.25", "tags": ["a", 7], "m": {"a": "1"}, "s": {"n": 9}, "more": 1}'))
    json = F.when(e % 6 == 0, F.concat(F.lit('{"id": "x'), s, F.lit('", "price": null}'))).when(e % 6 == 1, F.concat(F.lit('{"id": '), s, F.lit("}"))).when(e % 6 == 2, whole).when(e % 6 == 3, F.when(e % 4 == 3, "[1]").otherwise("nothing"))
    json = json.when(e % 6 == 4, '{"price": "dear", "tags": [1, {"q": 2}], "m": {"a": 1, "b": "x"}, "s": {"n": "y"}}').otherwise(F.concat(F.lit('{"id": '), s, F.lit(', "tags": "none"}')))
    out = records.validate(_table(spark, sf_dir, "events").select("event_id", json.alias("json")), "id long, price decimal(10,2), tags array<string>, m map<string,int>, s struct<n:int>")
    return out.select("event_id", "error", F.col("record.id").alias("id"), F.col("record.price").alias("price"), F.array_join("record.tags", ",", "").alias("tags"), F.col("record.s.n").alias("n"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'severity' END, CASE WHEN event_id % 3 = 0 THEN 'status' END, CASE WHEN value IS NULL OR value / 50 > 1 OR value < 0 THEN 'confidence' END, CASE WHEN event_id % 2 = 0 THEN 'path' END], lambda x: x IS NOT NULL), ',') AS errors FROM events""")
def issue_errors(spark, sf_dir):
    """V2: issues against their enumerations and bounds."""
    e = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 0, "odd").otherwise("minor").alias("severity"), F.when(e % 3 == 0, F.lit(None)).otherwise("warn").alias("status"), (F.col("value") / 50).alias("confidence"), F.when(e % 2 == 0, "a").otherwise("/a").alias("path"))
    return records.validate_issues(rows).select("event_id", F.array_join("errors", ",").alias("errors"))


_META = "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'GH/T 1-2020' WHEN 2 THEN 'GB 2-2020' ELSE 'DB11/T 3' END AS number, CASE c_custkey % 3 WHEN 0 THEN '中华人民共和国国家标准' WHEN 1 THEN '行业标准' ELSE '' END AS level FROM customer"


@query(f"WITH m AS ({_META}) SELECT doc_id, number, level, CASE WHEN number = '' THEN 'no_number' WHEN number LIKE 'GH/T%' AND level LIKE '%国家标准%' THEN 'gh_national' WHEN number LIKE 'GB%' AND level <> '' AND level NOT LIKE '%国家标准%' THEN 'gb_not_national' ELSE '' END AS warnings FROM m")
def metadata_warnings(spark, sf_dir):
    """What a record's number and level say against each other, beside the record's summary."""
    k = F.col("c_custkey")
    number = F.when(k % 4 == 0, "").when(k % 4 == 1, "GH/T 1-2020").when(k % 4 == 2, "GB 2-2020").otherwise("DB11/T 3")
    level = F.when(k % 3 == 0, "中华人民共和国国家标准").when(k % 3 == 1, "行业标准").otherwise("")
    rows = _table(spark, sf_dir, "customer").select(k.alias("doc_id"), number.alias("标准号"), level.alias("标准层级"), F.lit("").alias("标准中文名称"), F.lit("").alias("标准性质"), F.lit("").alias("制修订"), F.lit("").alias("ics"), "c_name")
    found = metadata.warnings(rows).select("doc_id", F.array_join("warnings", ",").alias("warnings"))
    return records.metadata_summary(rows).join(found, "doc_id").select("doc_id", F.col("标准号").alias("number"), F.col("标准层级").alias("level"), "warnings")


def _artifacts(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")).alias("thread_id"), F.col("o_orderkey").cast("string").alias("artifact_id"), (F.col("o_custkey") % 50).alias("doc_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("/out/"), (F.col("o_orderkey") % 97).cast("string")).alias("virtual_path"), F.lit("/host").alias("host_path"))


@query("SELECT o_orderkey::VARCHAR AS artifact_id, '/out/' || (o_orderkey % 97) AS virtual_path FROM orders WHERE o_custkey % 50 = 7 AND o_orderkey % 97 IN (SELECT o_custkey % 97 FROM orders WHERE o_totalprice > 200000)")
def thread_artifacts(spark, sf_dir):
    """A thread's artifacts that exist, without their host paths."""
    there = _table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.concat(F.lit("/out/"), (F.col("o_custkey") % 97).cast("string")).alias("path")).distinct()
    return records.public_artifacts(records.artifacts_for(_artifacts(spark, sf_dir), "t7", files=there)).select("artifact_id", "virtual_path")


@query("WITH a AS (SELECT o_custkey % 50 AS doc_id, o_orderpriority AS type, max(o_orderkey) AS a FROM orders GROUP BY ALL) SELECT doc_id, string_agg(type || '=' || a, ',' ORDER BY type) AS artifacts FROM a GROUP BY doc_id")
def artifact_maps(spark, sf_dir):
    """The last artifact of each type."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("artifacts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return records.artifact_map(_artifacts(spark, sf_dir)).select("doc_id", shown.alias("artifacts"))


@query("WITH i AS (SELECT l_orderkey AS doc_id, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY ALL), a AS (SELECT o_orderkey AS doc_id, o_orderpriority || '=' || o_orderkey AS artifacts FROM orders) SELECT doc_id, 'success' AS status, NOT bad AS passed, artifacts FROM i LEFT JOIN a USING (doc_id)")
def review_responses(spark, sf_dir):
    """P20: the public answer to a review."""
    issues = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("warn").alias("status"), F.lit("轻度").alias("severity"))
    held = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderkey").cast("string").alias("artifact_id"), F.lit(1).alias("ord"))
    out = records.review_response(issues, held)
    return out.select("doc_id", "status", "passed", F.array_join(F.transform(F.map_entries("artifacts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("artifacts"))


_RESULTS = """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'parse' ELSE 'other' END AS tool FROM events"""


@query(f"WITH r AS ({_RESULTS}) SELECT id, 'report' AS type, '/out/' || id || '.md' AS virtual_path FROM r WHERE tool = 'review' UNION ALL SELECT id, 'markdown', '/md/' || id FROM r WHERE tool = 'parse' AND id % 2 = 0")
def artifacts_of_results(spark, sf_dir):
    """Artifacts that results name at the paths listed for their tool."""
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    tool = F.when(e % 3 == 0, "review").when(e % 3 == 1, "parse").otherwise("other")
    result = F.when(e % 3 == 0, F.concat(F.lit('{"files": {"report": "/out/'), s, F.lit('.md"}}'))).otherwise(F.concat(F.lit('{"md": "'), F.when(e % 2 == 0, F.concat(F.lit("/md/"), s)).otherwise(""), F.lit('"}')))
    spec = spark.sql("SELECT * FROM VALUES ('review', 'files.report', 'report'), ('parse', 'md', 'markdown') AS s(tool, field, type)")
    return records.artifacts_of(_table(spark, sf_dir, "events").select(e.alias("id"), tool.alias("tool"), result.alias("result")), spec)


@query("SELECT o_custkey AS job_id, count(*) AS n, string_agg('/out/' || o_orderkey, ',' ORDER BY '/out/' || o_orderkey) AS paths, coalesce(string_agg(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, '; ' ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END), '') AS errors, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'ok' ELSE 'failed' END AS status FROM orders GROUP BY o_custkey")
def manifests(spark, sf_dir):
    """K2: a job's artifacts, its errors and its status."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string")).alias("virtual_path"), F.lit("json").alias("type"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("error"))
    return sinks.build_manifest(rows).select("job_id", F.size("artifacts").cast("long").alias("n"), F.array_join(F.col("artifacts.virtual_path"), ",").alias("paths"), "errors", "status")


@query("SELECT DISTINCT 't' || o_custkey AS thread_id, '/out/' || (o_orderkey % 7) AS virtual_path FROM orders WHERE o_orderstatus <> 'F' EXCEPT SELECT 't' || o_custkey, '/out/' || (o_orderkey % 7) FROM orders WHERE o_orderpriority = '1-URGENT'")
def registered_artifacts(spark, sf_dir):
    """K7: artifacts that are not registered yet, each once."""
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("thread_id"), F.concat(F.lit("/out/"), (F.col("o_orderkey") % 7).cast("string")).alias("virtual_path"), (F.col("o_orderstatus") != "F").alias("ok"), "o_orderpriority")
    return sinks.register_artifacts(rows, rows.where("o_orderpriority = '1-URGENT'")).select("thread_id", "virtual_path")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '/p/' || conv_id || '.md' WHEN turn % 3 = 1 THEN '/x/' || conv_id END AS markdown_path FROM conversations")
def manifest_paths(spark, sf_dir):
    """The Markdown that a manifest leads to."""
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    item = lambda kind, path: F.struct(kind.alias("type"), path.alias("virtual_path"))
    primary = item(F.when(t % 3 == 0, "markdown").otherwise("json"), F.concat(F.lit("/p/"), c, F.lit(".md")))
    found = F.array(item(F.lit("image"), F.lit("/i")), item(F.when(t % 3 == 2, "json").otherwise("markdown"), F.concat(F.lit("/x/"), c)))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", primary.alias("primary"), found.alias("artifacts"))
    return files.resolve_manifest(rows).select("conv_id", "turn", "markdown_path")


@query("SELECT page_id, 0 AS page_idx, idx::INT AS idx, CASE idx WHEN 0 THEN 'ICS ' || page_id || '.1' ELSE trim(coalesce(url, '')) END AS text FROM pages, (SELECT unnest([0, 1]) AS idx)")
def layout_headers(spark, sf_dir):
    """Text of the header blocks of layout JSON."""
    span = lambda *c: F.struct(F.array(*[F.struct(x.alias("content")) for x in c]).alias("spans"))
    block = lambda *c: F.struct(F.lit("header").alias("type"), F.array(span(*c)).alias("lines"))
    body = F.struct(F.array(F.struct(F.lit(0).alias("page_idx"), F.array(block(F.lit("ICS "), F.col("page_id").cast("string"), F.lit(".1")), block(F.coalesce("url", F.lit("")))).alias("discarded_blocks"))).alias("pdf_info"))
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(body).alias("json"))
    return files.header_blocks(files.read_layout(rows)).select(F.col("doc_id").alias("page_id"), "page_idx", "idx", "text")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'doc/images/' ELSE 'doc/' END || doc_id || '.png' AS member FROM documents WHERE strlen(coalesce(text, '')) <= 100 AND doc_id % 3 <> 2")
def tiny_images(spark, sf_dir):
    """Image members of at most a hundred bytes, below images/ or at most one folder deep."""
    k = F.col("doc_id") % 3
    name = F.concat(F.when(k == 0, "doc/images/").when(k == 1, "doc/").otherwise("doc/deep/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return images.tiny_images(_table(spark, sf_dir, "documents").select("doc_id", name.alias("member"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))).select("doc_id", "member")


_HASH = "'0123456789ABCDEF' || (doc_id + 10) || '.png'"


@query(f"""SELECT doc_id, coalesce(text, '') || chr(10) || '![](img/b' || doc_id || '.jpg) ./img/b' || doc_id || '.jpg /img/c' || doc_id || '.jpg images/none.jpg ![x]( q/A.jpg) ![y](img/c' || doc_id || '.jpg) (img/h' || doc_id || '.png) x' || {_HASH} || ' img/b' || doc_id || '.jpg' AS text, CASE WHEN doc_id % 2 = 0 THEN '表1 ' || source ELSE '' END AS caption FROM documents""")
def rewritten_refs(spark, sf_dir):
    """Image references of every form renamed, a to b and b to c in one text; the last table caption before an anchor."""
    s, hashed = F.col("doc_id").cast("string"), F.expr(_HASH)
    old = lambda k: F.concat(F.lit(k), s, F.lit(".jpg"))
    parts = ["\n![](images/", old("a"), ") ./images/", old("a"), " /images/", old("b"), " images/none.jpg ![x]( q/A.jpg) ![y](deep/er/", F.upper(old("b")), ") (", hashed, ") x", hashed, " images/", old("a")]
    body = F.concat(F.coalesce("text", F.lit("")), *[F.lit(x) if isinstance(x, str) else x for x in parts])
    docs = _table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))
    pair = lambda a, b: F.struct(a.alias("old"), b.alias("new"))
    names = F.array(pair(old("a"), old("b")), pair(old("b"), old("c")), pair(F.lit("a"), F.lit("new1")), pair(hashed, F.concat(F.lit("h"), s, F.lit(".png"))))
    renames = _table(spark, sf_dir, "documents").select("doc_id", F.explode(names).alias("r")).select("doc_id", "r.*")
    caps = _table(spark, sf_dir, "documents").select("doc_id", images.caption_before(F.concat(F.lit("x\n"), F.when(F.col("doc_id") % 2 == 0, "表0 a\n 表1 ").otherwise("图"), F.col("source"), F.lit("\nANCHOR\n表2")), F.lit("ANCHOR")).alias("caption"))
    return images.rewrite_refs(docs, renames, "img/").join(caps, "doc_id")


@query("SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'subagent' ELSE 'main' END AS source, CASE WHEN event_id % 2 = 0 THEN 'tools:' || event_id END AS call_id FROM events")
def event_sources(spark, sf_dir):
    """ST8: which agent an event comes from."""
    e = F.col("event_id")
    space = F.when(e % 2 == 0, F.array(F.lit("graph"), F.concat(F.lit("tools:"), e.cast("string")), F.lit("tools:z"))).otherwise(F.array(F.lit("graph")))
    return E.event_source(_table(spark, sf_dir, "events").select(e.alias("seq"), space.alias("namespace"))).select("seq", "source", "call_id")


@query("""WITH r AS (SELECT event_id AS id, event_id % 4 AS n FROM events)
SELECT id, i::INT AS ord, 'artifact.created' AS event, '/out/' || id || ['.a', '.b', '.c'][i + 1] AS virtual_path FROM r, unnest(range(0, 3)) AS u(i) WHERE i < n UNION ALL SELECT id, n::INT, 'tool.completed', NULL FROM r""")
def tool_events(spark, sf_dir):
    """ST9: events of finished tools: none to three artifacts, then the completion."""
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    named = lambda k, least: F.when(e % 4 > least, F.concat(F.lit("/out/"), s, F.lit(f".{k}")))
    result = F.to_json(F.struct(named("a", 0).alias("a"), F.struct(named("b", 1).alias("b")).alias("files"), named("c", 2).alias("c")))
    spec = spark.sql("SELECT * FROM VALUES ('review', 'a', 'r1'), ('review', 'files.b', 'r2'), ('review', 'c', 'r3'), ('other', 'a', 'x') AS s(tool, field, type)")
    rows = _table(spark, sf_dir, "events").select(e.alias("id"), F.lit("review").alias("tool"), result.alias("result"))
    return E.tool_events(rows, spec).select("id", "ord", "event", "virtual_path")


@query("""SELECT event_id AS seq, 'm' || event_id AS message_id, CASE WHEN event_id % 5 = 3 THEN 'extra' ELSE 'review' END AS tool, '{"n":' || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END || event_id || '}' AS content FROM events WHERE event_id % 5 <> 4
UNION ALL SELECT event_id, NULL, 'second', '{"q":[1]}' FROM events WHERE event_id % 5 = 1""")
def tool_messages(spark, sf_dir):
    """ST11: tool messages found inside nested payloads, up to thirteen objects deep, in each of the forms."""
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    name = F.when(e % 5 == 3, '"additional_kwargs": {"name": "extra"}').otherwise('"name": "review"')
    content = F.when(e % 2 == 0, F.concat(F.lit('"{\\"n\\": '), s, F.lit('}"'))).otherwise(F.concat(F.lit('{"n": '), s, F.lit("}")))
    inner = F.concat(F.lit('{"id": "m'), s, F.lit('", '), name, F.lit(', "content": '), content, F.lit("}"))
    deep = F.concat(F.repeat(F.lit('{"a": ['), (e % 7 * 2).cast("int")), inner, F.repeat(F.lit("]}"), (e % 7 * 2).cast("int")))
    data = F.when(e % 5 == 0, F.concat(F.lit('{"kwargs": '), inner, F.lit("}"))).when(e % 5 == 1, F.concat(F.lit('[{"tool_name": "second", "name": "", "type": "x", "content": {"q": [1]}}, '), deep, F.lit("]"))).when(e % 5 == 4, '{"content": "text", "name": "n"}').otherwise(deep)
    return E.unwrap_messages(_table(spark, sf_dir, "events").select(e.alias("seq"), data.alias("data")))


@query("""SELECT doc_id, array_to_string(list_filter([array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)), 'é' || doc_id], lambda x: x <> ''), chr(10)) || chr(10) || chr(10) || 'end' AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)""")
def layout_texts(spark, sf_dir):
    """the text of nested layout JSON, in reading order; each line of a text is a span two to six levels down."""
    span = lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("content"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit(None).cast("string").alias("content"), x.alias("text")))
    spans = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), span)
    block = F.to_json(F.struct(F.lit("zz").alias("other"), F.array(F.struct(spans.alias("spans"))).alias("lines"), F.lit(3).alias("html")))
    tail = F.to_json(F.struct(F.concat(F.lit("é"), F.col("doc_id").cast("string")).alias("text")))
    wrap = F.concat(F.repeat(F.lit('{"blocks": ['), (F.col("doc_id") % 4).cast("int")), block, F.repeat(F.lit("]}"), (F.col("doc_id") % 4).cast("int")))
    json = F.concat(F.lit('[{"lines": ['), wrap, F.lit(", "), tail, F.lit('], "spans": [null, 5]}, {"unknown": "x"}, "end"]'))
    return nested.flat_text(_table(spark, sf_dir, "documents").select("doc_id", json.alias("json")), "doc_id")


@query("WITH c AS (SELECT user_id AS trace_id, min(ts) AS s, max(ts) AS e, count(*) AS spans FROM events GROUP BY user_id) SELECT trace_id, 'meta.extract.start' AS type, s AS created_at, '' AS extras FROM c UNION ALL SELECT trace_id, 'meta.extract.end', e, 'spans=' || spans FROM c")
def progress_events(spark, sf_dir):
    """ST12: start and end of an extraction, with its counts."""
    counts = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trace_id")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("spans"))
    shown = F.array_join(F.transform(F.map_entries("extras"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return E.progress_rows(counts, "extract").select("trace_id", "type", "created_at", shown.alias("extras"))


_NUMBER = "[A-Z]{2,4}(?:/[A-Z])? ?[0-9]+(?:\\.[0-9]+)*[-—–][0-9]{4}"


@query(f"WITH {Q.LINES}, k AS (SELECT doc_id, text, regexp_extract_all(text, '标准正式编号：({_NUMBER})', 1) AS own, regexp_extract_all(text, '代替({_NUMBER})', 1) AS old FROM corpus) SELECT doc_id, '标准号' AS cls, own[1] AS txt, (strpos(text, '标准正式编号：' || own[1]) + 7)::INT AS start_pos FROM k WHERE len(own) > 0 UNION ALL SELECT doc_id, '代替标准号', old[1], (strpos(text, '代替' || old[1]) + 2)::INT FROM k WHERE len(old) > 0")
def found_spans(spark, sf_dir):
    """Numbers that the default extractor finds, each at its own place."""
    return metadata.find_spans(std_corpus(spark, sf_dir)).where("cls <> '引用文件'")


_NUM = r"^(?:[A-Z]{1,6}[0-9]{0,3}(?:/[A-Z]{1,8}[0-9]{0,3})?)\s+[0-9]+(?:[.][0-9]+)*[—-](?:[0-9]{4}|[0-9]{2})"
_BARE = "trim(regexp_replace(t, '^(?:代替 *)?(?:替代)?', ''))"


_KIND = (("ics", "ics", "t"), ("ccs", "ccs", "t"), ("old", "replaced", "CASE WHEN num <> '' THEN num ELSE t END"), ("num <> ''", "number", "num"), ("lvl", "hierarchy", "t"), ("cod", "code", "t"))
_PLACE = {"ics": "CASE WHEN NOT ccs THEN t ELSE '' END", "ccs": "CASE WHEN NOT ics THEN t ELSE '' END", "code": "CASE WHEN NOT ics AND NOT ccs AND num = '' THEN t ELSE '' END", "hierarchy": "t", "number": "CASE WHEN num <> '' AND NOT old THEN num ELSE early END", "replaced": "CASE WHEN old THEN CASE WHEN num <> '' THEN num ELSE t END ELSE '' END"}
_FLAGS = metadata.FIELDS
_STATE = ", ".join(f"'' AS f_{f}" for f in _FLAGS)


def _round(name: str, before: str, pick: str, value) -> str:
    """One pass over a document's blocks in order, as a recursion that carries the six fields."""
    fields = ", ".join(f"CASE WHEN p = '{f}' THEN {value(f)} ELSE f_{f} END AS f_{f}" for f in _FLAGS)
    return f"""{name} AS (SELECT doc_id, 0::BIGINT AS n, {before} UNION ALL SELECT doc_id, n, {fields} FROM (SELECT b.*, {', '.join(f'm.f_{f}' for f in _FLAGS)}, {pick} AS p FROM {name} m JOIN b ON b.doc_id = m.doc_id AND b.n = m.n + 1))"""


_LAST = ", ".join(f"arg_max(f_{f}, n) AS f_{f}" for f in _FLAGS)
_HEADER_SQL = f"""WITH RECURSIVE raw AS ({derived.duck(derived.HEADERS, 'pages')}),
b0 AS (SELECT doc_id, idx, index, {Q.squeeze('text')} AS t FROM raw WHERE type = 'header'),
b1 AS (SELECT *, starts_with(upper(t), 'ICS') OR contains(t, '国际标准分类') AS ics, starts_with(upper(t), 'CCS') OR contains(t, '中国标准文献分类') OR regexp_matches(replace(upper(t), ' ', ''), '^[A-Z]{{1,3}}[0-9]{{1,3}}(?:[.][0-9]+)?$') AS ccs,
  contains(t, '代替') OR contains(t, '替代') AS old, CASE WHEN regexp_matches(upper({_BARE}), '{_NUM}') THEN replace({_BARE}, '—', '-') ELSE '' END AS num,
  contains(t, '中华人民共和国国家标准') OR contains(t, '国家标准化指导性技术文件') OR contains(t, '行业标准') OR contains(t, '地方标准') AS lvl, regexp_matches(replace(upper(t), ' ', ''), '^[A-Z]{{1,6}}(?:/[A-Z]{{1,6}})?$') AS c0 FROM b0 WHERE t <> ''),
b AS (SELECT b1.*, c0 AND NOT ics AND NOT ccs AS cod, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n, coalesce((SELECT arg_min(CASE WHEN NOT e.old THEN e.num ELSE '' END, e.idx) FROM b1 e WHERE e.doc_id = b1.doc_id AND e.index = 3), '') AS early FROM b1),
{_round("r1", _STATE + " FROM (SELECT DISTINCT doc_id FROM b)", "CASE " + " ".join(f"WHEN {t} AND f_{f} = '' THEN '{f}'" for t, f, _ in _KIND) + " END", lambda f: next(v for _, g, v in _KIND if g == f))},
s1 AS (SELECT doc_id, {_LAST} FROM r1 GROUP BY doc_id),
{_round("r2", ", ".join(f"f_{f}" for f in _FLAGS) + " FROM s1", "CASE WHEN num = '' THEN NULL WHEN old AND f_replaced = '' THEN 'replaced' WHEN NOT old AND f_number = '' THEN 'number' END", lambda f: "num")},
s2 AS (SELECT doc_id, {_LAST} FROM r2 GROUP BY doc_id),
{_round("r3", ", ".join(f"f_{f}" for f in _FLAGS) + " FROM s2", "CASE " + " ".join(f"WHEN index = {i} AND f_{f} = '' THEN '{f}'" for i, f in enumerate(metadata.PLACES)) + " END", lambda f: _PLACE[f])},
s3 AS (SELECT doc_id, {_LAST} FROM r3 GROUP BY doc_id),
corpus AS ({derived.duck(derived.COVERS, 'pages')}), {Q.cover('corpus')},
o AS (SELECT doc_id, string_agg(t, ' ' ORDER BY idx) AS organizations FROM (SELECT doc_id, idx, trim(regexp_replace(trim(text), '发布$', '')) AS t FROM raw WHERE type = 'footer') WHERE t <> '' GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(nullif({'CASE WHEN contains(f_hierarchy, chr(22269)||chr(23478)||chr(26631)||chr(20934)) THEN chr(22269)||chr(23478)||chr(26631)||chr(20934) ELSE CASE WHEN contains(f_hierarchy, chr(34892)||chr(19994)||chr(26631)||chr(20934)) THEN chr(34892)||chr(19994)||chr(26631)||chr(20934) ELSE f_hierarchy END END' if f == 'hierarchy' else f'f_{f}'}, ''), cover.{f}) AS {f}" for f in _FLAGS)}, coalesce(organizations, '') AS organizations FROM cover LEFT JOIN s3 USING (doc_id) LEFT JOIN o USING (doc_id)"""


@query(_HEADER_SQL)
def header_records(spark, sf_dir):
    """the cover record from header blocks by kind, by number and by place, then from the text; who issues, from the footers.  The SQL walks the blocks one by one."""
    blocks = derived.headers(spark, sf_dir)
    found = metadata.header_records(blocks, derived.covers(spark, sf_dir))
    return found.join(metadata.issuing_organizations(blocks), "doc_id", "left").withColumn("organizations", F.coalesce("organizations", F.lit("")))


def _written(spark) -> str:
    """A folder of its own in the shared one; it goes with the session."""
    return new_folder(spark, "written") + "/t"


@query(f"WITH {Q.LINES}, {book_queries._BOOK} SELECT doc_id || '/' || chunk_id AS chunk_id, title, scope, content, 'local' AS analysis_mode, scope AS targets FROM chunks")
def saved_rules(spark, sf_dir):
    """Rules written as an index and read back, what they lack filled in."""
    book = rulebook.rule_chunks(S.lines(std_corpus(spark, sf_dir)))
    book = book.withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id")).drop("doc_id", "source_ref")
    path = _written(spark)
    sinks.save_index(book, path)
    return files.load_index(spark, path).select("chunk_id", "title", "scope", "content", "analysis_mode", F.array_join("target_scopes", ",").alias("targets"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '国家标准' WHEN 1 THEN '地方标准' ELSE '行业标准' END AS category FROM customer")
def category_folders(spark, sf_dir):
    """Records written by category and read back by folder."""
    k = F.col("c_custkey")
    number = F.when(k % 3 == 0, "GB 1-2020").when(k % 3 == 1, "DB11 2-2020").otherwise("JB 3-2020")
    path = _written(spark)
    sinks.write_by_category(_table(spark, sf_dir, "customer").select(k.alias("id"), T.category(number, F.lit("")).alias("category")), path)
    return spark.read.schema("id long, category string").json(path)


@query("SELECT o_orderkey AS input, o_orderstatus <> 'F' AS success FROM orders")
def run_log(spark, sf_dir):
    """K5: a log appended to twice, a row an input."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input"), (F.col("o_orderstatus") != "F").alias("success"))
    path = _written(spark)
    sinks.append_run_log(rows.where("input % 2 = 0"), path)
    sinks.append_run_log(rows.where("input % 2 = 1"), path)
    return spark.read.schema("input long, success boolean").json(path)


@query("SELECT event_id, 'j' || user_id % 4 AS job_id, CASE event_id % 2 WHEN 0 THEN 'pass' ELSE 'fail' END AS status FROM events")
def written_reviews(spark, sf_dir):
    """Issues written a folder a job and read back."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("j"), (F.col("user_id") % 4).cast("string")).alias("job_id"), F.when(F.col("event_id") % 2 == 0, "pass").otherwise("fail").alias("status"))
    path = _written(spark)
    sinks.write_review(rows, path)
    return spark.read.schema("event_id long, status string, job_id string").json(path)


@query("SELECT c_nationkey::VARCHAR AS doc_id, 'ICS' AS cls, 'n' || c_custkey AS txt, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 1000)::INT END AS start_pos FROM customer")
def written_spans(spark, sf_dir):
    """Annotated records written as JSON lines and read back as spans."""
    k = F.col("c_custkey")
    place = F.when(k % 2 == 0, F.struct((k % 1000).cast("int").alias("start_pos"), F.lit(0).alias("end_pos")))
    item = F.struct(F.lit("ICS").alias("extraction_class"), F.concat(F.lit("n"), k.cast("string")).alias("extraction_text"), place.alias("char_interval"))
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), F.array(item).alias("extractions"))
    path = _written(spark)
    sinks.write_metadata({"annotated": rows}, ["annotated", "annotated"], path)
    return files.read_spans(spark, f"{path}/annotated").select("doc_id", "cls", "txt", "start_pos")
