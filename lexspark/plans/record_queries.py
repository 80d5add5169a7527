"""Registered queries: issues, format checks, metadata, names, events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import audit, batches, metadata, review
from lexspark.operators import segment as S
from lexspark.plans import sql as Q
from lexspark.sources import derived
from lexspark.sources.std_corpus import std_corpus
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


_I = f"WITH i AS ({derived.duck(derived.ISSUES, 'events')})"
_P = f"WITH p AS ({derived.duck(derived.PARTS, 'events')})"
_S = f"WITH s AS ({derived.duck(derived.SPANS, 'customer')})"


@query(f"{_I} SELECT doc_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pass", "fail", "warn", "info", "insufficient_context", "llm_error", "not_ready")).replace("AS pass", 'AS "pass"') + " FROM i GROUP BY doc_id")
def audit_counts(spark, sf_dir):
    """G1."""
    return review.audit_counts(derived.issues(spark, sf_dir))


@query(f"{_I} SELECT coalesce(audit_track, 'content_llm') AS track, coalesce(scope, 'full_document') AS scope, count(*) AS total, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'pass') AS \"pass\", count(*) FILTER (status = 'insufficient_context') AS insufficient FROM i GROUP BY 1, 2")
def scope_summary(spark, sf_dir):
    """G3."""
    return review.scope_summary(derived.issues(spark, sf_dir))


@query(f"{_I}, s AS (SELECT coalesce(severity, '') AS k, count(*) AS n FROM i GROUP BY 1), t AS (SELECT coalesce(audit_track, '') AS k, count(*) AS n FROM i GROUP BY 1) SELECT (SELECT count(*) FROM i) AS total_issues, (SELECT count(*) FROM i WHERE status = 'fail') AS failed, (SELECT count(*) FROM i WHERE status = 'warn') AS warn, (SELECT count(*) FROM i WHERE status = 'insufficient_context') AS insufficient_context, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM s) AS by_severity, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM t) AS by_track")
def review_summary(spark, sf_dir):
    """One pass by grouping sets; the maps are shown as text."""
    out = review.review_summary(derived.issues(spark, sf_dir))
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumns({"by_severity": shown("by_severity"), "by_track": shown("by_track")})


@query(f"{_I}, f AS (SELECT doc_id, scope, min(ord) AS o FROM i WHERE status = 'insufficient_context' GROUP BY 1, 2) SELECT doc_id, coalesce(string_agg(scope, ',' ORDER BY o), '') AS scopes FROM f GROUP BY doc_id")
def insufficient_scopes(spark, sf_dir):
    """G7, W11."""
    return review.insufficient_scopes(derived.issues(spark, sf_dir)).select("doc_id", F.array_join("scopes", ",").alias("scopes"))


@query(f"""{_I}, b AS (SELECT doc_id, coalesce(scope, '') AS scope, count(*) AS n, min(ord) AS o FROM i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM b), t AS (SELECT doc_id, string_agg(scope || '（' || n || ' 项）', '、' ORDER BY r) AS top_scopes FROM r WHERE r <= 3 GROUP BY 1),
x AS (SELECT doc_id, rule_name, min(ord) AS o FROM i WHERE status = 'insufficient_context' GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM x), z AS (SELECT doc_id, string_agg(rule_name, '、' ORDER BY o) AS insufficient FROM y WHERE r <= 6 GROUP BY 1),
v AS (SELECT doc_id, string_agg(s || ' ' || n, ', ' ORDER BY o) AS severities FROM (SELECT doc_id, coalesce(severity, '') AS s, count(*) AS n, min(ord) AS o FROM i GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc_id, string_agg('fix ' || event_id, '；' ORDER BY r) FILTER (event_id % 3 <> 0) AS suggestions FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM i) WHERE r <= 6 GROUP BY 1)
SELECT doc_id, count(*) AS total, any_value(top_scopes) AS top_scopes, coalesce(any_value(insufficient), '') AS insufficient, any_value(severities) AS severities, coalesce(any_value(suggestions), '') AS suggestions FROM i LEFT JOIN t USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN g USING (doc_id) GROUP BY doc_id""")
def issue_digest(spark, sf_dir):
    """Totals, severities, scopes, suggestions, and rules without context."""
    fix = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat_ws(" ", F.lit("fix"), "event_id"))
    return review.issue_digest(derived.issues(spark, sf_dir).withColumn("scope", F.coalesce("scope", F.lit(""))).withColumn("suggestion", fix))


@query(f"{_I} SELECT doc_id, count(*) FILTER (status = 'fail' OR severity IN ('严重', 'critical')) = 0 AS passed FROM i GROUP BY doc_id")
def verdicts(spark, sf_dir):
    """G17."""
    return review.verdict(derived.issues(spark, sf_dir))


@query(f"{_I} SELECT doc_id, page, string_agg(ord || '. [' || status || '] ' || rule_name || '：' || coalesce(scope, 'full_document'), chr(10) ORDER BY ord) AS report FROM (SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 20 + 1)::INT AS page FROM i) GROUP BY doc_id, page")
def reports(spark, sf_dir):
    """G20."""
    return review.render_report(derived.issues(spark, sf_dir).withColumn("scope", F.coalesce("scope", F.lit("full_document"))), per_page=20)


@query(f"{_I} SELECT event_id, CASE severity WHEN '严重' THEN 'critical' WHEN '中度' THEN 'major' WHEN '轻度' THEN 'minor' WHEN '提示' THEN 'info' WHEN 'major' THEN 'major' ELSE 'info' END AS severity, CASE status WHEN 'llm_error' THEN 'fail' WHEN 'not_ready' THEN 'insufficient_context' WHEN 'info' THEN 'warn' ELSE status END AS status FROM i")
def public_issues(spark, sf_dir):
    """F26."""
    return derived.issues(spark, sf_dir).select("event_id", T.severity(F.col("severity")).alias("severity"), T.status(F.col("status")).alias("status"))


@query(f"{_I}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM i WHERE status = 'fail') SELECT doc_id, ord, lpad(r::VARCHAR, 3, '0') AS no FROM n WHERE r <= 20")
def capped_failures(spark, sf_dir):
    """The first twenty failures of a document, numbered; the cap is the rule's own."""
    return batches.capped(derived.issues(spark, sf_dir).where("status = 'fail'").select("doc_id", "ord"), "doc_id", "ord")


_R = {"pass": "true, \"confidence\": 0.9", "fail": "false, \"confidence\": 0.8", "warn": "false, \"confidence\": 0.35", "info": "false"}


@query(f"""{_I} SELECT doc_id, rule_name AS rule_id, CASE WHEN status IN ('fail', 'llm_error') THEN 'fail' ELSE 'insufficient_context' END AS status,
CASE WHEN status IN ('fail', 'warn', 'info') THEN '中度' ELSE '轻度' END AS severity, (CASE status WHEN 'fail' THEN 0.8 WHEN 'warn' THEN 0.35 WHEN 'info' THEN 0.0 ELSE 0.1 END)::DOUBLE AS confidence,
CASE WHEN status IN ('fail', 'warn', 'info') THEN '未在文档中明确说明' WHEN status = 'llm_error' THEN 'LLM 审核异常：' || left('call ' || event_id || ' ' || repeat('x', (event_id % 400)::INT), 200) ELSE '无法解析 LLM 响应' END AS actual FROM i WHERE status <> 'pass'""")
def judge_issues(spark, sf_dir):
    """Answers in a fence, in running text, unreadable ones, and calls that failed."""
    answer = F.lit("no answer")
    for s, body in _R.items():
        text = '{"pass": ' + body + "}"
        text = f"```json\n{text}\n```" if s == "fail" else f"I think {text} is it." if s == "warn" else text
        answer = F.when(F.col("status") == s, text).otherwise(answer)
    error = F.when(F.col("status") == "llm_error", F.concat(F.lit("call "), F.col("event_id").cast("string"), F.lit(" "), F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int"))))
    return review.judge_issues(derived.issues(spark, sf_dir).select("doc_id", F.col("rule_name").alias("rule_id"), answer.alias("response"), error.alias("error")))


def _facts(spark, sf_dir):
    return audit.facts(S.zones(S.lines(std_corpus(spark, sf_dir))))


_FACTS = r"""f0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS idx, CASE WHEN head <> '' THEN head ELSE held END AS h FROM zoned WHERE held <> ''),
f1 AS (SELECT *, CASE WHEN toc_title THEN 'toc_title' WHEN zone = 'toc' THEN 'toc_entry' WHEN head <> '' AND kind IN ('foreword', 'introduction', 'references', 'index') THEN 'front_title' WHEN head <> '' AND kind = 'appendix' THEN 'appendix_title'
  WHEN regexp_matches(h, '^[0-9]+(?:\.[0-9]+)+') THEN 'clause' WHEN head <> '' THEN 'chapter' ELSE 'paragraph' END AS role FROM f0),
facts AS (SELECT doc_id, idx, role, h, coalesce(last_value(CASE WHEN toc_title THEN 'toc' WHEN role IN ('front_title', 'appendix_title', 'chapter') THEN coalesce(kind, 'other_body') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 'cover') AS scope, substr(held, 1, 300) AS text_excerpt FROM f1)"""


def _over_facts(q):
    return f"WITH {Q.LINES}, {Q.HEAD}, {_FACTS} {q}"


@query(_over_facts("SELECT doc_id, idx, role, scope FROM facts"))
def paragraph_facts(spark, sf_dir):
    """D25, D26, P17."""
    return _facts(spark, sf_dir).select("doc_id", "idx", "role", "scope")


@query(_over_facts("""SELECT doc_id, idx, CASE WHEN n IS NULL THEN 'no number' ELSE 'number ' || n || ', due ' || due END AS reason FROM (SELECT *, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS due FROM (SELECT *, try_cast(nullif(regexp_extract(h, '^([0-9]+)[\\x09-\\x0D\\x20]+.+$', 1), '') AS INT) AS n FROM facts WHERE role = 'chapter')) WHERE n IS NULL OR n <> due""".replace("\\\\", "\\")))
def chapter_failures(spark, sf_dir):
    """C1, W4."""
    return audit.check_chapters(_facts(spark, sf_dir))


@query(_over_facts("""SELECT doc_id, idx, reason FROM (SELECT doc_id, idx, level, bool_or(titled) OVER w AND NOT bool_and(titled) OVER w AS mixed FROM (SELECT *, len(string_split(regexp_extract(h, '^([0-9]+(?:\\.[0-9]+)+)', 1), '.')) AS level, trim(regexp_extract(h, '^[0-9]+(?:\\.[0-9]+)+[\\x09-\\x0D\\x20]*(.*)$', 1)) <> '' AS titled FROM facts WHERE role = 'clause' AND scope <> 'terms_definitions') WINDOW w AS (PARTITION BY doc_id, level)), LATERAL (SELECT unnest([CASE WHEN level > 5 THEN 'depth ' || level END, CASE WHEN mixed THEN 'titles differ at level ' || level END]) AS reason) WHERE reason IS NOT NULL""".replace("\\\\", "\\")))
def clause_failures(spark, sf_dir):
    """C2, G15, F13."""
    return audit.check_clauses(_facts(spark, sf_dir))


@query(_over_facts("""SELECT doc_id, idx1 AS idx, 'after ' || role AS reason FROM (SELECT *, lead(role) OVER w AS role1, lead(scope) OVER w AS scope1, lead(idx) OVER w AS idx1,
  first_value(CASE WHEN role IN ('clause', 'chapter') THEN {'r': role, 'l': level} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING) AS nxt
  FROM (SELECT *, CASE WHEN regexp_matches(h, '^[0-9]') THEN len(string_split(regexp_extract(h, '^([0-9]+(?:\\.[0-9]+)*)', 1), '.')) ELSE 0 END AS level FROM facts) WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
WHERE role IN ('chapter', 'clause') AND scope NOT IN ('terms_definitions', 'symbols_abbreviations') AND role1 = 'paragraph' AND scope1 = scope AND nxt.r = 'clause' AND (role = 'chapter' OR nxt.l > level)""".replace("\\\\", "\\")))
def dangling_failures(spark, sf_dir):
    """C3, W5, W6."""
    return audit.check_dangling(_facts(spark, sf_dir))


_FAILED = "(" + " UNION ALL ".join(f"SELECT doc_id, idx, reason, '{rule}' AS rule_id FROM ({ORACLES[q]})" for q, rule in (("chapter_failures", "DOCX-FMT-001"), ("clause_failures", "DOCX-FMT-002"), ("dangling_failures", "DOCX-FMT-003"))) + ")"
_LOOKED = _over_facts("SELECT doc_id, unnest([CASE WHEN role = 'chapter' THEN 'DOCX-FMT-001' END, CASE WHEN role = 'clause' AND scope <> 'terms_definitions' THEN 'DOCX-FMT-002' END, 'DOCX-FMT-003', CASE WHEN regexp_matches(text_excerpt, '^(——|·|[a-z]）|[0-9]+）)') THEN 'DOCX-FMT-004' END]) AS rule_id FROM facts")


@query(f"SELECT doc_id, rule_id, sum(c)::BIGINT AS checked, sum(f)::BIGINT AS failed FROM (SELECT doc_id, rule_id, 1 AS c, 0 AS f FROM ({_LOOKED}) WHERE rule_id IS NOT NULL UNION ALL SELECT doc_id, rule_id, 0, 1 FROM {_FAILED}) GROUP BY ALL")
def format_evaluations(spark, sf_dir):
    """Checked and failed rows of every check."""
    return audit.evaluations(_facts(spark, sf_dir))


@query(f"SELECT doc_id, rule_id || '-' || lpad(n::VARCHAR, 3, '0') AS issue_id, rule_id, idx, reason, 'fail' AS status, '中度' AS severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY idx, reason) AS n FROM {_FAILED}) WHERE n <= 20")
def format_issues(spark, sf_dir):
    """C6, C7."""
    facts = _facts(spark, sf_dir)
    return audit.format_issues(facts, std_corpus(spark, sf_dir))


def _marks(x: str) -> str:
    """A title without marks, white space and punctuation."""
    return Q.sub(Q.sub(x, r"^#+[\x09-\x0D\x20]*"), Q.B[:-1] + "（）()【】《》\"'：:，,。；;\\-—/、]")


def _split_number(text: str) -> str:
    """SQL columns number, name and key of a heading's text."""
    held = Q.squeeze(text)
    number = f"CASE WHEN regexp_matches({held}, '^[0-9]+(?:[.][0-9]+)*[.]? +.+$') THEN regexp_extract({held}, '^([0-9]+(?:[.][0-9]+)*)[.]? +.+$', 1) ELSE regexp_extract({held}, '^([0-9]+(?:[.][0-9]+)+)[^0-9].+$', 1) END"
    return f"{number} AS num, {held} AS held"


_ALIGN = f"""e0 AS (SELECT doc_id, idx, {Q.squeeze('text_excerpt')} AS x FROM facts WHERE role = 'toc_entry'),
e1 AS (SELECT doc_id, idx, x, CASE WHEN regexp_matches(x, '(?i)^.+?[ .]*(?:[.]{{2,}}| )(?:[IVXLCM]+|[0-9]+)$') THEN trim(regexp_extract(x, '(?i)^(.+?) *(?:[.]{{2,}}| )(?:[IVXLCM]+|[0-9]+)$', 1)) WHEN regexp_matches(x, '(?i)^.+?(?:[IVXLCM]+|[0-9]+)$') THEN trim(regexp_extract(x, '(?i)^(.+?)(?:[IVXLCM]+|[0-9]+)$', 1)) ELSE x END AS t FROM e0),
e2 AS (SELECT doc_id, idx, {_split_number('t')} FROM e1),
g2 AS (SELECT doc_id, idx, {_split_number("coalesce(nullif(CASE WHEN role <> 'paragraph' THEN h END, ''), text_excerpt)")} FROM facts WHERE role IN ('chapter', 'clause', 'front_title', 'appendix_title') AND NOT (role = 'clause' AND scope = 'terms_definitions')),
e3 AS (SELECT doc_id, idx, num, CASE WHEN num = '' THEN held ELSE trim(regexp_replace(substr(held, length(num) + 1), '^[.]? ', '')) END AS name FROM e2), g3 AS (SELECT doc_id, idx, num, CASE WHEN num = '' THEN held ELSE trim(regexp_replace(substr(held, length(num) + 1), '^[.]? ', '')) END AS name FROM g2),
e4 AS (SELECT doc_id, idx, CASE WHEN num <> '' THEN num || '|' ELSE '' END || {_marks('name')} AS key, {_marks('name')} AS title FROM e3 WHERE {_marks('name')} NOT IN ('目次', '目录')),
g4 AS (SELECT doc_id, idx, CASE WHEN num <> '' THEN num || '|' ELSE '' END || {_marks('name')} AS key, {_marks('name')} AS title FROM g3),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM e4),
hs AS (SELECT doc_id, list({{'idx': idx, 'key': key, 'title': title}} ORDER BY idx) AS free FROM g4 GROUP BY doc_id),
r AS (SELECT doc_id, 0::BIGINT AS n, NULL::INT AS toc_idx, NULL::INT AS heading_idx, coalesce(free, []) AS free FROM (SELECT DISTINCT doc_id FROM facts) LEFT JOIN hs USING (doc_id)
  UNION ALL SELECT doc_id, n, idx, hit, list_filter(free, lambda h: hit IS NULL OR h.idx <> hit) FROM (SELECT t.doc_id, t.n, t.idx, r.free, coalesce(CASE WHEN t.key <> '' THEN list_filter(r.free, lambda h: h.key = t.key)[1].idx END, CASE WHEN t.title <> '' THEN list_filter(r.free, lambda h: h.title = t.title)[1].idx END) AS hit FROM r JOIN t ON t.doc_id = r.doc_id AND t.n = r.n + 1))
SELECT doc_id, toc_idx, heading_idx FROM r WHERE n > 0 UNION ALL SELECT doc_id, NULL, unnest(free).idx FROM (SELECT doc_id, arg_max(free, n) AS free FROM r GROUP BY doc_id)"""


@query(_over_facts("").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _ALIGN)
def toc_alignment(spark, sf_dir):
    """Contents rows with their headings, and what is left over on either side; the SQL carries the free headings from row to row."""
    f = _facts(spark, sf_dir)
    return audit.align_toc(audit.toc_entries(f), audit.heading_facts(f))


@query("""SELECT doc_id, idx, (1 + sum((brk AND NOT tab)::INT) OVER w)::BIGINT AS page, (sum((brk AND tab)::INT) OVER w)::BIGINT AS table_breaks, (sum((tab AND NOT prev)::INT) OVER w)::BIGINT AS tables FROM (
SELECT *, coalesce(lag(tab) OVER (PARTITION BY doc_id ORDER BY idx), false) AS prev FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_quantity % 3 = 0 AS brk, l_returnflag = 'R' AS tab FROM lineitem)) WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""")
def running_pages(spark, sf_dir):
    """D27, W7."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), idx.alias("idx"), (F.col("l_quantity") % 3 == 0).alias("is_break"), (F.col("l_returnflag") == "R").alias("in_table"))
    return audit.page_estimate(rows).select("doc_id", "idx", "page", "table_breaks", "tables")


@query(f"{_S}, c AS (SELECT doc_id, cls, trim(txt) AS txt, min(start_pos) AS start_pos, min(seq) AS seq FROM s WHERE trim(txt) <> '' AND cls <> 'other' GROUP BY ALL) SELECT doc_id, cls, txt, start_pos, seq FROM c")
def consolidated_spans(spark, sf_dir):
    """G8."""
    return metadata.consolidate(derived.spans(spark, sf_dir))


@query(f"""{_S}, c AS (SELECT doc_id, cls, trim(txt) AS txt, min(start_pos) AS start_pos, min(seq) AS seq FROM s WHERE trim(txt) <> '' AND cls <> 'other' GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cls ORDER BY start_pos IS NULL, start_pos, seq) AS r FROM c),
g AS (SELECT doc_id, coalesce(max(txt) FILTER (cls = '标准号' AND r = 1), '') AS number, coalesce(max(txt) FILTER (cls = 'ICS' AND r = 1), '') AS ics, coalesce(max(txt) FILTER (cls = '代替标准号' AND r = 1), '') AS replaced,
  coalesce(string_agg(txt, ';' ORDER BY start_pos IS NULL, start_pos, txt) FILTER (cls = '引用文件'), '') AS refs FROM f GROUP BY doc_id)
SELECT *, CASE WHEN regexp_matches(number, '^[A-Z]{{2}}/T') THEN '推荐性' WHEN starts_with(number, 'GB') THEN '强制性' ELSE '' END AS nature, CASE WHEN replaced <> '' THEN '修订' ELSE '制订' END AS revision FROM g""")
def metadata_records(spark, sf_dir):
    """G9, G10, G11, F18, L5."""
    out = metadata.records(derived.spans(spark, sf_dir))
    return out.select("doc_id", F.col("标准号").alias("number"), "ics", F.col("代替标准号").alias("replaced"), F.array_join("引用文件", ";").alias("refs"), F.col("标准性质").alias("nature"), F.col("制修订").alias("revision"))


@query(f"""{_S}, c AS (SELECT DISTINCT doc_id, cls, trim(txt) AS txt FROM s WHERE trim(txt) <> '' AND cls <> 'other') SELECT doc_id, count(DISTINCT cls) FILTER (cls <> '引用文件') AS single, count(*) FILTER (cls = '引用文件') AS multi FROM c GROUP BY doc_id""")
def fill_counts(spark, sf_dir):
    """G12."""
    return metadata.fill_counts(metadata.records(derived.spans(spark, sf_dir))).select("doc_id", F.col("single").cast("long"), F.col("multi").cast("long"))


_CATEGORY = "CASE WHEN regexp_matches(number, '^GB') OR contains(hierarchy, '国家标准') THEN '国家标准' WHEN regexp_matches(number, '^DB[0-9]') OR contains(hierarchy, '地方标准') THEN '地方标准' WHEN number <> '' OR contains(hierarchy, '行业标准') THEN '行业标准' ELSE '其他' END"


@query(f"WITH corpus AS ({derived.duck(derived.COVERS, 'pages')}), {Q.cover('corpus')} SELECT doc_id, number, replaced, ics, ccs, code, hierarchy FROM cover")
def cover_fields(spark, sf_dir):
    """What the text says of the cover: the first number that is not another standard's, and what stands beside it."""
    rows = derived.covers(spark, sf_dir)
    return rows.select("doc_id", *[c.alias(k) for k, c in metadata.cover_fields(F.col("text")).items()])


@query(f"WITH {Q.LINES}, {Q.cover('corpus')} SELECT doc_id, number, replaced, hierarchy FROM cover")
def corpus_covers(spark, sf_dir):
    """F16, F22, over whole texts."""
    fields = metadata.cover_fields(F.col("text"))
    return std_corpus(spark, sf_dir).select("doc_id", *[fields[k].alias(k) for k in ("number", "replaced", "hierarchy")])


_STEMS = "SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN source || '{0}' || (doc_id // 5 % 30) || '{1}' WHEN 3 THEN 'Größe' ELSE source || '_x' END AS stem FROM documents"


def _unique_sql(lead: str, tail: str, first: int) -> str:
    """Numbers that no name has, counted off one by one, instead of a gap search."""
    name = f"stem || '{lead}' || n || '{tail}'"
    return f"""WITH s AS ({_STEMS.format(lead, tail)}), r AS (SELECT *, row_number() OVER (PARTITION BY lang, stem ORDER BY doc_id) AS k FROM s),
f AS (SELECT lang, stem, n, row_number() OVER (PARTITION BY lang, stem ORDER BY n) AS j FROM (SELECT DISTINCT lang, stem FROM r WHERE k > 1) d, unnest(range({first}, (SELECT max(k) FROM r) + 60)) AS u(n) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang IS NOT DISTINCT FROM d.lang AND s.stem = d.{name}))
SELECT doc_id, CASE WHEN k = 1 THEN r.stem ELSE r.{name} END AS unique_stem FROM r LEFT JOIN f ON f.lang IS NOT DISTINCT FROM r.lang AND f.stem = r.stem AND f.j = r.k - 1"""


def _stems(spark, sf_dir, lead, tail):
    return spark.sql(_STEMS.format(lead, tail).replace("//", "div").replace("documents", "{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query(_unique_sql("_", "", 2))
def unique_names(spark, sf_dir):
    """The second and later of a name take numbers that no name has."""
    return metadata.unique_names(_stems(spark, sf_dir, "_", ""), "lang", "stem", "doc_id").select("doc_id", "unique_stem")


@query(_unique_sql("（", "）", 1))
def unique_captions(spark, sf_dir):
    """Names with the number in brackets."""
    return metadata.unique_names(_stems(spark, sf_dir, "（", "）"), "lang", "stem", "doc_id", "%s（%d）", 1).select("doc_id", "unique_stem")


@query("""WITH t AS (SELECT DISTINCT lang, format('{:03d}', (doc_id // 3 % 50)::INT) AS name FROM documents WHERE doc_id % 3 = 0), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 <> 0),
f AS (SELECT lang, format('{:03d}', n::INT) AS name, row_number() OVER (PARTITION BY lang ORDER BY n) AS k FROM (SELECT DISTINCT lang FROM r) d, unnest(range(1, (SELECT max(k) FROM r) + 60)) AS u(n) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lang = d.lang AND t.name = format('{:03d}', n::INT)))
SELECT doc_id, name AS unique_stem FROM r JOIN f USING (lang, k)""")
def numbered_names(spark, sf_dir):
    """Running numbers beside names that are there already."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    taken = docs.where("doc_id % 3 = 0").select("lang", F.format_string("%03d", F.expr("doc_id div 3") % 50).alias("name"))
    return metadata.numbered_names(docs.where("doc_id % 3 <> 0"), "lang", "doc_id", taken).select("doc_id", "unique_stem")


@query("""SELECT doc_id, coalesce(nullif(trim(regexp_replace(trim(coalesce(text, '')), '[^A-Za-z0-9_.\\-\\x{4e00}-\\x{9fff}]+', '_', 'g'), '._'), ''), 'artifact') AS stem FROM documents""")
def safe_names(spark, sf_dir):
    """F1."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.safe_name(F.coalesce("text", F.lit(""))).alias("stem"))


@query("""WITH n AS (SELECT doc_id, doc_id % 4 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN '国家标准' WHEN 1 THEN '地方标准' WHEN 2 THEN '行业标准' ELSE '' END AS category, CASE k WHEN 0 THEN '推荐性' ELSE '' END AS nature FROM n WHERE k < 3""")
def number_categories(spark, sf_dir):
    """category and nature by number."""
    k = F.col("doc_id") % 4
    number = F.when(k == 0, "GB/T 1-2020").when(k == 1, "DB11 2-2020").when(k == 2, "JB 3-2020")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where(k < 3).select("doc_id", number.alias("number"))
    return rows.select("doc_id", T.category(F.col("number"), F.lit("")).alias("category"), T.nature(F.col("number")).alias("nature"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size, strlen(coalesce(text, '')) <= 4000 AS eligible, 'text/markdown' AS mime, source LIKE '%secret%' AS sensitive FROM documents""")
def file_inventory(spark, sf_dir):
    """S3, P14, P15, F38."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size"), (F.octet_length(text) <= 4000).alias("eligible"), T.mime_type(F.concat("source", F.lit(".md"))).alias("mime"), T.is_sensitive(F.concat("source", F.lit(".md"))).alias("sensitive"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber >= 3)")
def pending_inputs(spark, sf_dir):
    """Inputs without every selected output."""
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return batches.pending(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), done, "o_orderkey")


def _run_log(spark, sf_dir):
    k = F.col("event_id") % 3
    outcome = F.when(F.col("value") < 50, "oversized").when(F.col("value") >= 50, F.when(k == 0, "skipped").when(k == 1, "succeeded").otherwise("failed"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", outcome.alias("outcome"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (value < 50) AS oversized, count(*) FILTER (value >= 50 AND event_id % 3 = 0) AS skipped, count(*) FILTER (value >= 50 AND event_id % 3 = 1) AS succeeded, count(*) FILTER (value >= 50 AND event_id % 3 = 2) AS failed FROM events GROUP BY user_id")
def batch_summary(spark, sf_dir):
    """G18."""
    return batches.summary(_run_log(spark, sf_dir), "user_id")


@query("SELECT user_id, event_id FROM events WHERE value >= 50 AND event_id % 3 = 2")
def batch_failures(spark, sf_dir):
    """The failed inputs of a batch, a row each."""
    return batches.failures(_run_log(spark, sf_dir))


@query(f"{_P} SELECT seq, CASE WHEN event = 'custom' THEN 'agent.progress' WHEN data LIKE '%__interrupt__\"%' THEN 'approval.required' WHEN data LIKE '%\"todos\"%' THEN 'plan.updated' WHEN event IN ('messages', 'updates', 'values') THEN 'message.delta' WHEN event = 'error' THEN 'run.failed' ELSE 'langgraph.event' END AS routed FROM p")
def routed_events(spark, sf_dir):
    """ST2."""
    return E.route_events(derived.parts(spark, sf_dir)).select("seq", "routed")


@query(f"{_P} SELECT run_id, message_id, count(*) AS n FROM (SELECT run_id, message_id FROM p WHERE message_id IS NULL UNION ALL SELECT DISTINCT run_id, message_id FROM p WHERE message_id IS NOT NULL) GROUP BY ALL")
def deduplicated_messages(spark, sf_dir):
    """ST3."""
    return E.dedup_messages(derived.parts(spark, sf_dir).withColumnRenamed("run_id", "thread_id")).groupBy(F.col("thread_id").alias("run_id"), "message_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_P} SELECT run_id, arg_max(data, seq) AS data, max(seq) AS seq FROM p WHERE event = 'values' GROUP BY run_id")
def latest_states(spark, sf_dir):
    """ST4."""
    return E.latest_state(derived.parts(spark, sf_dir))


@query(f"{_P} SELECT run_id, CASE WHEN count(*) FILTER (event = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (event = 'end') > 0 THEN 'completed' ELSE 'running' END AS state, count(*) AS n_events, string_agg(DISTINCT artifact_id, ',' ORDER BY artifact_id) AS artifacts FROM p GROUP BY run_id")
def run_states(spark, sf_dir):
    """ST5."""
    return E.run_lifecycle(derived.parts(spark, sf_dir)).withColumn("artifacts", F.array_join("artifacts", ","))


@query(f"{_P} SELECT run_id AS call_id, count(*) FILTER (event = 'error') AS retries, bool_or(seq % 97 = 0) AS exhausted, count(*) FILTER (event = 'ping') AS polls, arg_max(event, seq) AS last_state, max(seq) - min(seq) AS elapsed FROM p GROUP BY run_id")
def call_telemetry(spark, sf_dir):
    """ST6."""
    kind = F.when(F.col("event") == "error", "retry").when(F.col("event") == "ping", "poll")
    return E.call_telemetry(derived.parts(spark, sf_dir).select(F.col("run_id").alias("call_id"), kind.alias("kind"), (F.col("seq") % 97 == 0).alias("exhausted"), F.col("event").alias("state"), "seq", F.col("seq").alias("t")))


@query(f"{_P} SELECT seq, 'event: ' || event || chr(10) || 'data: ' || data || chr(10) || chr(10) AS wire FROM p")
def wire_events(spark, sf_dir):
    """ST7."""
    return E.encode_sse(derived.parts(spark, sf_dir)).select("seq", "wire")


@query("SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'review.ingest.started' ELSE 'review.' || event_type || '.s' || event_id % 3 END AS type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, least(2.0 * 2.0 ** (event_id % 6), 10.0) AS wait FROM events")
def typed_events(spark, sf_dir):
    """F4, F27, F31, ST1."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    started = (F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)
    node, status = F.when(started, "ingest").otherwise(F.col("event_type")), F.when(started, "started").otherwise(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")))
    return ev.select("event_id", E.event_type(node, status).alias("type"), T.utc_iso("ts").alias("created_at"), T.backoff(F.col("event_id") % 6 + 1, 2.0, 10.0, 2.0).alias("wait"))


@query("""SELECT p_partkey, array_to_string([CASE n // 1000 WHEN 0 THEN '' WHEN 1 THEN 'M' WHEN 2 THEN 'MM' ELSE 'MMM' END, ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1], ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1], ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1]], '') AS roman, n AS back, CASE WHEN n > 702 THEN chr((64 + (n - 703) // 676 + 1)::INT) || chr((65 + (n - 703) // 26 % 26)::INT) || chr((65 + (n - 703) % 26)::INT) WHEN n > 26 THEN chr((64 + (n - 1) // 26)::INT) || chr((65 + (n - 1) % 26)::INT) ELSE chr((64 + n)::INT) END AS letters
FROM (SELECT p_partkey, (p_partkey % 3999 + 1)::INT AS n FROM part)""")
def numerals(spark, sf_dir):
    """There and back."""
    n = (F.col("p_partkey") % 3999 + 1).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.to_roman(n).alias("roman"), T.to_letters(n).alias("letters"))
    return rows.withColumn("back", T.roman_or_int(F.col("roman")))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""")
def carried_forward(spark, sf_dir):
    """The last question before each turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return batches.carried(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")
