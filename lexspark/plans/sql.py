"""DuckDB SQL that states the registered queries over again, for comparison."""

from __future__ import annotations

from lexspark.functions import text as T
from lexspark.sources import std_corpus

B = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{3000}]"
NL = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def strip(x: str) -> str:
    return sub(x, f"^{B}+|{B}+$")


def squeeze(x: str) -> str:
    return strip(sub(x, f"{B}+", " "))


def key(x: str) -> str:
    return sub(sub(sub(strip(x), r"^[#\x09-\x0D\x20]+"), f"{B}+"), r"[：:，,。；;（）()\[\]【】《》\-—]+")


def classify(x: str) -> str:
    k = sub(key(x), r"^[0-9]+(?:\.[0-9]+)*")
    tests = " ".join(f"WHEN {'starts_with' if at_start else 'contains'}({k}, '{word}') THEN '{scope}'" for scope, at_start, word in T.HEADING_RULES)
    return f"(CASE {tests} END)"


def toc_entry(x: str) -> str:
    return has(squeeze(x), r"(?i) (?:[IVXLCM]+|[0-9]+)$")


def numbered(x: str) -> str:
    return has(x, r"^[0-9]+(?:\.[0-9]+)*[\x09-\x0D\x20]+.+$")


BARE = ", ".join(f"'{t}'" for t in T.BARE_TITLES)
END = ", ".join(f"'{t}'" for t in T.END_SCOPES)
BODY = ", ".join(f"'{t}'" for t in T.BODY_SCOPES)
CORPUS = std_corpus.DUCK_SQL
LINES = f"""corpus AS ({CORPUS}),
parts AS (SELECT doc_id, string_split_regex(text, '{NL}') AS p FROM corpus),
ln AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM parts))"""
HEAD = f"""h0 AS (SELECT *, {strip('line')} AS held FROM ln),
h1 AS (SELECT *, CASE WHEN {has('held', r'^#{1,6}[\x09-\x0D\x20]*.+$')} THEN {strip("regexp_extract(held, '^#{1,6}[\\x09-\\x0D\\x20]*(.+)$', 1)")} WHEN held IN ({BARE}) THEN held ELSE '' END AS head FROM h0),
h2 AS (SELECT *, CASE WHEN head <> '' THEN {classify('head')} END AS kind, head <> '' AND {has(key('head'), '^(目次|目录)')} AS toc_title FROM h1),
h3 AS (SELECT *,
  {toc_entry("(CASE WHEN head <> '' THEN head ELSE held END)")} OR {has('held', r'(?i)\.{3,}[\x09-\x0D\x20]*(?:[0-9]+|[IVXLCM]+)$')} AS toc_like,
  {has('held', '[。！？；;：:]$')} OR length(held) >= 30 AS prose,
  head <> '' AND (kind IS NOT NULL OR {has(key('head'), '^[0-9]')}) AS title FROM h2),
h4 AS (SELECT *, CASE WHEN held = '' THEN '' WHEN toc_title OR toc_like THEN 'T' WHEN title AND prose THEN 'Q' WHEN title THEN 'H' WHEN prose THEN 'P' ELSE 'N' END AS code,
  head <> '' AND NOT toc_title AND kind IS NOT NULL AND NOT {toc_entry('head')} AS opens,
  CASE WHEN head <> '' THEN NOT toc_title AND kind IS NOT NULL ELSE {numbered('held')} AND NOT {toc_entry('held')} END AS plain FROM h3),
h5 AS (SELECT *, substr(coalesce(string_agg(code, '') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING), ''), 1, 12) AS seen FROM h4),
h6 AS (SELECT *, CASE WHEN regexp_matches(seen, '^[NH]*[PQ]') THEN true WHEN regexp_matches(seen, '^[NH]*T[TN]*[HQ]') THEN false WHEN regexp_matches(seen, '^[NH]*T[TN]*P') THEN true ELSE length({sub('seen', '[^T]')}) < 2 END AS genuine,
  min(CASE WHEN toc_title THEN line_no END) OVER (PARTITION BY doc_id) AS toc FROM h5),
h7 AS (SELECT *, coalesce(CASE WHEN toc IS NULL THEN min(CASE WHEN plain THEN line_no END) OVER (PARTITION BY doc_id) ELSE min(CASE WHEN opens AND genuine AND line_no > toc THEN line_no END) OVER (PARTITION BY doc_id) END, 2147483647) AS body FROM h6),
zoned AS (SELECT *, CASE WHEN line_no >= body THEN 'body' WHEN line_no >= toc THEN 'toc' ELSE 'cover' END AS zone FROM h7)"""
SECTIONS = f"""b0 AS (SELECT *, CASE WHEN held = '' THEN false WHEN head <> '' THEN kind IS NOT NULL OR {has(key('head'), '^[0-9]')} OR NOT {has('head', '[。！？；;：:]$')} ELSE {numbered('held')} END AS cut FROM zoned WHERE zone = 'body'),
b1 AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM b0),
b2 AS (SELECT doc_id, sec, {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text, arg_min(CASE WHEN head <> '' THEN head ELSE held END, line_no) AS heading, bool_or(cut) AS anyc, min(line_no) AS line_start, max(CASE WHEN held <> '' THEN line_no END) AS line_end FROM b1 GROUP BY doc_id, sec),
b3 AS (SELECT *, NOT bool_or(anyc) OVER (PARTITION BY doc_id) AS none, {classify('heading')} AS own FROM b2 WHERE text <> ''),
b4 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS prev FROM b3),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS ord, CASE WHEN none THEN 'other_body' ELSE coalesce(own, CASE WHEN prev IN ({END}) THEN prev END, 'other_body') END AS scope, CASE WHEN none THEN '' ELSE heading END AS heading, text, line_start, line_end FROM b4),
both_sections AS (SELECT doc_id, ord, scope, text FROM sections UNION ALL SELECT doc_id, ord, 'end', text FROM sections WHERE scope IN ({END})),
scopes AS (SELECT doc_id, zone AS scope, {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM zoned WHERE zone <> 'body' GROUP BY doc_id, zone HAVING {strip("string_agg(line, chr(10) ORDER BY line_no)")} <> ''
  UNION ALL SELECT doc_id, scope, string_agg(text, chr(10) || chr(10) ORDER BY ord) FROM both_sections GROUP BY doc_id, scope)"""
RULES = std_corpus.rules_sql()


def over_lines(query: str) -> str:
    return f"WITH {LINES} {query}"


def over_zones(query: str) -> str:
    return f"WITH {LINES}, {HEAD} {query}"


def over_sections(query: str, *more: str) -> str:
    return f"WITH {', '.join([LINES, HEAD, SECTIONS, *more])} {query}"


W = r"[\p{L}\p{N}_]"
NUMBER = rf"(?i)(?:GB|GB/T|GB/Z|GH/T|NY/T|DB[0-9]{{2}}/T){B}*[\p{{L}}\p{{N}}_.-]+[-—][0-9]{{4}}"


def cover(source: str, key: str = "doc_id") -> str:
    """CTEs that end in ``cover`` (key, number, replaced, ics, ccs, code, hierarchy) of the texts of ``source``."""
    number = "regexp_replace(regexp_replace({}, '[—–－]+', '-', 'g'), '^(?:代替|替代)\\x20*', '')".replace("\\\\", "\\")
    sure = f"NOT regexp_matches(substr(text, greatest(1, pos - 20), pos - greatest(1, pos - 20) + length(hit) + 20), '代替|替代|相比|首次发布|被代替|废止') AND (pos = 1 OR NOT regexp_matches(substr(text, pos - 1, 1), '{W}')) AND NOT regexp_matches(substr(text, pos + length(hit), 1), '{W}')"
    edge = lambda p: f"(?:^|[^\\p{{L}}\\p{{N}}_]){p}(?:$|[^\\p{{L}}\\p{{N}}_])".replace("\\\\", "\\")
    pair = edge(f"([A-Z]){B}+([0-9]{{2}})")
    return f"""cov0 AS (SELECT {key}, text, string_split_regex(text, '{NUMBER}') AS g, regexp_extract_all(text, '{NUMBER}') AS h FROM {source}),
cov1 AS (SELECT {key}, text, i, h[i] AS hit, (1 + list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS pos FROM cov0, unnest(range(1, len(h) + 1)) AS u(i)),
cov2 AS (SELECT {key}, arg_min(hit, i) AS hit FROM cov1 WHERE {sure} GROUP BY {key}),
cov3 AS (SELECT c.{key}, {strip(number.format("coalesce(hit, '')"))} AS number, {strip(number.format(f"regexp_extract(text, '(?i)代替{B}*([A-Z]{{1,5}}/?T?{B}*[\\p{{L}}\\p{{N}}_.-]+[-—][0-9]{{4}})', 1)".replace(chr(92) * 2, chr(92))))} AS replaced,
  regexp_extract(text, '{edge(f"(?i:ICS){B}*([0-9]{{2}}(?:[.][0-9]+){{0,2}})")}', 1) AS ics, replace(regexp_extract(text, '{edge(f"(?i:CCS){B}*((?i:[A-Z]){B}*[0-9]{{2}})")}', 1), ' ', '') AS ccs1,
  CASE WHEN regexp_matches(text, '{edge(f"B{B}*31")}') THEN regexp_extract(text, '{pair}', 1) || regexp_extract(text, '{pair}', 2) ELSE '' END AS ccs2,
  upper(regexp_extract(text, '(?i)(?:^|\\n){B}*(GB|GB/T|GB/Z|DB[0-9]{{2}}/T){B}*(?:\\n|$)', 1)) AS own_code,
  CASE WHEN contains(text, '国家标准') THEN '国家标准' WHEN contains(text, '行业标准') THEN '行业标准' WHEN contains(text, '地方标准') THEN '地方标准' ELSE '' END AS hierarchy FROM {source} c LEFT JOIN cov2 ON c.{key} = cov2.{key}),
cover AS (SELECT {key}, number, replaced, ics, CASE WHEN ccs1 <> '' THEN ccs1 WHEN regexp_matches(ccs2, '^[A-H]') THEN ccs2 ELSE '' END AS ccs, CASE WHEN own_code <> '' THEN own_code ELSE coalesce(string_split(string_split_regex(upper(number), '{B}+')[1], '/')[1], '') END AS code, hierarchy FROM cov3)""".replace("\\\\", "\\")
