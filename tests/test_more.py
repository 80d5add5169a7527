"""Fallback splitters, unwrapped messages, progress rows and hooks."""

from lexspark.operators import audit, hooks, rulebook
from lexspark.operators import segment as S
from lexspark.streaming import events as E


def test_fallback_and_headings(spark):
    df = spark.createDataFrame([(1, "intro\n# 1 范围\na\n# 范围 again\nb\n## 术语\nc\n# x\nd"), (2, "plain")], "doc_id int, text string")
    got = {(r.doc_id, r.scope): r.text for r in S.fallback_split(S.lines(df)).collect()}
    assert got == {(1, "scope"): "# 1 范围\na", (1, "terms_definitions"): "## 术语\nc", (1, "other_body"): "# x\nd", (2, "other_body"): "plain"}
    heads = spark.createDataFrame([(1, "# 1  范围\ntext\n2.1 条\n#")], "doc_id int, text string")
    assert [r.heading for r in S.body_headings(heads).orderBy("line_no").collect()] == ["1 范围", "2.1 条"]
    book = spark.createDataFrame([(1, "# t\nlost\n## [GB-01] 名称\nbody\n\nmore\n### 其他\n")], "doc_id int, text string")
    assert [(r.rule_id, r.rule_name, r.text) for r in rulebook.rule_headings(S.lines(book)).orderBy("rule_id").collect()] == [("GB-01", "名称", "body\n\nmore"), ("R-002", "其他", "")]


def test_messages_and_progress(spark):
    data = '{"messages": [{"kwargs": {"id": "m1", "name": "parse", "content": "{\\"a\\": 1}"}}, {"type": "tool", "id": "m2", "additional_kwargs": {"name": "x"}, "content": {"b": 2}}, {"name": "bad", "content": "text"}]}'
    df = spark.createDataFrame([(1, data), (2, "broken")], "seq long, data string")
    assert sorted((r.message_id, r.tool, r.content) for r in E.unwrap_messages(df).collect()) == [("m1", "parse", '{"a": 1}'), ("m2", "x", '{"b":2}')]
    rows = E.progress_rows(spark.createDataFrame([("t", "s", "e", 3)], "trace_id string, started string, ended string, n int"), "scoped").collect()
    assert [(r.type, r.created_at, r.extras) for r in rows] == [("meta.scoped.start", "s", {}), ("meta.scoped.end", "e", {"n": "3"})]


def test_hooks(spark):
    files = spark.createDataFrame([("a", bytearray(b"hi")), ("b", bytearray(b"\xff"))], "path string, content binary")
    got = {r.path: (r.text, r.error is None) for r in hooks.parse_documents(files, lambda b: (b.decode(), "{}")).collect()}
    assert got == {"a": ("hi", True), "b": (None, False)}
    iss = spark.createDataFrame([(1, i, f"r{i}", "s", "warn", "major") for i in range(40)], "doc_id int, ord int, rule_name string, scope string, status string, severity string")
    assert hooks.summarise(iss, lambda p: f"{len(p.splitlines())} {p[:2]}").first().summary == "32 r0"
    facts = spark.createDataFrame([(1, "paragraph", "ab"), (1, "paragraph", None)], "doc_id int, kind string, text_excerpt string")
    assert [(r.facts, r.chars) for r in audit.facts_summary(facts).collect()] == [(2, 2)]


def test_headers_of_a_cover(spark):
    from pyspark.sql import functions as F

    from lexspark.functions import text as T

    cases = {"ICS 67.080.10": "ics", "B 31": "ccs", "CCS B31": "ccs", "GB": "code", "中华人民共和国国家标准": "hierarchy", "GB/T 15034—2009": "number", "代替 GB/T 15034—1994": "replaced", "plain words": None}
    df = spark.createDataFrame(list(cases.items()), "t string, kind string")
    assert {r.t: r.k for r in df.select("t", T.header_kind(F.col("t")).alias("k")).collect()} == cases


def test_alignment_prefers_bookmarks(spark):
    from lexspark.operators import audit

    toc = spark.createDataFrame([(1, 1, "a", "a", ["m2"]), (1, 2, "a", "a", []), (1, 3, "x", "b", None)], "doc_id long, idx int, key string, title string, bookmarks array<string>")
    heads = spark.createDataFrame([(1, 10, "a", "a", ["m1"]), (1, 11, "q", "q", ["m2", "m3"]), (1, 12, "b2", "b", [])], "doc_id long, idx int, key string, title string, bookmarks array<string>")
    assert sorted((r.toc_idx, r.heading_idx) for r in audit.align_toc(toc, heads).collect()) == [(1, 11), (2, 10), (3, 12)]
    plain = audit.align_toc(toc.drop("bookmarks"), heads).collect()
    assert {(r.toc_idx, r.heading_idx) for r in plain} == {(1, 10), (2, None), (3, 12), (None, 11)}


def test_windows_hold_the_whole_text(spark):
    from pyspark.sql import functions as F

    from lexspark.operators import review

    for n in (0, 1, 2200, 2201, 9000):
        got = spark.range(1).select(review.windows(F.lit(("abc" * n)[:n]))).first()[0]
        assert "".join(got) == ("abc" * n)[:n] and len(got) == max(1, -(-n // 2200))


def test_documents_without_facts(spark):
    from lexspark.operators import audit

    facts = spark.createDataFrame([(1, 1, "paragraph", "chapter", "scope", "2 范围", "2 范围")], "doc_id long, idx int, kind string, role string, scope string, display_heading string, text_excerpt string")
    got = {(r.doc_id, r.rule_id, r.status) for r in audit.format_issues(facts, spark.range(3).selectExpr("id as doc_id")).collect()}
    assert got == {(1, "DOCX-FMT-001", "fail"), (0, "DOCX-FMT-000", "info"), (2, "DOCX-FMT-000", "info")}
