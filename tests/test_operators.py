"""Scopes, contexts, numbering, pages and records on small tables."""

from pyspark.sql import functions as F

from lexspark.operators import metadata, numbering, records, review, scopes
from lexspark.sources.std_corpus import rules


def test_scope_keys(spark):
    df = spark.createDataFrame([(["术语", " scope ", None, "", "范围", "own"],)], "k array<string>")
    assert df.select(scopes.normalize_keys(F.col("k"))).first()[0] == ["terms_definitions", "scope", "own"]
    assert df.select(scopes.canonical(F.array(F.lit("end"), F.lit("toc")))).first()[0] == ["toc", "end"]
    m = spark.createDataFrame([(1, {"scope": "a", "toc": " "}, "whole"), (2, {"toc": ""}, None)], "doc_id int, scopes map<string,string>, text string")
    got = [(r.selected, r.warning is None) for r in scopes.select_scopes(m, ["scope", "toc"]).orderBy("doc_id").collect()]
    assert got == [({"scope": "a"}, True), ({"full_document": ""}, False)]
    keys = spark.createDataFrame([(1, ["appendix"]), (2, ["index"])], "doc_id int, keys array<string>")
    assert [(r.expanded, r.added) for r in scopes.expand_scopes(keys, rules(spark)).orderBy("doc_id").collect()] == [(["other_body", "appendix"], ["other_body"]), (["index"], [])]
    act = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], ["z"])], "active array<string>, requested array<string>")
    assert [r.scopes for r in scopes.active_scopes(act).collect()] == [["b"], ["a"]]


def test_modes(spark):
    df = spark.createDataFrame([("full", True, True, []), ("format", False, True, []), ("partial", True, False, []), ("chapters", True, False, ["scope"]), ("x", True, True, []), ("content", False, False, [])], "mode string, has_content boolean, has_source boolean, scopes array<string>")
    assert [(r.content, r.format_only, r.partial, r.error) for r in scopes.resolve_mode(df).collect()] == [(True, False, False, None), (False, True, False, None), (True, False, True, "scopes are missing"), (True, False, True, None), (False, False, False, "unknown mode"), (True, False, False, "content is missing")]


def test_rule_retrieval(spark):
    hits = spark.createDataFrame([("scope", "N-01", 0.9), ("scope", "N-05", 0.5), ("toc", "N-05", 0.8), ("toc", "N-07", 0.7), ("toc", "N-01", 0.6)], "scope string, chunk_id string, score double")
    docs = spark.createDataFrame([(1, "scope"), (1, "toc"), (2, "scope")], "doc_id int, scope string")
    got = {(r.doc_id, r.chunk_id, r.matched_scope) for r in scopes.retrieve_rules(docs, hits, rules(spark)).collect()}
    assert got == {(1, "N-05", "toc"), (1, "N-01", "scope"), (2, "N-01", "scope"), (2, "N-05", "scope")}
    q = spark.createDataFrame([("q1", "前言"), ("q2", "范围"), ("q3", "nothing")], "query_id string, query string")
    bare = spark.createDataFrame([("q2",)], "query_id string")
    assert [(r.query_id, r.chunk_id, r.score) for r in scopes.keyword_search(q, rules(spark), bare).collect()] == [("q1", "N-04", 0.5)]
    v = spark.createDataFrame([([1.0, 2.0], [3.0])], "q array<double>, d array<double>")
    assert v.select(scopes.positional_cosine(F.col("q"), F.col("d"))).first()[0] == 3.0


def test_contexts(spark):
    units = spark.createDataFrame([(1, 1, "foreword", "前言", "f" * 30), (1, 2, "scope", "1 范围", "s" * 30), (1, 3, "other_body", "", "b" * 30), (1, 4, "appendix", "附录", "a" * 30), (2, 1, "cover", "cover", "c" * 99), (3, 1, "appendix", "附录", "z")], "doc_id int, ord int, scope string, heading string, text string")
    plans = spark.createDataFrame([(d, r, t) for d in (1, 2, 3) for r, t in (("body", ["scope"]), ("front", ["foreword"]), ("none", ["index"]))], "doc_id int, chunk_id string, targets array<string>")
    got = {(r.doc_id, r.chunk_id): r.context for r in scopes.build_context(plans, units, 50).collect()}
    assert got[1, "body"] == "## 1 范围\n" + "s" * 30 and got[1, "front"] == "## 前言\n" + "f" * 30
    assert got[1, "none"] == "## 前言\n" + "f" * 30 and got[2, "body"] == "c" * 50 and got[3, "front"] == "## 附录\nz"


def test_list_numbers(spark):
    rows = [(1, i, "L", lv, [1, 3, 1]) for i, lv in enumerate([0, 1, 1, 2, 1, 0, 1, 2, 2])] + [(2, 0, "L", 1, [5])]
    df = spark.createDataFrame(rows, "doc_id int, idx int, list_id string, level int, start array<int>")
    got = [(r.doc_id, r.numbers) for r in numbering.list_numbers(df).orderBy("doc_id", "idx").collect()]
    assert got == [(1, [1]), (1, [1, 3]), (1, [1, 4]), (1, [1, 4, 1]), (1, [1, 5]), (1, [2]), (1, [2, 3]), (1, [2, 3, 1]), (1, [2, 3, 2]), (2, [5, 1])]
    shown = spark.createDataFrame([([2, 27, 4], "%1.%2（%3）", ["decimal", "lowerLetter", "upperRoman"])], "n array<int>, p string, f array<string>")
    assert shown.select(numbering.render_number(F.col("n"), F.col("p"), F.col("f"))).first()[0] == "2.aa（IV）"
    fix = spark.createDataFrame([(1, 1, True, "4"), (1, 2, False, "3.2"), (1, 3, False, "4.1")], "doc_id int, idx int, is_chapter boolean, number string")
    assert [r.number for r in numbering.correct_numbering(fix).orderBy("idx").collect()] == ["4", "4.2", "4.1"]


def test_styles(spark):
    df = spark.createDataFrame([(1, "a", None, "song", 10), (1, "b", "a", None, 12), (1, "c", "b", "hei", None), (1, "x", "y", None, 1), (1, "y", "x", "kai", None), (1, "z", "gone", None, 7), (1, "z", "gone", None, 7), (2, "a", None, None, None)], "doc_id int, style string, based_on string, font string, size int")
    rows = numbering.resolve_inheritance(df, ["font", "size"]).collect()
    assert len(rows) == 7 and [(r.style, r.font, r["size"]) for r in rows if r.doc_id == 2] == [("a", None, None)]
    got = {r.style: (r.font, r["size"]) for r in rows if r.doc_id == 1}
    assert got.pop("z") == (None, 7)
    assert got == {"a": ("song", 10), "b": ("song", 12), "c": ("hei", 12), "x": ("kai", 1), "y": ("kai", 1)}


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "封面"), (1, 2, "目 次\n前言\nII\n1 范围 .... 1\n2 术语 3\n\n"), (1, 3, " "), (1, 4, "正文")], "doc_id int, page int, text string")
    assert numbering.toc_page(pages).first().toc_page == 2
    assert [r.line for r in numbering.page_lines(pages).orderBy("page", "i").collect()] == ["封面", "目 次", "前言", "II", "2 术语 3", "正文"]
    assert numbering.text_view(pages, F.lit(3)).first().text == "正文"
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["目次 I", "前言", "II", "1 范围 1", "loose"])], "doc_id int, line_no int, line string")
    assert [(r.title, r.page, r.page_scheme) for r in numbering.paired_toc_rows(lines).orderBy("line_no").collect()] == [("前言", 2, "roman"), ("1 范围", 1, "arabic")]
    foot = spark.createDataFrame([(1, 1, 90.0, 100.0, "3"), (1, 1, 95.0, 100.0, " iv "), (1, 1, 10.0, 100.0, "9"), (1, 1, 99.0, 100.0, "text")], "doc_id int, page int, y double, height double, text string")
    assert numbering.footer_page(foot).first().label == "iv"
    m = spark.createDataFrame([(1, 1, "arabic", 1, 5), (1, 2, "arabic", 2, 6), (1, 3, "arabic", 9, 7), (2, 1, "arabic", 3, 5), (2, 2, "arabic", 4, 6)], "doc_id int, toc_idx int, page_scheme string, toc_page int, raw_page int")
    assert [(r.doc_id, r.toc_idx, r.body_page) for r in numbering.check_toc_pages(m).collect()] == [(1, 3, 3)]
    o = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, 1, 1), (2, 2, 3)], "doc_id int, toc_idx int, heading_idx int")
    assert {r.doc_id: r.mismatch for r in numbering.order_mismatch(o).collect()} == {1: True, 2: False}
    h = spark.createDataFrame([("范围", "1."), ("1 范围", "2"), ("x", None)], "t string, n string")
    assert [r[0] for r in h.select(numbering.display_heading(F.col("t"), F.col("n"))).collect()] == ["1 范围", "1 范围", "x"]


def test_validation(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no", "b": "x"}',), ("[",), ("{}",)], "json string")
    assert [r.error for r in records.validate(df, "a int, b string").collect()] == [None, "bad fields: a", "no object", None]
    i = spark.createDataFrame([("major", "fail", 0.5, "/x"), ("zz", None, 1.5, "x")], "severity string, status string, confidence double, path string")
    assert [r.errors for r in records.validate_issues(i).collect()] == [[], ["severity", "status", "confidence", "path"]]


def test_artifacts(spark):
    a = spark.createDataFrame([(1, "t", "a1", "md", 1, "/1", "/h"), (1, "t", "a2", "md", 2, "/2", "/h"), (1, "t", "b", "json", 1, "/3", "/h"), (2, "u", "c", "md", 1, "/4", "/h")], "doc_id int, thread_id string, artifact_id string, type string, ord int, virtual_path string, host_path string")
    assert {r.doc_id: r.artifacts for r in records.artifact_map(a).collect()} == {1: {"md": "a2", "json": "b"}, 2: {"md": "c"}}
    assert "host_path" not in records.public_artifacts(a).columns and records.artifacts_for(a, "t", "b").count() == 1
    assert records.artifacts_for(a, "t", None, spark.createDataFrame([("/2",)], "path string")).first().artifact_id == "a2"
    res = spark.createDataFrame([(1, "parse", '{"out": {"md": "/m"}}'), (2, "parse", "{}")], "id int, tool string, result string")
    spec = spark.createDataFrame([("parse", "out.md", "markdown")], "tool string, field string, type string")
    assert [tuple(r) for r in records.artifacts_of(res, spec).collect()] == [(1, "markdown", "/m")]
    row = spark.createDataFrame([("a b", "x/y", [(1, "p"), (2, "q")], 2, "GB/T 1-2020", "body")], "t string, a string, items array<struct<id:int,v:string>>, w int, n string, text string")
    got = row.select(records.download_url(F.col("t"), F.col("a")), records.pick(F.col("items"), F.col("w"))["v"], records.base_name(F.col("n"), F.col("t")), records.prepend_cover(F.col("text"), {"标准号": F.col("n"), "ICS": F.lit("")}), records.dotted(F.lit('{"a": {"b": "c"}}'), "a.b"), records.location_text(F.lit("p1"), F.lit(None).cast("string"))).first()
    assert tuple(got) == ("/threads/a%20b/artifacts/x%2Fy", "q", "GB-T-1-2020", "标准号：GB/T 1-2020\n\nbody", "c", "位置=p1，样式=未命名样式")
    iss = spark.createDataFrame([(1, 1, "warn", "major", "r", "scope"), (2, 1, "fail", "major", "r", "scope")], "doc_id int, ord int, status string, severity string, rule_name string, scope string")
    assert [(r.doc_id, r.passed, r.report) for r in records.review_response(iss, a, True).orderBy("doc_id").collect()] == [(1, True, "1. [warn] r：scope"), (2, False, "1. [fail] r：scope")]


def test_metadata(spark):
    docs = spark.createDataFrame([(1, "标准正式编号：GB/T 15034-2009\n代替GB/T 15034-1994\n见 GB/T 1.1-2020 。")], "doc_id int, text string")
    spans = metadata.find_spans(docs).withColumn("seq", F.lit(1))
    r = metadata.records(spans).first()
    assert (r["标准号"], r["代替标准号"], r["制修订"], r["标准性质"], r["引用文件"]) == ("GB/T 15034-2009", "GB/T 15034-1994", "修订", "推荐性", ["GB/T 1.1-2020"])
    w = spark.createDataFrame([(1, "GH/T 1513-2025", "中华人民共和国国家标准"), (2, "", ""), (3, "GB 1-2020", "行业标准"), (4, "GB 1-2020", "")], "doc_id int, `标准号` string, `标准层级` string")
    assert [x.warnings for x in metadata.warnings(w).orderBy("doc_id").collect()] == [["gh_national"], ["no_number"], ["gb_not_national"], []]


def test_review_loop_widens(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    sc = spark.createDataFrame([(1, "scope", "x" * 50), (2, "cover", "tiny")], "doc_id int, scope string, text string")
    got = review.run_review(docs, sc, rules(spark)).collect()
    assert {(r.doc_id, r.round) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    sure = review.run_review(docs, sc, rules(spark), judge=lambda p: '{"pass": true}').collect()
    assert sure == []
