"""Files, bundles, sinks and streams."""

import json
import zipfile

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import audit, images, review, rulebook
from lexspark.operators import segment as S
from lexspark.sources import files, sinks
from lexspark.streaming import events as E

BOOK = "# 测试规则\n\n## 范围\n\n标准应明确范围章节。\n\n## 规范性引用文件\n\n标准应列出规范性引用文件。\n\n```\na\n\nb\n```\n"


def test_corpus_and_rules(spark, tmp_path):
    (tmp_path / "b.md").write_text(BOOK, encoding="utf-8")
    (tmp_path / "a.txt").write_bytes(b"ok \xff bytes")
    (tmp_path / "c.bin").write_bytes(b"no")
    got = {r.file_name: r.text for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"b.md": BOOK, "a.txt": "ok  bytes"}
    assert [r.path.rsplit("/")[-1] for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.txt", "b.md", "c.bin"]
    rules = files.load_rules(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.scope) for r in rules] == [("RAG-0001", "scope"), ("RAG-0002", "normative_references"), ("RAG-0003", "normative_references")]
    assert rules[2].content == "```\na\n\nb\n```" and rules[0].tags == ["scope", "范围", "测试规则"]
    default = spark.createDataFrame([r for r in rules[:1]], rulebook.rule_chunks(S.lines(spark.createDataFrame([("x", "")], "doc_id string, text string"))).schema)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.md").write_text("no heading")
    assert files.load_rules(spark, str(tmp_path / "empty"), default).count() == 1
    sinks.save_index(rulebook.rule_chunks(S.lines(spark.createDataFrame([("x", BOOK)], "doc_id string, text string"))).drop("doc_id"), str(tmp_path / "index"))
    assert files.load_index(spark, str(tmp_path / "index")).count() == 3
    assert files.is_fresh(spark, str(tmp_path / "b.md"), str(tmp_path / "index"))


def test_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for n, d in (("doc/images/h.jpg", b"x" * 10), ("doc/a.md", b"# a"), ("doc/b.md", b"# b"), ("doc/a_middle.json", b"{}"), ("doc/content_list.json", b"[]"), ("doc/content_list_v2.json", b"[]")):
            z.writestr(n, d)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("x.json", b"{}")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = files.explode_bundles(spark, str(tmp_path)).collect()
    roles = {r.role: r.member for r in rows if r.role}
    assert roles == {"markdown": "doc/a.md", "layout": "doc/a_middle.json", "content_list": "doc/content_list.json"}
    assert sorted((r.bundle.rsplit("/")[-1], bool(r.error)) for r in rows if r.error) == [("bad.zip", True), ("two.zip", True)]
    assert [r.member for r in rows if r.is_image] == ["doc/images/h.jpg"]
    assert images.tiny_images(files.explode_bundles(spark, str(tmp_path))).count() == 1


def test_layout_spans_and_manifest(spark, tmp_path):
    layout = {"pdf_info": [{"page_idx": 0, "discarded_blocks": [{"type": "header", "lines": [{"spans": [{"content": "ICS "}, {"content": "67.080.10"}]}]}, {"lines": [{"spans": [{"content": "GB"}]}]}]}]}
    df = spark.createDataFrame([(1, json.dumps(layout)), (2, "not json")], "doc_id int, json string")
    read = files.read_layout(df)
    assert json.loads(read.where("doc_id = 2").first().layout) == {"raw": "not json"}
    assert [(r.idx, r.text) for r in files.header_blocks(read).orderBy("idx").collect()] == [(0, "ICS 67.080.10"), (1, "GB")]
    (tmp_path / "s.jsonl").write_text(json.dumps({"doc_id": "d", "extractions": [{"extraction_class": "ICS", "extraction_text": "1", "char_interval": {"start_pos": 3}}, {"extraction_class": "CCS", "extraction_text": "2", "char_interval": None}]}) + "\n", encoding="utf-8")
    assert [(r.cls, r.txt, r.start_pos) for r in files.read_spans(spark, str(tmp_path / "s.jsonl")).orderBy("seq").collect()] == [("ICS", "1", 3), ("CCS", "2", None)]
    art = spark.createDataFrame([(("json", "/j"), [("json", "/j"), ("markdown", "/m")]), (("markdown", "/p"), [])], "primary struct<type:string,virtual_path:string>, artifacts array<struct<type:string,virtual_path:string>>")
    assert [r.markdown_path for r in files.resolve_manifest(art).collect()] == ["/m", "/p"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("j1", "/b", "md", None, "国家标准"), ("j1", "/a", "json", "boom", "其他"), ("j2", "/c", "md", None, "其他")], "job_id string, virtual_path string, type string, error string, category string")
    got = {r.job_id: (r.status, [a.virtual_path for a in r.artifacts]) for r in sinks.build_manifest(rows).collect()}
    assert got == {"j1": ("failed", ["/a", "/b"]), "j2": ("ok", ["/c"])}
    sinks.write_review(rows, str(tmp_path / "r"))
    sinks.write_by_category(rows, str(tmp_path / "c"))
    for _ in range(2):
        sinks.append_run_log(rows, str(tmp_path / "log"))
    assert files.read_results(spark, str(tmp_path / "r")).count() == 3 and spark.read.json(str(tmp_path / "c")).count() == 3 and spark.read.json(str(tmp_path / "log")).count() == 6
    assert sinks.selected_outputs(["aggregated", "all"]) == ["aggregated", "annotated", "normalized"]
    new = spark.createDataFrame([("t", "/a", True), ("t", "/a", True), ("t", "/b", False), ("t", "/c", True), ("t", None, True)], "thread_id string, virtual_path string, ok boolean")
    old = spark.createDataFrame([("t", "/c")], "thread_id string, virtual_path string")
    assert [r.virtual_path for r in sinks.register_artifacts(new, old).collect()] == ["/a"]


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i % 3}", ("values", "error", "custom", "end")[i % 4], f'{{"todos": [{i}]}}' if i % 5 == 0 else "{}", None if i % 6 == 0 else f"m{i % 4}", f"a{i % 2}") for i in range(40)], "seq long, run_id string, event string, data string, message_id string, artifact_id string")
    rows = rows.withColumn("thread_id", F.col("run_id")).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_000_000_000))  # a row at the epoch itself would be late
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(_drain(E.route_events(stream).select("seq", "routed"), "routed", "append")) == key(E.route_events(rows).select("seq", "routed"))
    assert key(_drain(E.latest_state(stream), "latest", "complete")) == key(E.latest_state(rows))
    assert key(_drain(E.run_lifecycle(stream), "runs", "complete")) == key(E.run_lifecycle(rows))
    one = lambda df: sorted((r.thread_id, str(r.message_id)) for r in df.collect())
    assert one(_drain(E.dedup_messages(stream), "dedup", "append")) == one(E.dedup_messages(rows))


def test_intake_reads_each_file_once(spark, tmp_path):
    src = tmp_path / "docs"
    src.mkdir()
    (src / "a.md").write_text("one")
    for names in (["a.md"], ["a.md", "b.md"]):
        (src / names[-1]).write_text("one")
        q = E.stream_corpus(spark, str(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(r.file_name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == names


def test_events(spark):
    df = spark.createDataFrame([(1, "t", '{"a": 1, "type": "x"}', ["agent", "tools:9"]), (2, "u", "broken", ["agent"])], "event_id int, type string, payload string, namespace array<string>")
    got = {r.event_id: r.extras for r in E.normalize_events(df).collect()}
    assert got == {1: {"a": "1"}, 2: {}} or got == {1: {"a": "1"}, 2: None}
    assert [(r.source, r.call_id) for r in E.event_source(df).orderBy("event_id").collect()] == [("subagent", "tools:9"), ("main", None)]
    assert spark.range(1).select(E.event_type(F.lit("judge_rules"), F.lit("coverage_check"))).first()[0] == "review.coverage.completed"


def test_text_functions(spark):
    def one(col):
        return spark.range(1).select(col).first()[0]

    assert one(T.roman_or_int(F.lit("XIV"))) == 14 and one(T.roman_or_int(F.lit("12"))) == 12 and one(T.roman_or_int(F.lit("XQ"))) is None
    assert one(T.page_refs(F.lit(r"TOC PAGEREF _Toc1 \h pageref _Toc2"))) == ["_Toc1", "_Toc2"]
    assert one(T.file_component(F.lit('a<b>:c  d. '))) == "a_b__c d" and one(T.safe_name(F.lit("  ..  "))) == "artifact"
    assert one(T.match_key(F.lit("3.1"), F.lit("（术语） 和"))) == "3.1|术语和" and one(T.heading_level(F.lit("3.1.2 x"))) == 3
    assert one(T.is_standard_number(F.lit("代替GB/T 15034—1994"))) and not one(T.is_standard_number(F.lit("GB")))
    assert one(T.truncate_bytes(F.lit("ab汉字"), 4)) == "ab" and one(T.truncate_bytes(F.lit("ab汉字"), 5)) == "ab汉"
    assert one(T.severity(F.lit("致命"))) == "critical" and one(T.status(F.lit(None).cast("string"))) == "info" and one(T.status(F.lit("zz"))) == "warn"
    assert one(images.caption_before(F.lit("表1 a\nx\n表2 b\nANCHOR"), F.lit("ANCHOR"))) == "表2 b"
    assert one(T.is_sensitive(F.lit("/x/.env.local"))) and one(T.mime_type(F.lit("a.PNG"))) == "image/png"
    docs = spark.createDataFrame([(1, "see images/ab.jpg and images/abc.jpg"), (2, "none")], "doc_id int, text string")
    ren = spark.createDataFrame([(1, "ab.jpg", "图1.jpg"), (1, "abc.jpg", "图2.jpg")], "doc_id int, old string, new string")
    assert [r.text for r in images.rewrite_refs(docs, ren).orderBy("doc_id").collect()] == ["see images/图1.jpg and images/图2.jpg", "none"]


def test_checks_on_facts(spark):
    f = spark.createDataFrame(
        [(1, 1, "chapter", "scope", "1 范围", "1 范围"), (1, 2, "paragraph", "scope", None, "本文件。"), (1, 3, "chapter", "terms_definitions", "3 术语和定义", "3 术语和定义"), (1, 4, "clause", "other_body", "3.1 测试", "3.1 测试"), (1, 5, "clause", "other_body", "3.2", "3.2"), (1, 6, "clause", "other_body", "3.1.1.1.1.1 深", "3.1.1.1.1.1 深"), (2, 1, "paragraph", "cover", None, "a）列")],
        "doc_id long, idx int, role string, scope string, display_heading string, text_excerpt string",
    ).withColumn("kind", F.lit("paragraph"))
    assert [(r.idx, r.reason) for r in audit.check_chapters(f).collect()] == [(3, "number 3, due 2")]
    assert sorted((r.idx, r.reason) for r in audit.check_clauses(f).collect()) == [(4, "titles differ at level 2"), (5, "titles differ at level 2"), (6, "depth 6")]
    got = {(r.doc_id, r.rule_id): (r.checked, r.failed) for r in audit.evaluations(f).collect()}
    assert got[1, "DOCX-FMT-001"] == (2, 1) and got[2, "DOCX-FMT-004"] == (1, 0)
    assert audit.format_issues(f).where("rule_id = 'DOCX-FMT-001'").first().issue_id == "DOCX-FMT-001-001"
    toc = spark.createDataFrame([(1, 1, "1|范围", "范围"), (1, 2, "2|术语", "术语"), (1, 3, "9|无", "无")], "doc_id long, idx int, key string, title string")
    heads = spark.createDataFrame([(1, 5, "1|范围", "范围"), (1, 6, "3|术语", "术语"), (1, 7, "4|术语", "术语")], "doc_id long, idx int, key string, title string")
    assert {(r.toc_idx, r.heading_idx) for r in audit.align_toc(toc, heads).collect()} == {(1, 5), (2, 6), (3, None), (None, 7)}


def test_judges(spark):
    plans = spark.createDataFrame([(1, "R", "single", "yes"), (2, "R", "single", "boom"), (3, "R", "skip", "x")], "doc_id long, chunk_id string, strategy string, prompt string")

    def judge(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return 'so: {"pass": false, "confidence": 0.9}'

    assert sorted((r.doc_id, r.status) for r in review.judged(plans, judge).collect()) == [(1, "fail"), (2, "fail")]
    assert [r.error for r in review.with_judge(plans.where("doc_id = 2"), judge).collect()] == ["down"]


def test_odd_corpora(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "no heading at all"), (5, "# 目次\n1 范围 1\n# 1 范围\n内容。\n")], "doc_id long, text string")
    zoned = S.zones(S.lines(df))
    assert {(r.doc_id, r.scope) for r in S.scope_text(zoned).collect()} == {(4, "cover"), (5, "toc"), (5, "scope")}
    assert S.sections(zoned.limit(0)).collect() == []
