"""Walks, chains, names, references and records on rows that would show a cut or a wrong rule."""

import json
import random

from pyspark.sql import functions as F

from lexspark.operators import full_review, hooks, images, metadata, nested, numbering, records, retrieve, review, toc_pages
from lexspark.sources import index
from lexspark.streaming import events as E


def test_style_chains_of_any_length_and_cycles(spark):
    rows = [(1, f"s{i}", f"s{i - 1}" if i else None, "root" if i == 0 else None, 7 if i == 500 else None) for i in range(1000)]
    rows += [(2, "x", "y", None, 1), (2, "y", "z", None, 2), (2, "z", "x", "fz", None), (2, "t", "x", None, None), (3, "p", "gone", None, 3), (3, "one", None, None, None)]
    out = {(r.doc_id, r.style): (r.font, r["size"]) for r in numbering.resolve_inheritance(spark.createDataFrame(rows, "doc_id int, style string, based_on string, font string, size int"), ["font", "size"]).collect()}
    assert len(out) == len(rows)
    assert out[1, "s999"] == ("root", 7) and out[1, "s499"] == ("root", None) and out[1, "s500"] == ("root", 7)
    assert out[2, "t"] == ("fz", 1) and out[2, "y"] == ("fz", 2) and out[2, "z"] == ("fz", 1)
    assert out[3, "p"] == (None, 3) and out[3, "one"] == (None, None)


def test_list_numbers_of_nine_levels(spark):
    def plain(levels, start):
        held, out = {}, []
        for level in levels:
            held = {k: v for k, v in held.items() if k <= level}
            for k in range(level):
                held.setdefault(k, start.get(k, 1))
            held[level] = held.get(level, start.get(level, 1) - 1) + 1
            out.append([held[k] for k in range(level + 1)])
        return out

    rng = random.Random(1)
    levels = [1, 0, 1, 8, 8, 7, 8, 0] + [rng.randrange(9) for _ in range(200)]
    rows = spark.createDataFrame([(1, i, "L", x, [1, 3]) for i, x in enumerate(levels)], "doc_id int, idx int, list_id string, level int, start array<int>")
    assert [r.numbers for r in numbering.list_numbers(rows).orderBy("idx").collect()] == plain(levels, {0: 1, 1: 3})


def test_names_are_unique(spark):
    rng = random.Random(2)
    stems = ["a", "a", "a_2"] + [rng.choice(["a", "a_2", "a_2_2", "b", "b_3", "a_10", "a_02", "é"]) for _ in range(300)]
    rows = spark.createDataFrame([(i, "d" if i % 3 else "e", s) for i, s in enumerate(stems)], "id int, dir string, stem string")
    out = metadata.unique_names(rows, "dir", "stem", "id").collect()
    assert len(out) == len(stems) and len({(r.dir, r.unique_stem) for r in out}) == len(stems)
    first = {}
    for r in sorted(out, key=lambda r: r.id):
        assert (r.unique_stem == r.stem) == ((r.dir, r.stem) not in first)
        first.setdefault((r.dir, r.stem), r.id)
    names = {r.id: r.unique_stem for r in metadata.unique_names(spark.createDataFrame([(0, "d", "a"), (1, "d", "a"), (2, "d", "a_2")], "id int, dir string, stem string"), "dir", "stem", "id").collect()}
    assert names == {0: "a", 1: "a_3", 2: "a_2"}
    taken = spark.createDataFrame([("d", "001"), ("d", "003"), ("d", "x"), ("d", "04")], "dir string, name string")
    out = metadata.numbered_names(rows.where("id < 5"), "dir", "id", taken).collect()
    assert [(r.dir, r.unique_stem) for r in sorted(out, key=lambda r: r.id)] == [("e", "001"), ("d", "002"), ("d", "004"), ("e", "002"), ("d", "005")]


def test_references_of_every_form(spark):
    text = "![](x.jpg) ![t](./images/a.jpg) images/a.jpg ./images/a.jpg /images/b.jpg 0123456789abcdef01.png ![z](q/B.JPG) images/none.jpg a.jpg"
    names = [(1, "x.jpg", "y.jpg"), (1, "a.jpg", "b.jpg"), (1, "b.jpg", "c.jpg"), (1, "0123456789abcdef01.png", "h.png"), (1, None, "n")]
    docs = spark.createDataFrame([(1, text), (2, text), (1, None)], "doc_id int, text string")
    out = images.rewrite_refs(docs, spark.createDataFrame(names, "doc_id int, old string, new string"), "img").collect()
    assert {(r.doc_id, r.text) for r in out} == {(1, "![](img/y.jpg) ![t](img/b.jpg) img/b.jpg ./img/b.jpg /img/c.jpg img/h.png ![z](img/c.jpg) images/none.jpg a.jpg"), (2, text), (1, None)}


def test_image_members_of_flat_archives(spark):
    rows = spark.createDataFrame([("a", "x/images/1.PNG"), ("a", "deep/er/2.png"), ("a", "3.jpg"), ("a", "full.md"), ("b", "p/q/r/4.gif"), ("b", "n.txt")], "bundle string, member string")
    assert sorted((r.bundle, r.member) for r in images.image_members(rows).collect()) == [("a", "3.jpg"), ("a", "x/images/1.PNG"), ("b", "p/q/r/4.gif")]


def test_records_of_any_type(spark):
    rows = ['{"a": "1.25", "b": ["x", {"q": 1}], "m": {"k": "z", "j": 3}, "s": {"n": "no", "l": [{"i": 1}, {"i": "x"}]}}', '{"a": "x"}', "[1]", "nope", None, '{"a": null, "b": "none", "more": 1}']
    out = records.validate(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, json string"), "a decimal(10,2), b array<string>, m map<string,int>, s struct<n:int,l:array<struct<i:int>>>").orderBy("i").collect()
    assert [r.error for r in out] == ["bad fields: b[1], m.k, s.n, s.l[1].i", "bad fields: a", "no object", "no object", "no object", "bad fields: b"]
    assert str(out[0].record.a) == "1.25" and out[0].record.b == ["x", None] and out[0].record.m == {"k": None, "j": 3} and [x.i for x in out[0].record.s.l] == [1, None]


def test_tools_complete_after_their_artifacts(spark):
    spec = spark.createDataFrame([("t", "a", "x"), ("t", "b", "y")], "tool string, field string, type string")
    rows = spark.createDataFrame([(1, "t", '{"a": "p", "b": "q"}'), (2, "t", "{}"), (3, "u", None)], "id int, tool string, result string")
    assert sorted((r.id, r.ord, r.event) for r in E.tool_events(rows, spec).collect()) == [(1, 0, "artifact.created"), (1, 1, "artifact.created"), (1, 2, "tool.completed"), (2, 0, "tool.completed"), (3, 0, "tool.completed")]


def test_messages_at_any_depth(spark):
    message = '{"id": "m1", "name": "review", "content": "{\\"n\\": 1}"}'
    for _ in range(12):
        message = '{"a": [%s]}' % message
    rows = [(1, message), (2, '{"kwargs": {"id": "k", "tool_name": "t", "content": {"q": [1]}}}'), (3, '{"content": "text"}'), (4, "x"), (5, None), (6, '[{"type": "tool", "additional_kwargs": {"name": "z"}, "content": "{}"}]')]
    got = {(r.seq, r.message_id, r.tool, r.content) for r in E.unwrap_messages(spark.createDataFrame(rows, "seq int, data string")).collect()}
    assert got == {(1, "m1", "review", '{"n": 1}'), (2, "k", "t", '{"q":[1]}'), (6, None, "z", "{}")}


def test_flat_text_in_reading_order(spark):
    def plain(v):
        if isinstance(v, str):
            return v
        if isinstance(v, dict):
            parts = [v[k] for k in ("text", "content", "html") if isinstance(v.get(k), str)]
            for k in ("spans", "lines", "blocks"):
                parts += [plain(x) for x in v[k]] if isinstance(v.get(k), list) else []
            return "\n".join(p for p in parts if p)
        return "\n".join(plain(x) for x in v) if isinstance(v, list) else ""

    rng = random.Random(3)

    def made(depth):
        r = rng.random()
        if depth == 0 or r < 0.3:
            return rng.choice(["a", "", "é x", 3, None, True])
        if r < 0.55:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: made(depth - 1) for k in rng.sample(["text", "content", "html", "spans", "lines", "blocks", "zz"], rng.randint(0, 5))}

    def deep(n):
        return {"spans": [deep(n - 1)], "text": str(n)} if n else "end"

    values = [*(made(6) for _ in range(150)), deep(12)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "nope"), (901, None)]
    got = {r.id: r.text for r in nested.flat_text(spark.createDataFrame(rows, "id int, json string"), "id").collect()}
    assert got == {**{i: plain(v) for i, v in enumerate(values)}, 900: "", 901: ""}


def test_cover_numbers_and_headers(spark):
    rows = [(1, "本文件与GB/T 1-2000相比主要变化很多很多很多很多很多很多很多很多很多 GB/T 2-2020 行业标准"), (2, "本标准代替 GB/T 15034—1994《导则》。\n本标准与 GB/T 15034—1994 相比主要差异如下："), (3, None), (4, "")]
    got = {r.doc_id: r for r in spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", *[c.alias(k) for k, c in metadata.cover_fields(F.coalesce("text", F.lit(""))).items()]).collect()}
    assert (got[1].number, got[1].hierarchy, got[1].code) == ("GB/T 2-2020", "行业标准", "GB")
    assert (got[2].number, got[2].replaced) == ("", "GB/T 15034-1994")
    first = ["ICS 67.080.10", "B 31", "GB", "中华人民共和国国家标准", "GB/T 15034—2009", "代替 GB/T 15034—1994"]
    blocks = [(1, 0, i, "header", t) for i, t in enumerate(first)] + [(2, 0, 4, "header", "GB/T 9999—2026"), (2, 0, 9, "footer", "国家局 发布"), (2, 1, 0, "header", "ICS 1"), (3, 0, 3, "header", "GB/T 7—2001")]
    out = {r.doc_id: r for r in metadata.header_records(spark.createDataFrame(blocks, "doc_id int, page_idx int, idx int, type string, text string"), spark.createDataFrame([(1, ""), (2, "本标准代替 GB/T 8888—2020。"), (3, ""), (4, None)], "doc_id int, text string")).collect()}
    assert (out[1].number, out[1].replaced, out[1].code, out[1].hierarchy, out[1].ccs) == ("GB/T 15034-2009", "GB/T 15034-1994", "GB", "国家标准", "B 31")
    assert (out[2].number, out[2].replaced, out[2].ics) == ("GB/T 9999-2026", "GB/T 8888-2020", "")
    assert out[3].number == "GB/T 7-2001" and out[4].number == ""


def test_failed_calls_are_failures(spark):
    rows = [(1, "r", None, "timeout " + "x" * 300), (2, "r", None, None), (3, "r", '{"pass": true}', None), (4, "r", '{"pass": true}', "late")]
    out = {r.doc_id: r for r in review.judge_issues(spark.createDataFrame(rows, "doc_id int, rule_id string, response string, error string")).collect()}
    assert out[1].status == "fail" and len(out[1].actual) == len("LLM 审核异常：") + 200 and out[2].status == "insufficient_context" and 3 not in out and out[4].status == "fail"


def test_hook_over_chunks_of_any_size(spark):
    import re

    def found(text):
        if "boom" in text:
            raise ValueError("boom")
        return [("n", m.group(0), m.start()) for m in re.finditer("ab+", text)] + ([("loose", "z", None)] if "z" in text else [])

    docs = spark.createDataFrame([(1, "xab" * 50 + "z"), (2, ""), (3, None), (4, "abbbb zz " * 30)], "doc_id int, text string")
    want = {(1, "n", "ab", 3 * i + 1) for i in range(50)} | {(4, "n", "abbbb", 9 * i) for i in range(30)} | {(1, "loose", "z", None), (4, "loose", "z", None)}
    for size in (7, 50, 10000):
        got = [(r.doc_id, r.cls, r.txt, r.start_pos) for r in hooks.extracted(docs, found, size, 20).collect()]
        assert len(got) == len(want) and set(got) == want
    bad = hooks.extracted(spark.createDataFrame([(1, "boom"), (2, "ab")], "doc_id int, text string"), found, 100, 10).collect()
    assert {(r.doc_id, r.cls, r.error) for r in bad} == {(1, None, "boom"), (2, "n", None)}


def test_only_changed_books_are_cut_again(spark, tmp_path):
    path = str(tmp_path / "index")
    books = lambda *rows: spark.createDataFrame(rows, "book string, text string")
    seen = []

    def rows_of(changed):
        seen.append(sorted(r.book for r in changed.collect()))
        return index.cut_books(changed)

    a, b, c = ("a", "# 范围\none\n\ntwo\n"), ("b", "# 前言\nthree\n"), ("c", None)
    index.refresh(books(a, b, c), path, rows_of=rows_of)
    index.refresh(books(a, ("b", "# 前言\nnew\n"), ("d", "# 目次\nfour\n")), path, rows_of=rows_of)
    index.refresh(books(a, ("b", "# 前言\nnew\n"), ("d", "# 目次\nfour\n")), path, rows_of=rows_of)
    assert seen == [["a", "b", "c"], ["b", "d"], []]
    got = {(r.book, r.content, r.cut_by) for r in index.load(spark, path).collect()}
    assert got == {("a", "one", 0), ("a", "two", 0), ("b", "new", 1), ("d", "four", 1)}
    index.tidy(spark, path)
    assert {(r.book, r.content) for r in index.load(spark, path).collect()} == {g[:2] for g in got}
    index.refresh(books(("a", "no heading")), path, rows_of=rows_of)  # no rule has a title: of no use, so all is cut anew next time
    index.refresh(books(("a", "no heading"), b), path, rows_of=rows_of)
    assert seen[3:] == [["a"], ["a", "b"]]
    index.refresh(books(b), path, force=True, rows_of=rows_of)
    assert seen[-1] == ["b"] and index.load(spark, path).count() == 1


def test_bounded_search_is_exact(spark):
    rng = random.Random(4)
    vocabulary = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(6000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randint(1, 40))) for i in range(500)] + [(i, "w1 w2 w3") for i in range(500, 520)], "id long, text string")
    post = retrieve.postings(docs, "id", "text")
    weights = retrieve.idf(post, docs.agg(F.count(F.lit(1)).alias("n")))
    index_, asked = retrieve.tfidf(post, weights).cache(), retrieve.tfidf(post.where("id % 20 = 0"), weights).cache()
    everything = retrieve.cosine_search(asked, index_).cache()
    for k in (1, 8, 600):
        bounded = retrieve.bounded_scores(asked, index_, k)
        rows = lambda s: sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieve.top_k(s, k).collect())
        assert rows(bounded) == rows(everything)
        if k == 1:
            assert bounded.count() < everything.count() / 2  # pairs scored


def test_contents_pages_without_rows_lack_context(spark):
    schema = "doc_id int, toc_idx int, number string, title string, page int, bookmark_match boolean, h_scope string, h_role string, h_page int, h_table_breaks int, h_bookmarked boolean"
    rows = [(1, 1, "", "前言", 1, False, "foreword", "front_title", 2, 0, False), (1, 2, "1", "范围", 1, False, "scope", "chapter", 3, 0, False), (1, 3, "2", "要求", 4, False, "other_body", "chapter", 5, 0, False), (1, 4, "3", "表", 9, False, "other_body", "chapter", 6, 2, False), (1, 5, "", "目次", 1, False, "scope", "chapter", 3, 0, False), (1, 6, "4", "x", None, False, "other_body", "chapter", 7, 0, False)]
    matches = spark.createDataFrame(rows, schema)
    heads = matches.select("doc_id", F.col("h_scope").alias("scope"), F.col("h_page").alias("page"))
    judged = toc_pages.verdicts(matches, toc_pages.anchors(spark.createDataFrame([(1, 1)], "doc_id int, page int"), heads))
    got = {r.toc_idx: (r.body_page, r.verdict) for r in judged.collect()}
    # the foreword's page is moved from 2 to 1 by its own pair; the body's pairs differ and move nothing
    assert got == {1: (1, "pass"), 2: (1, "pass"), 3: (3, "fail"), 4: (4, "unreliable"), 5: (1, "out_of_scope"), 6: (5, "skipped")}
    entries = spark.createDataFrame([(1, 7, 1), (2, 0, 0)], "doc_id int, n_entries long, n_unmatched long")
    assert {r.doc_id: tuple(r)[1:] for r in toc_pages.evaluation(entries, judged).collect()} == {1: ("fail", 5, 1, 2, 1, 1), 2: ("insufficient_context", 0, 0, 0, 0, 0)}


def test_the_judge_reads_all_of_a_context(spark):
    long = "词" * 9000 + " PHRASE"
    units = [(1, 1, "scope", "1 范围", "short text of the scope, forty characters and more of it, PHRASE"), (1, 2, "appendix", "附录 A", long), (2, 1, "scope", "1 范围", "x" * 60)]
    units = spark.createDataFrame(units, "doc_id long, ord int, scope string, heading string, text string")
    held = spark.createDataFrame([(1, ["scope", "appendix"]), (2, ["scope"])], "doc_id long, scopes array<string>")
    rules = [("R1", "范围", "scope", "c1", "local", ["scope"], 1), ("R2", "附录", "appendix", "c2", "local", ["appendix"], 2), ("R3", "引用", "normative_references", "c3", "local", ["normative_references"], 3)]
    rules = spark.createDataFrame(rules, "chunk_id string, title string, scope string, content string, analysis_mode string, target_scopes array<string>, ord int")
    hits = spark.createDataFrame([("scope", "R1", 0.9), ("appendix", "R2", 0.9), ("scope", "R3", 0.1), ("normative_references", "R3", 0.9)], "scope string, chunk_id string, score double")

    def judge(prompt):
        return '{"pass": false, "confidence": 0.9, "actual": "seen"}' if "PHRASE" in prompt else '{"pass": true}'

    out = full_review.full_review(units, held, rules, hits, judge=judge)
    got = {(r.doc_id, r.rule_id, r.status, r.strategy, r.round) for r in out.collect()}
    assert got == {(1, "R1", "fail", "single", 1), (1, "R2", "fail", "window", 1)}
    # a document without references is warned where a rule that asks for them was picked
    wide = hits.unionByName(spark.createDataFrame([("scope", "R4", 0.8)], hits.schema))
    book = rules.unionByName(spark.createDataFrame([("R4", "跨", "scope", "c4", "cross_section", ["scope", "normative_references"], 4)], rules.schema))
    warned = full_review.full_review(units, held, book, wide, judge=judge).where("status = 'warn'")
    assert {(r.doc_id, r.rule_id, r.scope, r.audit_track) for r in warned.collect()} == {(1, "R4", "normative_references", "content_llm"), (2, "R4", "normative_references", "content_llm")}


def test_dense_search_in_pieces_of_any_size(spark):
    rng = random.Random(7)
    rows = [(i, 0 if i % 3 else 1, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(200)] + [(300, None, [1.0, 0.0, 0.0]), (301, 0, None), (302, 5, [1.0, 2.0, 3.0])]
    base = spark.createDataFrame(rows, "id long, label int, v array<double>")

    def cosine(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) + 0.0 if n else 0.0

    want = []
    for q, label, v in rows:
        if q % 20 == 0 and label is not None and v:
            near = sorted((-cosine(v, w), i) for i, other, w in rows if other == label and i != q and w)[:5]
            want += [(q, i, -s + 0.0) for s, i in near]
    for piece, block in ((4096, 1024), (7, 3)):
        got = [tuple(r) for r in retrieve.dense_search(base, base.where("id % 20 = 0"), 5, piece, block).collect()]
        assert sorted(got) == sorted(want)


def test_cosine_of_arrays(spark):
    from lexspark.functions import vectors

    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_rules_of_a_long_book_have_their_own_ids(spark):
    text = "# 范围\n" + "\n\n".join(f"p{i}" for i in range(10050))
    out = index.cut_books(spark.createDataFrame([("b", text)], "book string, text string"))
    assert out.count() == out.select("chunk_id").distinct().count() == 10050
