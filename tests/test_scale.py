"""What a step must not do as its tables grow, seen on small ones."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from lexspark.operators import full_review, nested, numbering, retrieve, review, rulebook
from lexspark.operators.segment import lines
from lexspark.plans import more_queries
from lexspark.sources.shared import cut, dealt
from lexspark.streaming.lifecycle import RunProcessor


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_review_gathers_no_table_that_grows_for_a_broadcast(spark):
    units = cut(spark.createDataFrame([(1, 1, "scope", "h", "abc")], "doc_id long, ord int, scope string, heading string, text string"))
    planned = cut(spark.createDataFrame([(1, "N-01", False, [1])], "doc_id long, chunk_id string, head_only boolean, units array<int>"))
    made = full_review.texts(planned, units)
    assert "Broadcast" not in plan(made)
    assert [r.context for r in made.collect()] == ["## h\nabc"]
    sizes = units.select("doc_id", "ord", "scope", F.length("text").alias("chars"), F.length("heading").alias("title_chars"))
    aimed = planned.select("doc_id", "chunk_id", F.array(F.lit("scope")).alias("targets"))
    assert "Broadcast" not in plan(full_review.contexts(aimed, sizes))


def test_list_numbers_sort_rows_once_whatever_the_levels(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0, [1])], "doc_id long, idx int, list_id string, level int, start array<int>")
    assert plan(numbering.list_numbers(rows, levels=9)).count("Sort [") == 1


def test_rows_are_dealt_over_more_partitions_as_they_grow(spark):
    rows = spark.range(100)
    assert dealt(rows, "id", rows=10).rdd.getNumPartitions() == 10
    assert dealt(rows, "id") is rows


def test_best_products_over_pieces_and_blocks(spark):
    held = [(i, i % 2, None if i == 3 else [float(i), None, 2.0][: 1 + i % 3]) for i in range(30)] + [(40, None, [1.0]), (41, 7, [1.0])]
    rows = spark.createDataFrame(held, "id long, label int, v array<double>")
    got = {r.query_id: (r.n, r.best) for r in retrieve.best_products(rows, rows.where("id % 3 = 0 or id > 30"), piece=4, block=3).collect()}
    dot = lambda a, b: None if a is None or b is None else sum((x or 0) * (y or 0) for x, y in zip(a, b))
    want = {}
    for i, label, v in held:
        if label is not None and (i % 3 == 0 or i > 30):
            met = [dot(v, w) for j, other, w in held if other == label and j != i]
            if met:
                want[i] = (len(met), max((x for x in met if x is not None), default=None))
    assert got == want


class _Calls:
    """A state handle that counts what is asked of it."""

    def __init__(self):
        self.n, self.held = 0, {}

    def state(self, name, *_):
        def ask(fn):
            def call(*a):
                self.n += 1
                return fn(*a)

            return call

        held = self.held
        put = lambda v: held.__setitem__(name, v)
        add = lambda v: held.setdefault(name, []).extend(v)
        return SimpleNamespace(
            exists=ask(lambda: name in held), get=ask(lambda *k: iter(held[name]) if isinstance(held.get(name), list) else held.get(name)), update=ask(put), appendList=ask(add), appendValue=ask(lambda v: add([v])),
            containsKey=ask(lambda k: k in held.get(name, {})), updateValue=ask(lambda k, v: held.setdefault(name, {}).update({k: v})),
        )

    getValueState = getListState = getMapState = state


def test_a_run_asks_its_state_a_few_times_a_batch(spark):
    calls, run = _Calls(), RunProcessor()
    run.init(calls)
    event = lambda i: SimpleNamespace(seq=i, event="values", artifact_id="a")
    last = lambda rows: [(r.n_events, r.version) for r in run.handleInputRows((1,), iter(rows), None)]
    assert last([event(i) for i in range(0, 2000, 2)]) == [(1000, 1)]
    assert last([event(i) for i in [7, 7, 8, 3000, 3000]]) == [(1002, 2)]  # late, late again, seen, new, new again
    assert last([event(i) for i in [7, 3000]]) == []
    assert calls.n < 30


def _plans(monkeypatch, module):
    seen, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (seen.append(plan(df)), real(df))[1])
    return seen


def test_a_walk_goes_down_in_one_pass(spark, monkeypatch):
    seen = _plans(monkeypatch, nested)
    rows = spark.createDataFrame([(1, '[{"a": [1, {"b": {}}], "c": "{}"}, null, []]'), (2, "{"), (3, '{"d": [[[[{"e": [[[[{"f": 1}]]]]}]]]]}')], "id int, data string")
    got = sorted((r.id, r.o) for r in nested.objects(rows).select("id", F.to_json("object").alias("o")).collect())
    assert got == sorted([(1, '{"a":[1,{"b":{}}],"c":"{}"}'), (1, '{"b":{}}'), (1, "{}"), (3, '{"d":[[[[{"e":[[[[{"f":1}]]]]}]]]]}'), (3, '{"e":[[[[{"f":1}]]]]}'), (3, '{"f":1}')])
    assert not any("Union" in p for p in seen[:2])


def test_flat_text_shuffles_a_string_once(spark):
    deep = '[{"lines": [{"text": "", "spans": [[], ["", ""], {"content": "a"}, ["b"]]}, "c"], "text": "t", "html": 5}, "", [[["", ["d"]]]], {"spans": [[""], "e"], "text": "x"}, 3]'
    rows = spark.createDataFrame([(1, deep), (2, '{"lines": []}'), (3, '"s"'), (4, "no")], "id int, json string")
    flat = nested.flat_text(rows, "id")

    def plain(v):
        if isinstance(v, list):
            return "\n".join(plain(x) for x in v)
        if isinstance(v, dict):
            parts = [v[k] for k in nested.TEXT_KEYS if isinstance(v.get(k), str)] + [plain(x) for k in nested.PART_KEYS if isinstance(v.get(k), list) for x in v[k]]
            return "\n".join(x for x in parts if x)
        return v if isinstance(v, str) else ""

    import json

    assert {r.id: r.text for r in flat.collect()} == {1: plain(json.loads(deep)), 2: "", 3: "s", 4: ""}
    assert plan(flat).count("Exchange hashpartitioning") == plan(flat).count("Exchange") <= 2  # the plan's first and final form


def test_rules_are_cut_by_one_shuffle(spark):
    books = spark.createDataFrame([(1, "# A\nx\n\ny\n## B\nz\n")], "doc_id long, text string")
    rules = rulebook.rule_chunks(lines(books))
    assert plan(rules).count("Exchange") == 1
    assert [(r.chunk_id, r.title, r.content, r.source_ref) for r in rules.orderBy("chunk_id").collect()] == [("RAG-0001", "A", "x", "#A-p1"), ("RAG-0002", "A", "y", "#A-p2"), ("RAG-0003", "B", "z", "#B-p1")]


def test_rule_contexts_are_chosen_by_lengths(spark, monkeypatch):
    seen, real = [], more_queries.scopes.context_units
    monkeypatch.setattr(more_queries.scopes, "context_units", lambda plans, units, limit: (seen.append(units.columns), real(plans, units, limit))[1])
    more_queries.rule_contexts(spark, "/root/testdata/sf0.001")
    assert seen == [["doc_id", "ord", "scope", "chars"]]


def test_a_judge_is_asked_once_a_prompt(spark, tmp_path):
    def judge(prompt, path=str(tmp_path)):
        import uuid

        open(f"{path}/{uuid.uuid4().hex}", "w").close()
        return '{"pass": false, "confidence": 0.1}'

    rules = spark.createDataFrame([("N-01", "scope", "local", "t", "c")], "chunk_id string, scope string, analysis_mode string, title string, content string")
    held = spark.createDataFrame([(1, "scope", "x" * 50)], "doc_id long, scope string, text string")
    out = review.run_review(held.select("doc_id"), held, rules, judge=judge)
    assert sorted(r.round for r in out.collect()) == [1, 2]
    assert len(list(tmp_path.iterdir())) == 2
