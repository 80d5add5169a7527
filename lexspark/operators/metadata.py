"""Extracted spans to metadata records, cover fields and quality warnings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.sources.shared import cut, ranked

#: Field names of a metadata record.  Fixed values.
SINGLE = ("ICS", "CCS", "标准号", "标准中文名称", "标准英文名称", "标准层级", "代替标准号", "发布日期", "实施日期", "归口单位")
MULTI = ("引用文件", "术语", "起草单位", "起草人", "发布单位", "提出单位")


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, txt, start_pos): the default extractor, by pattern: the number, the number it replaces, and cited numbers, each with its own start."""
    number = r"[A-Z]{2,4}(?:/[A-Z])? ?[0-9]+(?:\.[0-9]+)*[-—–][0-9]{4}"
    found = None
    for cls, lead, pattern in (("标准号", "标准正式编号：", f"标准正式编号：({number})"), ("代替标准号", "代替", f"代替({number})"), ("引用文件", "", f"(?<!：)(?<!替)({number})")):
        # a match starts after the gap before it and all that precedes; the captured text after the words that lead to it
        gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.posexplode(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))).alias("_i", "_m"))
        run = Window.partitionBy("doc_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        end = F.sum(F.length("_m.gap") + F.length("_m.hit")).over(run)
        start = end - F.length("_m.hit") + 1 + len(lead)
        rows = rows.select("doc_id", F.lit(cls).alias("cls"), F.substring(F.col("_m.hit"), F.lit(len(lead) + 1), F.length("_m.hit")).alias("txt"), start.cast("int").alias("start_pos"))
        found = rows if found is None else found.unionByName(rows)
    return found


def consolidate(spans: DataFrame) -> DataFrame:
    """One row a (document, class, text) with its least start; no start only if no occurrence has one.  Blank texts and unknown classes go."""
    rows = spans.withColumn("txt", T.strip(F.col("txt"))).where((F.col("txt") != "") & F.col("cls").isin(*SINGLE, *MULTI))
    return rows.groupBy("doc_id", "cls", "txt").agg(F.min("start_pos").alias("start_pos"), F.min("seq").alias("seq"))


def records(spans: DataFrame) -> DataFrame:
    """One record a document: single fields take the first text, multiple fields all texts in order; nature and revision are derived."""
    held = consolidate(spans)
    first = lambda c: F.min_by(F.when(F.col("cls") == c, F.col("txt")), F.when(F.col("cls") == c, F.struct(F.col("start_pos").isNull(), "start_pos", "seq")))
    every = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("cls") == c, F.struct(F.col("start_pos").isNull().alias("n"), "start_pos", "txt")))), lambda x: x["txt"])
    names = {"ICS": "ics", "CCS": "ccs"}
    out = held.groupBy("doc_id").agg(*[F.coalesce(first(c), F.lit("")).alias(names.get(c, c)) for c in SINGLE], *[every(c).alias(c) for c in MULTI])
    return out.withColumn("标准性质", T.nature(F.col("标准号"))).withColumn("制修订", F.when(F.col("代替标准号") != "", "修订").otherwise("制订"))


def fill_counts(records: DataFrame) -> DataFrame:
    """Filled single fields and number of multiple values of each record."""
    names = [{"ICS": "ics", "CCS": "ccs"}.get(c, c) for c in SINGLE]
    single, multi = F.lit(0), F.lit(0)
    for c in names:
        single = single + (F.col(c) != "").cast("int")
    for c in MULTI:
        multi = multi + F.size(c)
    return records.select("doc_id", single.alias("single"), multi.alias("multi"))


def warnings(records: DataFrame) -> DataFrame:
    """(doc_id, warnings): no number, and levels that do not suit the number."""
    number, level = F.upper(T.strip(F.col("标准号"))), T.strip(F.col("标准层级"))
    national = level.contains("国家标准")
    tests = [(number == "", "no_number"), (number.startswith("GH/T") & national, "gh_national"), (number.startswith("GB") & (level != "") & ~national, "gb_not_national")]
    return records.select("doc_id", F.array_compact(F.array(*[F.when(t, w) for t, w in tests])).alias("warnings"))


def hint_conflicts(records: DataFrame, cover: DataFrame) -> DataFrame:
    """(doc_id, field, hint, actual) where record and cover are both filled and differ; ``cover`` has doc_id, number and hierarchy."""
    both = records.join(cover, "doc_id")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), T.strip(F.coalesce(F.col(h), F.lit(""))).alias("hint"), T.strip(F.col(f)).alias("actual")) for f, h in (("标准号", "number"), ("标准层级", "hierarchy"))])
    rows = both.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")
    return rows.where("hint <> '' and actual <> '' and hint <> actual")


def fill_blank(primary: DataFrame, fallback: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``primary`` with blank fields filled from ``fallback``."""
    other = fallback.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    filled = [F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}"), F.lit("")).alias(f) for f in fields]
    return primary.join(other, key, "left").select(key, *filled)


#: A standard's number in running text, words near it that say it is another standard's, and hierarchies in order of precedence.  Fixed values.
NUMBER = r"(?i)(?U)\b(?:GB|GB/T|GB/Z|GH/T|NY/T|DB\d{2}/T)\s*[\w.-]+[-—]\d{4}\b"
OTHERS = "代替|替代|相比|首次发布|被代替|废止"
HIERARCHIES = ("国家标准", "行业标准", "地方标准")


def in_context(text: Column, pattern: str, around: int = 20) -> Column:
    """All matches of ``pattern`` in order, each as (hit, context): the match with up to ``around`` characters on either side."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<hit:string,context:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        low = F.greatest(F.lit(1), begin - around)
        context = F.substring(text, low, begin - low + F.length(x["hit"]) + around)
        return F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(s["found"], F.array(F.struct(x["hit"].alias("hit"), context.alias("context")))).alias("found"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.coalesce(F.aggregate(zipped, start, step)["found"], F.array().cast("array<struct<hit:string,context:string>>"))


def cover_fields(text: Column) -> dict[str, Column]:
    """Cover fields read from text: number, replaced number, ics, ccs, code and hierarchy; what is not found is empty.

    The number is the first one that no word of ``OTHERS`` stands within 20 characters of.  The hierarchy is the first of
    ``HIERARCHIES`` that the text names anywhere.  The code is a line of its own, or else what the number starts with.
    """
    own = F.get(F.filter(in_context(text, NUMBER), lambda x: ~x["context"].rlike(OTHERS)), 0)["hit"]
    number = T.standard_number(F.coalesce(own, F.lit("")))
    old = F.regexp_extract(text, r"(?i)(?U)代替\s*([A-Z]{1,5}/?T?\s*[\w.-]+[-—]\d{4})", 1)
    ics = F.regexp_extract(text, r"(?i)(?U)\bICS\s*([0-9]{2}(?:\.[0-9]+){0,2})\b", 1)
    ccs = F.replace(F.regexp_extract(text, r"(?i)(?U)\bCCS\s*([A-Z]\s*\d{2})\b", 1), F.lit(" "), F.lit(""))
    bare = F.when(text.rlike(r"(?U)\bB\s*31\b"), F.concat(F.regexp_extract(text, r"(?U)\b([A-Z])\s+(\d{2})\b", 1), F.regexp_extract(text, r"(?U)\b([A-Z])\s+(\d{2})\b", 2)))
    ccs = F.when(ccs != "", ccs).when(bare.rlike("^[A-H]"), bare).otherwise("")
    code = F.upper(F.regexp_extract(text, r"(?i)(?:^|\n)\s*(GB|GB/T|GB/Z|DB\d{2}/T)\s*(?:\n|$)", 1))
    lead = F.get(F.split(F.get(F.split(F.upper(T.strip(number)), r"\s+"), 0), "/"), 0)
    level = F.lit("")
    for name in reversed(HIERARCHIES):
        level = F.when(text.contains(name), name).otherwise(level)
    return {k: F.coalesce(v, F.lit("")) for k, v in {"number": number, "replaced": T.standard_number(old), "ics": ics, "ccs": ccs, "code": F.when(code != "", code).otherwise(lead), "hierarchy": level}.items()}


#: A number at the start of a header block, and what each place of a cover's header holds.  Fixed values.
HEADER_NUMBER = r"^(?:[A-Z]{1,6}[0-9]{0,3}(?:/[A-Z]{1,8}[0-9]{0,3})?)\s+[0-9]+(?:\.[0-9]+)*[—-](?:[0-9]{4}|[0-9]{2})"
PLACES = ("ics", "ccs", "code", "hierarchy", "number", "replaced")
FIELDS = ("ics", "ccs", "replaced", "number", "hierarchy", "code")


def _described(t: Column, index: Column) -> Column:
    """A header block with what it could be."""
    held = F.upper(t)
    tight = F.replace(held, F.lit(" "), F.lit(""))
    bare = T.strip(F.regexp_replace(t, "^(?:代替[\\x20]*)?(?:替代)?", ""))
    number = F.when(F.upper(bare).rlike(HEADER_NUMBER), F.replace(bare, F.lit("—"), F.lit("-"))).otherwise("")
    ics = held.startswith("ICS") | t.contains(T.ICS_WORD)
    ccs = held.startswith("CCS") | t.contains(T.CCS_WORD) | tight.rlike(r"^[A-Z]{1,3}[0-9]{1,3}(?:\.[0-9]+)?$")
    level = F.lit(False)
    for w in T.HIERARCHY_WORDS:
        level = level | t.contains(w)
    old = t.contains(T.REPLACED_WORDS[0]) | t.contains(T.REPLACED_WORDS[1])
    code = tight.rlike(r"^[A-Z]{1,6}(?:/[A-Z]{1,6})?$") & ~ics & ~ccs
    named = {"text": t, "index": index, "number": number, "ics": ics, "ccs": ccs, "level": level, "old": old, "code": code}
    return F.struct(*[c.alias(k) for k, c in named.items()])


def _with(state: Column, **new: Column) -> Column:
    return F.struct(*[new.get(k, state[k]).alias(k) for k in FIELDS])


def header_fields(blocks: Column) -> Column:
    """A struct of ``FIELDS`` from the header blocks of a cover (an array of structs text, index, in order), by three folds.

    A block gives the first field that it fits and that is still empty.  Then blocks that hold a number give the two numbers that are
    still missing.  Then a block's place in the header (``PLACES``) gives what is still missing, unless the block is plainly something
    else; a missing number may stand one place early.  A hierarchy is named by its kind alone.
    """
    rows = F.transform(blocks, lambda x: _described(T.squeeze(x["text"]), x["index"]))
    rows = F.filter(rows, lambda x: x["text"] != "")
    none = F.struct(*[F.lit("").alias(k) for k in FIELDS])
    or_text = lambda x: F.when(x["number"] != "", x["number"]).otherwise(x["text"])

    def by_kind(s: Column, x: Column) -> Column:
        out = F.when(x["code"] & (s["code"] == ""), _with(s, code=x["text"])).otherwise(s)
        for test, field, value in ((x["level"], "hierarchy", x["text"]), (x["number"] != "", "number", x["number"]), (x["old"], "replaced", or_text(x)), (x["ccs"], "ccs", x["text"]), (x["ics"], "ics", x["text"])):
            out = F.when(test & (s[field] == ""), _with(s, **{field: value})).otherwise(out)
        return out

    def by_number(s: Column, x: Column) -> Column:
        own = F.when(~x["old"] & (s["number"] == ""), _with(s, number=x["number"])).otherwise(s)
        return F.when(x["number"] == "", s).when(x["old"] & (s["replaced"] == ""), _with(s, replaced=x["number"])).otherwise(own)

    def by_place(s: Column, x: Column) -> Column:
        early = F.get(F.filter(rows, lambda y: y["index"] == 3), 0)
        moved = F.when((early["number"] != "") & ~early["old"], early["number"]).otherwise("")
        values = {
            "ics": F.when(~x["ccs"], x["text"]),
            "ccs": F.when(~x["ics"], x["text"]),
            "code": F.when(~x["ics"] & ~x["ccs"] & (x["number"] == ""), x["text"]),
            "hierarchy": x["text"],
            "number": F.when((x["number"] != "") & ~x["old"], x["number"]).otherwise(moved),
            "replaced": F.when(x["old"], or_text(x)),
        }
        out = s
        for i, field in enumerate(PLACES):
            out = F.when((x["index"] == i) & (s[field] == ""), _with(s, **{field: F.coalesce(values[field], F.lit(""))})).otherwise(out)
        return out

    found = none
    for step in (by_kind, by_number, by_place):
        found = F.aggregate(rows, found, step)
    level = found["hierarchy"]
    for name in reversed(HIERARCHIES):
        level = F.when(found["hierarchy"].contains(name), name).otherwise(level)
    return _with(found, hierarchy=level)


def header_records(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, ics, ccs, replaced, number, hierarchy, code): the cover record, from the header of the first page, then from the text.

    ``blocks`` has doc_id, page_idx, idx, text (page 0 counts), and may have ``index``, a block's own place, else ``idx``; ``texts``
    (doc_id, text) gives what the header lacks.  Every document of ``texts`` has a row.
    """
    index = F.col("index") if "index" in blocks.columns else F.col("idx")
    rows = blocks.where("page_idx = 0")
    rows = (rows.where("type = 'header'") if "type" in blocks.columns else rows).select("doc_id", F.struct(F.col("idx").alias("o"), F.coalesce("text", F.lit("")).alias("text"), index.cast("int").alias("index")).alias("b"))
    first = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("_b")).select("doc_id", header_fields(F.col("_b")).alias("_h"))
    text = F.coalesce("text", F.lit(""))
    both = texts.select("doc_id", F.struct(*[c.alias(k) for k, c in cover_fields(text).items()]).alias("_t")).join(first, "doc_id", "left")
    return both.select("doc_id", *[F.coalesce(F.nullif(F.col(f"_h.{k}"), F.lit("")), F.col(f"_t.{k}")).alias(k) for k in FIELDS])


def issuing_organizations(blocks: DataFrame) -> DataFrame:
    """(doc_id, organizations): who issues, from the footers of the first page, without the word for it; ``blocks`` has doc_id, page_idx, idx, type, text."""
    bare = T.strip(F.regexp_replace(T.strip(F.col("text")), "发布$", ""))
    rows = blocks.where("page_idx = 0 and type = 'footer'").select("doc_id", F.struct("idx", bare.alias("text")).alias("b")).where("b.text <> ''")
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("b")).getField("text"), " ").alias("organizations"))


def unique_names(rows: DataFrame, directory: str, stem: str, order: str, form: str = "%s_%d", first: int = 2) -> DataFrame:
    """``rows`` with ``unique_stem``, which no other row of a directory has.

    The first row of a stem (by ``order``, then by id where that ties) keeps it.  The k-th repeat takes the k-th number, from ``first`` on, for which
    ``form`` makes a name that no row brings along: a, a, a_2 gives a, a_3, a_2.  ``form`` must end in the number or in fixed
    text behind it (``%s（%d）``), so names made of different stems differ.  Free numbers are found by a gap search: a taken
    number t that has j taken ones below it has t - first - j free ones below it and pushes every later repeat on by one.
    """
    key, at = ["_dir", "_stem"], "_k"
    lead, tail = form.replace("%s", "").split("%d")
    held = rows.withColumns({"_dir": F.col(directory), "_stem": F.col(stem), "_o": F.col(order), "_u": F.xxhash64(*rows.columns)})
    held = cut(ranked(held, key, ["_o", "_u"], at))
    repeats = held.where("_k > 1").select(*key).distinct()
    # names that look as if they were made of a stem that repeats
    made = F.regexp_extract("_stem", f"^(?s:(.+)){re.escape(lead)}([1-9][0-9]{{0,17}}){re.escape(tail)}$", 0)
    base, number = (F.regexp_extract("_stem", f"^(?s:(.+)){re.escape(lead)}([1-9][0-9]{{0,17}}){re.escape(tail)}$", i) for i in (1, 2))
    taken = held.where("_k = 1").where(made != "").select("_dir", base.alias("_stem"), number.cast("long").alias("_t")).where(F.col("_t") >= first).join(repeats, key, "left_semi")
    below = F.row_number().over(Window.partitionBy(*key).orderBy("_t")) - 1
    taken = taken.select(*key, (F.col("_t") - first - below).alias("_free"))
    steps = taken.groupBy(*key).agg(F.array_sort(F.collect_list("_free")).alias("_gaps"))  # one entry a name that is taken
    out = held.join(steps, key, "left")
    pushed = F.size(F.filter(F.coalesce("_gaps", F.array().cast("array<bigint>")), lambda g: g < F.col("_k") - 1))
    name = F.concat(F.col(stem), F.lit(lead), (F.col("_k") - 2 + first + pushed).cast("string"), F.lit(tail))
    return out.withColumn("unique_stem", F.when(F.col("_k") == 1, F.col(stem)).otherwise(name)).drop("_dir", "_stem", "_o", "_u", "_k", "_gaps")


def numbered_names(rows: DataFrame, directory: str, order: str, taken: DataFrame, form: str = "%03d", first: int = 1) -> DataFrame:
    """``rows`` with ``unique_stem``: 001, 002 … by ``order`` in each directory, without the names of ``taken`` (directory, name)."""
    held = ranked(rows.withColumns({"_dir": F.col(directory), "_o": F.col(order), "_u": F.xxhash64(*rows.columns)}), ["_dir"], ["_o", "_u"], "_k")
    number = F.regexp_extract("name", "^0*([1-9][0-9]{0,17})$", 1)
    used = taken.select(F.col(directory).alias("_dir"), "name", F.when(number != "", number.cast("long")).alias("_t")).distinct()
    used = used.where(F.col("_t").isNotNull() & (F.col("name") == F.format_string(form, F.col("_t"))) & (F.col("_t") >= first))
    below = F.row_number().over(Window.partitionBy("_dir").orderBy("_t")) - 1
    steps = used.select("_dir", (F.col("_t") - first - below).alias("_free")).groupBy("_dir").agg(F.array_sort(F.collect_list("_free")).alias("_gaps"))
    pushed = F.size(F.filter(F.coalesce("_gaps", F.array().cast("array<bigint>")), lambda g: g < F.col("_k")))
    return held.join(steps, "_dir", "left").withColumn("unique_stem", F.format_string(form, F.col("_k") - 1 + first + pushed)).drop("_dir", "_o", "_u", "_k", "_gaps")
