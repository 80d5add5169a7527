"""List numbers, inherited styles, displayed headings, pages of paged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.sources.shared import cut


def list_numbers(rows: DataFrame, levels: int | None = None) -> DataFrame:
    """``numbers``: counters of levels 0 .. the row's own, in document order within (doc_id, list_id).

    A level's counter restarts after any shallower row.  A level that a deeper row finds unused takes its start, and its own next row counts on
    from there.  ``rows`` has doc_id, idx, list_id, level, start (an array, the first number of each level, else 1); ``levels`` is one
    more than the deepest level and is looked up where it is not given.
    """
    if levels is None:
        levels = (rows.agg(F.max("level")).first()[0] or 0) + 1
    row, level = Window.partitionBy("doc_id", "list_id").orderBy("idx"), F.col("level")
    run = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("level", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1))
    # all windows share one order, so rows are sorted once whatever the levels
    out = rows.withColumns({"_b": before, **{f"_c{k}": F.sum(F.when(level == k, 1).otherwise(0)).over(run) for k in range(levels)}})
    held = {}
    for k in range(levels):
        since = F.coalesce(F.last(F.when(level < k, F.col(f"_c{k}")), ignorenulls=True).over(run), F.lit(0))
        # the first row of level k or deeper since the last shallower one: if it is deeper, it made the counter
        first = (level >= k) & (F.col("_b").isNull() | (F.col("_b") < k))
        made = F.last(F.when(first, (level > k).cast("int")), ignorenulls=True).over(run)
        held[f"_m{k}"] = F.col(f"_c{k}") - since + made - 1
    out = out.withColumns(held)
    number = [F.coalesce(F.get("start", F.lit(k)), F.lit(1)) + F.col(f"_m{k}") for k in range(levels)]
    return out.withColumn("numbers", F.slice(F.array(*[n.cast("int") for n in number]), F.lit(1), level + 1)).drop("_b", *[f"_{x}{k}" for k in range(levels) for x in "cm"])


def render_number(numbers: Column, pattern: Column, formats: Column) -> Column:
    """A pattern such as ``%1.%2`` with numbers put in: decimal, lower or upper letters, lower or upper roman."""

    def shown(n: Column, f: Column) -> Column:
        return F.when(f == "lowerLetter", F.lower(T.to_letters(n))).when(f == "upperLetter", T.to_letters(n)).when(f == "lowerRoman", F.lower(T.to_roman(n))).when(f == "upperRoman", T.to_roman(n)).otherwise(n.cast("string"))

    texts = F.zip_with(numbers, F.slice(formats, F.lit(1), F.size(numbers)), shown)
    start = F.struct(pattern.alias("p"), F.lit(1).alias("i"))
    return F.aggregate(texts, start, lambda s, t: F.struct(F.replace(s["p"], F.concat(F.lit("%"), s["i"].cast("string")), t).alias("p"), (s["i"] + 1).alias("i")))["p"]


def correct_numbering(rows: DataFrame) -> DataFrame:
    """``number`` with its first part set to the current chapter where it disagrees; ``rows`` has doc_id, idx, is_chapter, number."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chapter = F.last(F.when(F.col("is_chapter"), F.split("number", r"\.")[0]), ignorenulls=True).over(w)
    rows = rows.withColumn("_c", chapter)
    wrong = ~F.col("is_chapter") & F.col("_c").isNotNull() & (F.split("number", r"\.")[0] != F.col("_c"))
    return rows.withColumn("number", F.when(wrong, F.concat("_c", F.regexp_replace("number", "^[0-9]+", ""))).otherwise(F.col("number"))).drop("_c")


def resolve_inheritance(styles: DataFrame, attributes: list[str]) -> DataFrame:
    """(doc_id, style, attributes …): what a style lacks comes from the style that it is based on, nearest first, however long the chain.

    ``styles`` has doc_id, style, based_on and the attributes; of rows that repeat a style the smallest (based_on, attributes) counts.  Each step
    doubles what a style's pointer spans: it takes over what the style at its end knows, and that style's pointer.  A chain
    of n styles ends after log2(n) steps.  In a cycle no pointer ends; there a document's number of styles says when every pointer has
    gone round, after which nothing can be added, so no list of visited styles is needed.  A style that is based on one that does not exist
    is based on none.  What has ended leaves the loop and is met from its table.
    """
    one = styles.groupBy("doc_id", "style").agg(F.min(F.struct("based_on", *attributes)).alias("_r"))
    held = cut(one.select("doc_id", "style", F.col("_r.based_on").alias("_up"), *[F.col(f"_r.{a}").alias(a) for a in attributes]))
    longest = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    done, moving, span = held.where("_up is null"), held.where("_up is not null"), 1
    while span <= longest and not moving.isEmpty():
        above = done.unionByName(moving).select(F.col("doc_id").alias("_doc"), F.col("style").alias("_style"), F.col("_up").alias("_next"), *[F.col(a).alias(f"_{a}") for a in attributes])
        step = moving.join(above, (F.col("doc_id") == F.col("_doc")) & (F.col("_up") == F.col("_style")), "left")
        step = cut(step.select("doc_id", "style", F.col("_next").alias("_up"), *[F.coalesce(a, f"_{a}").alias(a) for a in attributes]))
        done, moving, span = done.unionByName(step.where("_up is null")), step.where("_up is not null"), 2 * span
    return done.unionByName(moving).drop("_up")


def display_heading(text: Column, number: Column) -> Column:
    """Heading with its list number in front unless it already starts with one."""
    return F.when(text.rlike("^[0-9]") | (F.coalesce(number, F.lit("")) == ""), text).otherwise(F.concat_ws(" ", F.rtrim(number, F.lit(".")), text))


def page_scheme(scope: Column) -> Column:
    return F.when(scope.isin("cover", "toc", "foreword", "introduction"), "roman").otherwise("arabic")


def toc_page(pages: DataFrame) -> DataFrame:
    """(doc_id, toc_page): first of the first eight pages with a line that is the contents' title."""
    return pages.where((F.col("page") <= 8) & F.col("text").rlike(r"(?m)^[\x09\x20]*目[\x20]*[次录][\x20]*$")).groupBy("doc_id").agg(F.min("page").alias("toc_page"))


def footer_page(spans: DataFrame, share: float = 0.18) -> DataFrame:
    """(doc_id, page, label): lowest span of a page's bottom part that is a page number; ``spans`` has y, height, text."""
    low = spans.where((F.col("y") >= F.col("height") * (1 - share)) & T.strip(F.col("text")).rlike("(?i)^([0-9]{1,4}|[IVXLCM]+)$"))
    return low.groupBy("doc_id", "page").agg(F.max_by(T.strip(F.col("text")), "y").alias("label"))


def paired_toc_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, title, page, page_scheme): contents titles with the page on their own line or the next."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    only = r"(?i)^([IVXLCM]+|[0-9]+)$"
    held = T.squeeze(F.col("line"))
    rows = lines.withColumn("_t", held).where("_t <> ''").withColumn("_next", F.lead("_t").over(w))
    title, page = T.title_and_page(F.col("_t"))
    rows = rows.where(~F.col("_t").rlike(only)).withColumn("_label", F.when(page.isNotNull(), F.regexp_extract("_t", r"(?i)([IVXLCM]+|[0-9]+)$", 1)).when(F.col("_next").rlike(only), F.col("_next")))
    rows = rows.withColumn("title", F.when(page.isNotNull(), title).otherwise(F.col("_t"))).where(F.col("_label").isNotNull() & ~T.heading_key(F.col("title")).isin("目次", "目录"))
    return rows.select("doc_id", "line_no", "title", T.roman_or_int(F.col("_label")).alias("page"), F.when(F.col("_label").rlike("^[0-9]+$"), "arabic").otherwise("roman").alias("page_scheme"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line): lines of paged text without blanks and dot leaders."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\R")).alias("i", "line"))
    return rows.where((T.strip(F.col("line")) != "") & ~F.col("line").rlike(r"\.{4,}")).select("doc_id", "page", "i", T.strip(F.col("line")).alias("line"))


def text_view(pages: DataFrame, first: Column) -> DataFrame:
    """(doc_id, text): non-blank pages from ``first`` on, joined in order."""
    kept = pages.where((T.strip(F.col("text")) != "") & (F.col("page") >= first))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def check_toc_pages(matched: DataFrame) -> DataFrame:
    """(doc_id, toc_idx, toc_page, body_page): contents pages that the body does not bear out.

    ``matched`` has doc_id, toc_idx, page_scheme, toc_page, raw_page (counted from the file's first
    page).  A scheme's pages are counted from its first heading, and a difference that all entries of the scheme share is taken for
    an offset of the count, not an error.
    """
    w = Window.partitionBy("doc_id", "page_scheme")
    rows = matched.withColumn("body_page", F.col("raw_page") - F.min("raw_page").over(w) + 1).withColumn("_d", F.col("toc_page") - F.col("body_page"))
    rows = rows.withColumn("_d", F.when(F.min("_d").over(w) == F.max("_d").over(w), 0).otherwise(F.col("_d")))
    return rows.where("_d <> 0").select("doc_id", "toc_idx", "toc_page", "body_page")


def order_mismatch(matched: DataFrame) -> DataFrame:
    """(doc_id, mismatch): whether matched headings leave the order of the contents."""
    w = Window.partitionBy("doc_id").orderBy("toc_idx")
    return matched.withColumn("_back", F.col("heading_idx") < F.lag("heading_idx").over(w)).groupBy("doc_id").agg(F.coalesce(F.bool_or("_back"), F.lit(False)).alias("mismatch"))
