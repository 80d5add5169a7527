"""Whether the pages that a table of contents gives are those of the headings, by logical pages and calibration.

Pages of headings are estimates counted from the file's first page.  Front matter is numbered from the document's first page, the body from its first heading, and a
scheme whose trusted pairs all differ by the same number of pages is moved by it.  What rests on an estimate that page breaks inside tables disturb, and that nothing
calibrates, is unreliable, not wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

#: Scopes of the front matter, and titles by which a contents row without a number is known.  Fixed values.
FRONT, FRONT_TITLES, APPENDIX, SELF = ("foreword", "introduction"), ("前言", "引言"), "附录", ("目次", "目录", "contents")


def entry_scheme(number: Column, title: Column) -> Column:
    """``roman`` for a foreword or an introduction without a number, else ``arabic``."""
    key = T.match_key(F.lit(""), title)
    front = F.lit(False)
    for t in FRONT_TITLES:
        front = front | key.startswith(t)
    return F.when((F.coalesce(number, F.lit("")) == "") & front, "roman").otherwise("arabic")


def anchors(facts: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, first_page, first_body): the first page of any paragraph (doc_id, page), and of a heading (doc_id, scope, page) outside the front matter and contents."""
    first = facts.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    body = headings.where(~F.col("scope").isin(*FRONT, "toc")).groupBy("doc_id").agg(F.min("page").alias("first_body"))
    return first.join(body, "doc_id", "full")


def verdicts(matches: DataFrame, anchor: DataFrame) -> DataFrame:
    """``matches`` with raw_page, body_page and verdict: ``pass``, ``fail``, ``unreliable``, ``skipped`` (pages or schemes that can't be compared), ``out_of_scope``.

    ``matches`` has doc_id, toc_idx, number, title, page (the contents' own), bookmark_match, and of the heading h_scope, h_role, h_page, h_table_breaks,
    h_bookmarked.  Everything a document needs is a window over its matches of one scheme.
    """
    rows = matches.join(anchor, "doc_id", "left").withColumn("scheme", entry_scheme(F.col("number"), F.col("title")))
    front, listed = F.col("h_scope").isin(*FRONT), F.col("h_scope") == "toc"
    rows = rows.withColumns({
        "h_scheme": F.when(F.col("h_page").isNull() | listed, None).when(front, "roman").otherwise("arabic"),
        "logical": F.when(listed, F.col("h_page")).when(front, F.col("h_page") - F.coalesce("first_page", F.lit(1)) + 1).otherwise(F.col("h_page") - F.coalesce("first_body", F.lit(1)) + 1),
        "shaky": (F.coalesce("h_table_breaks", F.lit(0)) > 0) & ~F.coalesce("h_bookmarked", F.lit(False)) & ~listed,
        "key": T.match_key(F.lit(""), F.col("title")),
    })
    own = F.col("key").isin(*SELF) | (F.col("key").rlike("^(?:目次|目录)") & (F.length("key") <= 3))
    numbered = (F.coalesce("number", F.lit("")) != "") | F.col("key").rlike("^[0-9]+(?:[.][0-9]+)*")
    looked = ~own & ~F.coalesce(listed, F.lit(False)) & F.when(F.col("scheme") == "roman", front).when(numbered, True).when(F.col("key").startswith(APPENDIX), F.col("h_role") == "appendix_title").otherwise(False)
    # trusted pairs of a scheme that differ alike calibrate all its headings
    same = (F.col("scheme") == F.col("h_scheme")) & F.col("page").isNotNull()
    trusted = F.when(same & (F.coalesce("bookmark_match", F.lit(False)) | ~F.col("shaky")), F.col("page") - F.col("logical"))
    scheme = Window.partitionBy("doc_id", "scheme")
    rows = rows.withColumn("looked", F.coalesce(looked, F.lit(False))).withColumn("_d", trusted)
    # a heading is moved by the offset of its own scheme, which a row of the other scheme may have set
    rows = rows.withColumns({f"_{s}": F.when(F.min(F.when(F.col("scheme") == s, F.col("_d"))).over(Window.partitionBy("doc_id")) == F.max(F.when(F.col("scheme") == s, F.col("_d"))).over(Window.partitionBy("doc_id")), F.min(F.when(F.col("scheme") == s, F.col("_d"))).over(Window.partitionBy("doc_id"))) for s in ("roman", "arabic")})
    moved = F.when(F.col("h_scheme") == "roman", F.col("_roman")).when(F.col("h_scheme") == "arabic", F.col("_arabic"))
    rows = rows.withColumn("calibrated", moved.isNotNull()).withColumn("logical", F.col("logical") + F.coalesce(moved, F.lit(0)))
    # what nothing calibrated: an offset that all looked-at rows of the entry's scheme share
    rest = F.when(F.col("looked") & ~F.col("calibrated") & F.col("page").isNotNull(), F.col("logical") - F.col("page"))
    rows = rows.withColumn("_r", rest)
    shared = F.when(F.min("_r").over(scheme) == F.max("_r").over(scheme), F.min("_r").over(scheme))
    rows = rows.withColumn("body_page", F.col("logical") - F.coalesce(shared, F.lit(0)))
    bad = F.col("body_page") != F.col("page")
    verdict = (
        F.when(~F.col("looked"), "out_of_scope")
        .when(F.col("page").isNull() | F.col("h_page").isNull() | (F.col("h_scheme") != F.col("scheme")), "skipped")
        .when(bad & F.col("shaky") & ~F.col("calibrated"), "unreliable")
        .when(bad, "fail")
        .otherwise("pass")
    )
    return rows.withColumn("verdict", verdict).select(*matches.columns, F.col("h_page").alias("raw_page"), "body_page", "verdict")


def evaluation(entries: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, status, checked, failed, skipped, unreliable, out_of_scope): one row a document of ``entries`` (doc_id, n_entries, n_unmatched).

    A document without a contents row is ``insufficient_context``; skipped counts contents rows without a heading as well.
    """
    count = lambda *v: F.count_if(F.col("verdict").isin(*v))
    per = judged.groupBy("doc_id").agg((F.count(F.lit(1)) - count("out_of_scope")).alias("checked"), count("fail").alias("failed"), count("skipped").alias("skipped"), count("unreliable").alias("unreliable"), count("out_of_scope").alias("out_of_scope"))
    both = entries.join(per, "doc_id", "left").na.fill(0, ["checked", "failed", "skipped", "unreliable", "out_of_scope"])
    status = F.when(F.col("n_entries") == 0, "insufficient_context").when(F.col("failed") > 0, "fail").otherwise("pass")
    return both.select("doc_id", status.alias("status"), "checked", "failed", (F.col("skipped") + F.col("n_unmatched")).alias("skipped"), "unreliable", "out_of_scope")
