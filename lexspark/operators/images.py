"""Content-list blocks: image names from captions, and references to them in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

BLOCK = "struct<type:string,text:string,img_path:string,image_caption:array<string>,table_caption:array<string>,table_body:string>"


def content_blocks(rows: DataFrame, json_col: str = "content_list") -> DataFrame:
    """(doc_id, ord, type, text, img_path, captions, table_body): blocks of a bare list or of one under content_list, items, blocks or data."""
    bare = F.from_json(json_col, f"array<{BLOCK}>")
    roots = [F.from_json(F.get_json_object(json_col, f"$.{k}"), f"array<{BLOCK}>") for k in ("content_list", "items", "blocks", "data")]
    blocks = F.coalesce(F.when(F.ltrim(json_col).startswith("["), bare), *roots)
    flat = rows.select("doc_id", F.posexplode(blocks).alias("ord", "b")).where("b is not null")
    return flat.select("doc_id", "ord", F.lower(T.strip(F.coalesce("b.type", F.lit("")))).alias("type"), T.strip(F.coalesce("b.text", F.lit(""))).alias("text"), T.strip(F.coalesce("b.img_path", F.lit(""))).alias("img_path"), F.when(F.lower("b.type") == "table", F.col("b.table_caption")).otherwise(F.col("b.image_caption")).alias("captions"), F.coalesce("b.table_body", F.lit("")).alias("table_body"))


def first_with(captions: Column, pattern: str) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(F.coalesce(captions, F.array().cast("array<string>")), T.strip), lambda c: c.rlike(pattern)), 0), F.lit(""))


def image_names(blocks: DataFrame) -> DataFrame:
    """(doc_id, old_name, suggested): the first caption that starts with 图 (tables: 表); else a lettered label after the last text before it."""
    run = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("_last", F.coalesce(F.last(F.when((F.col("type") == "text") & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(run), F.lit("")))
    name = F.element_at(F.split(F.replace("img_path", F.lit("\\"), F.lit("/")), "/"), -1)
    figure, label = first_with(F.col("captions"), "^图"), first_with(F.col("captions"), r"^[a-zA-Z][）)]")
    lettered = F.when((label != "") & (F.col("_last") != ""), F.concat(F.regexp_replace("_last", "[。，、；：,.;:!?！？]+$", ""), label)).otherwise("")
    suggested = F.when(F.col("type") == "table", first_with(F.col("captions"), "^表")).when(figure != "", figure).otherwise(lettered)
    out = rows.where(F.col("type").isin("image", "table") & (F.col("img_path") != "")).select("doc_id", "ord", name.alias("old_name"), suggested.alias("suggested"))
    return out.where("old_name <> '' and suggested <> ''")


def caption_before(text: Column, anchor: Column) -> Column:
    """Last line before the anchor that starts with 表."""
    head = F.when(F.instr(text, anchor) > 0, F.substring(text, F.lit(1), F.instr(text, anchor) - 1)).otherwise(F.lit(""))
    hits = F.regexp_extract_all(head, F.lit(r"(?m)^[\x09\x20]*(表[^\n]*)"), F.lit(1))
    return F.coalesce(T.strip(F.get(hits, F.size(hits) - 1)), F.lit(""))


#: What may be a reference to an image: a Markdown image, a path below images/, or a bare name that is a hash.
REFERENCE = r"!\[[^\]]*\]\([^)]*\)|(?:\./|/)?images/[^\s()\[\]<>\"'|]+|(?<![\w./-])[A-Fa-f0-9]{16,}\.[A-Za-z0-9]+"


def rewrite_refs(docs: DataFrame, renames: DataFrame, prefix: str = "images") -> DataFrame:
    """``docs`` with references to old image names in ``text`` turned into ``prefix/new``; ``renames`` has doc_id, old, new.

    A text is cut into references and what is between them once, and each reference is looked up by its name, so a new name is never
    taken for an old one (a to b and b to c in one text).  The target of a Markdown image is replaced whole, in any case of letters; of a path
    below ``images/`` a leading ``./`` or ``/`` stays.  Names that ``renames`` lacks stay; of several new names for an old one the smallest counts.
    """
    one = renames.where("old is not null and new is not null").groupBy("doc_id", F.lower("old").alias("k"), "old").agg(F.min("new").alias("new"))
    per = one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_exact"), F.collect_list(F.struct("k", "old", "new")).alias("_l"))
    # names that differ in their letters' case only: the first by code point speaks for the rest
    by_case = F.aggregate(F.array_sort("_l"), F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["new"]))))
    per = per.select("doc_id", "_exact", by_case.alias("_any"))
    path = lambda name: F.concat(F.lit(prefix.strip("/") + "/"), name)

    def rewritten(hit: Column) -> Column:
        target = F.regexp_extract(hit, r"^!\[[^\]]*\]\(([^)]*)\)$", 1)
        base = F.element_at(F.split(F.when(hit.startswith("!["), target).otherwise(hit), "/"), -1)
        new = F.coalesce(F.col("_exact")[base], F.when(hit.startswith("!["), F.col("_any")[F.lower(base)]))
        label = F.regexp_extract(hit, r"^(!\[[^\]]*\]\()", 1)
        lead = F.regexp_extract(hit, r"^(\./|/)?images/", 1)
        return F.when(new.isNull(), hit).when(label != "", F.concat(label, path(new), F.lit(")"))).otherwise(F.concat(lead, path(new)))

    gaps, hits = F.split("text", REFERENCE, -1), F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(rewritten(h), F.lit("")))), "")
    return docs.join(per, "doc_id", "left").withColumn("text", F.when(F.col("_exact").isNull(), F.col("text")).otherwise(joined)).drop("_exact", "_any")


IMAGE_SUFFIX = r"\.(png|jpe?g|gif|bmp|webp)$"


def is_image(member: Column) -> Column:
    """An image below images/, or one that is at most one folder deep."""
    held = F.lower(F.replace(member, F.lit("\\"), F.lit("/")))
    inside = held.startswith("images/") | held.contains("/images/")
    return held.rlike(IMAGE_SUFFIX) & (inside | (F.length(held) - F.length(F.replace(held, F.lit("/"), F.lit(""))) <= 1))


def image_members(members: DataFrame, by: str = "bundle") -> DataFrame:
    """Image members of each archive; where none is in its place, all files that are images by their suffix."""
    any_image = F.lower("member").rlike(IMAGE_SUFFIX)
    placed = F.coalesce(is_image(F.col("member")), F.lit(False))
    rows = members.withColumn("_placed", placed).withColumn("_some", F.max("_placed").over(Window.partitionBy(by)))
    return rows.where(F.when(F.col("_some"), F.col("_placed")).otherwise(any_image)).drop("_placed", "_some")


def tiny_images(members: DataFrame, least: int = 100) -> DataFrame:
    return members.where(is_image(F.col("member")) & (F.col("size") <= least))
