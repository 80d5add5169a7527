"""Reading corpora, bundles, spans, manifests and saved indexes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators.images import is_image
from lexspark.operators.rulebook import rule_chunks
from lexspark.operators.segment import lines

RULE = "chunk_id string, title string, scope string, content string, source_ref string, tags array<string>, analysis_mode string, target_scopes array<string>"
SPAN = "doc_id string, extractions array<struct<extraction_class:string,extraction_text:string,char_interval:struct<start_pos:int,end_pos:int>>>"


def read_corpus(spark: SparkSession, path: str, suffixes: str = "md,markdown,txt") -> DataFrame:
    """(path, file_name, text): one row a file; bytes that are no UTF-8 fall away."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{suffixes}}}").load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths and sizes of a folder's top level, in order; file contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path).select("path", "length", "modificationTime").orderBy("path")


def load_rules(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """Rule rows of all books below ``path``; ``default`` where they hold none."""
    docs = read_corpus(spark, path).select(F.col("path").alias("doc_id"), "text")
    found = rule_chunks(lines(docs))
    return default if default is not None and found.isEmpty() else found


def read_layout(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """``layout``: the JSON text, or {"raw": …} where it can't be read."""
    return rows.withColumn("layout", F.when(F.try_parse_json(json_col).isNotNull(), F.col(json_col)).otherwise(F.to_json(F.struct(F.col(json_col).alias("raw")))))


def header_blocks(rows: DataFrame, json_col: str = "layout") -> DataFrame:
    """(doc_id, page_idx, idx, type, index, text): text of the discarded blocks of each page, their spans joined; ``index`` is the place that a block names."""
    schema = "struct<pdf_info:array<struct<page_idx:int,discarded_blocks:array<struct<type:string,index:int,lines:array<struct<spans:array<struct<content:string>>>>>>>>>"
    pages = rows.select("doc_id", F.explode(F.from_json(json_col, schema)["pdf_info"]).alias("p"))
    blocks = pages.select("doc_id", "p.page_idx", F.posexplode("p.discarded_blocks").alias("idx", "b"))
    spans = F.flatten(F.transform("b.lines", lambda line: F.transform(line["spans"], lambda s: F.coalesce(s["content"], F.lit("")))))
    return blocks.select("doc_id", "page_idx", "idx", "b.type", "b.index", T.strip(F.array_join(spans, "")).alias("text"))


def explode_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, member, size, content, is_image, role, error): members of zip archives; role marks the first Markdown, layout and content list.  An archive that can't be read, or has no Markdown, has an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        for n in names:  # a member at a time
                            data = z.read(n)
                            yield pd.DataFrame({"bundle": [bundle], "member": [n], "size": [len(data)], "content": [data], "error": [None]})
                        if not any(n.lower().endswith(".md") for n in names):
                            yield pd.DataFrame({"bundle": [bundle], "member": [None], "size": [0], "content": [None], "error": ["no Markdown"]})
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame({"bundle": [bundle], "member": [None], "size": [0], "content": [None], "error": [str(e)]})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    out = raw.mapInPandas(run, "bundle string, member string, size long, content binary, error string")
    name = F.lower(F.element_at(F.split("member", "/"), -1))
    kind = F.when(name.endswith(".md"), "markdown").when(name.endswith("_middle.json") | (name == "layout.json"), "layout").when(name.contains("content_list") & name.endswith(".json") & ~name.contains("v2"), "content_list")
    out = out.withColumn("is_image", F.coalesce(is_image(F.col("member")), F.lit(False))).withColumn("_kind", kind)
    first = F.row_number().over(Window.partitionBy("bundle", "_kind").orderBy("member")) == 1
    return out.withColumn("role", F.when(F.col("_kind").isNotNull() & first, F.col("_kind"))).drop("_kind")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, cls, txt, start_pos, seq) of annotated JSON lines."""
    rows = spark.read.schema(SPAN).json(path)
    return rows.select("doc_id", F.posexplode("extractions").alias("seq", "e")).select("doc_id", F.col("e.extraction_class").alias("cls"), F.col("e.extraction_text").alias("txt"), F.col("e.char_interval.start_pos").alias("start_pos"), "seq")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Saved rules; fields that they lack take defaults, unknown ones are dropped."""
    rows = spark.read.schema(RULE).json(path)
    empty = F.array().cast("array<string>")
    return rows.select("chunk_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "scope", "content", "source_ref")], F.coalesce("tags", empty).alias("tags"), F.coalesce("analysis_mode", F.lit("local")).alias("analysis_mode"), F.coalesce("target_scopes", empty).alias("target_scopes"))


def is_fresh(spark: SparkSession, sources: str, saved: str) -> bool:
    """Whether every saved file is at least as new as every source (two aggregates reach the driver)."""
    newest = list_files(spark, sources).agg(F.max("modificationTime")).first()[0]
    oldest = list_files(spark, saved, "*.json").agg(F.min("modificationTime")).first()[0]
    return newest is not None and oldest is not None and oldest >= newest


def resolve_manifest(rows: DataFrame) -> DataFrame:
    """``markdown_path``: the primary artifact if it is Markdown, else the first Markdown artifact."""
    first = F.get(F.filter("artifacts", lambda a: a["type"] == "markdown"), 0)["virtual_path"]
    return rows.withColumn("markdown_path", F.coalesce(F.when(F.col("primary.type") == "markdown", F.col("primary.virtual_path")), first))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)
