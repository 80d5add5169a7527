"""Places for a caller's own parser and summary model.  Both run inside the tasks, and a failure stays with its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_documents(files: DataFrame, parser: Callable[[bytes], tuple[str, str]]) -> DataFrame:
    """(path, text, layout, error) from (path, content): ``parser`` turns bytes into text and layout JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    text, layout = parser(bytes(content))
                    error = None
                except Exception as e:  # noqa: BLE001  whatever the caller's parser raises
                    text, layout, error = None, None, str(e)[:200]
                yield pd.DataFrame({"path": [path], "text": [text], "layout": [layout], "error": [error]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, layout string, error string")


def summarise(issues: DataFrame, model: Callable[[str], str], most: int = 32) -> DataFrame:
    """(doc_id, summary): ``model`` reads a document's first ``most`` issues, the number being part of what it is asked."""
    line = F.concat_ws(" | ", F.substring("rule_name", 1, 240), "scope", "status", "severity")
    text = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("s")))), lambda x: x["s"]), 1, most), "\n")
    asked = issues.groupBy("doc_id").agg(text.alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "summary": [model(p) for p in batch["prompt"]]})

    return asked.mapInPandas(run, f"doc_id {dict(asked.dtypes)['doc_id']}, summary string")


def chunks(docs: DataFrame, size: int, buffer: int) -> DataFrame:
    """(doc_id, start, skip, own, chunk): pieces of ``size`` characters of each text with up to ``buffer`` characters on either side.

    ``skip`` characters of a chunk come before its own, of which there are ``own``.  A blank text has no chunk.
    """
    n = F.length("text")
    rows = docs.where(F.coalesce(F.btrim("text"), F.lit("")) != "").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("_at"))
    start = F.greatest(F.lit(0), F.col("_at") - buffer)
    rows = rows.select("doc_id", "text", "_at", start.alias("start"), (F.col("_at") - start).alias("skip"), F.least(F.lit(size), n - F.col("_at")).alias("own"))
    return rows.select("doc_id", "start", "skip", "own", F.substring("text", F.col("start") + 1, F.col("skip") + F.col("own") + buffer).alias("chunk"))


def extracted(docs: DataFrame, extract, size: int = 10000, buffer: int = 1000) -> DataFrame:
    """(doc_id, cls, txt, start_pos, error) of the spans that ``extract(text) -> (class, text, start) …`` finds in chunks of each text.

    ``extract`` is called inside the tasks, once a chunk, by a Python table function that each chunk is joined with laterally.  Chunks overlap by ``buffer`` on
    both sides, so a span that is no longer than that, and that ``buffer`` characters before it are enough to tell, is seen whole in the chunk
    where it starts; only that chunk counts it.  Starts are moved back to the text's own (from 0); a span without a start is counted
    once a (document, class, text) and has none.  Spans of different chunks never double, whatever ``size`` is.  A chunk that ``extract`` fails
    on gives one row with the error and nothing else.
    """
    spark = docs.sparkSession

    class Extract:
        def eval(self, chunk: str):
            try:
                held = [(cls, txt, None if start is None else int(start), None) for cls, txt, start in extract(chunk)]
            except Exception as e:  # noqa: BLE001  whatever the caller's extractor raises stays with its chunk
                held = [(None, None, None, str(e)[:200])]
            yield from held

    table = F.udtf(Extract, returnType="cls string, txt string, found int, error string")
    rows = chunks(docs, size, buffer).repartition(spark.sparkContext.defaultParallelism * 4)  # long texts give many chunks: deal them anew
    met = rows.lateralJoin(table(F.col("chunk").outer()))
    own = (F.col("found") >= F.col("skip")) & (F.col("found") < F.col("skip") + F.col("own"))
    start = (F.col("start") + F.col("found")).cast("int")
    placed = met.where(own | F.col("error").isNotNull()).select("doc_id", "cls", "txt", start.alias("start_pos"), "error")
    loose = met.where("found is null and error is null").select("doc_id", "cls", "txt").distinct()
    return placed.unionByName(loose.select("*", F.lit(None).cast("int").alias("start_pos"), F.lit(None).cast("string").alias("error")))
