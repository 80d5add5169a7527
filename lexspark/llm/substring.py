"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text: h = 2 h + G[byte] in 16 bits, so h depends on the last 16
bytes only.  A chunk ends where h is the smallest of the ``reach`` values before and after it, and ``longest`` bytes from its start at
the latest, then after the last smallest h among the last ``SETTLE`` of these bytes, so that a word or line said over and over is cut in the same
places wherever it starts; an end inside a character moves to the character's end.  (Against a threshold on h this keeps chunks of much the
same size, so less of a repeated text's ends lies in chunks that reach beyond it.)  After an insertion the ends fall back into
step with the content.

Chunks are equal if their size, number of words and 96 bits of hash agree.  Of equal chunks one place *owns* the content: the
first in the smallest document.  Every other place is a repeat, in the same document or another.  Consecutive chunks of a
document that occur more than once form a run, whoever owns them.  A run says that a text repeats, but not where that text begins and
ends: the chunks at both ends reach beyond it.  So a run counts if the words in it and those around it that the repeated text could hold
are more than the length asked for; every chunk therefore carries how many words could stand before and after it.  No repeat of that
length is missed because its chunks fall badly, and a run whose surroundings can't make it that long is left alone.

Only repeats are ever cut out, and a chunk's owner is never a repeat, so whatever is cut still stands somewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)

#: Parts of a chunk's shape: 32 bits of hash, its size and its number of words, which ``longest`` bounds.
PART = 1 << 12

#: Bytes that the rolling hash looks back.
BACK = 16

#: Bytes in which an end that nothing marks looks for its place: longer than a usual word or short line.
SETTLE = 64


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling: a window of 2m is two windows of m."""
    h = GEAR[data]
    for m in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[m:] = h[:-m]
        h = h + (shifted << np.uint16(m))
    return h


def smallest_before(h: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of the ``reach`` values before each one, by doubling; the largest number where there is none."""
    most = np.iinfo(h.dtype).max

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((np.full(min(by, len(x)), most, x.dtype), x[: max(0, len(x) - by)]))

    low, span = shifted(h, 1), 1
    while 2 * span <= reach:
        low, span = np.minimum(low, shifted(low, span)), 2 * span
    return np.minimum(low, shifted(low, reach - span)) if span < reach else low


def chunk_ends(data: np.ndarray, reach: int = 12, longest: int = 256) -> list[int]:
    """Exclusive end of every chunk, never inside a character; the last is the text's end."""
    h = gear(data)
    marks = np.nonzero((h < smallest_before(h, reach)) & (h <= smallest_before(h[::-1], reach)[::-1]))[0] + 1
    ends, at, n = [], 0, len(data)
    first = np.append((data & 0xC0) != 0x80, True)  # where a character starts, and the text's end

    def close(end: int) -> int:
        while not first[end]:
            end += 1
        ends.append(end)
        return end

    def unmarked(at: int) -> int:
        last = h[at + longest - min(SETTLE, longest // 2) : at + longest][::-1]
        return at + longest - int(last.argmin())

    for m in marks.tolist():
        while m - at > longest:
            at = close(unmarked(at))
        if m > at:
            at = close(m)
    while n - at > longest:
        at = close(unmarked(at))
    if at < n:
        ends.append(n)
    return ends


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 12, longest: int = 256) -> DataFrame:
    """(doc_id, place, shape, digest): the chunks of every whole text.

    ``digest`` is 64 bits of a 128-bit hash of the bytes, ``shape`` 32 more, the size in bytes and the number of words that begin in
    it, in one number, since there are many rows.  ``place`` is its first byte in the text's UTF-8 form and the numbers of words before and after it that a
    repeat could hold whose first or last whole chunk this is.  An end is the same in two places if they agree for ``BACK + reach`` bytes before
    and ``reach`` after it, so such a repeat begins at most that far before the chunk before, and ends at most ``reach`` after the
    chunk behind.  Null and empty texts have no chunks; ids may be of any type.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64]
                rows, places, sizes, words, hashes = [], [], [], [], []
                for row, text in enumerate(part["text"]):
                    raw = text.encode("utf-8", "surrogatepass")
                    if not raw:
                        continue
                    data = np.frombuffer(raw, np.uint8)
                    blank = (data == 32) | ((data >= 9) & (data <= 13))
                    seen = np.concatenate(([0], np.cumsum(~blank & np.concatenate(([True], blank[:-1])))))
                    ends = chunk_ends(data, reach, longest)
                    begin = [0, *ends[:-1]]
                    low = np.maximum(0, np.array([0, 0, *begin[1:-1]][: len(ends)], np.int64) - BACK - reach)
                    high = np.minimum(len(raw), np.array([*ends[1:], len(raw)], np.int64) + reach)
                    rows.append(np.full(len(ends), row))
                    places.append((np.array(begin, np.int64) * PART + seen[begin] - seen[low]) * PART + seen[high] - seen[ends])
                    sizes.append(np.diff([0, *ends]))
                    words.append(seen[ends] - seen[begin])
                    hashes += [digest(raw[a:b]) for a, b in zip(begin, ends)]
                if rows:
                    h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                    shape = ((h[:, 1] & 0xFFFFFFFF) * PART + np.concatenate(sizes)) * PART + np.concatenate(words)
                    yield pd.DataFrame({"doc_id": part["doc_id"].iloc[np.concatenate(rows)].to_numpy(), "place": np.concatenate(places), "shape": shape, "digest": h[:, 0]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, place long, shape long, digest long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 12) -> DataFrame:
    """(doc_id, start, end, words, before, after, owner, kept): every chunk whose content stands in more than one place; ``kept`` is the place that owns it.

    Rows that share an id hold one document: a place that they both have counts once.  Rows with a null id are left out.  A
    content's places are counted by partial sums before the shuffle, and places meet their content in a join that adaptive
    execution may split, so a chunk that a third of all documents share is in no single task.
    """
    found = chunks(docs.where(F.col(id_col).isNotNull()), id_col, text_col, reach)
    key = ["digest", "shape"]
    again = found.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = found.join(again, key).select("doc_id", F.shiftrightunsigned("place", 24).alias("start"), F.col("place").bitwiseAND(PART * PART - 1).alias("around"), *key, "owner", "n").repartition("doc_id")
    same = Window.partitionBy("doc_id", *key)  # within one document
    here = met.withColumns({"here": F.count(F.lit(1)).over(same), "first": F.min("start").over(same), "last": F.max("start").over(same)})
    more = here.where("owner <> doc_id or n > here or first <> last")
    end = F.col("start") + F.shiftrightunsigned("shape", 12).bitwiseAND(PART - 1)
    kept = (F.col("owner") == F.col("doc_id")) & (F.col("start") == F.col("first"))
    around = [F.shiftrightunsigned("around", 12).alias("before"), F.col("around").bitwiseAND(PART - 1).alias("after")]
    return more.select("doc_id", "start", end.alias("end"), F.col("shape").bitwiseAND(PART - 1).alias("words"), *around, "owner", kept.alias("kept"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longer_than: int = 50, min_words: int = 25, reach: int = 12) -> DataFrame:
    """One row a passage: ``id_col, start, end, n_words, first_doc_id, kept``.

    A run of chunks that each stand in more than one place is found if the repeated text in it could have more than
    ``longer_than`` words.  Each part of it that is owned elsewhere and has ``min_words`` words or more is a passage to be cut out
    with :func:`without_repeats`; what lies between such parts is a passage that stays (``kept``), so chance words that an earlier document
    owns are not torn out of the copy that stays.  ``start`` and ``end`` are bytes of the text's UTF-8 form, at character starts, and
    lie up to a chunk or two inside the repeated text at either end.  ``first_doc_id`` is the smallest document that owns a
    chunk of it.  Repeats inside one document count.  Null and empty texts
    and rows with a null id give no passage; rows that share an id count as one document.
    """
    run = Window.partitionBy("doc_id").orderBy("start", "end", "owner", "kept")
    parts = repeated_chunks(docs, id_col, text_col, reach)
    # rows that repeat a place (an id given twice) follow each other: the first stands for all
    parts = parts.withColumn("_twin", F.coalesce((F.col("start") == F.lag("start").over(run)) & (F.col("end") == F.lag("end").over(run)) & (F.col("owner") == F.lag("owner").over(run)), F.lit(False))).where("not _twin")
    goes_on = F.coalesce(F.col("start") == F.lag("end").over(run), F.lit(False))
    same = goes_on & F.coalesce(F.col("kept") == F.lag("kept").over(run), F.lit(False))
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumns({"_new": (~goes_on).cast("int"), "_turn": (~same).cast("int")})
    parts = parts.withColumns({"_run": F.sum("_new").over(so_far), "_part": F.sum("_turn").over(so_far)})
    total = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("owner").alias("owner"), F.bool_and("kept").alias("kept")]
    parts = parts.groupBy("doc_id", "_run", "_part").agg(*total, F.min(F.struct("start", "before")).alias("left"), F.max(F.struct("end", "after")).alias("right"))
    whole = Window.partitionBy("doc_id", "_run")
    could = F.sum("words").over(whole) + F.min("left").over(whole)["before"] + F.max("right").over(whole)["after"]
    parts = parts.withColumn("_could", could).where(F.col("_could") > longer_than).withColumn("kept", F.col("kept") | (F.col("words") < min_words))
    inside = whole.orderBy("start", "end", "_part")
    turn = F.when(F.col("kept") == F.lag("kept").over(inside), 0).otherwise(1)
    parts = parts.withColumn("_turn", turn).withColumn("_piece", F.sum("_turn").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = parts.groupBy("doc_id", "_run", "_piece").agg(*total)
    return found.select(F.col("doc_id").alias(id_col), "start", "end", F.col("words").cast("long").alias("n_words"), F.col("owner").alias("first_doc_id"), "kept")


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages that are not kept cut out of their texts.

    What a passage repeats stays where it is owned, so no chunk disappears from the whole corpus.  Rows that share
    an id may hold different texts and stay as they are.  A null text stays null.  Other columns
    may have any names.
    """
    twice = docs.groupBy(F.col(id_col)).count().where("count > 1").select(id_col)
    gone = passages.where(~F.col("kept")).join(twice, id_col, "left_anti").groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(gone, F.col(f"row.`{id_col}`") == F.col("id"), "left")
    text = F.col(f"row.`{text_col}`")
    raw = F.encode(text, "UTF-8")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    piece = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    left = F.aggregate("cuts", state, lambda s, c: F.struct(c["end"].alias("at"), F.array_append(s["parts"], piece(s["at"], c["start"])).alias("parts")))
    whole = F.concat(F.array_join(left["parts"], ""), piece(left["at"], F.octet_length(text).cast("long")))
    new = F.when(F.col("cuts").isNull() | text.isNull(), text).otherwise(whole)
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
