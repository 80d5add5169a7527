"""Language identification by compression.

A bounded sample of labelled texts gives each language a dictionary of raw content.  A text, in
lower case and with everything but letters folded to spaces, is encoded by zstandard once with each dictionary; the
smallest encoding names the language.  Long texts are encoded in blocks whose sizes are added
up, so that every part of a text leans on the dictionary and memory stays bounded.

Lines that occur in more than one language of the sample (licences, boilerplate) teach nothing about a
language and stay out of the dictionaries; a line that one language repeats goes in once.

A text is rejected when its margin between the two smallest encodings is narrow.  How narrow is read off rows of the sample that no
dictionary has: at most a stated share of those that are named rightly is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import SMALL, cut, shuffled, thinned

NOT_LETTERS = re.compile(r"[\W\d_]+")
NUMBERS = regex.compile(r"\p{N}+")
UNKNOWN = "und"


def letters(text: str) -> str:
    """The letters (Unicode category L) of a text in lower case, everything else as spaces."""
    held = NOT_LETTERS.sub(" ", text.lower())
    # what \w holds beside letters and digits: superscripts, fractions, numerals
    return (held if held.isascii() else NUMBERS.sub(" ", held)).strip()


@dataclass(frozen=True)
class Model:
    """Languages in code point order, each with its dictionary."""

    langs: tuple[str, ...]
    content: tuple[bytes, ...]
    block: int = 4096
    level: int = 3
    min_margin: float = 0.0

    def compressors(self):
        import zstandard as zs

        size = max([1, *map(len, self.content)])
        params = zs.ZstdCompressionParameters.from_level(self.level, source_size=self.block, dict_size=size, min_match=3, strategy=zs.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
        made = []
        for content in self.content:
            if len(content) < 8:  # too little to be a dictionary
                made.append(zs.ZstdCompressor(compression_params=params))
                continue
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(zs.ZstdCompressor(dict_data=d, compression_params=params))
        return made


def classify(text: str | None, model: Model, compressors) -> tuple[str, float, float]:
    """(language, score, margin).  No letters: (``und``, 0, 0).  Ties go to the first language.

    margin is the second smallest size less the smallest, over the second smallest; score maps it
    to 0.5 .. 1 (1 if only one language is known).
    """
    held = letters(text or "").encode()
    if not held or not model.langs:
        return UNKNOWN, 0.0, 0.0
    parts = [held[k : k + model.block] for k in range(0, len(held), model.block)]
    sizes = [sum(len(c.compress(p)) for p in parts) for c in compressors]
    order = np.argsort(sizes, kind="stable")
    if len(order) == 1:
        return model.langs[0], 1.0, 1.0
    margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
    return model.langs[order[0]], 1.0 - 0.5 * float(np.exp(-40.0 * margin)), float(margin)


def pieces_of(text: str, longest: int = 400) -> list[str]:
    """The letters of a text's lines, long lines in consecutive pieces: together all of the text."""
    held = (letters(line) for line in text.split("\n"))
    return [line[k : k + longest] for line in held for k in range(0, len(line), longest)]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 1500, dict_bytes: int = 131072, sample_rows: int = 384000, rejected_share: float = 0.002) -> Model:
    """Fit to at most ``docs_per_lang`` rows of each language, in a fixed shuffled order; every value of the label is a language.

    ``sample_rows`` bounds the rows of all languages together and ``256 * dict_bytes`` the bytes of all dictionaries: many languages get a smaller
    part each, of one row and one byte at least.

    Three quarters of the rows make the dictionaries: lines of their whole texts are drawn by hash, up to ``dict_bytes`` a language, and
    only those reach the driver.  The last quarter sets ``min_margin``: at most ``rejected_share`` of its rightly named texts have a smaller one.
    Rows whose text or language is null are left out.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = cut(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("total")))
    langs = sorted(r["lang"] for r in counts.select("lang").collect())  # the labels' values, not their rows
    if not langs:
        return Model((), ())
    docs_per_lang, dict_bytes = max(1, min(docs_per_lang, sample_rows // len(langs))), max(1, min(dict_bytes, 256 * dict_bytes // len(langs)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), shuffled(F.col(id_col)).alias("k"))
    rows = rows.join(F.broadcast(counts) if len(langs) <= SMALL else counts, "lang")
    total = F.col("total")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("k", "id", F.xxhash64("text")))
    sample = cut(thinned(rows, F.col("k"), docs_per_lang, total).withColumn("r", rank).where(F.col("r") <= docs_per_lang))

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pieces_of(t) for t in texts], dtype=object)

    taught = (F.col("r") % 4 != 0) | (total < 8)  # of a language of a few rows all are for the dictionary
    lines = sample.where(taught).select("lang", F.explode(F.pandas_udf(typed, "array<string>")("text")).alias("line"))
    own = lines.groupBy("line").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other")
    upto = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("lang").orderBy("h", "line"))
    drawn = own.select("lang", "line", F.xxhash64("line", F.lit("line")).alias("h")).withColumn("upto", upto).where(F.col("upto") <= dict_bytes).toPandas().sort_values(["h", "line"])
    held = {lang: part["line"].tolist() for lang, part in drawn.groupby("lang")}
    model = Model(tuple(langs), tuple(b" ".join(x.encode() for x in held.get(lang, [])) for lang in langs))
    margins = predict(sample.where(~taught), model).where("language.lang_pred = lang").agg(F.percentile("language.margin", F.lit(rejected_share)).alias("m")).first()["m"]
    return replace(model, min_margin=float(margins or 0.0))


def predict(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float | None = None, out_col: str = "language") -> DataFrame:
    """``docs`` with ``out_col``: a struct of lang_pred, score, margin, rejected.

    A null text, or one without a letter, is ``und`` and rejected; so is a text whose margin is
    below ``min_margin`` (by default the model's own), and one that two languages fit equally.  Only the text is read; every text
    is encoded whole.  An existing column ``out_col`` is replaced.
    """
    least = model.min_margin if min_margin is None else min_margin

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for texts in batches:
            found = [classify(t, model, compressors) for t in texts]
            margin = np.array([m for _, _, m in found], dtype=float)
            lang = [x for x, _, _ in found]
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": np.array([s for _, s, _ in found], dtype=float), "margin": margin, "rejected": (margin < least) | (margin == 0) | (np.array(lang, dtype=object) == UNKNOWN)})

    fn = F.pandas_udf(typed, "lang_pred string, score double, margin double, rejected boolean")
    return docs.withColumn(out_col, fn(F.coalesce(F.col(text_col), F.lit(""))))
