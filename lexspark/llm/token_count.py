"""Token counts of a unigram tokenizer without making its tokens.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character;
dynamic programming keeps, for each position, the best score and the number of tokens on the best
path.  Ties follow the tokenizer: of equal scores the piece that starts earlier (the longer one)
stays, and an unknown character, which scores ten below the worst piece, never replaces an equal score.  Unknown
characters fall back to their UTF-8 bytes, one token each.

Spaces become U+2581 and one is put in front of a text that is not empty.  A cut is certain before a run of U+2581 when no piece has
one after another character, and around a character that is in no piece; segments between certain cuts are
counted one by one and remembered, up to a bound, for the life of a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces: those stand for no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(len(m)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], most: int = 1_000_000, longest: int = 64):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min([0.0, *(s for _, s in pieces)] if not pieces else [s for _, s in pieces]) - PENALTY
        chars = set("".join(p for p, _ in pieces))
        spaced = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        line = "" if "\n" in chars else "\n"
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else "")) if spaced else None
        self.known: dict[str, int] = {}
        self.most, self.longest = most, longest

    def segment(self, text: str) -> int:
        """Tokens on the best path through ``text``."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list] = [[] for _ in range(n)] if len(self.automaton) else []
        if ends:
            for end, hit in self.automaton.iter(text):
                ends[end].append(hit)
        for i in range(1, n + 1):
            top, tokens, single = None, 0, False
            for size, score in ends[i - 1] if ends else ():  # longest first
                s = best[i - size] + score
                if top is None or s > top:
                    top, tokens = s, count[i - size] + 1
                single |= size == 1
            if not single:
                s = best[i - 1] + self.unknown
                if top is None or s > top:
                    top, tokens = s, count[i - 1] + len(text[i - 1].encode("utf-8", "surrogatepass"))
            best[i], count[i] = top, tokens
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty have none."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.cut is None:
            return self.segment(text)
        total, known = 0, self.known
        for s in self.cut.findall(text):
            n = known.get(s)
            if n is None:
                n = self.segment(s)
                if len(s) <= self.longest and len(known) < self.most:
                    known[s] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``: the number of tokens of every whole text (null and empty: 0).

    ``path`` is the vocabulary file on the executors.  An existing column ``n_tokens`` is replaced.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    return docs.withColumn("n_tokens", F.pandas_udf(typed, "long")(F.coalesce(F.col(text_col), F.lit(""))))
