"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that stands inside no vocabulary token can never be joined by a merge, so a cut
between the two is certain.  For a vocabulary whose words are split at white space this holds for
every pair that starts with a white-space byte; :func:`certain_left_bytes` reads that off the
vocabulary file rather than assuming it.  Only cuts after such an ASCII byte and before a
byte that is not white space are used: normalisation (composition, lower case, collapse of white
space) and the pre-tokeniser's pattern never reach across them.

A text is cut at certain places into fragments of at least ``least`` characters (longer where no cut is
certain), the fragments are encoded one by one, and the ids are concatenated.  :class:`Encoder`
cuts at every certain place; its fragments repeat a lot, so it encodes each new one once and
remembers up to a bounded number of short ones.  A word is cut too, between letters whose pair of bytes is in no token; what stands
before such a cut is encoded without the mark of a word's end.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = b" \t\n\r\x0b\x0c"
FRAGMENT = 16384
#: Fragments that a worker remembers, and characters that it encodes together, where it returns ids and texts.  Workers stay when their task ends, more of them than an
#: executor has cores, and each keeps what it remembers.
REMEMBERED = 1 << 16
TOGETHER = 1 << 18


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def inner_pairs(vocab, suffix: str) -> set[tuple[int, int]]:
    """All pairs of neighbouring bytes inside any token."""
    to_byte, pairs = byte_of_char(), set()
    for token in vocab:
        body = [to_byte[c] for c in token.removesuffix(suffix) if c in to_byte] if suffix else [to_byte[c] for c in token if c in to_byte]
        pairs.update(zip(body, body[1:]))
    return pairs


def certain_left_bytes(path: str) -> bytes:
    """White-space bytes that begin no pair inside any token."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    lefts = {a for a, _ in inner_pairs(model["vocab"], model.get("end_of_word_suffix") or "")}
    return bytes(b for b in BLANK if b not in lefts)


#: Letters and digits of the Latin script, and ASCII marks.  Not U+0130: its lower case ends in a combining mark.
LATIN = "0-9A-Za-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u012F\\u0131-\\u024F"
MARKS = "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~-"


def mark_cuts(path: str) -> str:
    """Marks that are in no token together with a Latin letter or digit: a cut between the two is certain where the pre-tokeniser parts words from marks too.

    Empty if the vocabulary's pre-tokeniser does not.  The apostrophe is never among them.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    pre = json.dumps(whole.get("pre_tokenizer") or {})
    if "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" not in pre:
        return ""
    to_byte, suffix = byte_of_char(), whole["model"].get("end_of_word_suffix") or ""
    tokens = [bytes(to_byte[c] for c in t.removesuffix(suffix) if c in to_byte).decode("utf-8", "ignore") for t in whole["model"]["vocab"]]
    met = re.compile(f"[{LATIN}]([{re.escape(MARKS)}])|([{re.escape(MARKS)}])[{LATIN}]")
    seen = {g for t in tokens for m in met.finditer(t) for g in m.groups() if g}
    return "".join(c for c in MARKS if c not in seen)


#: Letters of the Latin script that lower case and composition leave as they are.
LOWER = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
#: Words of such letters, in either case: one run of letters for any pre-tokeniser, before and after normalisation.
PLAIN_WORD = re.compile("[" + "".join(c + (c.upper() if len(c.upper()) == 1 and c.upper().lower() == c else "") for c in LOWER) + "]+")


def letter_cuts(path: str) -> re.Pattern | None:
    """Places inside a word where a cut is certain: between two letters whose bytes on either side stand in no token together.

    Only where the vocabulary's pre-tokeniser keeps runs of letters whole; only letters of :data:`LOWER`, in either case.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    if "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" not in json.dumps(whole.get("pre_tokenizer") or {}):
        return None
    pairs = inner_pairs(whole["model"]["vocab"], whole["model"].get("end_of_word_suffix") or "")
    rules = []
    for left in LOWER:
        right = [c for c in LOWER if (left.encode()[-1], c.encode()[0]) not in pairs]
        if right:
            both = lambda cs: "".join({x for c in cs for x in (c, c.upper()) if len(x) == 1 and x.lower() == c})
            rules.append(f"(?<=[{both([left])}])(?=[{both(right)}])")
    return re.compile("|".join(rules)) if rules else None


@lru_cache(maxsize=4)
def _inner(path: str):
    """The same tokeniser without the mark of a word's end: for what stands before a cut inside a word."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    whole["model"]["end_of_word_suffix"] = None
    whole["post_processor"] = None
    tok = Tokenizer.from_str(json.dumps(whole))
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def _loaded(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    left = certain_left_bytes(path).decode("ascii")
    cut = re.compile(f"[{re.escape(left)}](?=[^\\s\\x00-\\x20\\x1c-\\x1f])") if left else None
    return tok, cut


def fragments(text: str, cut: re.Pattern | None, least: int = FRAGMENT) -> Iterator[str]:
    """The text in order, cut only where it is certain; the pieces concatenate to the text."""
    at = 0
    while cut is not None and len(text) - at > least:
        m = cut.search(text, at + least)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(text: str, path: str, least: int = FRAGMENT) -> list[int]:
    tok, cut = _loaded(path)
    parts = list(fragments(text, cut, least))
    return [i for e in tok.encode_batch_fast(parts, add_special_tokens=False) for i in e.ids]


def decode(ids: list[int], path: str) -> str:
    return _loaded(path)[0].decode(ids, skip_special_tokens=False)


class Encoder:
    """Encodes texts fragment by fragment, cut at every certain place."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 48):
        self.tok, cut = _loaded(path)
        left = certain_left_bytes(path).decode("ascii")
        self.fragment = re.compile(f"[^{re.escape(left)}]+") if left else None
        marks = re.escape(mark_cuts(path))
        # a cut between a Latin letter or digit and such a mark, in either order
        self.inner = re.compile(f"(?<=[{LATIN}])(?=[{marks}])|(?<=[{marks}])(?=[{LATIN}])") if marks else None
        self.letters = letter_cuts(path)
        self.before = _inner(path) if self.letters else None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.number = list(range(self.tok.get_vocab_size(True)))  # one object an id, shared by all that is remembered
        self.known: dict[str, tuple[int, ...]] = {}
        self.most, self.longest = most, longest

    def cut(self, text: str) -> list[str]:
        parts = self.fragment.findall(text)
        if self.inner is None or any(x in text for x in self.special):  # a special token is found before any cut
            return parts
        out = []
        for p in parts:
            if p.isalnum():
                out.append(p)
            else:
                out += self.inner.split(p)
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text in order.  White space that a cut leaves behind has no ids, as in the whole text."""
        if self.fragment is None:
            yield from (e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False))
            return
        parts = [self.cut(t) for t in texts]
        number = self.number
        new = list({f for p in parts for f in p if f not in self.known})
        cuts = [self.letters.split(f) if self.letters and PLAIN_WORD.fullmatch(f) else [f] for f in new]
        last = self.tok.encode_batch_fast([c[-1] for c in cuts], add_special_tokens=False)
        head = iter(self.before.encode_batch_fast([x for c in cuts for x in c[:-1]], add_special_tokens=False) if self.letters else ())
        found = {f: tuple([number[i] for e in (*islice(head, len(c) - 1), z) for i in e.ids]) for f, c, z in zip(new, cuts, last)}
        room = self.most - len(self.known)
        self.known.update([x for x in found.items() if len(x[0]) <= self.longest][: max(0, room)])
        known = self.known
        for p in parts:
            yield [i for f in p for i in (known[f] if f in known else found[f])]


@lru_cache(maxsize=2)
def _encoder(path: str, most: int = 400_000) -> Encoder:
    return Encoder(path, most)


def _groups(texts, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters together."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def _ids_rows(path: str, text_col: str, rows: int = 64):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):  # ids and text of a few rows at a time
                part = batch.slice(k, rows)
                ids = [x for g in _groups(part.column(text_col).to_pylist(), TOGETHER) for x in _encoder(path, REMEMBERED).encode(g)]
                made = pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, path) for x in ids], pa.string())], ["ids", "decoded"])
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "bpe"])

    return run


def _digest_batches(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [str(i) for i in range(_loaded(path)[0].get_vocab_size(True))]
        for texts in batches:
            n, a, b = [], [], []
            for ids in (x for g in _groups(texts) for x in _encoder(path).encode(g)):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(decode(ids, path).encode()).hexdigest())
            yield pd.DataFrame({"n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": a, "decoded_sha256": b})

    return run


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``bpe``: a struct of ``ids`` and ``decoded``.

    A null or empty text has no ids and decodes to the empty string.  Every text is encoded whole.
    ``path`` is the tokenizer file on the executors.  An existing column ``bpe`` is replaced.  A worker remembers at most
    :data:`REMEMBERED` fragments; what it doesn't remember is encoded anew, with the same ids.
    """
    rest = docs.drop("bpe")
    made = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    schema = T.StructType([*rest.schema.fields, T.StructField("bpe", made)])
    return rest.mapInArrow(_ids_rows(path, text_col), schema)


def bpe_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``bpe``: n_tokens and the digests of ids and decoded text, made where the ids are, so that neither leaves its task."""
    fn = _iter_udf(_digest_batches(path), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.withColumn("bpe", fn(F.coalesce(F.col(text_col), F.lit(""))))


def _iter_udf(run, schema: str):
    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(batches)

    return F.pandas_udf(typed, schema)
