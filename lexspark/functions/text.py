"""Column functions on headings, numbers and names.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{3000}]"
#: The same characters as a string.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u3000"
#: Titles that are headings without a mark.  Fixed values.
BARE_TITLES = ("目次", "目录", "前言", "引言", "参考文献", "索引")
#: Scope keys in canonical order.  Fixed values.
SCOPES = ("cover", "toc", "foreword", "introduction", "scope", "normative_references", "terms_definitions", "symbols_abbreviations", "other_body", "appendix", "references", "index", "end")
BODY_SCOPES = ("scope", "normative_references", "terms_definitions", "symbols_abbreviations", "other_body")
END_SCOPES = ("appendix", "index", "references")
#: Sections that end the contents.  Fixed values.
OPENERS = ("foreword", "introduction", "scope", "normative_references", "terms_definitions", "symbols_abbreviations", "appendix", "index", "references")
#: Heading keywords in order of precedence: (scope, whether the keyword must start the key, keyword).  Fixed values.
HEADING_RULES = (
    ("foreword", True, "前言"),
    ("introduction", True, "引言"),
    ("normative_references", False, "规范性引用文件"),
    ("terms_definitions", False, "术语和定义"),
    ("symbols_abbreviations", False, "缩略语"),
    ("scope", True, "范围"),
    ("appendix", True, "附录"),
    ("index", True, "索引"),
    ("references", False, "参考文献"),
)
#: Fixed values.
SEVERITIES = {"critical": "critical", "major": "major", "minor": "minor", "info": "info", "致命": "critical", "严重": "critical", "重度": "critical", "中度": "major", "轻度": "minor", "提示": "info", "warn": "minor"}
STATUSES = {"pass": "pass", "fail": "fail", "warn": "warn", "insufficient_context": "insufficient_context", "llm_error": "fail", "not_ready": "insufficient_context", "info": "warn"}
MIME_TYPES = {"md": "text/markdown", "json": "application/json", "jsonl": "application/x-ndjson", "txt": "text/plain", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "png": "image/png", "jpg": "image/jpeg"}


#: What a heading key leaves out.  Fixed values: keys must equal on both sides of every comparison.
KEY_MARKS = r"：:，,。；;（）()\[\]【】《》\-—"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def heading_key(c: Column) -> Column:
    """A heading without marks, white space and punctuation, in one pass."""
    return F.regexp_replace(c, f"^{BLANK}*[#\\x09-\\x0D\\x20]*|[{BLANK[1:-1]}{KEY_MARKS}]+", "")


def heading_content(line: Column) -> Column:
    """Text of a Markdown heading or of a bare title, else empty."""
    return bound(strip(line), _heading_of)


def _heading_of(held: Column) -> Column:
    return F.when(held.startswith("#"), strip(F.regexp_extract(held, r"^#{1,6}[\x09-\x0D\x20]*(.+)$", 1))).when(held.isin(*BARE_TITLES), held).otherwise(F.lit(""))


def _scope_of(key: Column) -> Column:
    """Scope of a heading key without its number, or null."""
    found = F.lit(None).cast("string")
    for scope, at_start, word in reversed(HEADING_RULES):
        found = F.when(key.startswith(word) if at_start else key.contains(word), scope).otherwise(found)
    return found


def _unnumbered(key: Column) -> Column:
    return F.regexp_replace(key, r"^[0-9]+(?:\.[0-9]+)*", "")


def classify(heading: Column) -> Column:
    """Scope of a heading, or null."""
    return bound(_unnumbered(heading_key(heading)), _scope_of)


def is_toc_title(heading: Column) -> Column:
    return heading_key(heading).rlike("^(目次|目录)")


def is_toc_entry(c: Column) -> Column:
    """Ends in a page number, roman or arabic, after white space."""
    return c.rlike(f"(?i)[^{BLANK[1:-1]}]{BLANK}+(?:[IVXLCM]+|[0-9]+){BLANK}*$")


def is_numbered(c: Column) -> Column:
    return c.rlike(r"^[0-9]+(?:\.[0-9]+)*[\x09-\x0D\x20]+.+$")


def line_marks(line: Column) -> Column:
    """What the segmentation asks of a line, each part computed once.

    ``held`` without white space at its ends, ``head`` (text of a heading), ``kind`` (its scope), ``toc_title``, ``code``
    (T contents, Q running text in a heading, H heading, P running text, N other, blank for a blank line), ``opens`` (a
    heading that can end the contents), ``plain`` (a line that can begin a body without contents), ``cut`` (opens a section).
    """

    def with_kind(held: Column, last: Column, head: Column, key: Column, kind: Column) -> Column:
        marked, stop = head != "", last.isin(*"。！？；;：:")
        prose = stop | (F.length(held) >= 30)
        toc_title, numbered = marked & key.rlike("^(目次|目录)"), key.rlike("^[0-9]")
        # a heading ends as its line does, and only a line that ends in a digit or a roman numeral can be a contents row
        entry = last.rlike("(?i)[IVXLCM0-9]") & F.when(marked, is_toc_entry(head)).otherwise(is_toc_entry(held))
        toc_like = entry | (last.rlike("(?i)[IVXLCM0-9]") & held.rlike(r"(?i)\.{3,}[\x09-\x0D\x20]*(?:[0-9]+|[IVXLCM]+)$"))
        title = marked & (kind.isNotNull() | numbered)
        code = F.when(toc_title | toc_like, "T").when(title & prose, "Q").when(title, "H").when(prose, "P").otherwise("N")
        return F.struct(
            held.alias("held"),
            head.alias("head"),
            kind.alias("kind"),
            toc_title.alias("toc_title"),
            code.alias("code"),
            (marked & ~toc_title & F.coalesce(kind.isin(*OPENERS), F.lit(False)) & ~entry).alias("opens"),
            F.when(marked, ~toc_title & kind.isNotNull()).otherwise(is_numbered(held) & ~entry).alias("plain"),
            F.when(marked, kind.isNotNull() | numbered | ~stop).otherwise(is_numbered(held)).alias("cut"),
        )

    no, none = F.lit(False), F.lit(None).cast("string")
    blank = F.struct(F.lit("").alias("held"), F.lit("").alias("head"), none.alias("kind"), no.alias("toc_title"), F.lit(" ").alias("code"), no.alias("opens"), no.alias("plain"), no.alias("cut"))
    of_head = lambda held, last, head: bound(heading_key(head), lambda key: bound(F.when(head != "", _scope_of(_unnumbered(key))), lambda kind: with_kind(held, last, head, key, kind)))
    of_line = lambda held: bound(F.right(held, F.lit(1)), lambda last: bound(_heading_of(held), lambda head: of_head(held, last, head)))
    return bound(strip(line), lambda held: F.when(held == "", blank).otherwise(of_line(held)))


def strip_page(c: Column) -> Column:
    """A contents row without its leader and page."""
    dotless = strip(F.regexp_replace(c, r"(?i)\.{3,}[\x09-\x0D\x20]*(?:[0-9]+|[IVXLCM]+)[\x09-\x0D\x20]*$", ""))
    return strip(F.regexp_replace(dotless, r"(?i)[\x09-\x0D\x20]+(?:[0-9]+|[IVXLCM]+)[\x09-\x0D\x20]*$", ""))


def roman_or_int(c: Column) -> Column:
    """Value of a roman or arabic number; null if it is neither or zero in roman."""
    value = F.create_map(*[F.lit(x) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in p])
    held = F.upper(strip(c))
    digits = F.transform(F.reverse(F.split(held, "")), lambda ch: value[ch])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda s, v: F.when(v < s["last"], F.struct((s["total"] - v).alias("total"), s["last"].alias("last"))).otherwise(F.struct((s["total"] + v).alias("total"), v.alias("last")))
    roman = F.aggregate(digits, start, step)["total"]
    return F.when(held.rlike("^[0-9]+$"), held.try_cast("int")).when(held.rlike("^[IVXLCDM]+$"), roman)


def to_roman(n: Column) -> Column:
    """1 to 3999 in roman numerals, a lookup for each decimal digit."""
    ones = lambda a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c]
    table = [ones("M", "", ""), ones("C", "D", "M"), ones("X", "L", "C"), ones("I", "V", "X")]
    digit = lambda i: (F.floor(n / 10 ** (3 - i)) % 10).cast("int")
    parts = [F.element_at(F.array(*[F.lit(x) for x in table[i]]), digit(i) + 1) for i in range(4)]
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts))


def to_letters(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: base 26 without a zero."""
    state = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).alias("n"), F.concat(F.char(65 + (s["n"] - 1) % 26), s["s"]).alias("s"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), state, step)["s"]


def title_and_page(c: Column) -> tuple[Column, Column]:
    """Title and page of a contents row; no page: the whole row and null."""
    held = squeeze(c)
    spaced, tight = r"(?i)^(.+?) *(?:\.{2,}| )([IVXLCM]+|[0-9]+)$", r"(?i)^(.+?)([IVXLCM]+|[0-9]+)$"
    pick = lambda i, other: F.when(held.rlike(spaced), F.regexp_extract(held, spaced, i)).when(held.rlike(tight), F.regexp_extract(held, tight, i)).otherwise(other)
    return strip(pick(1, held)), roman_or_int(pick(2, F.lit(None)))


def number_and_title(c: Column) -> tuple[Column, Column]:
    held = squeeze(c)
    spaced, tight = r"^([0-9]+(?:\.[0-9]+)*)\.? (.+)$", r"^([0-9]+(?:\.[0-9]+)+)([^0-9].+)$"
    pick = lambda i, other: F.when(held.rlike(spaced), F.regexp_extract(held, spaced, i)).when(held.rlike(tight), F.regexp_extract(held, tight, i)).otherwise(other)
    return pick(1, F.lit("")), strip(pick(2, held))


def match_key(number: Column, title: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"^#+[\x09-\x0D\x20]*", ""), f"{BLANK}+", ""), r"[（）()【】《》\"'：:，,。；;\-—/、]", "")
    return F.when(number == "", bare).otherwise(F.concat_ws("|", F.regexp_replace(number, f"{BLANK}+", ""), bare))


def heading_level(c: Column) -> Column:
    number = F.regexp_extract(c, r"^[\x09-\x0D\x20]*([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def page_refs(field: Column) -> Column:
    return F.regexp_extract_all(field, F.lit(r"(?i)\bPAGEREF[\x09-\x0D\x20]+([^\x09-\x0D\x20\\]+)"), F.lit(1))


def safe_name(c: Column, fallback: str = "artifact") -> Column:
    kept = F.btrim(F.regexp_replace(strip(c), r"[^A-Za-z0-9_.\-\x{4e00}-\x{9fff}]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def file_component(c: Column) -> Column:
    return F.rtrim(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*]', "_")), F.lit(". "))


def is_sensitive(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.startswith(".env") | name.contains("secret") | name.contains("credential") | name.contains("token")


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def nature(number: Column) -> Column:
    """Guide, recommended or mandatory, from a standard's number."""
    code = squeeze(F.upper(F.coalesce(number, F.lit(""))))
    return F.when(code.rlike("^[A-Z]{2}/Z"), "指导性技术文件").when(code.rlike("^[A-Z]{2}/T"), "推荐性").when(code.startswith("GA"), "推荐性").when(code.startswith("GB"), "强制性").otherwise("")


def category(number: Column, hierarchy: Column) -> Column:
    code, level = F.replace(F.upper(number), F.lit(" "), F.lit("")), F.coalesce(hierarchy, F.lit(""))
    return F.when(code.startswith("GB") | level.contains("国家标准"), "国家标准").when(code.rlike("^DB[0-9]{2}") | level.contains("地方标准"), "地方标准").when((code != "") | level.contains("行业标准"), "行业标准").otherwise("其他")


def standard_number(c: Column) -> Column:
    """One form for a number: hyphen before the year, no 'replaces' in front."""
    return strip(F.regexp_replace(F.regexp_replace(c, "[—–－]+", "-"), "^(?:代替|替代)[\\x20]*", ""))


def is_standard_number(c: Column) -> Column:
    return standard_number(c).rlike(r"^[A-Z]{2,4}(?:/[A-Z])? ?[0-9]+(?:\.[0-9]+)*-(?:[0-9]{4}|[0-9]{2})$")


def lookup(values: dict[str, str], c: Column, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for p in values.items() for x in p])
    return F.coalesce(table[strip(c)], F.lit(default))


def severity(c: Column) -> Column:
    return lookup(SEVERITIES, c, "info")


def status(c: Column) -> Column:
    """Public status; a missing one is ``info`` and an unknown one ``warn``."""
    return F.when(c.isNull(), "info").otherwise(lookup(STATUSES, c, "warn"))


def mime_type(name: Column) -> Column:
    return lookup(MIME_TYPES, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), "application/octet-stream")


def backoff(attempt: Column, first: float, most: float, factor: float) -> Column:
    """Upper bound of the wait before an attempt."""
    return F.least(F.lit(first) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def safe_long(c: Column) -> Column:
    """A whole number, or null."""
    return strip(c).try_cast("long")


def safe_double(c: Column) -> Column:
    return strip(c).try_cast("double")


def safe_bool(c: Column) -> Column:
    """True for 1, true, yes, y and on in any case; false for everything else, null included."""
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def truncate_bytes(c: Column, n: int) -> Column:
    """At most n bytes of UTF-8, no character cut in two."""
    head = F.substring(F.encode(c, "UTF-8"), 1, n)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+$", ""))


def front_matter(text: Column) -> Column:
    """What precedes the first heading of chapter 4; everything if there is none or nothing precedes it."""
    mark = r"(?m)^#{1,6}[\x09\x20]*(?:第[\x20]*4[\x20]*章|4(?![0-9.]))"
    at = F.regexp_instr(text, F.lit(mark))
    head = F.substring(text, 1, F.greatest(at - 1, F.lit(0)))
    return F.when((at > 0) & (strip(head) != ""), head).otherwise(text)


#: Words by which a cover's header says what it is.  Fixed values.
ICS_WORD, CCS_WORD, REPLACED_WORDS = "国际标准分类", "中国标准文献分类", ("代替", "替代")
HIERARCHY_WORDS = ("中华人民共和国国家标准", "国家标准化指导性技术文件", "行业标准", "地方标准")


def header_kind(c: Column) -> Column:
    """What a block of a cover's header is: ics, ccs, replaced, hierarchy, number, code, or null.  First that fits, in this order."""
    held = F.upper(squeeze(c))
    tight = F.replace(held, F.lit(" "), F.lit(""))
    number = held.rlike(r"^[A-Z]{1,6}[0-9]{0,3}(?:/[A-Z]{1,8}[0-9]{0,3})? [0-9]+(?:\.[0-9]+)*[—-](?:[0-9]{4}|[0-9]{2})")
    level = F.lit(False)
    for w in HIERARCHY_WORDS:
        level = level | held.contains(w)
    return (
        F.when(held.startswith("ICS") | held.contains(ICS_WORD), "ics")
        .when(held.startswith("CCS") | held.contains(CCS_WORD) | tight.rlike(r"^[A-Z]{1,3}[0-9]{1,3}(?:\.[0-9]+)?$"), "ccs")
        .when(held.contains(REPLACED_WORDS[0]) | held.contains(REPLACED_WORDS[1]), "replaced")
        .when(level, "hierarchy")
        .when(number, "number")
        .when(tight.rlike(r"^[A-Z]{1,6}(?:/[A-Z]{1,6})?$"), "code")
    )
