"""Tokens, terms, excerpts, titles and names as column expressions.

All of this stays in the JVM except Unicode compatibility normalisation, which Spark has no
function for; only values with characters outside ASCII go through it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD = r"[a-z0-9[\p{L}\p{N}]]+"  # the frequent ones are looked for first
CONTROL = r"[\x00-\x1F\x7F-\u009F]"
#: White space of the source language's \s class, which is wider than Java's.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
LINES = r"\r\n|\n|\r"
TERMS = 64
EXCERPT_LINES, EXCERPT_CHARS = 6, 400
CANDIDATE_LINES, CANDIDATE_BYTES = 400, 32 * 1024
INDEX_EXCERPT_CHARS = 1_200
TITLE_CHARS = 256
EMPTY_EXCERPT = "[empty source]"


#: Code points that compatibility normalisation leaves as they are, next to any other of them; a test holds this.
STABLE = (
    (0x00, 0x7F), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x391, 0x3A1), (0x3A3, 0x3CE),
    (0x400, 0x482), (0x48A, 0x52F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023), (0x20AC, 0x20AC), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
    (0x1F300, 0x1F64F),
)
#: The first range is tried alone; most characters need no other.
UNSTABLE = "[^\\x00-\\x7F[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in STABLE[1:]) + "]]"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in v])


def nfkc(text: Column) -> Column:
    """Compatibility-normalised text. Python only sees texts with characters that may change; for others it gets a null."""
    return F.coalesce(_nfkc(F.when(text.rlike(UNSTABLE), text)), text)


def nfkc_each(texts: Column) -> Column:
    """nfkc of every text of a short list, such as a request's."""
    return _nfkc_each(texts)


def tokens(text: Column, normalise: bool = True) -> Column:
    """Lower-cased runs of letters and numbers, in order, with repeats.

    Compatibility forms count as what they stand for. Within a lambda, where Spark has no
    Python functions, the text must be normalised already (normalise=False).
    """
    return F.regexp_extract_all(plain(text, normalise), F.lit(WORD), F.lit(0))


def plain(text: Column, normalise: bool = True) -> Column:
    """Normalised, lower-cased text; a null is empty."""
    return F.lower(F.coalesce(nfkc(text) if normalise else text, F.lit("")))


def term_uses(plain_text: Column, term: str) -> Column:
    """How often a term, a run of letters and numbers, is a whole word of a ``plain`` text; no list of words is made."""
    other = r"[\p{L}\p{N}]"
    return F.regexp_count(plain_text, F.lit(f"{term}(?<!{other}{term})(?!{other})"))


def distinct_terms(text: Column, normalise: bool = True) -> Column:
    """Terms in order of their first use."""
    return F.array_distinct(tokens(text, normalise))


def sorted_terms(text: Column, limit: int = TERMS, normalise: bool = True) -> Column:
    return F.slice(F.array_sort(distinct_terms(text, normalise)), 1, limit)


def term_count(words: Column, term: Column | str) -> Column:
    wanted = F.lit(term) if isinstance(term, str) else term
    return F.size(F.filter(words, lambda w: w == wanted))


def prioritised_terms(groups: list[Column], limit: int = TERMS) -> Column:
    """The first ``limit`` terms of the groups in turn, each in order, returned sorted."""
    joined = F.array_distinct(F.concat(*[F.array_sort(F.array_distinct(g)) for g in groups]))
    return F.array_sort(F.slice(joined, 1, limit))


def lines(text: Column) -> Column:
    return F.split(text, LINES)


def excerpt(text: Column, terms: Column, max_lines: int = EXCERPT_LINES, max_chars: int = EXCERPT_CHARS) -> Column:
    """struct(text, start_line, end_line, truncated): lines around the first that holds a term."""
    source = lines(F.coalesce(text, F.lit("")))
    hit = F.transform(lines(nfkc(F.coalesce(text, F.lit("")))), lambda line: F.arrays_overlap(tokens(line, False), terms))
    anchor = F.greatest(F.array_position(hit, True), F.lit(1))
    start = F.greatest(anchor - 2, F.lit(1)).cast("int")
    end = F.least(start + max_lines - 1, F.size(source)).cast("int")
    body = F.regexp_replace(F.array_join(F.slice(source, start, end - start + 1), "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\u009F]", " ")
    cut = (start > 1) | (end < F.size(source)) | (F.char_length(body) > max_chars)
    shown = F.substring(body, 1, max_chars)
    last = F.least(end, start + F.size(F.split(shown, "\n")) - 1).cast("int")  # the last line that the cut text still shows
    return F.struct(shown.alias("text"), start.alias("start_line"), last.alias("end_line"), cut.alias("truncated"))


def was_bounded(text: Column, max_lines: int = CANDIDATE_LINES, max_bytes: int = CANDIDATE_BYTES) -> Column:
    """Whether a source is longer than a candidate's excerpt may be."""
    clean = _clean(text)
    return (F.octet_length(clean) > max_bytes) | (F.regexp_count(clean, F.lit(LINES)) >= max_lines)


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\u009F]", " "))


#: What Python's str.rstrip removes.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f uses it. Spark has no Python functions within f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cut_bytes(text: Column, limit: int) -> Column:
    """The whole code points among the first ``limit`` bytes, without white space at the end."""
    head = lambda n: F.try_validate_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.rtrim(F.coalesce(*[head(max(limit - k, 0)) for k in range(4)]), F.lit(BLANK))


def bounded_excerpt(text: Column, max_lines: int = CANDIDATE_LINES, max_bytes: int = CANDIDATE_BYTES) -> Column:
    """At most so many lines and bytes of a source; a code point is never split."""
    head = F.substring_index(F.regexp_replace(_clean(F.coalesce(text, F.lit(""))), "\r\n?", "\n"), "\n", max_lines)
    short = _bound(head, lambda h: F.when(F.octet_length(h) > max_bytes, _cut_bytes(h, max_bytes)).otherwise(h))
    return F.coalesce(_bound(short, lambda x: F.when(x != "", x)), F.lit(EMPTY_EXCERPT))


def relevant_excerpt(text: Column, terms: Column, max_lines: int = CANDIDATE_LINES, max_bytes: int = CANDIDATE_BYTES) -> Column:
    """Bounded excerpt around the first line that holds a term as a substring."""
    return bounded_excerpt(surroundings(text, terms, max_lines, max_bytes), max_lines, max_bytes)


def surroundings(text: Column, terms: Column, max_lines: int = CANDIDATE_LINES, max_bytes: int = CANDIDATE_BYTES) -> Column:
    """What lies around the first line that holds a term as a substring, before it is bounded.

    A term has no line break, so its line is told from where it first is in the whole text.
    Values that each term is looked for in are bound; else they are computed for each term.
    """
    first = lambda low: F.array_min(F.transform(terms, lambda t: F.nullif(F.position(t, low), F.lit(0))))
    before = lambda low: F.substring(low, F.lit(1), F.coalesce(first(low), F.lit(1)) - 1)
    anchor = _bound(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.regexp_count(before(low), F.lit(LINES)) + 1)
    window = lambda source: F.array_join(F.slice(source, F.greatest(anchor - max_lines // 3, F.lit(1)).cast("int"), max_lines), "\n")
    chosen = _bound(lines(F.coalesce(text, F.lit(""))), lambda source: F.when(F.size(source) > max_lines, window(source)).otherwise(text))
    chars = max_bytes // 2
    start = lambda c: F.greatest(F.coalesce(_bound(F.lower(c), first), F.lit(1)) - chars // 3, F.lit(1))
    return _bound(chosen, lambda c: F.when(F.octet_length(c) > max_bytes, F.substring(c, start(c), F.lit(chars))).otherwise(c))


def index_excerpt(text: Column, max_chars: int = INDEX_EXCERPT_CHARS) -> Column:
    """struct(text, truncated) of an index hit's excerpt."""
    clean = F.trim(F.regexp_replace(text, CONTROL, " "))
    return F.struct(F.substring(clean, 1, max_chars).alias("text"), (F.char_length(clean) > max_chars).alias("truncated"))


def _one_line(text: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(text, CONTROL, " "), f"{SPACE}+", " ")
    return F.substring(F.regexp_replace(flat, f"^{SPACE}+|{SPACE}+$", ""), 1, TITLE_CHARS)


def title(path: Column, content: Column) -> Column:
    """First level-one heading that is not empty once cleaned, else the file's stem."""
    headings = F.regexp_extract_all(F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿", ""), F.lit(rf"(?m)^#[\t  ]+([^\r\n]*?)[\t  ]*\r?$"), F.lit(1))
    cleaned = F.transform(headings, lambda h: _one_line(F.regexp_replace(h, r"\s+#+\s*$", "")))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.get(F.filter(cleaned, lambda h: h != ""), F.lit(0)), _one_line(stem))


def normal_title(text: Column, normalise: bool = False) -> Column:
    source = nfkc(text) if normalise else text
    return F.regexp_replace(F.regexp_replace(F.lower(source), f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " ")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def module_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9@/_:.-]+", "-")


def truncation(reasons: Column) -> Column:
    """struct(truncated, reasons) of the reasons that apply."""
    found = F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())))
    return F.struct((F.size(found) > 0).alias("truncated"), found.alias("reasons"))
