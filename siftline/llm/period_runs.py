"""All runs (maximal repetitions) of a word sequence in linear time, without suffix structures or hashes.

Words are only compared for order. Every run has a Lyndon root that is the longest Lyndon
word at its place under the order of words or under the reversed order, so both Lyndon
arrays, with how far each root's start and end agree to the right and to the left, give all
runs (``runs``).

``lyndon`` walks from left to right. At each place it goes up the chain of previous smaller
suffixes and stores, for every pair that it ever compares, how long the pair agrees. A new
pair learns its agreement from those stored before:
- from the chain: if the last pair agreed for ``a`` symbols and its link up for ``b``,
  unequal ``a`` and ``b`` give the smaller of them;
- from the match that reaches furthest right: a pair inside it agrees as its image at the
  match's first place does, as far as the match goes.
Symbols are compared one by one only where both say nothing, which is past the furthest
symbol seen. ``left_matches`` does the same from right to left for the agreement to the left
of a root's start and end. Tests count the comparisons.

The operators: ``mark`` adds the runs of each text as spans, ``collapse`` keeps the first
period of each run, ``report`` is the query's digest. A text is one row of one task.

Defined results: null text is empty and has no runs; a null id leaves the words of
``report`` as they are; repeated rows repeat their result; an empty table gives no rows;
texts are read whole, at about 150 bytes of memory a word; of columns that clash with the
added ones the operators speak in an error, ``report`` reads doc_id and text alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12
Run = tuple[int, int, int]


class _End:
    """Beyond the first word: smaller than every word in either order, equal to none."""

    __lt__ = __gt__ = lambda self, other: False


def lyndon(x: list, up: bool) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix (len(x) if none), and how many words both have in common.

    ``up`` takes the order of the words, else the reversed one; a suffix that ends first is
    smaller in both. x[i:nss[i]] is the longest Lyndon word at i.
    """
    n = len(x)
    x = [*x, _End()]  # x[-1], where the chains end
    nss, pss, right, above = [n] * n, [-1] * n, [0] * n, [0] * n
    from_l = from_r = reach = 0  # the match that goes furthest: from_l and from_r agree until reach
    for r in range(1, n):
        word, left, last, a = x[r], r - 1, -1, 0
        while True:
            if up:
                while x[left] > word:
                    nss[left] = r
                    last, left, a = left, pss[left], 0
            else:
                while x[left] < word:
                    nss[left] = r
                    last, left, a = left, pss[left], 0
            if left < 0 or x[left] != word:
                pss[r] = left
                break
            known, m = False, 1
            if last >= 0:
                b = above[last]
                known, m = a != b, max(1, min(a, b))
            if not known and r < reach:
                shift, far = from_r - from_l, reach - r
                image, to = (left - shift if left >= from_r else left), r - shift
                agreed = right[image] if nss[image] == to else above[to] if pss[to] == image else -1
                if agreed >= 0:
                    known, m = agreed != far, max(m, min(agreed, far))
            if not known:
                while r + m < n and x[left + m] == x[r + m]:
                    m += 1
            if r + m > reach:
                from_l, from_r, reach = left, r, r + m
            if r + m < n and (x[left + m] < x[r + m]) == up:
                pss[r], above[r] = left, m
                break
            nss[left], right[left] = r, m
            last, left, a = left, pss[left], m
    return nss, right


def left_matches(x: list, nss: list[int], right: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, its next smaller suffix, words in common to the left of both), where the latter can matter for a run."""
    n = len(x)
    back = [0] * n
    from_l = from_r = reach = n  # the match that goes furthest left
    for i in range(n - 1, -1, -1):
        r = nss[i]
        if r == n:
            continue
        if i == 0 or x[i - 1] != x[r - 1]:
            if right[i] >= r - i:
                yield i, r, 0
            continue
        period = r - i
        if right[i] >= period and nss[r] == r + period and back[r] >= period:
            m = back[r] - period  # the root stands again at r
        else:
            known, m = False, 1
            if i > reach and r <= from_l:
                shift, far = from_r - from_l, i - reach
                if nss[i + shift] == r + shift:
                    agreed = back[i + shift]
                    known, m = agreed != far, max(1, min(agreed, far))
            if not known:
                while m < i and x[i - 1 - m] == x[r - 1 - m]:
                    m += 1
        back[i] = m
        if i - m < reach:
            from_l, from_r, reach = i, r, i - m
        if m < period <= m + right[i]:
            yield i, r, m


def runs(x: list, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` symbols and two periods, by start, then period."""
    found: set[Run] = set()
    for up in (True, False):
        nss, right = lyndon(x, up)
        for i, r, m in left_matches(x, nss, right):
            length = r + right[i] - (i - m)
            if length >= least:
                found.add((i - m, length, r - i))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept(n: int, found: list[Run]) -> list[tuple[int, int]]:
    """[from, to) of the places that no run holds after its first period."""
    out, at = [], 0
    for start, end in sorted((s + q, s + length) for s, length, q in found):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    if at < n:
        out.append((at, n))
    return out


def longest(found: list[Run]) -> Run | None:
    return min(found, key=lambda run: (-run[1], run[0], run[2]), default=None)


def mark(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with ``runs``: array of (start, length, period, first_char, end_char), of each text; words count from 0, characters too."""

    def make() -> Callable:
        def of(value: str | None) -> list[tuple]:
            words, spans = [], []
            for hit in WORD.finditer(value or ""):
                words.append(hit.group())
                spans.append(hit.span())
            return [(s, n, q, spans[s][0], spans[s + n - 1][1]) for s, n, q in runs(words, least)]

        return of

    return _with(df, text, "runs", "array<struct<start:long,length:long,period:long,first_char:long,end_char:long>>", make)


def collapse(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with ``collapsed``: the words of each text that no run holds after its first period, joined by one space."""

    def make() -> Callable:
        def of(value: str | None) -> str:
            words = WORD.findall(value or "")
            return " ".join(w for a, b in kept(len(words), runs(words, least)) for w in words[a:b])

        return of

    return _with(df, text, "collapsed", "string", make)


def _with(df: DataFrame, text: str, name: str, kind: str, make: Callable[[], Callable]) -> DataFrame:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name} already")

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = make()
        for values in batches:
            yield pd.Series([of(v) for v in values], dtype=object)

    return df.withColumn(name, F.pandas_udf(apply, kind)(F.col(text)))


def repeated_words(doc_id: int | None, words: list[str]) -> list[str]:
    """The words that ``report`` looks at: in one document of ten the words from a place chosen by the id repeat with a period chosen by it."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + period] * ((n - a) // period + 1))[: n - a]]


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(documents: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest run, and digests of all runs and of the collapsed text."""

    def make() -> Callable:
        def of(doc_id: int | None, text: str | None) -> list[tuple]:
            words = repeated_words(doc_id, WORD.findall(text or ""))
            found = runs(words)
            top = longest(found)
            best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            left = " ".join(w for a, b in kept(len(words), found) for w in words[a:b])
            return [(doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())]

        return of

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, REPORT, out_rows=5_000)
