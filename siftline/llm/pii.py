"""Personal data: fixed patterns, then contextual extraction bootstrapped from what they find.

Everything on the main path is DataFrame expressions. The fixed patterns give base spans
(email, ip, card, phone). These are the seeds. What stands around a span makes its lexical
patterns: the two words before it, the word before with the word after it, and a word that
a colon or equals sign ties to it (``key = "..."``). Punctuation between words
and span does not count, and a span right before is the word ``#``. Candidates are all other
tokens of letters, digits and ``._%+@:/-`` with ``CANDIDATE_LENGTH`` characters and
``CANDIDATE_DIGITS`` digits or more, or that long and led by ``@``; identifiers of letters
alone are not looked for.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence is the
mean score of its distinct instances; seeds score 1. A pattern is trusted if its confidence
reaches ``MIN_CONFIDENCE`` and its instances' scores sum to ``MIN_SEEDS``, and only trusted
patterns vote: an instance that is no seed scores the noisy-or of their confidences, else 0.
So the first round trusts patterns on seeds alone, later rounds also on what trusted ones
found, and no pattern raises itself over the threshold. Candidates behind a pattern that is
trusted in the end are added as spans of kind ``context``.

Defined results: null text is empty; a null id is kept; repeated rows are each reported;
spans are code points, end exclusive. Time and memory are nearly in proportion to a text's
length, whatever the number of its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .rows import bound, free_name, in_blocks, running

#: Fixed by contract. A match can only begin where a run of its first class begins or
#: where the match before it ended, which keeps the search linear in long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")
CANDIDATE = r"(?<![A-Za-z0-9._%+@:/-])(?=@[A-Za-z]|[A-Za-z._%+@:/-]*+[0-9])[A-Za-z0-9._%+@:/-]*[A-Za-z0-9]"
CANDIDATE_DIGITS, CANDIDATE_LENGTH = 4, 6
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
ROUNDS = 3

WORD, BETWEEN = r"(#|[\p{L}\p{M}\p{N}_]++)", r"[^\p{L}\p{M}\p{N}_#]*+"
SPAN = "struct<start:int,rank:int,end:int,match:string,patterns:array<string>>"
PLACE = "struct<start:int,rank:int,end:int>"
GROUP = 512


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _parts_small(match: Column) -> Column:
    short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _n_digits(match: Column, least: int, most: int) -> Column:
    return F.length(_digits(match)).between(least, most)


def _patterns(before: Column, follows: Column, after: Column) -> Column:
    """Lexical patterns of a span between two stretches of text; follows: whether another span ends where before begins."""
    last, then = F.reverse(F.concat(F.when(follows, "#").otherwise(""), F.lower(before))), F.regexp_extract(F.lower(after), f"^{BETWEEN}{WORD}", 1)
    lexical = lambda *words: F.concat(*words).rlike(r"\p{L}") & F.forall(F.array(*words), lambda w: F.length(w) > 0)

    def made(x: Column) -> Column:
        near, far = (F.reverse(F.regexp_extract(x["last"], f"^{BETWEEN}{WORD}(?:{BETWEEN}{WORD})?", k)) for k in (1, 2))
        tied = F.reverse(F.regexp_extract(x["last"], rf"^[^\p{{L}}\p{{M}}\p{{N}}_#:=]*+[:=]{BETWEEN}{WORD}", 1))
        return F.array(
            F.when(lexical(near, far), F.concat(far, F.lit(" "), near, F.lit(" _"))),
            F.when(lexical(near, x["then"]), F.concat(near, F.lit(" _ "), x["then"])),
            F.when(lexical(tied), F.concat(tied, F.lit(": _"))),
        )

    return F.filter(bound(F.struct(last.alias("last"), then.alias("then")), made), lambda p: p.isNotNull())


def spans(text: Column, pattern: str, rank: int, valid, maybe: Column) -> Column:
    """Array of spans of the pattern's matches that are valid, leftmost and non-overlapping.

    Lengths of the matches and of the pieces between them give the places. maybe: a cheap
    condition that every text with a match meets.
    """
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def found(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b, F.lit(0))
        places = F.zip_with(ends, F.transform(p, lambda x, i: F.struct(x["m"].alias("m"), i.alias("i"))), lambda end, x: F.struct(end.alias("end"), x["m"].alias("m"), x["i"].alias("i")))
        good = F.filter(places, lambda o: o["m"].isNotNull() & valid(o["m"]))
        around = lambda i: _patterns(F.get(p, i)["gap"], i > 0, F.get(p, i + 1)["gap"])
        return F.transform(good, lambda o: F.struct((o["end"] - F.length(o["m"])).alias("start"), F.lit(rank).alias("rank"), o["end"].alias("end"), o["m"].alias("match"), around(o["i"]).alias("patterns")))

    return F.when(maybe, bound(parts, found)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans of a text, in order of start and kind."""
    digits = text.rlike("[0-9]")
    return F.array_sort(
        F.concat(
            spans(text, EMAIL, 0, lambda m: F.lit(True), F.contains(text, F.lit("@"))),
            spans(text, IP, 1, _parts_small, digits & text.rlike(r"[0-9]\.[0-9]")),
            spans(text, CARD, 2, lambda m: _n_digits(m, 12, 19) & luhn(_digits(m)), digits),
            spans(text, PHONE, 3, lambda m: _n_digits(m, 9, 15), F.contains(text, F.lit("+"))),
        )
    )


def reaches(found: Column) -> Column:
    """For spans in order of start, the greatest end of each and all before it."""
    return running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))


def _below(sorted_starts: Column, bound_at: Column) -> Column:
    """How many of some sorted numbers are less than a bound, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_starts) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = (acc["low"] < acc["high"]) & (F.get(sorted_starts, middle) < bound_at)
        return F.struct(F.when(less, middle + 1).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(sorted_starts).alias("high")), halve, lambda acc: acc["low"])


def clear_of(base: Column, other: Column) -> Column:
    """The spans of other that overlap none of base (in order of start): the bases that start before its end all end before its start."""
    known = F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), reaches(base).alias("reach"))
    free = lambda k, c: F.coalesce(F.get(k["reach"], _below(k["starts"], c["end"]) - 1) <= c["start"], F.lit(True))
    return bound(known, lambda k: F.filter(other, lambda c: free(k, c)))


def scan(documents: DataFrame) -> DataFrame:
    """k_id, k_text (hash), base spans and candidate spans of every row; the text is read once and not kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    shaped = lambda m: (F.length(m) >= CANDIDATE_LENGTH) & ((F.length(_digits(m)) >= CANDIDATE_DIGITS) | F.startswith(m, F.lit("@")))
    other = spans(F.col("text"), CANDIDATE, len(KINDS) - 1, shaped, F.col("text").rlike("[0-9]|@[A-Za-z]"))
    return rows.withColumn("other", other).select("k_id", "k_text", "base", F.when(F.size("base") > 0, clear_of(F.col("base"), F.col("other"))).otherwise(F.col("other")).alias("other"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pattern, support and confidence of the trusted patterns after some rounds over edges of pattern, instance, seed (boolean)."""
    graph = cut(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    score = F.when(F.col("seed"), 1.0).otherwise(0.0)
    for k in range(rounds):
        patterns = graph.withColumn("score", score).groupBy("pattern").agg(F.sum("score").alias("support"), F.avg("score").alias("confidence"))
        trusted = patterns.where((F.col("support") >= min_seeds) & (F.col("confidence") >= min_confidence))
        if k == rounds - 1:
            return trusted
        doubts = trusted.select("pattern", F.log1p(-F.least("confidence", F.lit(0.999999))).alias("doubt"))
        instances = graph.where("NOT seed").join(doubts, "pattern").groupBy("instance").agg((1 - F.exp(F.sum("doubt"))).alias("belief"))
        graph = cut(graph.drop("belief").join(instances, "instance", "left"))
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0)))
    raise ValueError("rounds must be positive")


def find(documents: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """k_id, k_text, base, spans (base and discovered, in order of start and kind) for every row; a span is start, rank (of KINDS), end."""
    scanned = cut(scan(documents))

    def seen(spans_column: str, seed: bool) -> DataFrame:
        one = scanned.select("k_id", "k_text", F.explode(spans_column).alias("s"))
        return one.select("k_id", "k_text", "s", F.explode("s.patterns").alias("pattern"), F.col("s.match").alias("instance"), F.lit(seed).alias("seed"))

    candidates = seen("other", False)
    edges = seen("base", True).select("pattern", "instance", "seed").unionByName(candidates.select("pattern", "instance", "seed"))
    good = score_patterns(edges, rounds, min_seeds, min_confidence).select("pattern")
    more = candidates.join(good, "pattern", "left_semi").groupBy(F.col("k_id").alias("m_id"), F.col("k_text").alias("m_text")).agg(F.collect_set(F.struct("s.start", "s.rank", "s.end").cast(PLACE)).alias("more"))
    both = scanned.join(more, F.col("k_id").eqNullSafe(F.col("m_id")) & (F.col("k_text") == F.col("m_text")), "left")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["rank"], s["end"]).cast(PLACE))
    return both.select("k_id", "k_text", bare("base").alias("base"), F.array_sort(F.concat(bare("base"), F.coalesce("more", F.array().cast(f"array<{PLACE}>")))).alias("spans"))


def _listed(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def _count(column: str, rank: int) -> Column:
    return F.size(F.filter(column, lambda s: s["rank"] == rank)).cast("long")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, a count of each base kind, base_sha256 and all spans for every row."""
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:-1])]
    return find(documents).select(F.col("k_id").alias("doc_id"), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def stretches(found: Column) -> Column:
    """The maximal stretches that spans in order of start cover: where the one before ends, start, end, and the kind of the first span."""

    def of(reach: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        placed = F.transform(found, lambda s, i: F.struct(before(i).alias("after"), s["start"].alias("start"), s["rank"].alias("rank"), i.alias("i")))
        heads = F.filter(placed, lambda s: (s["i"] == 0) | (s["start"] >= s["after"]))
        end = lambda h, n: F.get(reach, F.coalesce(F.get(h, n + 1)["i"], F.size(reach)) - 1)
        return bound(heads, lambda h: F.transform(h, lambda s, n: F.struct(s["after"].alias("after"), s["start"].alias("start"), end(h, n).alias("end"), s["rank"].alias("rank"))))

    return bound(reaches(found), of)


def masked(text: Column, found: Column) -> Column:
    """The text with its spans replaced by their kinds; the text is walked once for each group of stretches and once inside it."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def rebuilt(group: Column) -> Column:
        start, end = F.get(group, F.lit(0))["after"], F.element_at(group, -1)["end"]
        piece = F.substring(text, start + 1, end - start)
        return bound(piece, lambda p: F.array_join(F.transform(group, lambda s: F.concat(F.substring(p, s["after"] - start + 1, s["start"] - s["after"]), F.get(names, s["rank"]))), ""))

    def whole(groups: Column) -> Column:
        rest = F.substring(text, F.element_at(F.element_at(groups, -1), -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(groups, rebuilt), ""), rest)

    return F.when(F.size(found) > 0, bound(stretches(found), lambda s: bound(in_blocks(s, GROUP), whole))).otherwise(text)


def mask(documents: DataFrame) -> DataFrame:
    """documents, all columns, with every span of the text replaced by its kind in angle brackets.

    Spans that overlap are one stretch, named by its first span. Repeated rows stay repeated.
    """
    own_id, own_hash, own_spans = (free_name(n, documents) for n in ("span_id", "span_hash", "span_list"))
    hit = find(documents).where(F.size("spans") > 0).select(F.col("k_id").alias(own_id), F.col("k_text").alias(own_hash), F.col("spans").alias(own_spans)).dropDuplicates([own_id, own_hash])
    joined = documents.join(hit, documents["doc_id"].eqNullSafe(hit[own_id]) & (F.xxhash64(documents["text"]) == hit[own_hash]), "left")
    text = F.when(F.col(own_spans).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(own_spans)))
    return joined.withColumn("text", text).drop(own_id, own_hash, own_spans)
