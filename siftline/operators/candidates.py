"""From sources to candidates: signals, eligibility, provider caps, and the aggregate list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest, paths, text
from ..sources.scratch import cut, stored
from .scoring import MAX_CANDIDATES, STRINGS, normalised

PROVIDER_CAP, INDEX_CAP = 1_024, 50
SIGNAL_TERMS = 128
BROADCAST = 64 << 20  # bytes of keys that are broadcast; more are joined
MAX_LONG_POLICIES = 16_384  # as many files as a repository's corpus may have
# Fixed value: test files among scripts.
TEST_CODE = r"(^|/)(test|tests|__tests__)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$"
COLUMNS = (
    "task_id", "id", "kind", "provider", "path", "line_start", "line_end", "symbol", "source_hash", "excerpt_hash", "freshness", "authority",
    "authority_evidence", "excerpt", "excerpt_bytes", "estimated_tokens", "graph_distance", "matched_terms", "criteria_ids", "truncated", "truncation_reasons",
)


def request_terms(query: Column, hint_terms: Column, criteria: Column) -> Column:
    """All terms a request (of ``scoring.normalised`` tasks) asks for, sorted, at most 128."""
    listed = F.flatten(F.transform(criteria, _asked))
    every = F.concat(text.tokens(query, False), F.flatten(F.transform(F.coalesce(hint_terms, F.array().cast(STRINGS)), lambda t: text.tokens(t, False))), listed)
    return F.slice(F.array_sort(F.array_distinct(every)), 1, SIGNAL_TERMS)


def signals(words: Column, terms: Column, criteria: Column) -> tuple[Column, Column]:
    """(requested terms that a source holds, ids of criteria with any of them)."""
    found = F.slice(F.array_sort(F.array_intersect(terms, words)), 1, SIGNAL_TERMS)
    ids = F.array_sort(F.transform(F.filter(criteria, lambda c: F.arrays_overlap(_asked(c), words)), lambda c: c["id"]))
    return found, ids


def _with_signals(rows: DataFrame, *shown: str) -> DataFrame:
    """rows (with terms and criteria) with matched_terms and criteria_ids, from the words of the named columns."""
    worded = rows.withColumn("_words", F.array_distinct(text.tokens(F.concat_ws(" ", *shown))))
    found, ids = signals(F.col("_words"), F.col("terms"), F.col("criteria"))
    return worded.withColumns({"matched_terms": found, "criteria_ids": ids}).drop("_words")


def _asked(criterion: Column) -> Column:
    listed = F.flatten(F.transform(F.coalesce(criterion["required_terms"], F.array().cast(STRINGS)), lambda t: text.tokens(t, False)))
    return F.array_distinct(F.concat(text.tokens(criterion["text"], False), listed))


def asking(tasks: DataFrame) -> DataFrame:
    """tasks in normalised form with the terms that they ask for, written once; tasks that were asked already are returned."""
    if "terms" in tasks.columns:
        return tasks
    return cut(normalised(tasks).withColumn("terms", request_terms(F.col("query"), F.col("hint_terms"), F.col("criteria"))))


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark applies the limit before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def postings(asked: DataFrame, rows: DataFrame, key: str, words: Column) -> DataFrame:
    """(term, key, and the other short columns of rows) of the words that some task asks for. A task has at most 128 terms; tasks are few enough to broadcast theirs or are joined."""
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    if wanted.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0] <= BROADCAST:  # else all words would be shuffled
        wanted = F.broadcast(wanted)
    short = [c for c in rows.columns if c not in ("content", "title", "excerpt", "shown")]
    return rows.select(*short, F.explode(F.array_distinct(words)).alias("term")).join(wanted, "term", "left_semi")


def wanted_by(asked: DataFrame, held: DataFrame, key: str, order: list[Column], cap: int | None) -> DataFrame:
    """Distinct (task_id, key) of rows that hold a term of a task; with ``cap`` only what can be among a task's first ``cap``.

    In the given order, which all tasks share, a row that is among a task's first ``cap`` is
    among the first ``cap`` of each of its terms, so every term's list is cut before tasks
    are paired with it: a word that most rows hold costs ``cap`` rows and not all of them.
    """
    if cap is not None:
        held = _first(held, ["term"], order, cap)
    return asked.select("task_id", F.explode("terms").alias("term")).join(held.select("term", key), "term").select("task_id", key).distinct()


def _named(asked: DataFrame, rows: DataFrame, key: str, hints: bool, order: list[Column], cap: int | None) -> DataFrame:
    """(task_id, key) of required sources and, with hints, of what lies under a hinted path (of each path the first ``cap``); joined by equality."""
    own = asked.select("task_id", F.explode("required_sources").alias("path")).join(rows.select(*{"path", key}), "path").select("task_id", key)
    if not hints:
        return own
    prefixes = asked.select(F.explode("hint_paths").alias("prefix")).distinct()
    under = rows.select(*[c for c in rows.columns if c not in ("content", "title", "excerpt")], F.explode(F.concat(F.array("path"), paths.ancestors(F.col("path")))).alias("prefix")).join(prefixes, "prefix", "left_semi")
    if cap is not None:
        under = _first(under, ["prefix"], order, cap)
    return own.unionByName(asked.select("task_id", F.explode("hint_paths").alias("prefix")).join(under.select("prefix", key), "prefix").select("task_id", key))


def _policies(asked: DataFrame, rows: DataFrame, order: list[Column] | None, cap: int) -> DataFrame:
    """(task_id, path) of the policies that every task may use: the first ``cap`` in order, or all where the order is not known yet."""
    own = rows.where(F.col("authority") == "policy").select("path", *({"id"} if "id" in rows.columns else {}))
    found = [r["path"] for r in (own.orderBy(*order).limit(cap) if order else own.limit(MAX_LONG_POLICIES + 1)).collect()]
    if order is None and len(found) > MAX_LONG_POLICIES:
        raise ValueError("too many policies are longer than an excerpt")
    return asked.select("task_id", F.explode(F.array(*[F.lit(p) for p in found]).cast(STRINGS)).alias("path"))


def of_sources(tasks: DataFrame, sources: DataFrame, provider: str, cap: int = PROVIDER_CAP, collection_limited: bool = False) -> DataFrame:
    """Candidates of one provider for every task, at most ``cap`` a task: required, then policies, then by path (documents) or id (filesystem).

    The excerpt of a source that fits one is the same for every task, so its words and its
    id are known when it is read. Of those a task's first ``cap`` (and one more, to tell
    whether there are more) are found by keys alone: the first of each term, hinted path and
    policy, then the first of their union. Only these are joined with their texts. A longer
    source shows what lies around a task's first term, so what it shows is looked at for
    each task that shares a word with it; documents only as far down the order as a task's
    first ``cap`` reach. A part of a word that a cut leaves is no word.
    """
    if "title" not in sources.columns:
        sources = sources.withColumn("title", F.lit("").cast("string"))
    files = provider == "filesystem"
    asked = asking(tasks)
    usable = sources.where(F.octet_length("content") > 0).withColumns({"long": text.was_bounded(F.col("content")), "policy": F.col("authority") == "policy"})
    usable = usable.withColumn("shown", F.when(F.col("long"), F.col("content")).otherwise(text.bounded_excerpt(F.when(~F.col("long"), F.col("content")))))  # columns, so that each is computed once
    shown = F.col("shown")
    none = F.lit(None)
    own_id = digest.candidate_id(F.lit(provider), F.col("path"), none.cast("int"), none.cast("int"), none.cast("string"), F.col("source_hash"), digest.text_hash(shown))
    last = "id" if files else "path"
    order = [F.desc("policy"), F.col(last)]
    keys = ["path", "authority", "policy", "long", *(["id"] if files else [])]
    known = stored((usable.withColumn("id", own_id) if files else usable).select(*keys), "source_keys")
    words = text.tokens(F.concat_ws(" ", F.col("path"), F.col("title"), shown))
    terms = stored(postings(asked, usable.select("path", "long", "title", "shown"), "path", words).select("path", "term"), "source_terms").join(known, "path")
    short, held = known.where("NOT long"), terms.where("NOT long")
    pairs = wanted_by(asked, held, "path", order, cap + 1).unionByName(_named(asked, short, "path", files, order, cap + 1)).unionByName(_policies(asked, short, [F.col(last)], cap + 1)).distinct()
    needs = asked.select("task_id", F.coalesce("required_sources", F.array().cast(STRINGS)).alias("needs"))
    keyed = pairs.join(short, "path").join(needs, "task_id").withColumn("required", F.array_contains("needs", F.col("path")))
    first = cut(_first(keyed.select("task_id", "path", "required", "policy", *(["id"] if files else [])), ["task_id"], [F.desc("required"), *order], cap + 1))
    longer = known.where("long")
    more = wanted_by(asked, terms.where("long"), "path", order, None).unionByName(_named(asked, longer, "path", files, order, None)).unionByName(_policies(asked, longer, None if files else [F.col("path")], cap + 1)).distinct()
    if not files:  # beyond a task's first cap + 1 in the order of paths nothing counts
        worst = first.groupBy("task_id").agg(F.count("*").alias("n"), F.max(F.struct((~F.col("required")).alias("r"), (~F.col("policy")).alias("p"), "path")).alias("worst")).where(F.col("n") > cap).select("task_id", "worst")
        here = F.struct((~F.col("required")).alias("r"), (~F.col("policy")).alias("p"), "path")
        placed = more.join(longer.select("path", "policy"), "path").join(needs, "task_id").withColumn("required", F.array_contains("needs", F.col("path")))
        more = placed.join(worst, "task_id", "left").where(F.col("worst").isNull() | (here < F.col("worst"))).select("task_id", "path")
    chosen = cut(first.select("task_id", "path").unionByName(more))
    rows = chosen.join(usable.drop("content"), "path").join(asked, "task_id")
    rows = rows.withColumn("around", text.surroundings(F.when(F.col("long"), F.col("shown")), F.col("terms")))
    rows = rows.withColumn("excerpt", F.when(F.col("long"), text.bounded_excerpt(F.col("around"))).otherwise(F.col("shown"))).withColumn("bounded", F.col("long")).drop("around", "shown")
    rows = stored(rows, "source_excerpts")  # an expression that much after it uses; computed once
    required = F.coalesce(F.array_contains("required_sources", F.col("path")), F.lit(False))
    rows = _with_signals(rows, "path", "title", "excerpt").withColumn("required", required)
    hinted = paths.within(F.col("path"), F.coalesce("hint_paths", F.array().cast(STRINGS)))
    eligible = (F.size("matched_terms") > 0) | F.col("policy") | F.col("required")
    rows = rows.where(eligible | hinted if files else eligible)
    rule = paths.authority(F.col("path"))["rule_id"]
    if files:
        evidence = F.when(F.col("policy"), "convention:ancestor-agents-file").otherwise("safe-filesystem-fallback")
    else:
        evidence = F.when(rule.isNotNull(), F.concat(F.lit("convention:"), rule)).otherwise("document-default")
    reasons = F.array(F.when(F.col("bounded"), "EXCERPT_BOUND"), F.lit("SOURCE_COLLECTION_LIMIT" if collection_limited else None).cast("string"))
    made = _finished(rows, provider, F.col("kind"), "live", F.array(evidence), reasons, ("required", "policy"))
    return _capped(made, [F.desc("required"), *order], cap, "PROVIDER_RESULT_LIMIT").select(*COLUMNS)


def _capped(rows: DataFrame, order: list[Column], cap: int, reason: str) -> DataFrame:
    """The first ``cap`` rows of each task; if there were more, all that stay say so.

    One row beyond the cap is ranked along to tell, so nothing is counted and the rank
    filter stays one that is applied before the shuffle. Rows are ranked without their
    excerpts, which are joined to those that stay.
    """
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "source_candidates")
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(*order))
    near = rows.drop("excerpt").withColumn("place", place).where(F.col("place") <= cap + 1)
    kept = near.withColumn("limited", F.max("place").over(Window.partitionBy("task_id")) > cap).where(F.col("place") <= cap)
    return _limited(rows.join(_small(kept.select("row", "limited")), "row").drop("row"), reason)


def _small(keys: DataFrame) -> DataFrame:
    """Ranked keys, broadcast if they are few."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST // 256 else keys


def _limited(kept: DataFrame, reason: str) -> DataFrame:
    reasons = F.when(F.col("limited"), F.array_sort(F.array_union("truncation_reasons", F.array(F.lit(reason))))).otherwise(F.col("truncation_reasons"))
    return kept.withColumns({"truncation_reasons": reasons, "truncated": F.col("truncated") | F.col("limited")})


def _finished(rows: DataFrame, provider: str, kind: Column, freshness: str, evidence: Column, reasons: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """Candidate columns from rows with excerpt, path, source_hash, authority and, where they have them, lines, symbol and distance."""
    for name, of in (("line_start", "int"), ("line_end", "int"), ("symbol", "string"), ("graph_distance", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(of))
    rows = rows.withColumn("excerpt_hash", digest.text_hash(F.col("excerpt")))
    cut = text.truncation(reasons)
    parts = [F.col(c) for c in ("path", "line_start", "line_end", "symbol", "source_hash", "excerpt_hash")]
    made = rows.withColumns({
        "id": digest.candidate_id(F.lit(provider), *parts),
        "kind": kind,
        "provider": F.lit(provider),
        "freshness": F.lit(freshness),
        "authority_evidence": evidence.cast(STRINGS),
        "excerpt_bytes": F.octet_length("excerpt").cast("long"),
        "estimated_tokens": text.token_estimate(F.col("excerpt")),
        "truncated": cut["truncated"],
        "truncation_reasons": cut["reasons"].cast(STRINGS),
    })
    return made.select(*COLUMNS, *more)


def of_hits(hits: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index hits re-read from live sources, hits whose source changed or went): joined on path and hash."""
    now = live.select("path", F.col("source_hash").alias("live_hash"), "content")
    joined = hits.join(now, "path", "left")
    same = F.col("source_hash").eqNullSafe(F.col("live_hash"))
    return joined.where(same).drop("live_hash"), joined.where(~same).select("path", F.lit("STALE_SELECTED_SOURCE").alias("code"))


def of_index(tasks: DataFrame, hits: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates of index hits, hits whose source changed or went). hits is what ``fts.search_many`` returns; live has path, source_hash, authority and content."""
    now = live.select(F.col("path").alias("l_path"), F.col("source_hash").alias("l_hash"), F.col("authority").alias("l_authority"), F.col("content").alias("l_content"))
    same = (F.col("path") == F.col("l_path")) & (F.col("source_hash") == F.col("l_hash"))
    found = hits.drop("content").join(now, same, "left")
    stale = found.where("l_path IS NULL").select("task_id", "path", F.lit("STALE_SELECTED_SOURCE").alias("code"))
    asked = asking(tasks).select("task_id", "terms", "criteria")
    rows = found.where("l_path IS NOT NULL").drop("authority", "excerpt").join(asked, "task_id").withColumns({"authority": F.col("l_authority"), "excerpt": text.relevant_excerpt(F.col("l_content"), F.col("hit_terms"))})
    rows = _with_signals(rows, "path", "title", "excerpt").withColumns({"line_start": F.col("start_line"), "line_end": F.col("end_line")})
    reasons = F.array(F.when(text.was_bounded(F.col("l_content")), "EXCERPT_BOUND"), F.when(F.col("limited"), "PROVIDER_RESULT_LIMIT"))
    evidence = F.array(F.lit("safe-live-source-reread"), F.lit("screened-local-fts-index"))
    return _finished(rows, "fts", F.col("kind"), "live", evidence, reasons), stale


def of_nodes(tasks: DataFrame, nodes: DataFrame, accepted: DataFrame, cap: int = PROVIDER_CAP) -> DataFrame:
    """Graph nodes of accepted sources that a task hints at, names or shares terms with; distance 0 for a hinted symbol."""
    live = nodes.join(accepted.select("path", "source_hash"), ["path", "source_hash"], "left_semi")
    asked = asking(tasks)
    place = [F.col(c) for c in ("path", "start_line", "start_column", "kind", "node_id")]
    held = postings(asked, live, "node_id", text.tokens(F.concat_ws(" ", "path", "name", "qualified_name", "excerpt")))
    called = _first(live.join(asked.select(F.explode("hint_symbols").alias("name")).distinct(), "name", "left_semi"), ["name"], place, cap + 1)
    called = asked.select("task_id", F.explode("hint_symbols").alias("name")).join(called.select("name", "node_id"), "name").select("task_id", "node_id")
    pairs = wanted_by(asked, held, "node_id", place, cap + 1).unionByName(_named(asked, live, "node_id", True, place, cap + 1)).unionByName(called).distinct()
    keyed = pairs.join(live.select("node_id", "path", "start_line", "start_column", "kind"), "node_id")
    first = _first(keyed, ["task_id"], place, cap + 1).select("task_id", "node_id")
    rows = _with_signals(first.join(live, "node_id").join(asked, "task_id"), "path", "name", "qualified_name", "excerpt")
    is_test = F.lower("path").rlike(TEST_CODE)
    made = rows.withColumns({
        "bounded": F.col("excerpt_truncated") | text.was_bounded(F.col("excerpt")),
        "excerpt": text.bounded_excerpt(F.col("excerpt")),
        "graph_distance": F.when(F.array_contains("hint_symbols", F.col("name")), 0).cast("int"),
        "line_start": F.col("start_line"),
        "line_end": F.col("end_line"),
        "symbol": F.col("name"),
        "authority": F.when(is_test, "test").otherwise("source_code"),
        "node_kind": F.col("kind"),
    })
    order = ("start_line", "start_column", "node_kind", "node_id")
    done = _finished(made, "codegraph", F.when(is_test, "test").otherwise("code"), "snapshot", F.array(F.concat(F.lit("typescript-ast:"), F.col("node_kind"))), F.array(F.when(F.col("bounded"), "EXCERPT_BOUND")), order)
    return _capped(done, [F.col(c) for c in ("path", *order)], cap, "PROVIDER_RESULT_LIMIT").select(*COLUMNS)


def of_text(tasks: DataFrame, provider: str, kind: str, path: str, body: str, always: bool) -> DataFrame:
    """The repository map or the version-control state as one pseudo-candidate a task."""
    rows = asking(tasks).withColumn("excerpt", text.bounded_excerpt(F.lit(body)))
    rows = _with_signals(rows, "excerpt").withColumns({"source_hash": digest.text_hash(F.lit(body)), "path": F.lit(path), "authority": F.lit(kind)})
    rows = rows if always else rows.where(F.size("matched_terms") > 0)
    return _finished(rows, provider, F.lit(kind), "live", F.array(), F.array(F.when(text.was_bounded(F.lit(body)), "EXCERPT_BOUND")))


def without_indexed(direct: DataFrame, indexed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Direct document candidates whose source is not an index hit already; policies and required sources stay."""
    known = indexed.select("task_id", "path", "source_hash").distinct().withColumn("known", F.lit(True))
    needed = tasks.select("task_id", F.explode("required_sources").alias("path")).distinct().withColumn("needed", F.lit(True))
    rows = direct.join(known, ["task_id", "path", "source_hash"], "left").join(needed, ["task_id", "path"], "left")
    return rows.where(F.col("known").isNull() | (F.col("authority") == "policy") | F.col("needed")).select(*direct.columns)


def aggregate(tasks: DataFrame, providers: list[DataFrame], cap: int = MAX_CANDIDATES, capsule: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """All providers' candidates, in their given order: once each by id, within the capsule, at most ``cap`` a task.

    For a repeated id the last provider's values win. If a task's list is cut, every
    candidate of it says so.
    """
    tagged = [p.select(*COLUMNS, F.lit(k).alias("from")) for k, p in enumerate(providers)]
    rows = reduce(DataFrame.unionByName, tagged)
    if capsule:
        allowed, forbidden = (F.array(*[F.lit(x) for x in side]).cast(STRINGS) for side in capsule)
        rows = rows.where(paths.allowed_by_capsule(F.col("path"), F.col("authority"), allowed, forbidden))
    # Keys are ranked alone; only what stays is joined with its excerpts and other columns.
    named = F.struct("path", "authority", "provider")
    once = rows.groupBy("task_id", "id").agg(F.max("from").alias("from"), F.max_by(named, "from").alias("k")).select("task_id", "id", "from", "k.*")
    needs = tasks.select("task_id", F.coalesce("required_sources", F.array().cast(STRINGS)).alias("needs"))
    ranked = once.join(needs, "task_id").withColumn("required", F.array_contains("needs", F.col("path")))
    direct = (F.col("authority") == "policy") & F.col("provider").isin("documents", "filesystem")
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("required"), F.desc(direct), F.col("id")))
    near = ranked.withColumn("place", place).where(F.col("place") <= cap + 1)
    kept = near.withColumn("limited", F.max("place").over(Window.partitionBy("task_id")) > cap).where(F.col("place") <= cap)
    found = rows.join(_small(kept.select("task_id", "id", "from", "limited")), ["task_id", "id", "from"])
    found = found.withColumn("last", F.row_number().over(Window.partitionBy("task_id", "id").orderBy(F.desc("from")))).where("last = 1")  # of a provider's repeated rows one
    return _limited(found, "CANDIDATE_SET_LIMIT").select(*COLUMNS)
