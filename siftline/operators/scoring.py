"""Requirements, applicable policies, visible terms and the score of evidence candidates.

tasks: one row a task with task_id, goal, query, criteria array<struct<id, text,
required_terms>>, hint_paths, hint_symbols, hint_terms, required_sources (arrays) and the
budget max_items, max_bytes, max_tokens. candidates: rows keyed by (task_id, id). Many
tasks are compiled in one job; everything up to the selection is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from . import vocabulary as v

STRINGS = "array<string>"
TASKS = (
    "task_id string, goal string, query string, criteria array<struct<id:string,text:string,required_terms:array<string>>>, hint_paths array<string>, "
    "hint_symbols array<string>, hint_terms array<string>, required_sources array<string>, max_items int, max_bytes long, max_tokens long"
)
MAX_CANDIDATES = 2_048


def _list(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast(STRINGS), F.array().cast(STRINGS))


def _literal(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def requirements(criteria: Column) -> Column:
    """struct(id, mode, terms, minimum) of each criterion; listed terms must all match, else two significant words do."""

    def one(c: Column) -> Column:
        listed = F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(c["required_terms"], lambda t: text.sorted_terms(t, normalise=False))))), 1, text.TERMS)
        implied = F.filter(text.sorted_terms(c["text"], normalise=False), lambda t: ~t.isin(*v.STOP_WORDS))
        explicit = c["required_terms"].isNotNull()
        terms = F.when(explicit, listed).otherwise(implied)
        least = F.when(explicit, F.size(listed)).otherwise(F.least(F.lit(2), F.greatest(F.lit(1), F.size(implied))))
        return F.struct(c["id"].alias("id"), F.when(explicit, "ALL").otherwise("AT_LEAST").alias("mode"), terms.alias("terms"), least.alias("minimum"))

    return F.transform(criteria, one)


def satisfied(requirement: Column, matched: Column) -> Column:
    every = F.when(F.size(requirement["terms"]) == 0, F.size(matched) > 0).otherwise(F.size(F.array_except(requirement["terms"], matched)) == 0)
    return F.when(requirement["mode"] == "ALL", every).otherwise(F.size(matched) >= requirement["minimum"])


def security_relevant(values: Column) -> Column:
    """Whether an array of request texts is about security."""
    words = F.array_distinct(F.flatten(F.transform(values, lambda t: text.tokens(t, False))))
    found = F.arrays_overlap(words, _literal(v.SECURITY)) | F.exists(values, lambda x: x.rlike(v.ACRONYM))
    for groups in v.TOGETHER:
        together = F.lit(True)
        for group in groups:
            together = together & F.arrays_overlap(words, _literal(group))
        found = found | together
    return F.coalesce(found, F.lit(False))


def normalised(tasks: DataFrame) -> DataFrame:
    """tasks with the words that they ask for in compatibility-normalised form, as those of the sources are."""
    per = F.transform("criteria", lambda c: F.size(_list(c["required_terms"])))
    every = F.col("n_criteria")
    out = tasks.withColumns({
        "n_criteria": F.struct(
            text.nfkc_each(F.transform("criteria", lambda c: c["text"])).alias("texts"),
            text.nfkc_each(F.flatten(F.transform("criteria", lambda c: _list(c["required_terms"])))).alias("terms"),
            F.transform(per, lambda _, k: F.aggregate(F.slice(per, 1, k), F.lit(0), lambda a, x: a + x)).alias("from"),
        ),
        "query": text.nfkc(F.col("query")),
        "hint_terms": text.nfkc_each(_list("hint_terms")),
    })

    def one(c: Column, k: Column) -> Column:
        own = F.slice(every["terms"], F.get(every["from"], k) + 1, F.size(c["required_terms"]))
        return F.struct(c["id"].alias("id"), F.get(every["texts"], k).alias("text"), F.when(c["required_terms"].isNotNull(), own).alias("required_terms"))

    return out.withColumn("criteria", F.transform("criteria", one)).drop("n_criteria")


def prepare_tasks(tasks: DataFrame) -> DataFrame:
    """tasks with query terms, requirements and security relevance; lists are sorted and distinct."""
    tasks = normalised(tasks)
    texts = F.concat(
        F.array("goal", "query"), F.transform("criteria", lambda c: c["text"]), F.flatten(F.transform("criteria", lambda c: _list(c["required_terms"]))),
        _list("hint_paths"), _list("hint_terms"), _list("required_sources"),
    )
    normal = tasks
    for name in ("hint_paths", "hint_symbols", "hint_terms", "required_sources"):
        normal = normal.withColumn(name, F.array_sort(F.array_distinct(_list(name))))
    return normal.withColumns({
        "criteria": F.array_sort("criteria"),
        "query_terms": text.sorted_terms(F.col("query"), normalise=False),
        "requirements": requirements(F.array_sort("criteria")),
        "security": security_relevant(F.filter(texts, lambda x: x.isNotNull())),
    })


def recognised(provider: Column, authority: Column, evidence: Column) -> Column:
    """Authority counts only where its provider and evidence are known."""
    found = F.lit(False)
    for name, accepted in v.RECOGNISED.items():
        found = found | ((authority == name) & F.arrays_overlap(evidence, _literal(accepted)))
    return F.coalesce(provider.isin("documents", "filesystem") & found, F.lit(False))


def nearest_policies(walked: DataFrame, agents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target and policy: of a target's scopes (target, depth, scope) the nearest that has a policy (scope, policy)."""
    return walked.join(agents, [*keys, "scope"]).groupBy(*keys, "target").agg(F.min_by("policy", "depth").alias("policy"))


def applicable_policies(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct (task_id, path) of policies that apply: the root one, security's if relevant, the nearest of every target.

    Targets' ancestors are exploded and joined by equality, so a scope is never compared
    with every target. A task has few policies; joins are on (task_id, directory).
    """
    own = candidates.where((F.col("authority") == "policy") & recognised(F.col("provider"), F.col("authority"), _list("authority_evidence")))
    own = own.select("task_id", "path", paths.file_name(F.col("path")).alias("file"), paths.directory(F.col("path")).alias("scope"))
    choose = lambda exact: F.min_by("path", F.struct((F.col("file") != exact).alias("other"), F.col("path").alias("p")))
    agents = own.where(F.lower("file") == "agents.md").groupBy("task_id", "scope").agg(choose("AGENTS.md").alias("policy"))
    security = own.where((F.col("scope") == "") & (F.lower("file") == "security.md")).groupBy("task_id").agg(choose("SECURITY.md").alias("policy"))
    root = agents.where(F.col("scope") == "").select("task_id", "policy")
    relevant = security.join(tasks.where("security").select("task_id"), "task_id", "left_semi").select("task_id", "policy")
    physical = candidates.where(~F.col("authority").isin("policy") & ~F.col("kind").isin("history", "repository_map")).select("task_id", F.col("path").alias("target"), F.lit(1).alias("physical"))
    named = tasks.select("task_id", F.explode(F.array_union("hint_paths", "required_sources")).alias("target"), F.lit(0).alias("physical"))
    targets = physical.unionByName(named).groupBy("task_id", "target").agg(F.max("physical").alias("physical"))
    above = F.filter(paths.ancestors(F.col("target")), lambda a: a != "")
    scopes = F.when(F.col("physical") == 0, F.concat(F.array("target"), above)).otherwise(above)
    walked = targets.select("task_id", "target", F.posexplode(scopes).alias("depth", "scope"))
    nearest = nearest_policies(walked, agents, ["task_id"]).select("task_id", "policy")
    return root.unionByName(relevant).unionByName(nearest).distinct().withColumnRenamed("policy", "path")


def score(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates with their task's needs, visible matches, ten score components, score and order."""
    prepared = prepare_tasks(tasks)
    policies = applicable_policies(prepared, candidates).select(F.col("task_id").alias("p_task"), F.col("path").alias("p_path"))
    needs = prepared.select("task_id", "query_terms", "requirements", "hint_paths", "hint_symbols", "required_sources", "max_items", "max_bytes", "max_tokens")
    rows = candidates.join(needs, "task_id").join(policies, (F.col("task_id") == F.col("p_task")) & (F.col("path") == F.col("p_path")), "left")
    for name in ("retained", "requested"):
        if name not in candidates.columns:
            rows = rows.withColumn(name, F.lit(False))
    visible = F.array_distinct(text.tokens(F.concat_ws(" ", "path", F.coalesce("symbol", F.lit("")), "excerpt")))
    rows = rows.withColumn("visible", visible).withColumn("recognised", recognised(F.col("provider"), F.col("authority"), _list("authority_evidence")))
    matches = F.transform("requirements", lambda r: F.struct(r["id"].alias("id"), F.array_intersect(r["terms"], F.col("visible")).alias("terms")))
    rows = rows.withColumn("criterion_terms", F.filter(matches, lambda m: F.size(m["terms"]) > 0)).withColumn("matched_query", F.array_intersect("query_terms", "visible"))
    required_terms = F.array_distinct(F.flatten(F.transform("criterion_terms", lambda m: m["terms"])))
    adapter = F.array_intersect(F.flatten(F.transform(_list("matched_terms"), lambda t: text.sorted_terms(t, normalise=False))), F.col("visible"))
    c = v.COMPONENTS
    on = lambda flag, name: F.when(F.coalesce(flag, F.lit(False)), c[name]).otherwise(0).cast("long").alias(name)
    hinted, by_symbol = F.array_contains("hint_paths", F.col("path")), F.array_contains("hint_symbols", F.col("symbol"))
    rank = F.coalesce(*[F.when(F.col("recognised") & (F.col("authority") == a), s) for a, s in v.AUTHORITY_SCORES.items()], F.lit(0))
    required, applicable = F.array_contains("required_sources", F.col("path")), F.col("p_path").isNotNull() & F.col("recognised")
    components = F.struct(
        on(required, "required_source"),
        on(applicable, "applicable_policy"),
        on(hinted, "hinted_path"),
        on(by_symbol, "hinted_symbol"),
        (F.least(F.size(required_terms), F.lit(text.TERMS)) * c["required_terms"]).cast("long").alias("required_terms"),
        (F.least(F.size("matched_query"), F.lit(text.TERMS)) * c["query_terms"]).cast("long").alias("query_terms"),
        F.coalesce(c["graph_distance"] - 50 * F.col("graph_distance"), F.lit(0)).cast("long").alias("graph_distance"),
        rank.cast("long").alias("authority"),
        on((F.col("kind") == "test") & (hinted | F.coalesce(by_symbol, F.lit(False))), "related_test"),
        on(F.col("freshness") == "live", "live_freshness"),
    )
    provider_rank = F.array_position(_literal(v.PROVIDERS), F.col("provider")).cast("int")
    first = F.when(required, "INCLUDE_REQUIRED_SOURCE").when(applicable, "INCLUDE_APPLICABLE_POLICY").when(F.size("criterion_terms") > 0, "INCLUDE_CRITERION_COVERAGE").otherwise("INCLUDE_RELEVANCE")
    found = text.prioritised_terms([required_terms, F.col("matched_query"), adapter])
    scored = rows.withColumns({
        "components": components,
        "mandatory": F.coalesce(required | applicable, F.lit(False)),
        "first_reason": first,
        "matched_terms": found,
        "criteria_ids": F.array_sort(F.transform("criterion_terms", lambda m: m["id"])),
        "order": F.struct(provider_rank.alias("provider"), F.col("path").alias("path"), F.coalesce("line_start", F.lit(0)).alias("line"), F.coalesce("symbol", F.lit("")).alias("symbol"), F.col("id").alias("id")),
    })
    return scored.withColumn("score", sum((F.col(f"components.{name}") for name in c), F.lit(0)).cast("long")).drop("visible", "p_task", "p_path")


def snapshot_violations(candidates: DataFrame, repository_id: str, worktree_digest: str, head: str | None) -> DataFrame:
    """Candidates of another snapshot or of unknown freshness; a compile needs none."""
    other = ~F.col("repository_id").eqNullSafe(F.lit(repository_id)) | ~F.col("worktree_digest").eqNullSafe(F.lit(worktree_digest)) | ~F.col("head").eqNullSafe(F.lit(head))
    return candidates.where(other | (F.col("freshness") == "unknown")).select("task_id", "id", F.when(other, "SNAPSHOT").otherwise("FRESHNESS").alias("rule"))
