"""Ranked lexical search over a document catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .catalog import authority_rank

# Weight and cap of a term's uses in each field, and the exact-title bonus.
FIELDS = (("title", 16, 3), ("path", 8, 3), ("module", 6, 3), ("topic", 6, 3), ("body", 1, 8))
EXACT_TITLE = 24
DEFAULT_LIMIT, MAX_LIMIT = 10, 50


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order of first use."""
    import unicodedata

    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", query).lower())))


def filtered(catalog: DataFrame, authorities: list[str] | None = None, modules: list[str] | None = None, topics: list[str] | None = None) -> DataFrame:
    """All filters must hold; within one filter any value does; an empty filter is none."""
    out = catalog
    if authorities:
        out = out.where(F.col("authority").isin(*authorities))
    for column, wanted in (("modules", modules), ("topics", topics)):
        if wanted:
            out = out.where(F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted])))
    return out


def score(terms: list[str], fields: dict[str, Column], title_tokens: Column) -> tuple[Column, Column, Column]:
    """(score, fields that hold a term, whether every term is in some field), from each field's ``plain`` text."""
    total, per_field = F.lit(0), {name: F.lit(False) for name, _, _ in FIELDS}
    every = F.lit(bool(terms))
    for term in terms:
        anywhere = F.lit(False)
        for name, weight, cap in FIELDS:
            n = text.term_uses(fields[name], term)
            total = total + weight * F.least(n, F.lit(cap))
            per_field[name] = per_field[name] | (n > 0)
            anywhere = anywhere | (n > 0)
        every = every & anywhere
    exact = F.array_join(title_tokens, " ") == " ".join(terms)
    total = total + F.when(exact & F.lit(bool(terms)), EXACT_TITLE).otherwise(0)
    names = F.filter(F.array(*[F.when(per_field[n], n) for n, _, _ in FIELDS]), lambda x: x.isNotNull())
    return total.cast("long"), names, every


def search(catalog: DataFrame, query: str, limit: int = DEFAULT_LIMIT, normalise: bool = True, **filters: list[str] | None) -> DataFrame:
    """The best hits: id, path, title, authority, source_hash, score, matched_fields, matched_terms, excerpt.

    Filters come before anything is read of a text; the scan, the score and the AND rule are one stage and
    only the top rows reach the driver.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    terms = query_terms(query)
    joined = lambda c: F.array_join(c, " ")
    parts = {"title": F.col("title"), "path": F.col("path"), "module": joined("modules"), "topic": joined("topics"), "body": F.col("content")}
    with_tokens = filtered(catalog, **filters).select("*", *[text.plain(c, normalise).alias(f"t_{n}") for n, c in parts.items()])
    total, names, every = score(terms, {n: F.col(f"t_{n}") for n in parts}, text.tokens(F.col("t_title"), False))
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hits = with_tokens.where(every).select("id", "path", "title", "authority", "source_hash", total.alias("score"), names.alias("matched_fields"), wanted.alias("matched_terms"), "content")
    top = hits.orderBy(F.desc("score"), authority_rank(F.col("authority")), "path", "id").limit(limit)
    return top.withColumn("excerpt", text.excerpt(F.col("content"), wanted)).drop("content")


def search_summary(catalog: DataFrame, query: str, limit: int = DEFAULT_LIMIT, **filters: list[str] | None) -> DataFrame:
    """One row: how many documents match, how many are returned, whether the limit cut."""
    terms = query_terms(query)
    body = F.concat_ws(" ", "title", "path", F.array_join("modules", " "), F.array_join("topics", " "), "content")
    wanted = F.array_distinct(F.array(*[F.lit(t) for t in terms]))
    found = filtered(catalog, **filters).select((F.size(F.array_intersect(wanted, text.tokens(body))) == F.size(wanted)).alias("hit"))  # each body is cut into words once
    n = F.count_if("hit")
    return found.agg(F.count("*").alias("considered"), n.alias("matched"), F.least(n, F.lit(limit)).alias("returned"), (n > limit).alias("truncated"))


def term_frequencies(documents: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent terms of a text column over all documents, with document counts; counts combine before the shuffle."""
    per_doc = documents.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    counted = per_doc.groupBy("term").agg(F.count("*").alias("tf"))
    return counted.orderBy(F.desc("tf"), "term").limit(limit)
