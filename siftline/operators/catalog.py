"""Document catalog: rows of metadata with hashes, its digest, freshness, conflicts and summary."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest, paths, text
from ..sources import versions
from . import ordered

#: Authorities from the strongest on.
AUTHORITIES = ("policy", "adr", "specification", "contract_schema", "roadmap", "implementation_note", "generated_summary")
MAX_DOCUMENTS, MAX_BYTES, MAX_TOTAL_BYTES = 4_096, 512 * 1024, 64 << 20
DIGEST_FIELDS = ("id", "path", "title", "authority", "modules", "topics", "source_hash", "size_bytes")


def authority_rank(authority: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in AUTHORITIES]), authority).cast("int") - 1


def describe(sources: DataFrame, normalise: bool = True) -> DataFrame:
    """Catalog rows of sources with path and content: id, title, authority, modules, topics, hash and size."""
    authority = paths.authority(F.col("path"))
    return sources.select(
        digest.document_id(F.col("path")).alias("id"),
        "path",
        text.title(F.col("path"), F.col("content")).alias("title"),
        authority["authority"].alias("authority"),
        F.struct(authority["basis"].alias("kind"), authority["rule_id"].alias("rule_id")).alias("authority_basis"),
        paths.modules(F.col("path"), normalise).alias("modules"),
        paths.topics(F.col("path"), normalise).alias("topics"),
        digest.text_hash(F.col("content")).alias("source_hash"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        "content",
    )


def capped(rows: DataFrame, order: str, size: str, max_rows: int, max_total: int) -> DataFrame:
    """rows in the ordered prefix that fits both caps, with total_bytes so far and the row's number.

    The prefix is taken with a limit first, so the running sum never orders more than
    ``max_rows`` rows in one task, and only of the order, which must be unique, and the
    sizes; the other columns are joined to what is left.
    """
    head = rows.select(order, size).orderBy(order).limit(max_rows)
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = head.withColumn("total_bytes", F.sum(size).over(running)).withColumn("position", F.row_number().over(Window.orderBy(order)))
    kept = numbered.where(F.col("total_bytes") <= max_total).drop(size)
    return rows.join(F.broadcast(kept), order).select(*rows.columns, "total_bytes", "position")  # max_rows short rows


def build(sources: DataFrame, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES, max_total: int = MAX_TOTAL_BYTES, normalise: bool = True) -> DataFrame:
    """Catalog of the document corpus, with oversize files left out and both caps kept."""
    usable = sources.where(paths.is_document(F.col("path")) & (F.octet_length("content") <= max_bytes))
    described = describe(usable, normalise)
    return capped(described, "path", "size_bytes", max_documents, max_total).drop("total_bytes", "position")


def catalog_digest(catalog: DataFrame) -> DataFrame:
    """One row: digest of the metadata rows in path order, and their number. Bounded by the catalog's own cap."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("path").alias("p"), F.to_json(F.struct(*DIGEST_FIELDS)).alias("j"))))
    body = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["j"]), ","), F.lit("]"))
    return catalog.agg(digest.text_hash(body).alias("catalog_digest"), F.count("*").alias("document_count"))


def fingerprint(catalog: DataFrame) -> DataFrame:
    """Order-free fingerprint for catalogs of any size: number of rows, and xor and sum of their hashes."""
    h = F.xxhash64(*DIGEST_FIELDS)
    return catalog.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("sum"))


def publish(catalog: DataFrame, root: str, listing: Callable[[], DataFrame] | None = None) -> versions.Version:
    """Make a built catalog the next version of the folder root, with its digest; refused if a row breaks a contract or, with ``listing`` (path, source_hash), its source changed meanwhile."""

    def about(written: Mapping[str, DataFrame]) -> dict[str, Any]:
        n, mark = ordered.of_rows(written["catalog"], list(DIGEST_FIELDS), ["path"])
        return {"document_count": n, "catalog_digest": mark}

    fresh = (lambda: staleness(catalog, listing()).where("status <> 'added'")) if listing else None
    return versions.publish(catalog.sparkSession, root, {"catalog": catalog}, about, lambda written: violations(written["catalog"]), fresh)


def staleness(catalog: DataFrame, live: DataFrame) -> DataFrame:
    """path and status (changed, missing, added) of all that differs between catalog and live rows (path, source_hash)."""
    old, new = catalog.select("path", F.col("source_hash").alias("old_hash")), live.select("path", F.col("source_hash").alias("new_hash"))
    status = F.when(F.col("new_hash").isNull(), "missing").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return old.join(new, "path", "full").select("path", status.alias("status")).where("status IS NOT NULL")


def title_conflicts(catalog: DataFrame, normalise: bool = False) -> DataFrame:
    """normalized_title and document_id of every document whose title others with different contents share.

    A row a document, so a title that very many documents have is no single row; whether
    contents differ is seen from the least and the greatest hash, combined before the shuffle.
    """
    rows = catalog.select(text.normal_title(F.col("title"), normalise).alias("normalized_title"), F.col("id").alias("document_id"), "source_hash")
    shared = rows.groupBy(F.col("normalized_title").alias("t")).agg(F.min("source_hash").alias("least"), F.max("source_hash").alias("most")).where("least <> most").select("t")
    return rows.join(shared, F.col("normalized_title") == F.col("t"), "left_semi").drop("source_hash")


def violations(catalog: DataFrame) -> DataFrame:
    """rule and path of every catalog row that breaks a contract."""
    checks = F.array(
        F.when(~paths.is_safe(F.col("path")), "unsafe_path"),
        F.when(F.col("id") != digest.document_id(F.col("path")), "id_mismatch"),
        F.when(~F.col("source_hash").rlike("^sha256:[0-9a-f]{64}$"), "hash_format"),
        F.when(digest.hash_distance(F.col("source_hash"), F.col("content")), "hash_mismatch"),
        F.when(F.col("size_bytes") != F.octet_length("content"), "size_mismatch"),
        F.when(~F.col("authority").isin(*AUTHORITIES), "authority"),
        F.when(F.col("modules") != F.array_sort(F.array_distinct("modules")), "modules_order"),
        F.when(F.col("topics") != F.array_sort(F.array_distinct("topics")), "topics_order"),
        F.when((F.char_length("title") < 1) | (F.char_length("title") > text.TITLE_CHARS), "title_length"),
    )
    single = catalog.select("path", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("rule"))
    twice = catalog.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate_path").alias("rule"))
    return single.unionByName(twice)


def summary(discovered: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Counters over discovered paths (path, size_bytes), in one pass."""
    sensitive, document = paths.is_sensitive(F.col("path")), paths.is_document(F.col("path"))
    usable = ~sensitive & document
    return discovered.agg(
        F.count("*").alias("discovered_path_count"),
        F.count_if(sensitive).alias("excluded_path_count"),
        F.count_if(usable & (F.col("size_bytes") <= max_bytes)).alias("candidate_document_count"),
        F.count_if(usable & (F.col("size_bytes") > max_bytes)).alias("omitted_document_count"),
        F.coalesce(F.sum(F.when(usable & (F.col("size_bytes") <= max_bytes), F.col("size_bytes"))), F.lit(0)).alias("total_bytes"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """path, representative and copies of every source: of equal contents the most authoritative, then the shortest, then the first path.

    The best path of a hash is an aggregate that combines before the shuffle; the one join
    back is an inner join of plain columns, whose hot hashes adaptive execution splits.
    """
    best = F.min(F.struct(authority_rank(F.col("authority")).alias("rank"), F.length("path").alias("length"), F.col("path").alias("path")))
    of_hash = rows.groupBy(F.col("source_hash").alias("h")).agg(best["path"].alias("representative"), F.count("*").alias("copies"))
    return rows.select("path", "source_hash").join(of_hash, F.col("source_hash") == F.col("h")).select("path", "representative", "copies")
