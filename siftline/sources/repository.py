"""Repository files as rows: listing, bounded safe reads, the document corpus and the fallback corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, paths, screen, text
from ..operators import catalog

MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 16_384, 1 << 20, 256 << 20


def walk(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """Files under root: path (relative), size_bytes, modified, content; sensitive and excluded paths are left out.

    Read with the binary file source, so any Hadoop file system works; content is read
    only if a later step asks for it, and a size filter is pushed into the source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    relative = F.ltrim(F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(base.replace("file:///", "file:/")) + 1, 1 << 20), F.lit("/"))
    rows = files.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    return rows.where(~paths.is_sensitive(F.col("path")) & ~paths.is_excluded(F.col("path"), excludes or []))


def directories(listing: DataFrame) -> DataFrame:
    """Distinct directories above the listed files."""
    return listing.select(F.explode(F.filter(paths.ancestors(F.col("path")), lambda a: a != "")).alias("path")).distinct()


def excluded_count(listing: DataFrame, excludes: list[str]) -> DataFrame:
    hidden = paths.is_sensitive(F.col("path")) | paths.is_excluded(F.col("path"), excludes)
    return listing.agg(F.count_if(hidden).alias("excluded_path_count"), F.count_if(~hidden).alias("accepted_path_count"))


def readable(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files with content as text; oversize, undecodable and sensitive ones are dropped."""
    small = files.where((F.col("size_bytes") <= max_bytes) & screen.is_clean_text(F.col("content")))
    return small.withColumn("content", _decoded()).where(~screen.is_sensitive(F.col("content")))


def _decoded() -> Column:
    """The content as text; bytes that are not UTF-8 give an empty one, which no Python worker can choke on."""
    return F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))


def omissions(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row: how many files are oversize, undecodable or sensitive, each counted once."""
    big = F.col("size_bytes") > max_bytes
    dirty = ~big & ~screen.is_clean_text(F.col("content"))
    secret = ~big & ~dirty & screen.is_sensitive(_decoded())
    return files.agg(F.count_if(big).alias("oversize"), F.count_if(dirty).alias("undecodable"), F.count_if(secret).alias("sensitive"))


def changed_between(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths whose size, time or content differ between two scans of the same files."""
    mark = lambda d: d.select("path", F.xxhash64("size_bytes", "modified", "content").alias("mark"))
    a, b = mark(first), mark(second).withColumnRenamed("mark", "other")
    return a.join(b, "path", "full").where(~F.col("mark").eqNullSafe(F.col("other"))).select("path")


def ascending_violations(accepted: DataFrame) -> DataFrame:
    """Paths of an accepted list (position, path) that are not above their predecessor, unsafe or blocked."""
    before = accepted.select((F.col("position") + 1).alias("position"), F.col("path").alias("before"))
    late = F.col("before").isNotNull() & (F.col("before") >= F.col("path"))
    bad = late | ~paths.is_safe(F.col("path")) | paths.is_sensitive(F.col("path"))
    return accepted.join(before, "position", "left").where(bad).select("position", "path")


def documents(files: DataFrame) -> DataFrame:
    """Catalog rows of the Markdown corpus."""
    return catalog.build(readable(files.where(paths.is_document(F.col("path"))), catalog.MAX_BYTES))


def fallback(files: DataFrame, taken: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """Source files that are not documents already, in the ordered prefix that fits the caps."""
    own = readable(files.where(paths.is_source_file(F.col("path")))).join(taken.select("path"), "path", "left_anti")
    kind = paths.kind(F.col("path"))
    rows = own.select("path", kind.alias("kind"), paths.file_authority(F.col("path"), kind).alias("authority"), digest.text_hash(F.col("content")).alias("source_hash"), "size_bytes", text.title(F.col("path"), F.lit("")).alias("title"), "content")
    return catalog.capped(rows, "path", "size_bytes", max_files, max_total).drop("total_bytes", "position")


def hybrid(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents and fallback files as one list of index sources."""
    columns = ["path", "kind", "authority", "source_hash", "title", "content", "size_bytes"]
    return docs.withColumn("kind", F.lit("document")).select(*columns).unionByName(files.select(*columns))


def observation_digest(sources: DataFrame, *columns: str, by: str | None = None) -> DataFrame:
    """Number and digest of a set of sources, the hash of the canonical JSON list of their paths, hashes, sizes and kinds in order of path; with ``by`` of each of its sets.

    The sources of one observation are at most ``MAX_FILES``, so their entries meet in one
    row; more are an error. ``ordered.of_rows`` has a digest for any number.
    """
    names = sorted(columns or ("kind", "path", "size_bytes", "source_hash"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("path", F.to_json(F.struct(*names)).alias("entry")))), lambda e: e["entry"])
    listed = F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))
    n = F.count("*")
    counted = F.when(n > MAX_FILES, F.raise_error(F.lit("more sources than one observation takes")).cast("long")).otherwise(n)
    head = sources if by else sources.orderBy("path").limit(MAX_FILES + 1)
    return head.groupBy(*([by] if by else [])).agg(counted.alias("sources"), digest.text_hash(listed).alias("identity"))


def blocked_policies(blocked: DataFrame, targets: DataFrame, security: Column) -> DataFrame:
    """Of policy files that could not be read, those that apply: root ones, security's if relevant, and those above a target."""
    scoped = blocked.select("path", paths.directory(F.col("path")).alias("scope"), F.lower(paths.file_name(F.col("path"))).alias("file"))
    above = targets.select(F.explode(paths.ancestors(F.col("path"))).alias("scope")).distinct()
    nested = scoped.where((F.col("file") == "agents.md") & (F.col("scope") != "")).join(above, "scope", "left_semi")
    root = scoped.where((F.col("scope") == "") & ((F.col("file") == "agents.md") | ((F.col("file") == "security.md") & security)))
    return root.select("path").unionByName(nested.select("path")).distinct()
