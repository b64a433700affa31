"""Directory trees on a mount that all executors see: bounded walks with links told apart, and reads that notice changes.

The binary file source follows links, has no ceilings and opens a file without looking
again. Here every directory of a level is listed by the task that gets it, links are never
followed, and a file is looked at before, while and after it is read.

Defined results: an empty root gives no entries; names that are not UTF-8 are left out and
counted; a directory that goes away while the walk runs gives no entries; a root that is no
directory, or a link, is an error.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .scratch import cut

MAX_ENTRIES, MAX_DEPTH, MAX_BYTES = 100_000, 64, 1 << 20
DIRECTORIES_PER_TASK = 256

ENTRY = "path string, kind string, depth int, size_bytes long, modified_ns long, inode long, links long"
READ = "path string, state string, size_bytes long, content binary"


@dataclass
class Walk:
    """entries: ``ENTRY`` columns and ``excluded``; reasons: why a truncated walk ends early, none of a whole one."""

    entries: DataFrame
    reasons: list[str]

    def files(self) -> DataFrame:
        return self.entries.where((F.col("kind") == "file") & ~F.col("excluded")).drop("excluded")

    def counters(self) -> DataFrame:
        """One row: accepted_path_count, excluded_path_count (links and other entries that are no file or directory among them), symlink_count, directory_count."""
        e, out = self.entries, F.col("excluded")
        return e.agg(
            F.count_if((F.col("kind") == "file") & ~out).alias("accepted_path_count"),
            F.count_if(out).alias("excluded_path_count"),
            F.count_if(F.col("kind") == "link").alias("symlink_count"),
            F.count_if((F.col("kind") == "directory") & ~out).alias("directory_count"),
        )


def order(path: str | Column) -> Column:
    """Depth-first order with the entries of each directory sorted by name: a directory's own before names that go on after its name."""
    return F.replace(F.col(path) if isinstance(path, str) else path, F.lit("/"), F.lit("\0"))


def _kind(mode: int) -> str:
    return "link" if stat.S_ISLNK(mode) else "directory" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"


def _listed(root: str):  # noqa: ANN202
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for parent, depth in zip(frame["path"], frame["depth"], strict=True):
                rows = []
                try:
                    # a directory that became a link since it was listed is not entered
                    held = os.open(os.path.join(root, parent), os.O_RDONLY | os.O_DIRECTORY | (os.O_NOFOLLOW if parent else 0))
                except OSError:
                    continue
                try:
                    with os.scandir(held) as found:
                        for entry in found:
                            path = f"{parent}/{entry.name}" if parent else entry.name
                            try:
                                path.encode()
                                s = os.stat(entry.name, dir_fd=held, follow_symlinks=False)
                            except (UnicodeEncodeError, FileNotFoundError):
                                continue
                            rows.append((path, _kind(s.st_mode), int(depth) + 1, s.st_size, s.st_mtime_ns, s.st_ino, s.st_nlink))
                            if len(rows) == 10_000:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                finally:
                    os.close(held)
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return run


def walk(spark: SparkSession, root: str, excludes: list[str] | None = None, max_entries: int = MAX_ENTRIES, max_depth: int = MAX_DEPTH, truncate: bool = False) -> Walk:
    """Entries under root, level by level; sensitive and excluded ones are marked and not entered, links and special files are marked.

    Beyond a ceiling the walk is an error, or with ``truncate`` keeps the first
    ``max_entries`` in depth-first order and nothing below ``max_depth``, and says so.
    Directories that lie behind that many entries already are not listed.
    """
    if os.path.islink(root) or not os.path.isdir(root):
        raise PySparkValueError(f"no directory to walk: {root}")
    reasons: set[str] = set()
    level = spark.createDataFrame([("", 0)], "path string, depth int")
    all_entries: DataFrame | None = None
    while True:
        found = level.mapInPandas(_listed(root), ENTRY)
        hidden = paths.is_sensitive(F.col("path")) | paths.is_excluded(F.col("path"), excludes or []) | F.col("kind").isin("link", "other")
        found = found.withColumn("excluded", F.coalesce(hidden, F.lit(False)))
        found = cut(found if all_entries is None else all_entries.unionByName(found))
        depth, n, deeper = found.agg(F.max("depth"), F.count("*"), F.max(F.when((F.col("kind") == "directory") & ~F.col("excluded"), F.col("depth")))).first()
        if n > max_entries:
            if not truncate:
                raise PySparkValueError(f"more than {max_entries} entries under {root}")
            reasons.add("MAX_ENTRIES")
            found = cut(found.orderBy(order(F.col("path"))).limit(max_entries))
        last = all_entries is not None and depth == reached
        reached, all_entries = depth, found
        if depth is None or last or deeper != depth:
            break
        level = found.where((F.col("depth") == depth) & (F.col("kind") == "directory") & ~F.col("excluded")).select("path", "depth")
        if depth >= max_depth:
            if not level.mapInPandas(_listed(root), ENTRY).limit(1).isEmpty():
                if not truncate:
                    raise PySparkValueError(f"entries below depth {max_depth} under {root}")
                reasons.add("MAX_DEPTH")
            break
        level = level.repartition(max(1, -(-level.count() // DIRECTORIES_PER_TASK)))
    return Walk(all_entries, [r for r in ("MAX_ENTRIES", "MAX_DEPTH") if r in reasons])


def read(files: DataFrame, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, state, size_bytes, content of every file of a walk.

    state: ``stable``; ``oversize`` (over max_bytes, not read); ``changed`` if size, time,
    inode or kind differ between the walk, the opening and the end of the read, or a
    directory above became a link; ``gone``. Only stable files have content.
    """

    def mark(s: os.stat_result) -> tuple[int, int, int]:
        return s.st_size, s.st_mtime_ns, s.st_ino

    def one(path: str, seen: tuple[int, int, int]) -> tuple[str, int, bytes | None]:
        whole = os.path.join(root, path)
        if os.path.realpath(os.path.dirname(whole)) != os.path.join(os.path.realpath(root), os.path.dirname(path)).rstrip("/"):
            return "changed", seen[0], None
        try:
            if not stat.S_ISREG(os.lstat(whole).st_mode):
                return "changed", seen[0], None
            held = os.open(whole, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
        except FileNotFoundError:
            return "gone", seen[0], None
        except OSError:
            return "changed", seen[0], None
        with os.fdopen(held, "rb") as f:
            if mark(os.fstat(held)) != seen:
                return "changed", seen[0], None
            if seen[0] > max_bytes:
                return "oversize", seen[0], None
            content = f.read(max_bytes + 1)
            try:
                same = mark(os.fstat(held)) == seen == mark(os.lstat(whole)) and len(content) == seen[0]
            except FileNotFoundError:
                same = False
        return ("stable", seen[0], content) if same else ("changed", seen[0], None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for path, *seen in frame.itertuples(index=False, name=None):
                rows.append((path, *one(path, tuple(int(v) for v in seen))))
                held += len(rows[-1][3] or b"")
                if held > 32 << 20:
                    yield pd.DataFrame(rows, columns=["path", "state", "size_bytes", "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "state", "size_bytes", "content"])

    return files.select("path", "size_bytes", "modified_ns", "inode").mapInPandas(run, READ)


def demand_stable(reads: DataFrame) -> DataFrame:
    """The reads, where one of a file that changed or went away is an error once it is met."""
    lost = F.col("state").isin("changed", "gone")
    return reads.withColumn("state", F.when(lost, F.raise_error(F.concat(F.lit("file changed while it was read: "), "path")).cast("string")).otherwise(F.col("state")))


def files(walked: Walk, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files of a walk as ``repository.walk`` gives them (path, size_bytes, modified, content), read once and stable; oversize ones without content."""
    times = walked.files().select("path", F.timestamp_micros(F.expr("modified_ns div 1000")).alias("modified"))
    return demand_stable(read(walked.files(), root, max_bytes)).where("state IN ('stable', 'oversize')").join(times, "path").select("path", "size_bytes", "modified", "content")


def violations(accepted: DataFrame, counters: DataFrame) -> DataFrame:
    """(rule, path) of an accepted walk that another process handed over, with its counters.

    accepted: position, path; rules: ``unsafe``, ``blocked``, ``repeated`` and, without a
    path, ``count`` where accepted_path_count is not the number of paths or a count is negative.
    The order is checked by ``repository.ascending_violations``.
    """
    path = F.col("path")
    rules = F.array_compact(F.array(F.when(~F.coalesce(paths.is_safe(path), F.lit(False)), F.lit("unsafe")), F.when(paths.is_sensitive(path), F.lit("blocked"))))
    per_path = accepted.select(F.explode(rules).alias("rule"), "path")
    repeated = accepted.groupBy("path").count().where("count > 1").select(F.lit("repeated").alias("rule"), "path")
    total = accepted.agg(F.count("*").alias("n"))
    wrong = counters.join(total, F.lit(True)).where(~F.col("accepted_path_count").eqNullSafe(F.col("n")) | (F.col("excluded_path_count") < 0) | F.col("excluded_path_count").isNull())
    return per_path.unionByName(repeated).unionByName(wrong.select(F.lit("count").alias("rule"), F.lit(None).cast("string").alias("path")))
