"""Code graph: import and call resolution, ordering, binding, validation and digests over node and edge tables."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest, screen
from . import ordered as rank_digests
from . import scripts

# What a specifier may stand for, in order.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
IMPORT_COLUMNS = "path string, kind string, specifier string, local_name string, imported string, start_line int, start_column int"
NODE_COLUMNS = "path string, kind string, name string, qualified_name string, start_line int, start_column int, end_line int, end_column int, source_hash string, exported boolean, excerpt string, excerpt_truncated boolean"
EXCERPT_LINES, EXCERPT_CHARS = 8, 2_000


def normal_path(path):
    """A joined relative path without dot segments, or null where it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(a, s):
        up = F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))
        return F.when(s == "..", up).otherwise(F.struct(F.concat(a["p"], F.array(s)).alias("p"), a["ok"].alias("ok")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.array_join(a["p"], "/")))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, specifier, …) with target: the first existing file a relative specifier can stand for.

    The ordered possibilities are exploded and joined with the files by equality.
    """
    base = normal_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), "specifier"))
    stem = F.regexp_replace("base", r"(?i)\.([mc]?[jt]s|[jt]sx)$", "")
    options = F.concat(F.array("base"), F.array(*[F.concat(stem, F.lit(s)) for s in SUFFIXES]), F.array(*[F.concat("base", F.lit(f"/index{s}")) for s in SUFFIXES]))
    keyed = imports.withColumn("import_key", F.xxhash64("path", "specifier"))
    local = keyed.where(F.startswith("specifier", F.lit("."))).select("import_key", "path", "specifier").distinct().withColumn("base", base).where("base IS NOT NULL")
    tried = local.select("import_key", F.posexplode(options).alias("pos", "target"))
    found = tried.join(files.select(F.col("path").alias("target")).distinct(), "target").groupBy("import_key").agg(F.min_by("target", "pos").alias("target"))
    return keyed.join(found, "import_key", "left").drop("import_key")


def call_edges(calls: DataFrame, nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """calls (path, from_id, target, identifier, lexically_shadowed) with to_id.

    A local symbol of that name comes first, then the exported symbol of the import's
    file; shadowed and property calls stay unresolved.
    """
    usable = ~F.col("lexically_shadowed") & (F.col("target") == F.col("identifier"))
    local = nodes.where("kind <> 'file'").groupBy("path", F.col("name").alias("identifier")).agg(F.min("node_id").alias("local_id"))
    exported = nodes.where("exported").groupBy(F.col("path").alias("target_path"), F.col("name").alias("imported")).agg(F.min("node_id").alias("export_id"))
    whole = nodes.where("kind = 'file'").select(F.col("path").alias("target_path"), F.col("node_id").alias("file_id"))
    bound = bindings.join(exported, ["target_path", "imported"], "left").join(whole, "target_path", "left")
    bound = bound.select("path", F.col("local_name").alias("identifier"), F.when(F.col("imported") == "*", F.col("file_id")).otherwise(F.col("export_id")).alias("bound_id"))
    bound = bound.groupBy("path", "identifier").agg(F.min("bound_id").alias("bound_id"))
    rows = calls.join(local, ["path", "identifier"], "left").join(bound, ["path", "identifier"], "left")
    return rows.withColumn("to_id", F.when(usable, F.coalesce("local_id", "bound_id"))).drop("local_id", "bound_id")


def with_ids(nodes: DataFrame) -> DataFrame:
    where = F.concat_ws(":", "start_line", "start_column")
    return nodes.withColumn("node_id", digest.graph_id("CGN-", F.col("path"), F.col("kind"), F.col("qualified_name"), where))


PLACE = ("path", "start_line", "start_column", "end_line", "end_column")


def edges(rows: DataFrame) -> DataFrame:
    """Edges (kind, from_id, to_id, target and the place's path, lines and columns) with ids; two calls at different places are two edges."""
    made = rows.select("kind", "from_id", "to_id", "target", *PLACE).distinct()
    return made.withColumn("edge_id", digest.edge_id(*[F.col(c) for c in ("kind", "from_id", "to_id", "target", *PLACE)]))


def ordered(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.orderBy("path", "start_line", "start_column", "kind", "node_id"), links.orderBy("kind", "from_id", F.coalesce("to_id", F.lit("")), "target", "edge_id")


FILE_FIELDS = ["path", "source_hash"]
NODE_FIELDS = ["path", "start_line", "start_column", "kind", "node_id", "source_hash"]
EDGE_FIELDS = ["kind", "from_id", "to_id", "target", "edge_id"]


def summary(files: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: counts, source_digest over the files in order, and graph_digest over files, nodes and edges in their order; repeated rows count."""
    marks = {}
    for name, rows, fields in (("files", files, FILE_FIELDS), ("nodes", nodes, NODE_FIELDS), ("edges", links, EDGE_FIELDS)):
        marks[name] = rank_digests.of_rows(rows, [c for c in fields if c in rows.columns], [c for c in fields if c in rows.columns])
    whole = digest.sha256_text("\n".join(f"{name} {n} {mark}" for name, (n, mark) in marks.items()))
    row = (*(n for n, _ in marks.values()), marks["files"][1], whole)
    return files.sparkSession.createDataFrame([row], "files long, nodes long, edges long, source_digest string, graph_digest string")


def shadowed(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """calls (path, place, identifier, …) with lexically_shadowed and the innermost scope_id that declares the identifier around the call.

    scopes: path, scope_id, from_place, to_place (exclusive) and the names it declares.
    Scopes are dealt by their length to grids of blocks of 1, 4, 16, … places, the first whose
    blocks are no shorter; there they lie in one block or two. A call looks into one block
    of each grid that has scopes, and meets scopes by equality of path, name and block.
    """
    length = F.col("to_place").cast("long") - F.col("from_place")
    bits = F.length(F.regexp_replace(F.bin(length - 1), "^0$", ""))
    declared = scopes.where("to_place > from_place").select("path", "scope_id", "from_place", "to_place", F.explode(F.array_distinct("names")).alias("identifier"), (F.ceil(bits / 2) * 2).cast("int").alias("level"))
    used = sorted(r["level"] for r in declared.select("level").distinct().collect())  # at most 33
    declared = declared.withColumn("block", F.explode(F.expr("sequence(shiftright(CAST(from_place AS BIGINT), level), shiftright(CAST(to_place AS BIGINT) - 1, level))")))
    levels = F.array(*[F.lit(k) for k in used]).cast("array<int>")
    asked = calls.select("path", "identifier", F.col("place").cast("long").alias("place")).distinct().withColumn("level", F.explode(levels)).withColumn("block", F.expr("shiftright(place, level)"))
    inside = asked.join(declared, ["path", "identifier", "level", "block"]).where("from_place <= place AND place < to_place")
    nearest = inside.groupBy("path", "identifier", "place").agg(F.max_by("scope_id", F.struct(F.col("from_place"), -F.col("to_place"), "scope_id")).alias("scope_id"))
    return calls.join(nearest, ["path", "identifier", "place"], "left").withColumn("lexically_shadowed", F.col("scope_id").isNotNull())


def binding_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files and manifest entries (path, source_hash) without an equal on the other side."""
    a = files.select("path", "source_hash").withColumn("in_graph", F.lit(True))
    b = manifest.select("path", "source_hash").withColumn("in_manifest", F.lit(True))
    return a.join(b, ["path", "source_hash"], "full").where("in_graph IS NULL OR in_manifest IS NULL").select("path", F.when(F.col("in_graph").isNull(), "not_in_graph").otherwise("not_in_manifest").alias("rule"))


def violations(files: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rule and id of whatever breaks the graph's contract."""
    wrong_id = nodes.where(~F.col("node_id").rlike("^CGN-[0-9a-f]{64}$")).select(F.lit("node_id_format").alias("rule"), F.col("node_id").alias("id"))
    twice = nodes.groupBy("node_id").count().where("count > 1").select(F.lit("duplicate_node").alias("rule"), F.col("node_id").alias("id"))
    ids = nodes.select(F.col("node_id").alias("k"))
    loose_from = links.join(ids, F.col("from_id") == F.col("k"), "left_anti").select(F.lit("edge_from").alias("rule"), F.col("edge_id").alias("id"))
    loose_to = links.where("to_id IS NOT NULL").join(ids, F.col("to_id") == F.col("k"), "left_anti").select(F.lit("edge_to").alias("rule"), F.col("edge_id").alias("id"))
    heads = nodes.where("kind = 'file'").groupBy("path").count()
    heads = files.join(heads, "path", "left").where("count IS NULL OR count <> 1").select(F.lit("file_node").alias("rule"), F.col("path").alias("id"))
    stale = nodes.join(files.select("path", F.col("source_hash").alias("file_hash")), "path", "left").where(~F.col("source_hash").eqNullSafe(F.col("file_hash"))).select(F.lit("node_hash").alias("rule"), F.col("node_id").alias("id"))
    leaky = nodes.where(screen.is_sensitive(F.col("excerpt"))).select(F.lit("sensitive_excerpt").alias("rule"), F.col("node_id").alias("id"))
    out = wrong_id
    for more in (twice, loose_from, loose_to, heads, stale, leaky):
        out = out.unionByName(more)
    return out


def _places(content: str):
    """A function from a character's place to its line and column (UTF-16), both from 1."""
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", content))]

    def of(place: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, place)
        return line, len(content[starts[line - 1] : place].encode("utf-16-le")) // 2 + 1

    return of


def extract_nodes(files: DataFrame) -> DataFrame:
    """Declarations and members of script files (path, source_hash, content) with their ends, found by scripts.declarations.

    A scan, not a parser; exact graphs come in as tables.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, source_hash, content in zip(batch["path"], batch["source_hash"], batch["content"], strict=True):
                content = content or ""
                all_lines, place = re.split(r"\r\n|\n|\r", content), _places(content)
                rows.append((path, "file", path.rsplit("/", 1)[-1], path, 1, 1, *place(len(content)), source_hash, True, *_excerpt(all_lines, 1, len(all_lines))))
                for kind, name, qualified, start, end, exported in scripts.declarations(content):
                    (line, column), (end_line, end_column) = place(start), place(end)
                    rows.append((path, kind, name, qualified, line, column, end_line, end_column, source_hash, exported, *_excerpt(all_lines, line, end_line)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_COLUMNS.split(", ")])

    return with_ids(files.select("path", "source_hash", "content").mapInPandas(run, NODE_COLUMNS))


def extract_imports(files: DataFrame) -> DataFrame:
    """path, kind (imports, exports), specifier, local_name, imported, start_line, start_column: rows for resolve_imports and, with its targets, the bindings of call_edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                place = _places(content or "")
                rows.extend((path, *found, *place(at)) for *found, at in scripts.imports(content or ""))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMPORT_COLUMNS.split(", ")])

    return files.select("path", "content").mapInPandas(run, IMPORT_COLUMNS)


def _excerpt(all_lines: list[str], line: int, end_line: int) -> tuple[str, bool]:
    body = "\n".join(all_lines[line - 1 : min(end_line, line - 1 + EXCERPT_LINES)])
    return body[:EXCERPT_CHARS], len(body) > EXCERPT_CHARS or end_line - line + 1 > EXCERPT_LINES


def per_file_rank(nodes: DataFrame) -> DataFrame:
    """nodes with their place within the file."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "start_column", "kind", "node_id")))
