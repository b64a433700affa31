"""Arrow plumbing shared by the operators that need a Python function over rows."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, out_rows: int = 20_000) -> DataFrame:
    """Apply a function that takes one row's columns and yields output tuples.

    ``make`` runs once in each task and returns the function, so it may load models there.
    Integers with nulls stay integers, and at most ``out_rows`` tuples (and their input
    batch) are held at a time.
    """
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, of = to_arrow_schema(fields), make()
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.extend(of(*row))
                if len(held) >= out_rows:
                    yield _batch(held, arrow)
                    held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for models that many tasks use."""
    return sys.modules.setdefault("_siftline_worker_cache", ModuleType("_siftline_worker_cache")).__dict__


BLOCK = 32
SHARES = 10_000


def free_name(wanted: str, *tables: DataFrame) -> str:
    """A column name like the wanted one that no column of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def need_free(table: DataFrame, *names: str) -> None:
    """An error where a table has a column that an operator is about to add, whatever the case."""
    clash = {c.lower() for c in table.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"the table has a column {', '.join(sorted(clash))} already")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(values: Column, size: int) -> Column:
    """An array cut into arrays of size elements; the array must not be empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, F.lit(size)))


def running(values: Column, combine: Callable[[Column, Column], Column], first: Column, levels: int = 2) -> Column:
    """The array of combine() of each element of values, all before it and first, which must be neutral.

    An aggregate copies its whole state at each step, so arrays are only ever built of a
    block's elements; blocks are continued from the running values of their totals.
    """
    none = F.slice(F.array(first), 1, 0)

    def chain(block: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(combine(acc["at"], x))).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, first, combine))
        return bound(running(totals, combine, first, levels - 1), lambda known: F.flatten(F.transform(blocks, lambda b, i: chain(b, F.when(i > 0, F.get(known, i - 1)).otherwise(first)))))

    if not levels:
        return chain(values, first)
    return bound(values, lambda v: F.when(F.size(v) > 0, bound(in_blocks(v, BLOCK), joined)).otherwise(none))


def share_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed (unique keys; count: how many of the rows have them), safe from hot keys.

    Fewer than ``SHARES`` keys can each hold over a ``SHARES``-th of all rows, so those are
    broadcast whatever the size of the data; the others are too small to crowd a task.
    """
    least = (keyed.agg(F.sum(count)).first()[0] or 0) / SHARES
    hot, cold = (keyed.where(c).drop(count) for c in (F.col(count) > least, F.col(count) <= least))
    cooled = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys, how).unionByName(cooled.join(cold, keys, how))
