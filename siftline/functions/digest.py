"""Content hashes, canonical JSON and stable ids.

Three JSON forms must not be mixed: canonical (keys sorted, absent fields left out),
declared (keys in declaration order, absent fields left out) and explicit (declared order
with nulls written).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_VALUES, MAX_DEPTH, MAX_BYTES = 100_000, 64, 128 << 20
SAFE_INTEGER = (1 << 53) - 1


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def sha256_text(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def _plain(value: Any, depth: int, count: list[int], drop: bool) -> Any:
    count[0] += 1
    if count[0] > MAX_VALUES or depth > MAX_DEPTH:
        raise ValueError("JSON value is too large or too deep")
    if value is None or isinstance(value, str | bool):
        return value
    if isinstance(value, int):
        if abs(value) > SAFE_INTEGER:
            raise ValueError("integer outside the safe range")
        return value
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("number is not finite")
        return int(value) if value.is_integer() else value
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): _plain(v, depth + 1, count, drop) for k, v in value.items() if not (drop and v is None)}
    if isinstance(value, Iterable):
        return [_plain(v, depth + 1, count, drop) for v in value]
    raise ValueError(f"not a JSON value: {type(value).__name__}")


def _utf16(key: str) -> bytes:
    return key.encode("utf-16-be", "surrogatepass")


def _ordered(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _ordered(value[k]) for k in sorted(value, key=_utf16)}
    return [_ordered(v) for v in value] if isinstance(value, list) else value


def dumps(value: Any, mode: str = "canonical") -> str:
    """JSON text of a value: canonical, declared or explicit."""
    plain = _plain(value, 0, [0], mode != "explicit")
    out = json.dumps(_ordered(plain) if mode == "canonical" else plain, separators=(",", ":"), ensure_ascii=False)
    if len(out.encode()) > MAX_BYTES:
        raise ValueError("JSON value has too many bytes")
    return out


def json_hash(value: Any, mode: str = "canonical") -> str:
    return sha256_text(dumps(value, mode))


@F.pandas_udf(StringType())
def _row_hash(rows: pd.DataFrame) -> pd.Series:
    def clean(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list | tuple):
            return [clean(x) for x in v]
        return None if isinstance(v, float) and v != v else v

    return pd.Series([json_hash({k: clean(v) for k, v in r.items()}) for r in rows.to_dict("records")], dtype=object)


def struct_hash(struct: Column) -> Column:
    """Canonical JSON hash of a struct, whatever characters its texts hold."""
    return _row_hash(struct)


def candidate_id(provider: Column, path: Column, line_start: Column, line_end: Column, symbol: Column, source_hash: Column, excerpt_hash: Column) -> Column:
    """Identity of a candidate; the fields are declared in key order, so to_json is canonical for control-free values."""
    identity = F.struct(
        excerpt_hash.alias("excerpt_hash"), line_end.alias("line_end"), line_start.alias("line_start"), path.alias("path"),
        provider.alias("provider"), source_hash.alias("source_hash"), symbol.alias("symbol"),
    )
    return text_hash(F.to_json(identity))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("DOC-"), F.sha2(path.cast("binary"), 256))


def source_id(path: Column, kind: Column, start_line: Column, end_line: Column, symbol: Column) -> Column:
    """Id of an index source; absent parts are explicit nulls."""
    parts = F.struct(path.alias("path"), kind.alias("kind"), start_line.alias("start_line"), end_line.alias("end_line"), symbol.alias("symbol"))
    return text_hash(F.to_json(parts, {"ignoreNullFields": "false"}))


def graph_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256))


def edge_id(kind: Column, from_id: Column, to_id: Column, target: Column, path: Column, *place: Column) -> Column:
    """Id of a graph edge: the hash of the canonical JSON list of its ends and its place, so two calls of one target differ."""
    texts = F.to_json(F.array(kind, from_id, F.coalesce(to_id, F.lit("")), target, path))
    listed = F.concat(F.regexp_replace(texts, r"\]$", ","), F.concat_ws(",", *[p.cast("string") for p in place]), F.lit("]"))
    return F.concat(F.lit("CGE-"), F.sha2(listed.cast("binary"), 256))


def hash_distance(expected: Column, text: Column) -> Column:
    """Whether a stored hash no longer is that of the text."""
    return ~expected.eqNullSafe(text_hash(text))
