"""JSON Schema rules as columns: one pass over a column of JSON texts gives every violation as a row.

A schema (a subset: const, enum, type, minLength, maxLength, a limit of UTF-8 bytes,
pattern, minimum, maximum, minItems, maxItems, uniqueItems, items, required, properties,
additionalProperties false) is compiled to expressions over a VARIANT; nothing is parsed in
Python. A value of the wrong type is not looked into.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<path:string,rule:string>>"
SAFE_INTEGER = (1 << 53) - 1
BYTES = "maxUtf8Bytes"
KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\()", "null": "^VOID$"}


def violations(rows: DataFrame, column: str, schema: dict[str, Any], keys: list[str]) -> DataFrame:
    """keys, path and rule of all that a column of JSON texts has against a schema; texts that are no JSON, or have a key twice, break the rule json."""
    return checked(rows, column, schema, keys).where("rule IS NOT NULL")


def checked(rows: DataFrame, column: str, schema: dict[str, Any], keys: list[str]) -> DataFrame:
    """violations, and for each text without any a row whose path and rule are null. A filter on them is no second check of the text."""
    parsed = rows.select(*keys, F.try_parse_json(F.col(column)).alias("_value"))
    none = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))
    found = F.when(F.col("_value").isNull(), none).otherwise(checks(F.col("_value"), "$", schema, F.lit("$")))
    return parsed.select(*keys, F.inline_outer(found))


def checks(root: Column, at: str, schema: dict[str, Any], path: Column) -> Column:
    """array<struct(path, rule)> of what the value at a place of root, a VARIANT, has against the schema. The value is there."""
    value = F.try_variant_get(root, at, "variant")
    kind = F.schema_of_variant(value)
    always, typed, nested = [], [], []
    broken = lambda bad, rule: F.when(bad, F.struct(path.alias("path"), F.lit(rule).alias("rule")))
    if "const" in schema:
        always.append(broken(~_equals(root, at, kind, schema["const"]), "const"))
    if "enum" in schema:
        some = F.lit(False)
        for option in schema["enum"]:
            some = some | _equals(root, at, kind, option)
        always.append(broken(~some, "enum"))
    of = schema.get("type")
    fits = F.lit(True)
    if of:
        number = F.try_variant_get(root, at, "double")
        fits = kind.rlike(KINDS["number" if of == "integer" else of])
        if of == "integer":
            fits = fits & F.coalesce((number == F.floor(number)) & (F.abs(number) <= SAFE_INTEGER), F.lit(False))
        always.append(broken(~fits, "type"))
    text = F.when(kind == "STRING", F.try_variant_get(root, at, "string"))
    number = F.when(kind.rlike(KINDS["number"]), F.try_variant_get(root, at, "double"))
    items = F.when(kind.rlike(KINDS["array"]), F.try_variant_get(root, at, "array<variant>"))
    for rule, bad in (
        ("minLength", lambda x: F.char_length(text) < x),
        ("maxLength", lambda x: F.char_length(text) > x),
        (BYTES, lambda x: F.octet_length(text) > x),
        ("pattern", lambda x: ~text.rlike(x)),
        ("minimum", lambda x: number < x),
        ("maximum", lambda x: number > x),
        ("minItems", lambda x: F.size(items) < x),
        ("maxItems", lambda x: F.size(items) > x),
        ("uniqueItems", lambda x: F.lit(bool(x)) & (F.size(F.array_distinct(F.transform(items, lambda i: F.to_json(i)))) < F.size(items))),
    ):
        if rule in schema:
            typed.append(broken(bad(schema[rule]), rule))
    for key in schema.get("required", []):
        gone = kind.rlike(KINDS["object"]) & F.try_variant_get(root, _step(at, key), "variant").isNull()
        typed.append(F.when(gone, F.struct(F.concat(path, F.lit(f".{key}")).alias("path"), F.lit("required").alias("rule"))))
    if schema.get("additionalProperties") is False:
        keys = F.when(kind.rlike(KINDS["object"]), F.json_object_keys(F.to_json(value)))
        other = F.array_except(keys, F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))
        nested.append(F.transform(other, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("rule"))))
    if isinstance(schema.get("items"), dict):
        nested.append(F.flatten(F.transform(items, lambda item, k: checks(item, "$", schema["items"], F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))))
    for key, own in schema.get("properties", {}).items():
        here = _step(at, key)
        there = kind.rlike(KINDS["object"]) & F.try_variant_get(root, here, "variant").isNotNull()
        nested.append(F.when(there, checks(root, here, own, F.concat(path, F.lit(f".{key}")))))
    none = F.array().cast(FOUND)
    flat = lambda found: F.array_compact(F.array(*found)).cast(FOUND) if found else none
    inner = F.concat(flat(typed), *[F.coalesce(n.cast(FOUND), none) for n in nested])
    return F.concat(flat(always), F.when(fits, inner).otherwise(none))


def _step(at: str, key: str) -> str:
    return f"{at}['{key}']"


def _equals(root: Column, at: str, kind: Column, wanted: Any) -> Column:
    """Whether the value is a given string, number, boolean or null."""
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        same, of = F.try_variant_get(root, at, "boolean") == wanted, "boolean"
    elif isinstance(wanted, int | float):
        same, of = F.try_variant_get(root, at, "double") == float(wanted), "number"
    elif isinstance(wanted, str):
        same, of = F.try_variant_get(root, at, "string") == wanted, "string"
    else:
        raise ValueError(f"no constant: {json.dumps(wanted)}")
    return kind.rlike(KINDS[of]) & F.coalesce(same, F.lit(False))
