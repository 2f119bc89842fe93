"""Validation of JSON texts by a subset of JSON Schema, as Arrow-batched functions.

Supported: type, enum, const, required, properties, additionalProperties false, items, minItems, maxItems, minLength,
maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, anyOf, allOf, not.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, name: str) -> bool:
    if name in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (name == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[name])


def errors(schema: dict, value, at: str = "$") -> list[str]:
    """What is wrong with a parsed value, as ``path: keyword``."""
    out: list[str] = []
    bad = lambda word: out.append(f"{at}: {word}")
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is(value, n) for n in names):
            return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        bad("enum")
    if "const" in schema and value != schema["const"]:
        bad("const")
    if isinstance(value, dict):
        out += [f"{at}: required {k}" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        for k, v in value.items():
            if k in known:
                out += errors(known[k], v, f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                bad(f"additionalProperties {k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            bad("items")
        for k, v in enumerate(value):
            out += errors(schema.get("items", {}), v, f"{at}[{k}]")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            bad("length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            bad("pattern")
    if _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            bad("range")
        if value <= schema.get("exclusiveMinimum", float("-inf")) or value >= schema.get("exclusiveMaximum", float("inf")):
            bad("exclusive range")
    if "anyOf" in schema and not any(not errors(s, value, at) for s in schema["anyOf"]):
        bad("anyOf")
    for s in schema.get("allOf", []):
        out += errors(s, value, at)
    if "not" in schema and not errors(schema["not"], value, at):
        bad("not")
    return out


def validation_errors(schema: dict, text: Column) -> Column:
    """An array of errors; empty for a valid text, ``$: json`` for one that doesn't parse, null for null."""
    from chronofold.session import ship

    ship(SparkSession.active())

    def check(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return errors(schema, json.loads(t))
            except ValueError:
                return ["$: json"]

        return texts.map(one)

    return F.pandas_udf(check, "array<string>")(text)


def is_valid(schema: dict, text: Column) -> Column:
    return F.size(validation_errors(schema, text)) == 0
