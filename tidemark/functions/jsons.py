"""JSON of models' answers: recovery from prose, checks against a schema, evidence that exists."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```")


def _balanced(text: str) -> str | None:
    """From the first bracket to the one that closes it, brackets of the same kind counted wherever they stand."""
    found = re.search(r"[\[{]", text)
    if not found:
        return None
    opening, depth = found[0], 0
    closing = {"{": "}", "[": "]"}[opening]
    for m in re.finditer(re.escape(opening) + "|" + re.escape(closing), text[found.start() :]):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return text[found.start() : found.start() + m.end()]
    return None


def recovered(raw: str | None) -> str | None:
    """The JSON value in a text: what stands in the first code fence, or the whole, or the first balanced part of it; else None."""
    if raw is None:
        return None
    fence = _FENCE.search(raw.strip())
    given = fence[1].strip() if fence else raw.strip()
    for candidate in (given, _balanced(given)):
        try:
            json.loads(candidate or "")
            return candidate
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def recover(raw: pd.Series) -> pd.Series:
    return raw.map(recovered)


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Where a value departs from a schema of objects, arrays, strings, numbers, integers and booleans, as `path: what`."""
    kind = schema["type"]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "number": number, "integer": number and value == int(value)}[kind]
    if not fits:
        return [f"{path}: expected {kind if kind != 'integer' or number else 'number'}"]
    out = []
    if kind == "object":
        out += [f"{path}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k, inner in schema.get("properties", {}).items():
            out += violations(value[k], inner, f"{path}.{k}") if k in value else []
    elif kind == "array" and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{path}[{i}]")
    elif kind == "string":
        if value not in schema.get("enum", [value]):
            out.append(f"{path}: {value} not in enum")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: longer than {schema['maxLength']}")
    elif number:
        if value < schema.get("minimum", value):
            out.append(f"{path}: below minimum {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{path}: above maximum {schema['maximum']}")
    return out


def errors(raw: Column, schema: dict) -> Column:
    """Departures of JSON texts from a schema; one that is no JSON has the error `$: no JSON`, null is null."""

    @F.pandas_udf(ArrayType(StringType()))
    def check(texts: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            try:
                return violations(json.loads(x), schema)
            except ValueError:
                return ["$: no JSON"]

        return texts.map(one)

    return check(raw)


def cited(items: DataFrame, evidence: str, count: Column) -> DataFrame:
    """Items with those of their evidence numbers that lie within 1 to `count`; items left without any go."""
    return items.withColumn(evidence, F.filter(evidence, lambda i: i.between(F.lit(1), count))).filter(F.size(evidence) > 0)
