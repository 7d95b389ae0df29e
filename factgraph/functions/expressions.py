"""Functions over expression trees and outcomes of open depth, as Arrow-batched functions of JSON text."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.functions import vocabulary as V

# Types of expression trees, and operators that compare.
RENAMED = {"REFERENCE": "SYMBOL_REFERENCE", "MEMBER": "PROPERTY_ACCESS", "CALL": "FUNCTION_CALL", "UNARY": "UNARY_OPERATION", "CONSTANT": "CONSTANT_REFERENCE"}
COMPARISONS = {"LESS_THAN", "LESS_THAN_OR_EQUAL", "GREATER_THAN", "GREATER_THAN_OR_EQUAL", "EQUAL", "NOT_EQUAL"}
EQUALITIES = {"EQUAL", "EQUALS", "NOT_EQUAL", "NOT_EQUALS"}


def _is_null(x: Any) -> bool:
    return isinstance(x, dict) and x.get("type") == "LITERAL" and "value" in x and x["value"] is None


def normalized(x: Any) -> Any:
    """An expression tree with the types that rules are read by."""
    if isinstance(x, list):
        return [normalized(v) for v in x]
    if not isinstance(x, dict):
        return x
    out = {k: normalized(v) for k, v in x.items()}
    kind = out.get("type")
    if kind == "BINARY":
        op = str(out.get("operator", ""))
        null = op in EQUALITIES and (_is_null(out.get("left")) or _is_null(out.get("right")))
        out["type"] = "NULL_CHECK" if null else "COMPARISON" if op in COMPARISONS else "LOGICAL_OPERATION" if op in ("AND", "OR") else "BINARY_OPERATION"
    elif kind in RENAMED:
        out["type"] = RENAMED[kind]
    return out


def is_impactful(x: Any) -> bool:
    """Whether an outcome changes what a caller or the data sees."""
    if isinstance(x, str):
        return x in V.IMPACTS
    x = x if isinstance(x, dict) else {}
    kind = x.get("kind")
    if kind == "THROW" and str(x.get("exception", "")) in V.GENERIC_EXCEPTIONS:
        return False
    if kind == "RETURN":
        value = x.get("expression") if isinstance(x.get("expression"), dict) else {}
        if value.get("type") == "EMPTY" or (value.get("type") == "LITERAL" and value.get("value") is None):
            return False
    if kind == "CONDITIONAL":
        return any(is_impactful(y) for side in ("trueOutcomes", "falseOutcomes") for y in (x.get(side) or []))
    return str(kind if kind is not None else x.get("type", "")) in V.IMPACTS


def collected(x: Any, key: str) -> list:
    """The values of a key, depth first with sorted keys."""
    if isinstance(x, dict):
        return [v for k in sorted(x) for v in ([x[k]] if k == key else collected(x[k], key))]
    return [v for y in x for v in collected(y, key)] if isinstance(x, list) else []


def numbers(x: Any) -> list[str]:
    if isinstance(x, bool):
        return []
    if isinstance(x, int | float):
        return [str(x)]
    if isinstance(x, dict):
        return [v for k in sorted(x) for v in numbers(x[k])]
    return [v for y in x for v in numbers(y)] if isinstance(x, list) else []


def _load(x: str | None) -> Any:
    try:
        return json.loads(x) if x is not None else None
    except ValueError:
        return x


def _dump(x: Any) -> str | None:
    return None if x is None else json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def normalize_expression(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _dump(normalized(_load(v))), na_action="ignore")


@F.pandas_udf(T.BooleanType())
def any_impactful(outcomes: pd.Series) -> pd.Series:
    """Of a JSON list of outcomes."""

    def one(v) -> bool:
        found = _load(v)
        return any(is_impactful(y) for y in found) if isinstance(found, list) else False

    return outcomes.map(one)


@F.pandas_udf(T.StringType())
def operators_of(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _dump(collected(_load(v), "operator")), na_action="ignore")


@F.pandas_udf(T.StringType())
def numbers_of(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _dump(numbers(_load(v))), na_action="ignore")
