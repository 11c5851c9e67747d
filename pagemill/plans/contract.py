"""Contracts of tables as JSON Schema, compiled to one column expression per rule."""

from __future__ import annotations

import json
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.files import read_text

_URI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$"
_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$"


def _is_moment(text: Column) -> Column:
    # Letters of either case are allowed, and a leap second, which timestamps do not know.
    usual = F.regexp_replace(F.upper(text), r"T([0-9]{2}:[0-9]{2}):60(?![0-9])", "T$1:59")
    return text.rlike(_DATE_TIME) & F.try_to_timestamp(usual).isNotNull()


_FORMATS: dict[str, Callable[[Column], Column]] = {"uri": lambda value: value.rlike(_URI), "date-time": _is_moment}


def _enum(value: Column, allowed: list) -> Column:
    return ~value.isin(*[entry for entry in allowed if entry is not None])


# Keyword -> (value, its argument) to a column that is true where the rule is broken, null for a null value.
_KEYWORDS: dict[str, Callable[[Column, object], Column]] = {
    "minLength": lambda value, least: F.length(value) < least,
    "maxLength": lambda value, most: F.length(value) > most,
    "minimum": lambda value, least: value < least,
    "exclusiveMinimum": lambda value, least: value <= least,
    "maximum": lambda value, most: value > most,
    "exclusiveMaximum": lambda value, most: value >= most,
    "minItems": lambda value, least: F.size(value) < least,
    "maxItems": lambda value, most: F.size(value) > most,
    "uniqueItems": lambda value, wanted: F.size(value) > F.size(F.array_distinct(value)) if wanted else F.lit(False),
    "pattern": lambda value, pattern: ~value.rlike(pattern),
    "enum": _enum,
    "const": lambda value, only: value != only,
    "format": lambda value, name: ~_FORMATS[name](value),
}
# What says nothing about a column's values: types are the table's own.
_SILENT = {"type", "title", "description", "examples", "default", "$comment", "$schema", "$id", "items"}


def _allows_null(rule: dict) -> bool:
    kinds = rule.get("type", [])
    return "null" in ([kinds] if isinstance(kinds, str) else kinds)


def compile_rules(schema: dict) -> dict[str, Column]:
    """``column.keyword`` -> column that is true where a row breaks the rule.

    A required column may not be null unless its type allows it. Rules of array items
    hold for every item; items that are null break none. Keywords and formats that
    are not known raise ``ValueError``, so no rule is passed over.
    """
    rules: dict[str, Column] = {}
    fields = schema.get("properties", {})
    for name in schema.get("required", []):
        if not _allows_null(fields.get(name, {})):
            rules[f"{name}.required"] = F.col(name).isNull()
    for name, rule in fields.items():
        for keyword, argument in rule.items():
            if keyword not in _SILENT:
                rules[f"{name}.{keyword}"] = _broken(name, keyword, argument)(F.col(name))
        for keyword, argument in rule.get("items", {}).items():
            if keyword not in _SILENT:
                test = _broken(name, keyword, argument)
                rules[f"{name}.{keyword}"] = F.exists(name, test)
    return rules


def _broken(name: str, keyword: str, argument: object) -> Callable[[Column], Column]:
    """The test of one rule; false, not null, for a null value."""
    if keyword not in _KEYWORDS or (keyword == "format" and argument not in _FORMATS):
        raise ValueError(f"unknown rule {keyword!r}: {argument!r} of column {name!r}")
    return lambda value: F.coalesce(_KEYWORDS[keyword](value, argument), F.lit(False))


def document_contract() -> dict:
    """The contract of documents that comes with the package."""
    return json.loads(resources.files("pagemill").joinpath("document_contract.json").read_text(encoding="utf-8"))


def load_contract(spark: SparkSession, path: str) -> dict:
    """A contract from a file in any file system that Spark reads."""
    return json.loads(read_text(spark, path))
