"""Ordered rules as one CASE expression: the first rule that holds wins."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_of(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """CASE WHEN over (condition, value) pairs, in order."""
    otherwise = default if isinstance(default, Column) else F.lit(default)
    if not branches:
        return otherwise
    (condition, value), *rest = branches
    expr = F.when(condition, value)
    for condition, value in rest:
        expr = expr.when(condition, value)
    return expr.otherwise(otherwise)


def first_regex(text: Column, rules: Iterable[tuple[str, str]], default: object = None) -> Column:
    """Value of the first pattern found in ``text`` (case-insensitive)."""
    return case_of([(text.rlike(f"(?i){p}"), F.lit(v)) for p, v in rules], default)


def first_contains(text: Column, rules: Iterable[tuple[str, str]], default: object = None) -> Column:
    """Value of the first literal contained in ``text`` (same case)."""
    return case_of([(text.contains(p), F.lit(v)) for p, v in rules], default)


def any_contains(text: Column, words: Iterable[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def behind_first_letters(pattern: str) -> str:
    """An alternation behind a test of the letters it can begin with: most places of a text fail it at once."""
    parts = pattern.split("|")
    if "(" in pattern or not all(re.match("[A-Z](?![?*{])", part) for part in parts):
        return pattern
    return f"(?=[{''.join(sorted({part[0] for part in parts}))}])(?:{pattern})"


def beginnings(patterns: Iterable[str]) -> list[str]:
    """Plain text that every alternative of the patterns begins with; a text without any of it matches none of them."""
    found = {re.match(r"(?:[A-Z0-9 ](?![?*{]))*", part).group() for p in patterns for part in p.split("|")}
    return sorted(w for w in found if not any(other in w for other in found - {w}))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def first_group(text: Column, patterns: Iterable[str], group: int = 1) -> Column:
    """Group of the first pattern that matches ``text``; null when none does."""
    branches = [(text.rlike(p), F.regexp_extract(text, p, group)) for p in patterns]
    return case_of(branches, None)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of one pattern, null (not '') when it does not take part in the match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
