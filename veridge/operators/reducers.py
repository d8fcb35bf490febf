"""Reductions at an edge's destination: what is aggregated, how it meets the old value, and when that counts as a change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reducer:
    """``idempotent``: applying the same message again changes nothing, so that steps may be repeated."""

    name: str
    agg: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    changed: Callable[[Column, Column], Column] = lambda old, new: ~old.eqNullSafe(new)
    idempotent: bool = True


def _or_old(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda old, got: F.when(got.isNull(), old).when(old.isNull(), got).otherwise(op(old, got))


MIN = Reducer("min", F.min, _or_old(F.least))
MAX = Reducer("max", F.max, _or_old(F.greatest))
SUM = Reducer("sum", F.sum, _or_old(lambda a, b: a + b), lambda old, new: F.lit(True), False)
PRODUCT = Reducer("product", F.product, _or_old(lambda a, b: a * b), lambda old, new: F.lit(True), False)
OR = Reducer("or", F.bool_or, _or_old(lambda a, b: a | b))
AND = Reducer("and", F.bool_and, _or_old(lambda a, b: a & b))
BIT_OR = Reducer("bit_or", F.bit_or, _or_old(lambda a, b: a.bitwiseOR(b)))
BIT_AND = Reducer("bit_and", F.bit_and, _or_old(lambda a, b: a.bitwiseAND(b)))
#: Writes where nothing is yet; of several messages the smallest.
SET_IF_UNSET = Reducer("setif", F.min, lambda old, got: F.coalesce(old, got), lambda old, new: old.isNull() & new.isNotNull())
#: All messages of a destination must agree; a query that reads one where they don't fails.
ASSIGN = Reducer("assign", lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.raise_error(F.lit("messages to assign differ"))), lambda old, got: F.coalesce(got, old))


def count_down(limit: int) -> Reducer:
    """Each message takes one off while the value is above ``limit``; changed where it reaches it."""
    return Reducer("count_down", lambda c: F.count(c), lambda old, got: F.when(got.isNull() | (old <= limit), old).otherwise(F.greatest(F.lit(limit), old - got)), lambda old, new: (old > limit) & (new == limit), False)


def count_down_value(limit: int) -> Reducer:
    """Each message takes its own amount off while the value is above ``limit``, where it stops; changed where it reaches it."""
    return Reducer("count_down_value", F.sum, lambda old, got: F.when(got.isNull() | (old <= limit), old).otherwise(F.greatest(F.lit(limit), old - got)), lambda old, new: (old > limit) & (new == limit), False)


def conditional(reducer: Reducer, allowed: Callable[[Column], Column]) -> Reducer:
    """``reducer`` where the old value allows it; elsewhere the old value stays and counts as unchanged."""
    ok = lambda old: F.coalesce(allowed(old), F.lit(False))
    return Reducer(f"conditional_{reducer.name}", reducer.agg, lambda old, got: F.when(ok(old), reducer.combine(old, got)).otherwise(old), lambda old, new: ok(old) & reducer.changed(old, new), reducer.idempotent)
