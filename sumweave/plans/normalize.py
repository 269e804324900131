"""Rewrites that Catalyst doesn't make: tightest bounds, range contradictions, canonical and unique predicates."""

from __future__ import annotations

from dataclasses import replace

from .spec import U64, ColumnRef, Filter, QuerySpec


def _tightest(column: ColumnRef, filters: list[Filter]) -> list[Filter] | None:
    """The filters of one column, each needed; None if they contradict each other."""
    low = max((f.constant for f in filters if f.op == ">"), default=-1)
    high = min((f.constant for f in filters if f.op == "<"), default=U64)
    equal = {f.constant for f in filters if f.op == "="}
    if len(equal) > 1 or any(not low < k < high for k in equal) or high - low < 2:
        return None
    if equal:
        return [Filter(column, "=", equal.pop())]
    return [Filter(column, op, k) for op, k, trivial in ((">", low, -1), ("<", high, U64)) if k != trivial]


def normalize(spec: QuerySpec) -> QuerySpec:
    """The same rows with fewer predicates. A query without rows is marked empty and keeps its filters."""
    joins = tuple(dict.fromkeys(j.canonical() for j in spec.joins if j.left != j.right))
    by: dict[ColumnRef, list[Filter]] = {}
    for f in spec.filters:
        by.setdefault(f.column, []).append(f)
    tight = [_tightest(c, fs) for c, fs in by.items()]
    if any(t is None for t in tight):
        return replace(spec, joins=joins, filters=tuple(dict.fromkeys(spec.filters)), empty=True)
    return replace(spec, joins=joins, filters=tuple(f for t in tight for f in t))
