"""Vector clocks as map<string, bigint>, conflict resolution, roles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROLES = ["reader", "writer", "admin"]


def merged(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def dominates(a: Column, b: Column) -> Column:
    """a is nowhere behind b and somewhere ahead."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    return F.forall(both, lambda d: d >= 0) & F.exists(both, lambda d: d > 0)


def resolve(a: Column, at_a: Column, b: Column, at_b: Column) -> Column:
    """local if it dominates, remote if that does, else the later one; local on a tie."""
    return F.when(dominates(a, b), "local").when(dominates(b, a), "remote").when(at_b > at_a, "remote").otherwise("local")


def allowed(role: Column, needed: Column) -> Column:
    """Unknown roles are readers."""
    rank = lambda c: F.greatest(F.array_position(F.array(*[F.lit(r) for r in ROLES]), c), F.lit(1))
    return rank(role) >= rank(needed)
