"""Interval, test and sampling statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval, clamped to 0..1; both 0 without trials."""
    size = F.when(n > 0, n.cast("double"))
    p, z2 = successes / size, z * z
    mid = (p + z2 / (2 * size)) / (1 + z2 / size)
    half = z * F.sqrt(p * (1 - p) / size + z2 / (4 * size * size)) / (1 + z2 / size)
    zero = F.lit(0.0)
    # greatest() and least() pass over nulls, so the case without trials is told apart first.
    return F.when(n > 0, F.greatest(zero, mid - half)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(zero)


def mcnemar(b: Column, c: Column) -> Column:
    """Chi-square of the paired test with continuity correction; 0 without discordant pairs. Significant above 3.841."""
    d = F.greatest(F.abs(b - c).cast("double") - 1, F.lit(0.0))
    return F.when(b + c > 0, d * d / F.when(b + c > 0, b + c)).otherwise(F.lit(0.0))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that k draws of n without replacement hold one of c successes; with n draws or more, whether there is one."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda m, i: m * (n - c - i) / F.nullif(n - i, F.lit(0))) if k > 0 else F.lit(1.0)
    return F.when(n <= k, (c > 0).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; 0 for empty ones, unlike lengths or a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot / F.when(both > 0, both)).otherwise(F.lit(0.0))


def delta(base: Column, head: Column) -> Column:
    """Seven-valued change of a case between two stored runs. xpass counts as passing, error as failing; skip and
    xfail are neither."""
    good = lambda s: s.isin("pass", "xpass")
    bad = lambda s: s.isin("fail", "error")
    return (
        F.when(base.isNull(), "added").when(head.isNull(), "removed").when(good(base) & bad(head), "newly_failing").when(bad(base) & good(head), "newly_passing")
        .when(bad(base) & bad(head), "still_failing").when(good(base) & good(head), "still_passing").otherwise("unchanged")
    )


def document_delta(base: Column, head: Column) -> Column:
    """Six-valued change between two run documents, where whatever doesn't pass fails."""
    good = lambda s: s.isin("pass", "xpass")
    return (
        F.when(base.isNull(), "added").when(head.isNull(), "removed").when(good(base) & ~good(head), "newly_failing").when(~good(base) & good(head), "newly_passing")
        .when(~good(base) & ~good(head), "still_failing").otherwise("unchanged")
    )
