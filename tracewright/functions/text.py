"""String similarities that Spark lacks, in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jaro(a: Column | str, b: Column | str) -> Column:
    """Jaro similarity; null if either string is."""
    a, b = _column(a), _column(b)
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    none = F.expr("cast(array() as array<int>)")

    def step(taken: Column, i: Column) -> Column:
        """Places of b that letters of a have taken so far (-1: none), with the next letter's."""
        low, high = F.greatest(i - reach, F.lit(0)), F.least(i + reach, m - 1)
        near = F.when(low <= high, F.sequence(low, high)).otherwise(none)
        free = F.filter(near, lambda j: (F.get(y, j) == F.get(x, i)) & ~F.array_contains(taken, j))
        return F.concat(taken, F.array(F.coalesce(F.get(free, 0), F.lit(-1))))

    taken = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), none, step)
    first = F.filter(F.transform(taken, lambda j, i: F.when(j >= 0, F.get(x, i))), lambda c: c.isNotNull())
    second = F.transform(F.array_sort(F.filter(taken, lambda j: j >= 0)), lambda j: F.get(y, j))

    def score(pair: Column) -> Column:
        k = F.size(pair["u"]).cast("double")
        moved = F.floor(F.size(F.filter(F.arrays_zip(pair["u"], pair["v"]), lambda p: p["u"] != p["v"])) / 2)
        return F.when(k > 0, (k / n + k / m + (k - moved) / k) / 3).otherwise(0.0)

    # Through one element, so that the matches are found once.
    out = F.get(F.transform(F.array(F.struct(first.alias("u"), second.alias("v"))), score), 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(out)


def jaro_winkler(a: Column | str, b: Column | str, known: Column | str | None = None) -> Column:
    """Jaro-Winkler similarity with prefix weight 0.1 over four letters, from the ``known`` Jaro similarity if given."""
    a, b = _column(a), _column(b)
    same = sum((F.when((F.length(a) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    return F.get(F.transform(F.array(jaro(a, b) if known is None else _column(known)), lambda j: j + F.lit(0.1) * same * (F.lit(1.0) - j)), 0)


def normalised(column):
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]", "")
