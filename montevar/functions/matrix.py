"""Small dense linear algebra on array columns, for any number of dimensions.

A symmetric matrix of order D is an ``array<double>`` of its upper triangle, row by row; the plan has the same few
expressions whatever D is.  Moments of many rows are gathered in long form: each row is exploded to the
D (D + 1) / 2 pairs of its values inside a code-generated stage, and one hash aggregate with a handful of buffers reduces
them, instead of one aggregation buffer (or several) per matrix entry.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: A pivot below this share of its diagonal entry is rounding.
PIVOT = 1e-13


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often (and in whatever lambda) it is used."""
    return F.transform(F.array(value), body)[0]


def _upto(n) -> Column:
    return F.sequence(F.lit(0), n if isinstance(n, Column) else F.lit(n - 1))


def packed_index(i, j, d: int):
    """Place of entry (i, j) in the packed upper triangle of order ``d`` (plain numbers or columns)."""
    if isinstance(i, Column) or isinstance(j, Column):
        i, j = (v if isinstance(v, Column) else F.lit(v) for v in (i, j))
        lo, hi = F.least(i, j), F.greatest(i, j)
        return lo * d - F.shiftright(lo * (lo - 1), 1) + hi - lo
    i, j = min(i, j), max(i, j)
    return i * d - i * (i - 1) // 2 + j - i


def _field(cells: Column, name: str) -> Column:
    return F.transform(cells, lambda c: c[name])


def pair_moments(rows: DataFrame, keys, values: str, d: int, masks: dict, sample: bool = False) -> DataFrame:
    """Per group and mask: ``n``, ``mean, min, max`` (arrays of ``d``) and ``cov`` (packed), with the mask's name in front.

    ``values`` is an array of ``d`` doubles; a row whose array is NULL counts nowhere, but its group is there.  ``masks``
    maps prefixes to conditions (None: all rows).  Covariances (of the population, or with ``sample`` those of a sample) are Spark's
    online aggregates: one pass, no shift, and every task reduces its rows to one buffer per group and pair
    before the shuffle, however many rows a group has.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    # Text, so that the optimizer folds the pairs into one constant: lambdas would form them anew for each row.
    pairs = F.from_json(F.lit(json.dumps([{"i": i, "j": j} for i in range(d) for j in range(i, d)])), "array<struct<i:int,j:int>>")
    flags = {pre: mask for pre, mask in masks.items() if mask is not None}
    flat = rows.select(*keys, F.col(values).alias("_v"), *[m.alias(f"_m{pre}") for pre, m in flags.items()], F.explode(pairs).alias("_p"))
    flat = flat.select(*keys, F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), *[f"_m{pre}" for pre in flags],
                       F.col("_v")[F.col("_p.i")].alias("_a"), F.col("_v")[F.col("_p.j")].alias("_b"))
    cov, aggs = F.covar_samp if sample else F.covar_pop, []
    for pre in masks:
        a, b = ((F.when(F.col(f"_m{pre}"), F.col(c)) if pre in flags else F.col(c)) for c in ("_a", "_b"))
        aggs += [F.count(a).alias(f"{pre}n"), F.avg(a).alias(f"{pre}mean"), F.min(a).alias(f"{pre}min"), F.max(a).alias(f"{pre}max"),
                 cov(a, b).alias(f"{pre}cov")]
    each = flat.groupBy(*keys, "_i", "_j").agg(*aggs)
    names = [f"{pre}{c}" for pre in masks for c in ("n", "mean", "min", "max", "cov")]
    cells = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_j", *names))).alias("_c"))
    own = F.filter("_c", lambda c: c["_i"] == c["_j"])
    out = []
    for pre in masks:
        out += [F.col(f"_c.{pre}n")[0].alias(f"{pre}n"), F.col(f"_c.{pre}cov").alias(f"{pre}cov")]
        out += [_field(own, f"{pre}{of}").alias(f"{pre}{of}") for of in ("mean", "min", "max")]
    return cells.select(*keys, *out)


def solved(entry: Callable[[Column, Column], Column], right: Column, d: int) -> Column:
    """``w`` with ``A w = right`` for the symmetric positive definite ``A`` whose entries are ``entry(i, j)``.

    Gauss-Jordan elimination, pivot by pivot; a zero pivot gives NULLs, no failure.
    """
    def eliminated(m: Column, p: Column) -> Column:
        pivot = F.transform(m[p], lambda v: F.try_divide(v, m[p][p]))
        return let(pivot, lambda q: F.transform(m, lambda row, i: F.when(i == p, q).otherwise(
            F.zip_with(row, q, lambda v, x: v - x * row[p]))))

    rows = F.transform(_upto(d), lambda i: F.concat(F.transform(_upto(d), lambda j: entry(i, j)), F.array(right[i])))
    return F.transform(F.aggregate(_upto(d), rows, eliminated), lambda row: row[d])


def cholesky(entry: Callable[[Column, Column], Column], d: int) -> Column:
    """Lower factor of the covariance matrix with entries ``entry(i, j)``: its columns, each of ``d`` values, end to end.

    A pivot of no more than rounding size (a variable that is a combination of earlier ones) gives a zero column, so
    that draws stay defined.
    """
    def column(done: Column, j: Column) -> Column:
        # What earlier columns leave of column j.
        rest = F.transform(_upto(d), lambda i: F.aggregate(
            done, entry(i, j), lambda left, c: left - c[i] * c[j]))
        return let(rest, lambda r: F.transform(r, lambda v, i: F.when(
            (i < j) | (r[j] <= F.abs(entry(j, j)) * PIVOT), F.lit(0.0)).otherwise(F.try_divide(v, F.sqrt(F.abs(r[j]))))))

    none = F.array().cast("array<array<double>>")
    return F.flatten(F.aggregate(_upto(d), none, lambda done, j: F.concat(done, F.array(column(done, j)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def quadratic_form(u: Column, packed: Column, d: int) -> Column:
    """``u' C u`` of a packed symmetric matrix."""
    return F.aggregate(_upto(d), F.lit(0.0), lambda s, i: s + u[i] * F.aggregate(
        _upto(d), F.lit(0.0), lambda t, j: t + packed[packed_index(i, j, d)] * u[j]))
