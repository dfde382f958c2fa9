"""Monte-Carlo market scenarios and the portfolio's trial returns.

Scenario ``t`` draws d standard normals keyed by ``(seed, factor, t)`` and maps
them through ``x = mu + L z`` (``L L^T = Sigma``), on arrays, so any number of factors has the same plan.
The factor moments and the Cholesky factor are a single row, consumed as one scalar subquery, so the trial
stage is a narrow projection over ``spark.range(n)``: no shuffle, no cross join,
results independent of partitioning and of task retries.

The portfolio return of a scenario is the mean over instruments of
``b_s + w_s . feat(x)``, which equals ``mean(b) + mean(w) . feat(x)``: the
instrument dimension collapses to one aggregate row instead of a
scenarios x instruments product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from montevar.functions.matrix import cholesky, let, packed_index
from montevar.functions.numeric import normal_of, uniform_of
from montevar.operators.features import feature_of
from montevar.operators.moments import cov_name
from montevar.operators.regression import weight_name


def chol_name(i: int, j: int) -> str:
    return f"l_{i}_{j}"


def scenario_params(moments: DataFrame, factors) -> DataFrame:
    """One row: ``mean_<f>`` and the lower Cholesky factor ``l_i_j`` of the covariance of wide moments."""
    d = len(factors)
    row = factor_arrays(draw_params(moment_arrays(moments, factors), d), d)
    return row.select(*[F.col("mean")[i].alias(f"mean_{f}") for i, f in enumerate(factors)],
                      *[F.col("chol")[j * d + i].alias(chol_name(i, j)) for i in range(d) for j in range(i + 1)])


def moment_arrays(moments: DataFrame, factors) -> DataFrame:
    """``mean, cov`` (packed) of the wide moments row."""
    d = len(factors)
    return moments.select(F.array(*[F.col(f"mean_{f}") for f in factors]).alias("mean"),
                          F.array(*[F.col(cov_name(factors[i], factors[j])) for i in range(d) for j in range(i, d)]).alias("cov"))


def draw_params(arrays: DataFrame, d: int) -> DataFrame:
    """One row ``v``: the means and, column by column, the Cholesky factor, in one array."""
    factor = let(F.col("cov"), lambda c: cholesky(lambda i, j: c[packed_index(i, j, d)], d))
    return arrays.select(F.concat("mean", factor).alias("v"))


def factor_arrays(params: DataFrame, d: int) -> DataFrame:
    """The same row as ``mean, chol``."""
    return params.select(F.slice("v", 1, d).alias("mean"), F.slice("v", d + 1, d * d).alias("chol"))


def as_scalar(one_row: DataFrame) -> "ScalarRow":
    """A one-row DataFrame of numeric columns as one scalar subquery."""
    return ScalarRow(one_row)


class ScalarRow:
    """Fields of a one-row DataFrame, read from a single array-valued scalar subquery.

    The values travel as one ``array<double>`` so the optimizer keeps exactly one
    subquery (a struct would be split into one subquery per field, each
    re-running the producing plan); every reference reuses its result.
    """

    def __init__(self, one_row: DataFrame):
        self.names = list(one_row.columns)
        arr = F.array(*[F.col(c).cast("double") for c in self.names])
        self._value = one_row.select(arr.alias("v")).scalar()

    def getField(self, name: str) -> Column:
        return self._value[self.names.index(name)]

    __getitem__ = getField


def draw(spark: SparkSession, arrays: DataFrame, d: int, n: int, seed: int = 1259, partitions: int | None = None) -> DataFrame:
    """``trial_id, x`` (array of ``d``): n draws from the normal with the moments ``mean, cov`` of the one row ``arrays``.

    For any number of factors the plan is the same; a combination of other factors has no noise of its own.
    """
    params = draw_params(arrays, d).select("v").scalar()
    if partitions is None:
        # About a thousand trials per task (the bootstrap multiplies each row by its
        # replicate count downstream), never more tasks than the cluster's slots.
        partitions = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 1000)))
    # A column first: subqueries may not be written inside a lambda.
    base = spark.range(0, n, 1, partitions).select(F.col("id").alias("trial_id"), params.alias("_v"))

    def uniform(j: Column, which: str) -> Column:
        return uniform_of(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(f":{which}:"), F.col("trial_id").cast("string")))

    index = F.sequence(F.lit(0), F.lit(d - 1))
    z = F.transform(index, lambda j: normal_of(uniform(j, "a"), uniform(j, "b")))
    x = let(F.struct(z.alias("z"), F.col("_v").alias("v")), lambda p: F.transform(index, lambda i: F.aggregate(
        F.sequence(F.lit(0), i), p["v"][i], lambda total, j: total + p["v"][d + j * d + i] * p["z"][j])))
    return base.select("trial_id", x.alias("x"))


def sample_scenarios(spark: SparkSession, moments: DataFrame, factors, n: int,
                     seed: int = 1259, partitions: int | None = None) -> DataFrame:
    """``trial_id, x_<f> ...``: n draws from N(mu, Sigma) (multivariate normal) of the wide moments row."""
    drawn = draw(spark, moment_arrays(moments, factors), len(factors), n, seed, partitions)
    return drawn.select("trial_id", *[F.col("x")[i].alias(f"x_{f}") for i, f in enumerate(factors)])


def mean_model(models: DataFrame, feats) -> DataFrame:
    """One row: averages of intercept and weights over instruments with a full model.

    Incomplete models are excluded through conditional averages rather than a
    filter: a filter on the solved weights would be pushed below the solve
    projections and inline the whole elimination into one predicate.
    """
    wcols = [weight_name(f) for f in feats]
    ok = F.col("intercept").isNotNull()
    for w in wcols:
        ok = ok & F.col(w).isNotNull()
    m = models.select("intercept", *wcols, ok.alias("_ok"))
    return m.agg(F.avg(F.when(F.col("_ok"), F.col("intercept"))).alias("intercept"),
                 *[F.avg(F.when(F.col("_ok"), F.col(w))).alias(w) for w in wcols],
                 F.count(F.when(F.col("_ok"), 1)).alias("n_models"))


def score_scenarios(scenarios: DataFrame, models: DataFrame, factors, feats=None) -> DataFrame:
    """``trial_id, average_return``: mean predicted instrument return per scenario."""
    feats = feats or [f"{f}_feat" for f in factors]
    mm = as_scalar(mean_model(models, feats))
    ret = mm.getField("intercept")
    for f, feat in zip(factors, feats):
        ret = ret + mm.getField(weight_name(feat)) * feature_of(F.col(f"x_{f}"))
    return scenarios.select("trial_id", ret.alias("average_return"))
