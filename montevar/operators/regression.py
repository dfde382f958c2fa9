"""One penalised linear model per instrument, fitted as a grouped aggregation.

The model minimises ``1/n sum (y - b - w.x)^2 / 2 + alpha |w|^2 / 2`` (squared
loss, L2 penalty, unpenalised intercept).  Its minimiser solves
``(C + alpha I) w = c`` with ``C`` the population covariance of the features and
``c`` their covariance with the label, and ``b = mean(y) - w.mean(x)``.  The
moments are one code-generated hash aggregate keyed by instrument and pair of variables (partial aggregation before
the shuffle, so a hot instrument never lands whole in one task); the d x d solve works on array
columns of the one-row-per-instrument result, with a plan of the same size for any d.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from montevar.functions.exprs import SPARK
from montevar.functions.linalg import spd_solve_stages
from montevar.functions.matrix import dot, let, packed_index, pair_moments, quadratic_form, solved


#: Residuals this small against the label (squared) are rounding.
EXACT = 1e-24


def weight_name(feat: str) -> str:
    base = feat[:-5] if feat.endswith("_feat") else feat
    return f"w_{base}"


def _cxx(i: int, j: int) -> str:
    i, j = min(i, j), max(i, j)
    return f"cxx_{i}_{j}"


def _moments(rows: DataFrame, feats, key: str, label: str, masks: dict) -> DataFrame:
    """Per instrument and mask: moments of features and label (the last value) over the complete rows.

    ``masks`` maps a prefix to a condition.  A row with a NULL feature or label counts nowhere.
    """
    cols = [*feats, label]
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    values = F.when(complete, F.array(*[F.col(c).cast("double") for c in cols]))
    return pair_moments(rows.withColumn("_z", values), key, "_z", len(cols), masks)


def model_moments(design_rows: DataFrame, feats, key: str = "symbol", label: str = "label") -> DataFrame:
    """Per instrument: ``n``, means ``my, mx_i``, and population covariances ``vy, cxx_i_j, cxy_i``."""
    d = len(feats)
    cov = lambda i, j: F.col("cov")[packed_index(i, j, d + 1)]
    return _moments(design_rows, feats, key, label, {"": None}).select(
        key, "n", F.col("mean")[d].alias("my"), *[F.col("mean")[i].alias(f"mx_{i}") for i in range(d)],
        *[cov(i, j).alias(_cxx(i, j)) for i in range(d) for j in range(i, d)], *[cov(i, d).alias(f"cxy_{i}") for i in range(d)],
        cov(d, d).alias("vy"))


def _solve(moments: DataFrame, d: int, alpha: float) -> DataFrame:
    """Adds the model ``_w`` (array) and ``intercept`` to the moments."""
    order = d + 1
    entry = lambda i, j: F.col("cov")[packed_index(i, j, order)] + F.when(i == j, F.lit(alpha)).otherwise(F.lit(0.0))
    right = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.col("cov")[packed_index(i, d, order)])
    weights = let(right, lambda r: solved(entry, r, d))
    out = moments.withColumn("_w", weights)
    # The label's mean comes after those of the features: the pairing leaves it out.
    return out.withColumn("intercept", F.col("mean")[d] - dot(F.col("_w"), F.slice("mean", 1, d)))


def ridge_stages(feats, alpha: float, ops=SPARK):
    """Projection stages from the moment columns to ``w_<factor>`` and ``intercept``."""
    d = len(feats)
    pre = [(f"_a_{i}_{j}", ops.add(ops.col(_cxx(i, j)), ops.lit(alpha)) if i == j else ops.col(_cxx(i, j)))
           for i in range(d) for j in range(d)]
    outs = [weight_name(f) for f in feats]
    stages = [pre] + spd_solve_stages(lambda i, j: f"_a_{i}_{j}", lambda i: f"cxy_{i}", d, outs, "r", ops)
    intercept = ops.col("my")
    for i, w in enumerate(outs):
        intercept = ops.sub(intercept, ops.mul(ops.col(w), ops.col(f"mx_{i}")))
    stages.append([("intercept", intercept)])
    return stages


def fit_linear(design_rows: DataFrame, feats, alpha: float = 1e-4, key: str = "symbol",
               label: str = "label") -> DataFrame:
    """Models table ``symbol, n, intercept, w_<factor> ...``."""
    out = _solve(_moments(design_rows, feats, key, label, {"": None}), len(feats), alpha)
    return out.select(key, "n", "intercept", *[F.col("_w")[i].alias(weight_name(f)) for i, f in enumerate(feats)])


def fit_and_score(design_rows: DataFrame, feats, alpha: float = 1e-4, ratio: float = 0.8,
                  key: str = "symbol", label: str = "label", fit_on: str = "all") -> DataFrame:
    """Fit on all rows and score R2 on the oldest rows, in one grouped aggregation.

    Besides the fit moments, the same ``groupBy(symbol)`` collects centred moments
    of the test rows (``k > ratio * max k``).  With residual ``e = y - b - w.x``:
    ``SS_res = n_t (Var(e) + mean(e)^2)``, ``Var(e) = Var(y) - 2 w.Cov(x, y) +
    w' Cov(x, x) w`` and ``SS_tot = n_t Var(y)``.  So no second pass over the rows
    and no join of rows with models is needed.  Output: the models columns plus
    ``n_test`` and ``score`` (NULL below two test rows).

    A constant test label (smallest equal to largest) scores 1 when predicted exactly, else 0.

    ``fit_on='all'`` fits on every row (the held-out rows are also fitted, as in
    the study being reproduced); ``'train'`` fits on the newest ``ratio`` share only.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    from montevar.operators.features import split_by_rank
    d = len(feats)
    rows = split_by_rank(design_rows, ratio, key)
    fit_mask = None if fit_on == "all" else F.col("is_train")
    mom = _moments(rows, feats, key, label, {"": fit_mask, "t_": ~F.col("is_train")}).withColumnRenamed("t_n", "n_test")
    nt = F.col("n_test")
    # The residual is u . (x, y) - intercept.
    u = F.concat(F.transform("_w", lambda w: -w), F.array(F.lit(1.0)))
    fitted = _solve(mom, d, alpha).withColumn("_u", u)
    fitted = fitted.select("*", quadratic_form(F.col("_u"), F.col("t_cov"), d + 1).alias("_ve"),
                           (dot(F.col("_u"), F.col("t_mean")) - F.col("intercept")).alias("_me"),
                           F.col("t_min")[d].alias("t_lo"), F.col("t_max")[d].alias("t_hi"),
                           F.col("t_cov")[packed_index(d, d, d + 1)].alias("_vy"))
    scored = fitted.select("*", (nt * (F.greatest(F.col("_ve"), F.lit(0.0)) + F.col("_me") * F.col("_me"))).alias("ss_res"),
                           (nt * F.col("_vy")).alias("ss_tot"))
    # The moments leave rounding residue; a constant label is told by its range.
    score = (F.when(nt < 2, F.lit(None).cast("double"))
             .when(F.col("t_lo") == F.col("t_hi"), F.when(_exact("ss_res", "n_test", "t_hi"), 1.0).otherwise(0.0))
             .otherwise(1 - F.try_divide(F.col("ss_res"), F.col("ss_tot"))))
    return scored.select(key, "n", "intercept", *[F.col("_w")[i].alias(weight_name(f)) for i, f in enumerate(feats)], "n_test", score.alias("score"))


def _exact(ss_res: str, n: str, label: str):
    return F.col(ss_res) <= F.col(n) * EXACT * F.greatest(F.col(label) * F.col(label), F.lit(EXACT))


def prediction_of(feats) -> "F.Column":
    pred = F.col("intercept")
    for f in feats:
        pred = pred + F.col(weight_name(f)) * F.col(f)
    return pred


def predict(rows: DataFrame, models: DataFrame, feats, key: str = "symbol") -> DataFrame:
    """Rows joined to their instrument's model, with ``prediction = b + w.x``.

    Rows and models are both hash-partitioned by instrument upstream, so the join
    reuses that partitioning; the models table is never broadcast (it grows with
    the number of instruments).
    """
    m = models.select(key, "intercept", *[weight_name(f) for f in feats])
    return rows.join(m, key).withColumn("prediction", prediction_of(feats))


def r2_by_symbol(pred: DataFrame, key: str = "symbol", label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """Coefficient of determination per instrument: ``symbol, n, score``.

    ``1 - SS_res / SS_tot``; a constant label scores 1.0 when predicted exactly and
    0.0 otherwise; instruments with fewer than two rows get no score (NULL) and
    are dropped, as are NaN scores.
    """
    res = (F.col(label) - F.col(prediction))
    g = pred.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                              F.sum(res * res).alias("ss_res"), F.min(label).alias("lo"), F.max(label).alias("hi"),
                              (F.var_pop(label) * F.count(label)).alias("ss_tot"))
    score = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
             .when(F.col("lo") == F.col("hi"), F.when(_exact("ss_res", "n", "hi"), 1.0).otherwise(0.0))
             .otherwise(1 - F.try_divide(F.col("ss_res"), F.col("ss_tot"))))
    out = g.select(key, "n", score.alias("score"))
    return out.where(F.col("score").isNotNull() & ~F.isnan("score"))


def r2_summary(scores: DataFrame) -> DataFrame:
    from montevar.operators.series import summarize
    return summarize(scores, "score")
