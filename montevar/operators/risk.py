"""Value-at-risk, conditional value-at-risk, trial statistics and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from montevar.functions.exprs import SPARK
from montevar.functions.matrix import let
from montevar.functions.numeric import (poisson1_from_uniform, poisson1_thresholds, poisson_from_uniform, poisson_thresholds,
                                        uniform_of)


# Rank accuracy of the approximate bracket (its ends are within n / accuracy ranks of the quantile)
# and the number of value ranges the bracket is cut into.
BRACKET_ACCURACY = 100_000
RANGES = 4096
#: The same for each of many groups.
GROUP_RANGES = 256


def _selected(df: DataFrame, col: str, p: float) -> DataFrame:
    """One row ``value, tail_mean``: the element at rank ``max(ceil(p n), 1)`` and the mean of the elements at or below it.

    Exact and distributed, one way at every size.  An approximate quantile pass brackets the answer; a second pass
    counts and sums the rows of ``RANGES`` value ranges inside the bracket and of the two ranges outside it, so that
    a running count over that many rows names the range that holds the rank, wherever the
    bracket lies.  Only that range's different values meet in one task: about ``8 n / accuracy / RANGES``
    of them, with equal values merged first.
    """
    from montevar.operators.scenarios import as_scalar
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    x = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    margin = 4.0 / BRACKET_ACCURACY
    ends = [max(p - margin, 0.0), min(p + margin, 1.0)]
    st = as_scalar(x.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", ends, BRACKET_ACCURACY).alias("_b"))
                   .select("n", F.col("_b")[0].alias("lo"), F.col("_b")[1].alias("hi")))
    rank = F.greatest(F.ceil(F.lit(float(p)) * st["n"]).cast("double"), F.lit(1.0))
    # Non-decreasing in x: -1 below the bracket, RANGES + 1 above it.
    part = F.coalesce(F.try_divide(F.col("_x") - st["lo"], st["hi"] - st["lo"]), F.lit(0.0)) * RANGES
    part = (F.when(F.col("_x") < st["lo"], -1).when(F.col("_x") > st["hi"], RANGES + 1)
            .otherwise(F.floor(part).cast("int")))
    ranged = x.select("_x", part.alias("_r"))
    run = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_w"), F.sum("_x").alias("_s"))
    cum = counts.select("_r", "_w", "_s", F.sum("_w").over(run("_r")).alias("_cw"), F.sum("_s").over(run("_r")).alias("_cs"))  # at most RANGES + 3 rows
    before = F.struct("_r", (F.col("_cw") - F.col("_w")).alias("before"), (F.col("_cs") - F.col("_s")).alias("sum"))
    hit = as_scalar(cum.where(F.col("_cw") >= rank).agg(F.min(before).alias("h")).select("h._r", "h.before", "h.sum"))
    inside = ranged.where(F.col("_r") == hit["_r"]).groupBy("_x").agg(F.count(F.lit(1)).alias("_w"))
    cum = inside.select("_x", (F.sum("_w").over(run("_x")) + hit["before"]).alias("_cw"),
                        (F.sum(F.col("_w") * F.col("_x")).over(run("_x")) + hit["sum"]).alias("_cs"))
    found = F.min(F.struct("_x", (F.col("_cs") / F.col("_cw")).alias("mean")))
    return cum.where(F.col("_cw") >= rank).agg(found.alias("f")).select(F.col("f._x").alias("value"), F.col("f.mean").alias("tail_mean"))


def lower_quantile(df: DataFrame, col: str, p: float, name: str = "value") -> DataFrame:
    """One row: the element at rank ``max(ceil(p n), 1)`` of the sorted non-NULL values; equals ``percentile_disc(p)``."""
    return _selected(df, col, p).select(F.col("value").alias(name))


def quantile_by(df: DataFrame, key, col: str, p: float, accuracy: int = 10_000) -> DataFrame:
    """Per group: ``<key>, n, quantile, tail_mean`` of the non-NULL values.

    ``quantile`` is the element at rank ``max(ceil(p n), 1)`` and equals ``percentile_disc(p)``, ``tail_mean`` is the
    mean of the values at or below it.  A NULL key is a group; groups without a value are left out.

    The selection of ``lower_quantile`` for many groups at once: an approximate bracket for each group, counts and
    sums of ``GROUP_RANGES`` value ranges inside it and of the two outside, and the different values of the
    one range that holds the group's rank.  Partial sums are made before every shuffle, so a group that holds a third of
    all rows leaves a task as a few hundred rows; no group is gathered or sorted whole.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    keys = [key] if isinstance(key, str) else list(key)
    x = df.select(*keys, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    margin = 4.0 / accuracy
    bracket = F.percentile_approx("_x", [max(p - margin, 0.0), min(p + margin, 1.0)], accuracy)
    n = F.count(F.lit(1))
    st = (x.groupBy(*keys).agg(n.alias("_n"), bracket.alias("_b"))
          .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"),
                  F.greatest(F.ceil(F.lit(float(p)) * F.col("_n")), F.lit(1)).alias("_rank")))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * GROUP_RANGES
    # Non-decreasing in x: -1 below the bracket, GROUP_RANGES + 1 above it.
    part = (F.when(F.col("_x") < F.col("_lo"), -1).when(F.col("_x") > F.col("_hi"), GROUP_RANGES + 1)
            .otherwise(F.floor(inner).cast("int")))
    ranged = x.join(st, same).select(*keys, "_x", part.alias("_r"), "_n", "_rank")
    counts = ranged.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_w"), F.sum("_x").alias("_s"),
                                             F.first("_n").alias("_n"), F.first("_rank").alias("_rank"))
    run = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.select("*", F.sum("_w").over(run).alias("_cw"), F.sum("_s").over(run).alias("_cs"))   # GROUP_RANGES + 3 rows a group
    hit = (cum.where((F.col("_cw") >= F.col("_rank")) & (F.col("_cw") - F.col("_w") < F.col("_rank")))
           .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_r").alias("_hr"),
                   (F.col("_cw") - F.col("_w")).alias("_bw"), (F.col("_cs") - F.col("_s")).alias("_bs")))
    inside = (ranged.join(hit, same & (F.col("_r") == F.col("_hr")))
              .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_w"), *[F.first(c).alias(c) for c in ("_n", "_rank", "_bw", "_bs")]))
    run = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = inside.select("*", (F.sum("_w").over(run) + F.col("_bw")).alias("_cw"),
                        (F.sum(F.col("_w") * F.col("_x")).over(run) + F.col("_bs")).alias("_cs"))
    return (cum.where((F.col("_cw") >= F.col("_rank")) & (F.col("_cw") - F.col("_w") < F.col("_rank")))
            .select(*keys, F.col("_n").alias("n"), F.col("_x").alias("quantile"), (F.col("_cs") / F.col("_cw")).alias("tail_mean")))


def value_at_risk_by(returns: DataFrame, key="symbol", p: float = 0.05, col: str = "fluct") -> DataFrame:
    """Per group: ``<key>, n, value_at_risk, conditional_var`` of its own returns."""
    out = quantile_by(returns, key, col, p)
    return out.withColumnsRenamed({"quantile": "value_at_risk", "tail_mean": "conditional_var"})


def value_at_risk(df: DataFrame, p: float = 0.05, col: str = "average_return") -> DataFrame:
    """One row ``value_at_risk``: the element at rank ceil(p n) of the sorted returns."""
    return lower_quantile(df, col, p, "value_at_risk")


def conditional_var(df: DataFrame, p: float = 0.05, col: str = "average_return") -> DataFrame:
    """One row ``value_at_risk, conditional_var``: mean of the returns at or below VaR, from the passes that select VaR."""
    return _selected(df, col, p).select(F.col("value").alias("value_at_risk"), F.col("tail_mean").alias("conditional_var"))


def historical_var(returns: DataFrame, p: float = 0.05, col: str = "avg_return") -> DataFrame:
    """One row ``value_at_risk, conditional_var`` of the realised returns themselves."""
    return conditional_var(returns, p, col)


def variance_covariance_var(returns: DataFrame, p: float = 0.05, col: str = "avg_return") -> DataFrame:
    """One row ``value_at_risk, conditional_var`` of a normal with the returns' mean and sample deviation."""
    from statistics import NormalDist
    z = NormalDist().inv_cdf(p)
    tail = NormalDist().pdf(z) / p
    one = returns.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    return one.select((F.col("m") + z * F.col("s")).alias("value_at_risk"),
                      (F.col("m") - tail * F.col("s")).alias("conditional_var"))


def trial_stats(df: DataFrame, col: str = "average_return") -> DataFrame:
    """min, max, count and population stddev in one pass."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"),
                  F.count(col).alias("count"), F.stddev_pop(col).alias("stddev"))


def ci_indices(num: int, probability: float) -> tuple[int, int]:
    """0-based positions of the interval ends among the sorted replicate values."""
    return int(num * probability / 2 - 1), int(num * (1 - probability / 2))


#: Ranges of about equally many trials into which the replicates' sums are cut (a power of two).
BOOT_RANGES = 256


@dataclass(frozen=True)
class Statistic:
    """A statistic of a weighted sample: partial sums, at most one cut, and a finisher.

    ``sums`` maps names to functions of a value's deviation d from a fixed origin near the data; their weighted sums are
    taken over the whole sample and over the values at or below the cut, beside ``w``, the sum of weights.  The cut is
    the value at rank ``max(ceil(rank * w), 1)``, or the deviation that ``at`` makes of the whole sample's sums.
    ``finish(whole, below, cut, origin)`` makes the statistic; ``cut`` is the value itself.  Sums of different
    tasks add up, so any such statistic takes one resampling pass.
    """

    name: str
    finish: Callable[[dict, dict, Column, Column], Column]
    sums: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    rank: float | None = None
    at: Callable[[dict], Column] | None = None


def _d(d: Column) -> Column:
    return d


def _dd(d: Column) -> Column:
    return d * d


def _stddev(whole: dict, *_) -> Column:
    mean = whole["d"] / whole["w"]
    return F.sqrt(F.greatest(whole["dd"] / whole["w"] - mean * mean, F.lit(0.0)))


def statistics(p: float = 0.05) -> dict[str, Statistic]:
    """The statistics that go by name; VaR and CVaR at level ``p``."""
    return {s.name: s for s in (
        Statistic("var", lambda whole, below, cut, origin: cut, rank=p),
        Statistic("cvar", lambda whole, below, cut, origin: origin + below["d"] / below["w"], {"d": _d}, rank=p),
        Statistic("mean", lambda whole, below, cut, origin: origin + whole["d"] / whole["w"], {"d": _d}),
        Statistic("stddev", _stddev, {"d": _d, "dd": _dd}))}


def _weight(seed: int, id_col: str):
    """Poisson(1) multiplicity of a row in a replicate, a pure function of ``seed:replicate:id``."""
    key = F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(":"), F.col(id_col).cast("string"))
    return uniform_of(key)


def _weighted(pairs: DataFrame, seed: int, id_col: str, keep) -> DataFrame:
    u = pairs.select(*keep, _weight(seed, id_col).alias("_u"))
    # w > 0 exactly when u exceeds P(w = 0); filtering on u keeps the pushed-down
    # predicate to one comparison instead of the whole inverse-CDF sum.
    u = u.where(F.col("_u") > F.lit(poisson1_thresholds()[0]))
    return u.select(*keep, poisson1_from_uniform(F.col("_u"), SPARK).alias("w"))


def resample_weights(df: DataFrame, num: int = 100, seed: int = 1, id_col: str = "trial_id",
                     keep=("average_return",)) -> DataFrame:
    """Bootstrap resampling as Poisson(1) multiplicities: ``replicate, <keep>, w`` (w >= 1).

    Replicate ``r`` holds row ``i`` ``w`` times, ``w ~ Poisson(1)`` drawn from the key
    ``seed:r:id`` - sampling with replacement at fraction 1.0, deterministic and
    independent of partitioning.  Rows with weight 0 are not emitted.
    """
    pairs = df.select(*keep, id_col, F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("replicate"))
    return _weighted(pairs, seed, id_col, ["replicate", *keep])


#: Equal rows that one task draws for.
RESAMPLE_CHUNK = 4096


def row_key(cols) -> Column:
    """Text of a row: each value with its length in front, so different rows never share it; NULL is ``-``."""
    cells = []
    for c in cols:
        text = F.col(f"`{c}`").cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws(",", *cells)


def resample_rows(df: DataFrame, fraction: float = 1.0, seed: int = 1) -> DataFrame:
    """Sampling with replacement as rows: every row Poisson(``fraction``) times, for tables without an id.

    The draw of a row is keyed by ``seed``, the row's text and its number among equal rows, so the result
    depends on the rows alone, never on their order or partitioning.  Equal rows are counted first; a row with many
    equals is dealt over tasks in chunks.  Columns and types stay; maps cannot be compared and are refused by Spark.
    """
    if not fraction > 0:
        raise ValueError("fraction must be positive")
    cols = df.columns
    quoted = [F.col(f"`{c}`") for c in cols]
    counted = df.groupBy(*quoted).agg(F.count(F.lit(1)).alias("__n"))
    chunks = counted.select(*quoted, "__n", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) DIV {RESAMPLE_CHUNK}"))).alias("__c"))
    # Chunks of one row go to different tasks; rows that hash alike stay spread by their own values.
    dealt = chunks.repartition(*quoted, "__c") if len(cols) else chunks
    first = F.col("__c") * RESAMPLE_CHUNK
    last = F.least(first + RESAMPLE_CHUNK, F.col("__n")) - 1
    drawn = dealt.select(*quoted, F.explode(F.sequence(first, last)).alias("__i"))
    u = uniform_of(F.concat(F.lit(f"{seed}:"), row_key(cols), F.lit(":"), F.col("__i").cast("string")))
    # More than none exactly when u exceeds the probability of none.
    drawn = drawn.select(*quoted, u.alias("__u")).where(F.col("__u") > F.lit(poisson_thresholds(fraction)[0]))
    times = poisson_from_uniform(F.col("__u"), fraction).cast("int")
    return drawn.select(*quoted, F.explode(F.sequence(F.lit(1), times)).alias("__t")).drop("__t")


def _range_of(x: Column, bounds: Column) -> Column:
    """How many of the ``BOOT_RANGES - 1`` ascending bounds are below ``x``, by bisection; never falls as ``x`` grows."""
    steps = F.array(*[F.lit(BOOT_RANGES >> k) for k in range(1, BOOT_RANGES.bit_length())])
    both = F.struct(x.alias("x"), bounds.alias("b"))
    return let(both, lambda p: F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.element_at(p["b"], at + step) < p["x"], at + step).otherwise(at)))


def replicate_values(df: DataFrame, wanted: Sequence[Statistic], num: int = 100, seed: int = 1, col: str = "average_return",
                     id_col: str = "trial_id") -> DataFrame:
    """``statistic, replicate, v``: each statistic of each bootstrap replicate.

    Every row meets every replicate inside its task, where partial sums per (replicate, range of values) are kept:
    the shuffle holds ``num x BOOT_RANGES`` rows of sums of each task whatever the number of trials.  Ranges are cut
    at approximate ranks, so each holds about equally many trials however heavy the tails are.  A running sum
    over a replicate's ranges names the one in which a cut lies; only that range's trials are weighted
    once more, merged by value and ranked.
    """
    from montevar.operators.scenarios import as_scalar
    terms = list(dict.fromkeys(f for s in wanted for f in s.sums.values()))
    sums_of = lambda s, prefix: {"w": F.col(f"{prefix}w")} | {n: F.col(f"{prefix}{terms.index(f)}") for n, f in s.sums.items()}
    names = ["w", *map(str, range(len(terms)))]
    rows = df.select(F.col(col).cast("double").alias("_x"), id_col).where(F.col("_x").isNotNull())
    shares = [k / BOOT_RANGES for k in range(1, BOOT_RANGES)]
    bounds = rows.agg(F.percentile_approx("_x", shares, 16 * BOOT_RANGES).alias("b")).select("b").scalar()
    origin = as_scalar(rows.agg(F.min("_x").alias("lo")))["lo"]
    # Columns first: subqueries may not be written inside a lambda.
    rows = rows.select("_x", id_col, bounds.alias("_b"), origin.alias("_o"))
    ranged = rows.select("_x", id_col, _range_of(F.col("_x"), F.col("_b")).alias("_r"), (F.col("_x") - F.col("_o")).alias("_d"))
    weighted = resample_weights(ranged, num, seed, id_col, keep=("_r", "_d"))
    sums = weighted.groupBy("replicate", "_r").agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * f(F.col("_d"))).alias(str(k)) for k, f in enumerate(terms)])
    whole = Window.partitionBy("replicate")                         # at most BOOT_RANGES rows each
    run = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sums.select("replicate", "_r", *[(F.sum(n).over(run) - F.col(n)).alias(f"_b{n}") for n in names],
                      *[F.sum(n).over(whole).alias(f"_a{n}") for n in names], F.col("w").alias("_own"))
    # The range of each cut: a rank lies where the running sum reaches it, a value where bisection puts it.
    spots = []
    for k, s in enumerate(wanted):
        if s.at is not None:
            rank, value = F.lit(None).cast("double"), s.at(sums_of(s, "_a"))
        else:
            rank, value = F.greatest(F.ceil(F.lit(float(s.rank if s.rank is not None else 0.0)) * F.col("_aw")).cast("double"), F.lit(1.0)), F.lit(None).cast("double")
        spots.append(F.struct(F.lit(k).alias("s"), rank.alias("rank"), value.alias("value")))
    spread = (cum.withColumn("_spot", F.explode(F.array(*spots))).select("*", "_spot.*").drop("_spot")
              .select("*", bounds.alias("_bounds"), origin.alias("_o")))
    target = _range_of(F.col("value") + F.col("_o"), F.col("_bounds"))
    spread = spread.withColumn("_t", target).drop("_bounds")
    reached = F.when(F.col("rank").isNotNull(), F.col("_bw") + F.col("_own") >= F.col("rank")).otherwise(F.col("_r") >= F.col("_t"))
    before = F.struct("_r", *[f"_b{n}" for n in names])
    # A cut above all trials of a replicate lies in its last range.
    at = spread.groupBy("replicate", "s").agg(
        F.coalesce(F.min(F.when(reached, before)), F.max(before)).alias("h"),
        *[F.first(c).alias(c) for c in ("rank", "value", "_o", *[f"_a{n}" for n in names])])
    at = at.select("replicate", "s", F.col("h._r").alias("_hr"), "rank", (F.col("_o") + F.col("value")).alias("_cut"), "_o",
                   *[F.col(f"h._b{n}").alias(f"_b{n}") for n in names], *[f"_a{n}" for n in names])
    # A few rows per replicate, a parameter: the side may be broadcast.
    near = ranged.join(F.broadcast(at), F.col("_r") == F.col("_hr"))
    held = ["rank", "_cut", "_o", *[f"_b{n}" for n in names], *[f"_a{n}" for n in names]]
    near = _weighted(near, seed, id_col, ["replicate", "s", "_x", "_d", *held])
    merged = near.groupBy("replicate", "s", "_x").agg(F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("_d", *held)])
    run = Window.partitionBy("replicate", "s").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = merged.select("replicate", "s", "_x", *held, F.sum("w").over(run).alias("_iw"), *[
        F.sum(F.col("w") * f(F.col("_d"))).over(run).alias(f"_i{k}") for k, f in enumerate(terms)])
    fits = F.when(F.col("rank").isNotNull(), F.col("_bw") + F.col("_iw") >= F.col("rank")).otherwise(F.col("_x") <= F.col("_cut"))
    # The first value that reaches a rank; the last that is no greater than a cut.
    inside = F.when(F.col("rank").isNotNull(), F.col("_x")).otherwise(-F.col("_x"))
    picked = running.groupBy("replicate", "s").agg(
        F.min(F.when(fits, F.struct(inside.alias("k"), "_x", *[f"_i{n}" for n in names]))).alias("h"), *[F.first(c).alias(c) for c in held])
    flat = picked.select("replicate", "s", F.coalesce("_cut", "h._x").alias("_cut"), "_o", *[f"_a{n}" for n in names],
                         *[(F.col(f"_b{n}") + F.coalesce(f"h._i{n}", F.lit(0.0))).alias(f"_b{n}") for n in names])
    value, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, s in enumerate(wanted):
        done = s.finish(sums_of(s, "_a"), sums_of(s, "_b"), F.col("_cut"), F.col("_o"))
        value, name = F.when(F.col("s") == k, done).otherwise(value), F.when(F.col("s") == k, F.lit(s.name)).otherwise(name)
    return flat.select(name.alias("statistic"), "replicate", value.alias("v"))


def replicate_stats(df: DataFrame, num: int = 100, p: float = 0.05, seed: int = 1, col: str = "average_return",
                    id_col: str = "trial_id") -> DataFrame:
    """Per replicate: ``replicate, var, cvar, mean, stddev`` (population) of the resample."""
    long = replicate_values(df, list(statistics(p).values()), num, seed, col, id_col)
    return long.groupBy("replicate").agg(*[F.max(F.when(F.col("statistic") == s, F.col("v"))).alias(s) for s in STATISTICS])


#: Statistics that go by name.
STATISTICS = ("var", "cvar", "mean", "stddev")


def bootstrap_ci(df: DataFrame, stat="var", num: int = 100, p: float = 0.05,
                 probability: float = 0.05, seed: int = 1, col: str = "average_return",
                 id_col: str = "trial_id") -> DataFrame:
    """Bootstrap confidence intervals of one or several statistics: ``STATISTICS`` by name (``'both'``: VaR and CVaR)
    or any ``Statistic`` of the caller's.

    One resampling pass serves all statistics; ends are the sorted replicate
    values at ``int(num p/2 - 1)`` and ``int(num (1 - p/2))`` (0-based).  Output
    one row per statistic: ``statistic, lower, upper``.
    """
    chosen = ["var", "cvar"] if stat == "both" else [stat] if isinstance(stat, (str, Statistic)) else list(stat)
    known = statistics(p)
    if not chosen or any(isinstance(s, str) and s not in known for s in chosen):
        raise ValueError(f"stat must be 'both', of {STATISTICS}, or a Statistic")
    wanted = [known[s] if isinstance(s, str) else s for s in chosen]
    if len({s.name for s in wanted}) < len(wanted):
        raise ValueError("statistics must have different names")
    lo, hi = ci_indices(num, probability)
    if not 0 <= lo <= hi < num:
        raise ValueError("too few replicates for an interval of this probability")
    long = replicate_values(df, wanted, num, seed, col, id_col)
    # ``num`` rows per statistic (a parameter): ranking them is bounded work.
    ranked = long.withColumn("pos", F.row_number().over(Window.partitionBy("statistic").orderBy("v")) - 1)
    return ranked.groupBy("statistic").agg(
        F.max(F.when(F.col("pos") == lo, F.col("v"))).alias("lower"),
        F.max(F.when(F.col("pos") == hi, F.col("v"))).alias("upper"))


__all__ = ["value_at_risk", "conditional_var", "historical_var", "variance_covariance_var", "trial_stats", "bootstrap_ci",
           "replicate_stats", "replicate_values", "Statistic", "statistics",
           "resample_weights", "resample_rows", "ci_indices", "lower_quantile", "quantile_by", "value_at_risk_by"]
