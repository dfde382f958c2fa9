"""Scenario results of every instrument, and the explicit scenario x model average.

An instrument's return in a scenario is ``b + w . feat(x)``.  Scenarios are a parameter of the study, instruments
grow: the scenarios are packed into blocks of bounded size, every model meets every block inside its task, and
what leaves the task is one row per (instrument, block) with sums and the block's lower tail, or one
partial sum per scenario.  The pairs themselves are never rows of a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from montevar.operators.features import feature_of
from montevar.operators.regression import weight_name

#: Doubles in a block of scenarios (8 MB), and in all blocks that are still copied to every executor.
BLOCK_VALUES = 1 << 20
BROADCAST_VALUES = 1 << 23
#: Copies of each block when they are shuffled instead.
SALTS = 64
#: Tasks of the product for each core.
TASKS_PER_SLOT = 4


def _blocks(scenarios: DataFrame, factors, n_trials: int) -> tuple[DataFrame, int]:
    """``block, cells``: the features of consecutive scenarios, by ``trial_id``; and the number of blocks."""
    width = len(factors) + 1
    size = max(1, BLOCK_VALUES // width)
    cell = F.struct("trial_id", *[feature_of(F.col(f"x_{f}")).alias(f"f{i}") for i, f in enumerate(factors)])
    packed = scenarios.groupBy(F.floor(F.col("trial_id") / size).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(cell)).alias("cells"))
    return packed, -(-n_trials // size)


def _met(models: DataFrame, scenarios: DataFrame, factors, n_trials: int, feats, key: str) -> DataFrame:
    """Every complete model beside every block of scenarios: ``key, block``, the model's ``_w0`` (intercept), ``_w1`` ... and ``cells``."""
    weights = [F.col(weight_name(f)) for f in feats]
    complete = F.col("intercept").isNotNull()
    for w in weights:
        complete = complete & w.isNotNull()
    # One array for the model: a filter on solved columns would be pushed below the solve.
    model = models.select(key, F.when(complete, F.array(F.col("intercept"), *weights)).alias("model"))
    blocks, n_blocks = _blocks(scenarios, factors, n_trials)
    dealt = model.select(key, "model", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")).where(F.col("model").isNotNull())
    # Plain numbers from here on: an element of an array would be looked up again for every scenario.
    dealt = dealt.select(key, "block", *[F.col("model")[i].alias(w) for i, w in enumerate(_weights(factors))])
    if n_trials * (len(factors) + 1) <= BROADCAST_VALUES:
        # A model is a short row and much work: few bytes would make few tasks.
        slots = models.sparkSession.sparkContext.defaultParallelism
        return dealt.repartition(TASKS_PER_SLOT * slots, key, "block").join(F.broadcast(blocks), "block")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return (dealt.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
            .join(blocks.select("*", salt).hint("shuffle_hash"), ["block", "salt"]))


def _weights(factors) -> list[str]:
    return [f"_w{i}" for i in range(len(factors) + 1)]


def _return_of(cell: Column, factors) -> Column:
    first, *rest = _weights(factors)
    out = F.col(first)
    for i, w in enumerate(rest):
        out = out + F.col(w) * cell[f"f{i}"]
    return out


def instrument_trials(models: DataFrame, scenarios: DataFrame, factors, n_trials: int, p: float = 0.05, feats=None,
                      key: str = "symbol") -> DataFrame:
    """Per instrument: ``trials, mean, stddev, min, max, value_at_risk, conditional_var`` of its simulated returns.

    ``value_at_risk`` is the element at rank ``max(ceil(p n), 1)`` of the sorted returns, ``conditional_var`` the mean of
    the returns at or below it, ``stddev`` that of the population.  Instruments without a complete model are
    left out.  A block gives back its smallest returns, as many as the rank, and all that equal the last of
    them; the instrument's rank lies among these.
    """
    feats = feats or [f"{f}_feat" for f in factors]
    rank = max(math.ceil(p * n_trials), 1)
    met = _met(models, scenarios, factors, n_trials, feats, key)
    returns = F.sort_array(F.transform("cells", lambda c: _return_of(c, factors)))
    # One row for each instrument and block; its array lives as long as the row.
    held = met.select(key, "block", returns.alias("r"))
    total = lambda a, of: F.aggregate(a, F.lit(0.0), lambda s, x: s + of(x))
    cut = F.element_at("r", F.least(F.lit(rank), F.size("r")))
    parts = held.select(
        key, F.size("r").cast("long").alias("n"), F.element_at("r", 1).alias("lo"), F.element_at("r", -1).alias("hi"),
        total(F.col("r"), lambda x: x).alias("s"), cut.alias("_cut"), "r")
    # Squares around the block's own mean lose no digits; blocks are joined around the mean of all.
    parts = parts.select("*", (F.col("s") / F.col("n")).alias("_mean"))
    # Sorted: what lies at or below the cut comes first, and ends with the cut unless more returns equal it.
    tail = F.when((F.size("r") > rank) & (F.get("r", F.lit(rank)) > F.col("_cut")), F.slice("r", 1, rank)).otherwise(
        F.filter("r", lambda x: x <= F.col("_cut")))
    parts = parts.select(
        key, "n", "lo", "hi", "s", F.aggregate("r", F.lit(0.0), lambda q, x: q + (x - F.col("_mean")) * (x - F.col("_mean"))).alias("q"),
        tail.alias("tail"))
    whole = parts.groupBy(key).agg(
        F.sum("n").alias("trials"), F.sum("s").alias("s"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.sum("q").alias("q"), F.collect_list(F.struct("n", "s")).alias("blocks"),
        F.sort_array(F.flatten(F.collect_list("tail"))).alias("tail"))
    mean = F.col("s") / F.col("trials")
    between = F.aggregate("blocks", F.lit(0.0), lambda t, b: t + b["n"] * (b["s"] / b["n"] - mean) * (b["s"] / b["n"] - mean))
    named = whole.select(key, "trials", "min", "max", mean.alias("mean"), F.sqrt((F.col("q") + between) / F.col("trials")).alias("stddev"),
                         F.element_at("tail", rank).alias("value_at_risk"), "tail")
    below = F.filter("tail", lambda x: x <= F.col("value_at_risk"))
    return named.select(key, "trials", "mean", "stddev", "min", "max", "value_at_risk",
                        (total(below, lambda x: x) / F.size(below)).alias("conditional_var"))


def scenario_means(models: DataFrame, scenarios: DataFrame, factors, n_trials: int, feats=None, key: str = "symbol") -> DataFrame:
    """``trial_id, average_return``: the mean of all instruments' returns, from the explicit product.

    Equals ``scenarios.score_scenarios``, which averages the models first.  Here every return is formed, as a
    statistic that is no mean would need; a task keeps one sum for each scenario.
    """
    feats = feats or [f"{f}_feat" for f in factors]
    met = _met(models, scenarios, factors, n_trials, feats, key)
    pairs = met.select(*_weights(factors), F.explode("cells").alias("c"))
    each = pairs.select(F.col("c.trial_id").alias("trial_id"), _return_of(F.col("c"), factors).alias("r"))
    return each.groupBy("trial_id").agg(F.avg("r").alias("average_return"))
