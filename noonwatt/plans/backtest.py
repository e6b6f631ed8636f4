"""Walk-forward backtest: every fold of every zone in one pass over the rows.

Fold membership is arithmetic on the timestamp: a row is tested in at most one
fold, and it is training data from one fold onwards. So the rows are never
copied once per fold; training statistics are added up per fold step and then
accumulated over the (few) steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import epoch_seconds, gate, to_market, week_bucket
from noonwatt.functions.numbers import clip_unit
from noonwatt.operators.ordered import join_small
from noonwatt.operators.quality import require_keys
from noonwatt.operators.reshape import complete_rows
from noonwatt.operators.scoring import error_metrics
from noonwatt.plans.boosting import Boosted, Forecaster, predict_fits, predict_per_key
from noonwatt.plans.forecast import (
    BOOSTED,
    CLIMATOLOGY,
    PERSISTENCE,
    RIDGE,
    feature_moments,
    predict_ridge,
    solve_ridge,
)

TS = "utc_timestamp"
ZONE = ("zone",)
DAY_SECONDS = 86400
SINGLE_PASS = (PERSISTENCE, CLIMATOLOGY, RIDGE)


def _test_start(fold: Column, test_days: int) -> Column:
    return F.col("__origin") + F.make_dt_interval(days=(fold * test_days).cast("int"))


def _train_end(fold: Column, test_days: int) -> Column:
    """The gate of the fold's first target hour."""
    return gate(to_market(_test_start(fold, test_days)))


def _spans(frame: DataFrame, keys: Sequence[str], initial_train_days: int) -> DataFrame:
    origin = F.min(TS) + F.expr(f"INTERVAL '{int(initial_train_days)}' DAY")
    return frame.groupBy(*keys).agg(origin.alias("__origin"), F.max(TS).alias("__end"))


def folds(
    frame: DataFrame,
    initial_train_days: int = 365,
    test_days: int = 30,
    keys: Sequence[str] = ZONE,
) -> DataFrame:
    """Rolling-origin folds per key; the last one ends at the last timestamp."""
    spans = _spans(frame, keys, initial_train_days)
    length = epoch_seconds("__end") - epoch_seconds("__origin")
    last = F.ceil(length / (test_days * DAY_SECONDS)) - 1
    numbered = spans.where(length > 0).select(
        *keys, "__origin", "__end", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("fold")
    )
    return numbered.select(
        *keys,
        "fold",
        _train_end(F.col("fold"), test_days).alias("train_end"),
        _test_start(F.col("fold"), test_days).alias("test_start"),
        F.least(_test_start(F.col("fold") + 1, test_days), F.col("__end")).alias("test_end"),
    )


def place_in_folds(
    frame: DataFrame,
    initial_train_days: int,
    test_days: int,
    keys: Sequence[str] = ZONE,
) -> DataFrame:
    """Add ``fold``, the fold a row is tested in (NULL before the first and from
    the last timestamp on), and ``train_from``, the first fold it is training
    data for."""
    rows = join_small(frame, _spans(frame, keys, initial_train_days), keys)
    step = test_days * DAY_SECONDS
    since = epoch_seconds(TS) - epoch_seconds("__origin")
    tested = F.when((since >= 0) & (F.col(TS) < F.col("__end")), F.floor(since / step))
    # A fold can only train on the row if it starts after it, and its gate lies at
    # most 37 hours before its start: one of three neighbouring folds is the first.
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil(since / step))
    reached = [
        F.when(_train_end(first + i, test_days) >= F.col(TS), first + i) for i in range(3)
    ]
    return rows.withColumns({"fold": tested, "train_from": F.coalesce(*reached)}).drop(
        "__origin", "__end"
    )


def _hourly_means(
    placed: DataFrame, steps: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Training mean per fold and hour of day, and per fold overall."""
    added = placed.groupBy(*keys, F.col("train_from").alias("fold"), "hour_of_day").agg(
        F.sum(vocab.TARGET).alias("__s"), F.count(vocab.TARGET).alias("__n")
    )
    last_hour = F.lit(vocab.HOURS_PER_DAY - 1).cast("bigint")
    hours = F.explode(F.sequence(F.lit(0).cast("bigint"), last_hour))
    grid = steps.select(*keys, "fold", hours.alias("hour_of_day"))
    upto = W.partitionBy(*keys, "hour_of_day").orderBy("fold").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys, "fold")
    summed = grid.join(added, [*keys, "fold", "hour_of_day"], "left").select(
        *keys,
        "fold",
        "hour_of_day",
        F.sum("__s").over(upto).alias("__s"),
        F.sum("__n").over(upto).alias("__n"),
    )
    return summed.select(
        *keys,
        "fold",
        "hour_of_day",
        F.try_divide("__s", "__n").alias("__hour_mean"),
        F.try_divide(F.sum("__s").over(whole), F.sum("__n").over(whole)).alias("__train_mean"),
    ).where(F.col("__train_mean").isNotNull())


def _cell_means(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tested rows with ``__cell_mean``: the mean of their (week, hour) cell over
    the training data of their fold.

    Training data is added up per cell and fold step and stacked with the tested
    rows; a running sum in fold order then gives each row its fold's mean. A cell
    gets seven rows a year.
    """
    cell = [*keys, "__week", "hour_of_day"]
    rows = placed.withColumn("__week", week_bucket("day_of_year"))
    added = rows.where(F.col("train_from").isNotNull()).groupBy(
        *cell, F.col("train_from").alias("__at")
    ).agg(F.sum(vocab.TARGET).alias("__s"), F.count(vocab.TARGET).alias("__n"))
    tested = rows.where(F.col("fold").isNotNull()).select(
        *cell,
        F.col("fold").alias("__at"),
        F.struct(*[F.col(c) for c in placed.columns]).alias("__row"),
    )
    stacked = added.unionByName(tested, allowMissingColumns=True)
    upto = W.partitionBy(*cell).orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow)
    mean = F.try_divide(F.sum("__s").over(upto), F.sum("__n").over(upto))
    found = stacked.withColumn("__cell_mean", mean).where(F.col("__row").isNotNull())
    return found.select("__row.*", "__cell_mean")


def fold_ridge(
    placed: DataFrame, steps: DataFrame, keys: Sequence[str] = ZONE, alpha: float = vocab.RIDGE_ALPHA
) -> DataFrame:
    """One ridge fit per key and fold from moments added up per fold step."""
    width = len(vocab.FEATURES) + 2
    added = feature_moments(placed.where(F.col("train_from").isNotNull()), [*keys, "train_from"])
    nothing = F.array_repeat(F.lit(0.0), width * width)
    every = (
        steps.select(*keys, "fold")
        .join(added.withColumnRenamed("train_from", "fold"), [*keys, "fold"], "left")
        .withColumn("moments", F.coalesce("moments", nothing))
    )
    return solve_ridge(every, keys, order="fold", alpha=alpha)


def _fitted(
    placed: DataFrame, steps: DataFrame, forecasters: dict[str, Forecaster], keys: Sequence[str]
) -> DataFrame:
    """(keys, timestamp, a column per forecaster): one fit per key and fold.

    A fit needs all its past rows at once, so these are copied to the folds they train; only
    inputs and target are copied. No row of a fold's training data is later than the gate of
    that fold and key.
    """
    last = steps.groupBy(*keys).agg(F.max("fold").alias("__last"))
    train = (
        join_small(placed.where(F.col("train_from").isNotNull()), last, keys)
        .where(F.col("train_from") <= F.col("__last"))
        .drop("fold")
        .withColumn("fold", F.explode(F.sequence("train_from", "__last")))
    )
    test = placed.where(F.col("fold").isNotNull())
    return predict_per_key(train, test, forecasters, [*keys, "fold"]).drop("fold")


def _boosted(placed: DataFrame, steps: DataFrame, settings: Boosted, keys: Sequence[str]) -> DataFrame:
    """(keys, timestamp, boosted): one ensemble per key and fold, from the rows up to its gate,
    which are read in place, not copied."""
    fits = []
    for step in steps.select(*keys, "fold").collect():  # one small row per fit
        same = reduce(and_, [F.col(k).eqNullSafe(F.lit(step[k])) for k in keys])
        fits.append((same & (F.col("train_from") <= step["fold"]), same & (F.col("fold") == step["fold"])))
    return predict_fits(placed, placed.where(F.col("fold").isNotNull()), fits, BOOSTED, settings, keys)


def backtest(
    frame: DataFrame,
    models: Sequence[str] = SINGLE_PASS,
    initial_train_days: int = 365,
    test_days: int = 30,
    keys: Sequence[str] = ZONE,
    boosted: Boosted = Boosted(),
    strict: bool = True,
    own: dict[str, Forecaster] | None = None,
) -> DataFrame:
    """Replay history: refit on each fold's past, forecast its test window.

    One row per tested hour with fold, actual, daylight, benchmark and a column
    per model. ``own``: more forecasters by name, functions of (training inputs, training
    target, inputs to predict). ``frame`` is read several times, so pass a stored table. With
    ``strict`` a key without any fold is an error.
    """
    own = dict(own or {})
    taken = sorted(set(own) & {*SINGLE_PASS, BOOSTED})
    if taken:
        raise ValueError(f"these names are built in: {taken}")
    unknown = sorted(set(models) - {*SINGLE_PASS, BOOSTED})
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    if test_days < 1 or initial_train_days < 1:
        raise ValueError("test_days and initial_train_days must be at least one")
    steps = folds(frame, initial_train_days, test_days, keys)
    if strict:
        message = "the series is shorter than the warm-up, so there is no fold"
        if frame.isEmpty():
            raise ValueError(message)
        require_keys(frame, steps, keys, message)
    placed = place_in_folds(frame, initial_train_days, test_days, keys)
    tested = _cell_means(placed, keys) if CLIMATOLOGY in models else placed.where(
        F.col("fold").isNotNull()
    ).withColumn("__cell_mean", F.lit(None).cast("double"))
    rows = join_small(tested, _hourly_means(placed, steps, keys), [*keys, "fold", "hour_of_day"])

    if RIDGE in models:
        rows = predict_ridge(rows, fold_ridge(placed, steps, keys), [*keys, "fold"])
    made: dict[str, Column] = {
        PERSISTENCE: clip_unit(F.coalesce("capacity_factor_lag_48h", "__train_mean")),
        CLIMATOLOGY: clip_unit(F.coalesce("__cell_mean", "__hour_mean", "__train_mean")),
        RIDGE: F.col(RIDGE) if RIDGE in models else None,
    }
    out = rows.select(
        *keys,
        "fold",
        TS,
        F.col(vocab.TARGET).alias("actual"),
        (F.col("ghi_max") > 0).alias("daylight"),
        vocab.BENCHMARK,
        *[made[m].alias(m) for m in models if m in SINGLE_PASS],
    )
    if BOOSTED in models:
        out = out.join(_boosted(placed, steps, boosted, keys), [*keys, TS])
    if own:
        out = out.join(_fitted(placed, steps, own, keys), [*keys, TS])
    return complete_rows(out, ["actual", vocab.BENCHMARK])


def summary(
    predictions: DataFrame, models: Sequence[str] = SINGLE_PASS, keys: Sequence[str] = ZONE
) -> DataFrame:
    return error_metrics(predictions, models, keys)
