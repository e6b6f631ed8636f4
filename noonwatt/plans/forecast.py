"""Forecasters, fitted for every zone at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noonwatt import vocab
from noonwatt.functions.calendar import week_bucket
from noonwatt.functions.numbers import clip_unit
from noonwatt.operators.ordered import join_small
from noonwatt.operators.reshape import complete_rows

ZONE = ("zone",)
MATRIX = T.ArrayType(T.DoubleType())
PERSISTENCE, CLIMATOLOGY, RIDGE, BOOSTED = (
    "persistence_48h", "climatology", "ridge", "gradient_boosting",
)


# --- persistence ----------------------------------------------------------------------


def fit_persistence(train: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """The training mean, used where no value 48 hours back exists."""
    return train.groupBy(*keys).agg(F.avg(vocab.TARGET).alias("train_mean"))


def predict_persistence(
    rows: DataFrame, fitted: DataFrame, keys: Sequence[str] = ZONE
) -> DataFrame:
    value = F.coalesce("capacity_factor_lag_48h", "train_mean")
    joined = join_small(rows, fitted, keys)
    return joined.select(*rows.columns, clip_unit(value).alias(PERSISTENCE))


# --- climatology ------------------------------------------------------------------------


def climatology_cells(train: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Means by (week, hour), by hour and overall; ``level`` is 0, 1 and 2.

    The rows are aggregated once to the finest cells, and the coarser means are
    rolled up from those.
    """
    cells = (
        train.where(F.col(vocab.TARGET).isNotNull())
        .groupBy(*keys, week_bucket("day_of_year").alias("week"), "hour_of_day")
        .agg(F.sum(vocab.TARGET).alias("__sum"), F.count(vocab.TARGET).alias("__n"))
    )
    sets = [[*keys, "week", "hour_of_day"], [*keys, "hour_of_day"], [*keys]]
    rolled = cells.groupingSets(sets, *keys, "week", "hour_of_day").agg(
        (F.sum("__sum") / F.sum("__n")).alias("mean_capacity_factor"),
        F.sum("__n").alias("hours"),
        (F.grouping("week") + F.grouping("hour_of_day")).cast("bigint").alias("level"),
    )
    return rolled


def predict_climatology(
    rows: DataFrame, cells: DataFrame, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Cell mean, else the hour's mean, else the overall mean.

    The three levels of a key become one row per hour of day with a map of its weeks, so
    the rows are joined once.
    """
    mean = F.col("mean_capacity_factor")
    overall = cells.where("level = 2").select(*keys, mean.alias("__all"))
    hour = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(vocab.HOURS_PER_DAY - 1).cast("bigint")))
    per_hour = cells.where("level < 2").groupBy(*keys, "hour_of_day").agg(
        F.map_from_entries(
            F.collect_list(F.when((F.col("level") == 0) & F.col("week").isNotNull(), F.struct("week", mean)))
        ).alias("__weeks"),
        F.max(F.when(F.col("level") == 1, mean)).alias("__hour"),
    )
    table = overall.withColumn("hour_of_day", hour).join(per_hour, [*keys, "hour_of_day"], "left")
    found = join_small(rows, table, [*keys, "hour_of_day"], "left")
    cell = F.try_element_at("__weeks", week_bucket("day_of_year"))
    value = F.coalesce(cell, "__hour", "__all")
    return found.select(*rows.columns, clip_unit(value).alias(CLIMATOLOGY))


# --- ridge ------------------------------------------------------------------------------


def feature_moments(
    train: DataFrame, keys: Sequence[str], features: Sequence[str] = vocab.FEATURES
) -> DataFrame:
    """Sums of products of (1, features, target) per key: all ridge needs to know.

    Each task adds up its own rows batch by batch; only one matrix per task and
    key is shuffled, whatever the number of rows.
    """
    keys = list(keys)
    width = len(features) + 2
    values = F.array(
        F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(vocab.TARGET).cast("double")
    )

    def add_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        sums: dict[tuple, np.ndarray] = {}

        def flush():
            held = pd.DataFrame(list(sums), columns=keys)
            held["moments"] = [m.ravel() for m in sums.values()]
            sums.clear()
            return held

        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                z = np.stack(group["__z"].to_numpy())
                sums[key] = sums.get(key, 0.0) + z.T @ z
            if len(sums) > 512:
                yield flush()
        if sums:
            yield flush()

    rows = complete_rows(train, [vocab.TARGET, *features]).select(*keys, values.alias("__z"))
    schema = rows.select(*keys).schema.add("moments", MATRIX)
    partial = rows.mapInPandas(add_up, schema)
    summed = (
        partial.select(*keys, F.posexplode("moments").alias("__i", "__m"))
        .groupBy(*keys, "__i")
        .agg(F.sum("__m").alias("__m"))
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]
    )
    return summed.groupBy(*keys).agg(ordered.alias("moments")).where(F.size("moments") == width**2)


def solve_ridge(
    moments: DataFrame,
    keys: Sequence[str],
    order: str | None = None,
    alpha: float = vocab.RIDGE_ALPHA,
    features: Sequence[str] = vocab.FEATURES,
) -> DataFrame:
    """Standardised ridge coefficients from the moments, in the features' own units.

    With ``order`` each row's moments are added to those of the rows before it, so
    one group holds one small matrix per fold and gives one fit per fold.
    """
    keys, width = list(keys), len(features) + 2

    def solve(group):
        import numpy as np
        import pandas as pd

        if order:
            group = group.sort_values(order)
        total, out = np.zeros((width, width)), []
        for _, row in group.iterrows():
            total = total + np.asarray(row["moments"], dtype=float).reshape(width, width)
            n = total[0, 0]
            mean = total[0, 1:] / n
            centred = total[1:, 1:] - n * np.outer(mean, mean)
            variance = np.clip(np.diag(centred)[:-1] / n, 0.0, None)
            flat = variance <= 1e-18 * (1.0 + mean[:-1] ** 2)
            scale = np.where(flat, 1.0, np.sqrt(variance))
            gram = centred[:-1, :-1] / np.outer(scale, scale)
            gram[flat, :] = gram[:, flat] = 0.0
            cross = np.where(flat, 0.0, centred[:-1, -1] / scale)
            weights = np.linalg.solve(gram + alpha * np.eye(width - 2), cross) / scale
            out.append(
                {
                    **{k: row[k] for k in [*keys, *([order] if order else [])]},
                    "train_rows": int(round(n)),
                    "intercept": float(mean[-1] - weights @ mean[:-1]),
                    "coefficients": weights,
                }
            )
        return pd.DataFrame(out)

    named = [*keys, *([order] if order else [])]
    schema = moments.select(*named).schema
    schema = schema.add("train_rows", "long").add("intercept", "double")
    schema = schema.add("coefficients", MATRIX)
    return moments.groupBy(*keys).applyInPandas(solve, schema)


def fit_ridge(train: DataFrame, keys: Sequence[str] = ZONE, **options) -> DataFrame:
    """One ridge model per key: train_rows, intercept, coefficients."""
    return solve_ridge(feature_moments(train, keys), keys, **options)


def predict_ridge(
    rows: DataFrame,
    fitted: DataFrame,
    keys: Sequence[str] = ZONE,
    features: Sequence[str] = vocab.FEATURES,
) -> DataFrame:
    joined = join_small(rows, fitted.select(*keys, "intercept", "coefficients"), keys)
    value = F.col("intercept")
    for i, name in enumerate(features):
        value = value + F.get("coefficients", F.lit(i)) * F.col(name)
    return joined.select(*rows.columns, clip_unit(value).alias(RIDGE))


# --- fitted pipelines ---------------------------------------------------------------------


def predict_fitted(rows: DataFrame, model, name: str = BOOSTED) -> DataFrame:
    """Apply any fitted pipeline and bound its output like every forecaster's."""
    return model.transform(rows).select(*rows.columns, clip_unit("__predicted").alias(name))
