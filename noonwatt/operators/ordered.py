"""Ordered operators that never put a whole series into one task.

A window over ``PARTITION BY zone`` sends all of a zone to one task, and a
window without PARTITION BY sends everything to one task. The operators here
order rows inside *slots* of a fixed time span (or blocks of a fixed number of
positions) and carry what must cross a slot border through a per-slot summary:
one row per key and slot, so its size is bounded by the time span covered.

``keys`` names the series columns, ``order`` the UTC timestamp column. Rows whose
key or timestamp is NULL form groups of their own and stay, as in SQL windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.functions.calendar import epoch_hours, epoch_seconds, hours, minutes_between

SLOT_HOURS = 28 * 24
BLOCK_ROWS = 8192
_GROUP, _SLOT, _BLOCK, _HOME = "__group", "__slot", "__block", "__home"


def _slot(order: str, slot_hours: int) -> Column:
    return F.floor(epoch_hours(order) / slot_hours)


def _with_earlier_slots(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    slot_hours: int,
    summaries: dict[str, Column],
    carries: dict[str, Callable[[W], Column]],
) -> DataFrame:
    """Tag rows with their (keys, slot) group and join what the key's earlier slots add up to.

    ``summaries`` are aggregates per group; ``carries`` turn them into values over all
    earlier slots, given the window that spans those. The group is a struct: it is never
    NULL itself, so rows with NULL parts find their summary.
    """
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    tagged = df.withColumn(_GROUP, F.struct(*parts, _slot(order, slot_hours).alias("slot")))
    per_slot = tagged.groupBy(_GROUP).agg(*[a.alias(n) for n, a in summaries.items()])
    earlier = (
        W.partitionBy(*[f"{_GROUP}.k{i}" for i in range(len(keys))])
        .orderBy(f"{_GROUP}.slot")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    carried = per_slot.select(_GROUP, *[c(earlier).alias(n) for n, c in carries.items()])
    return tagged.join(carried, _GROUP)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "position",
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in ``order``."""
    tagged = _with_earlier_slots(
        df, keys, order, slot_hours,
        {"__rows": F.count(F.lit(1))},
        {"__before": lambda w: F.coalesce(F.sum("__rows").over(w), F.lit(0))},
    )
    inside = W.partitionBy(_GROUP).orderBy(order)
    numbered = tagged.withColumn(name, F.col("__before") + F.row_number().over(inside) - 1)
    return numbered.drop("__before", _GROUP)


_SUMMANDS = ("sum", "cnt", "high", "low", "nan")


def _summands(column: str) -> dict[str, Column]:
    """What running totals of a column need: finite values, and the count of each kind of
    other ones, since a difference of sums never gets rid of an infinity again."""
    value = F.col(column).cast("double")
    endless = F.lit(float("inf"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < endless)
    one = lambda kind: F.when(kind, F.lit(1)).otherwise(F.lit(0))
    return {
        "sum": F.when(finite, value).otherwise(F.lit(0.0)),
        "cnt": one(value.isNotNull()),
        "high": one(value.isNotNull() & ~F.isnan(value) & (value == endless)),
        "low": one(value == -endless),
        "nan": one(value.isNotNull() & F.isnan(value)),
    }


def _mean(total: dict[str, Column]) -> Column:
    """The mean of a frame from its totals, as ``avg`` gives it."""
    mixed = (total["nan"] > 0) | ((total["high"] > 0) & (total["low"] > 0))
    return (
        F.when(total["cnt"] == 0, F.lit(None).cast("double"))
        .when(mixed, F.lit(float("nan")))
        .when(total["high"] > 0, F.lit(float("inf")))
        .when(total["low"] > 0, F.lit(float("-inf")))
        .otherwise(F.try_divide(total["sum"], total["cnt"]))
    )


def trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lags: dict[str, tuple[str, int]] | None = None,
    means: dict[str, tuple[str, int, int]] | None = None,
    slot_hours: int = SLOT_HOURS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Positional lags and trailing means.

    ``lags``: new column -> (column, rows back). ``means``: new column ->
    (column, first, last) for the mean over ``first`` to ``last`` rows back;
    NULLs are skipped, a frame that starts before the series is taken as far as
    it goes, and an empty frame gives NULL.

    Rows are cut into blocks of consecutive positions and each block also gets
    the rows just before it (a halo as long as the longest look-back), so the
    result equals one window over the whole series. Means come from running
    sums, so their cost does not grow with the frame.
    """
    lags, means = lags or {}, means or {}
    if any(n < 0 for _, n in lags.values()) or any(a < b or b < 0 for _, a, b in means.values()):
        raise ValueError("look-backs must not be negative and frames must run old to new")
    reach = max([n for _, n in lags.values()] + [a for _, a, _ in means.values()], default=0)
    if reach == 0 and not lags and not means:
        return df

    placed = with_position(df, keys, order, "__pos", slot_hours).withColumn(
        _HOME, F.floor(F.col("__pos") / block_rows)
    )
    halo = placed.withColumn(
        _BLOCK,
        F.explode(F.sequence(F.col(_HOME), F.floor((F.col("__pos") + reach) / block_rows))),
    )
    ordered = W.partitionBy(*keys, _BLOCK).orderBy("__pos")
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)

    columns = sorted({c for c, _, _ in means.values()})
    for i, c in enumerate(columns):
        halo = halo.withColumns({f"__{k}{i}": F.sum(v).over(running) for k, v in _summands(c).items()})

    def between(running_column: str, first: int, last: int) -> Column:
        upto = F.lag(running_column, last).over(ordered) if last else F.col(running_column)
        return upto - F.coalesce(F.lag(running_column, first + 1).over(ordered), F.lit(0))

    made = {name: F.lag(c, n).over(ordered) if n else F.col(c) for name, (c, n) in lags.items()}
    for name, (c, first, last) in means.items():
        i = columns.index(c)
        made[name] = _mean({k: between(f"__{k}{i}", first, last) for k in _SUMMANDS})

    out = halo.withColumns(made).where(F.col(_BLOCK) == F.col(_HOME))
    return out.select(*df.columns, *made)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """Values of the row just before, however long ago. ``columns``: new -> old."""
    values = F.struct(F.col(order).alias("__at"), *[F.col(c).alias(n) for n, c in columns.items()])
    tagged = _with_earlier_slots(
        df, keys, order, slot_hours,
        {"__last": F.max_by(values, F.struct(order))},
        {"__carried": lambda w: F.last("__last", ignorenulls=True).over(w)},
    )
    inside = W.partitionBy(_GROUP).orderBy(order)
    found = tagged.withColumn("__prev", F.coalesce(F.lag(values).over(inside), F.col("__carried")))
    return found.select(*df.columns, *[F.col(f"__prev.{n}").alias(n) for n in columns])


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    tie: str | None = None,
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """Last non-null value up to and including each row. ``columns``: new -> old.

    ``tie`` orders rows that share a timestamp.
    """
    at = F.struct(order, tie) if tie else F.struct(order)
    tagged = _with_earlier_slots(
        df, keys, order, slot_hours,
        {f"__s_{n}": F.max_by(c, F.when(F.col(c).isNotNull(), at)) for n, c in columns.items()},
        {
            f"__c_{n}": (lambda w, n=n: F.last(f"__s_{n}", ignorenulls=True).over(w))
            for n in columns
        },
    )
    inside = (
        W.partitionBy(_GROUP)
        .orderBy(*([order, tie] if tie else [order]))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    filled = {
        n: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__c_{n}"))
        for n, c in columns.items()
    }
    return tagged.select(*df.columns, *[e.alias(n) for n, e in filled.items()])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """Cumulative sum in ``order``; exact for decimals."""
    tagged = _with_earlier_slots(
        df, keys, order, slot_hours,
        {"__total": F.sum(value)},
        {"__earlier": lambda w: F.sum("__total").over(w)},
    )
    inside = (
        W.partitionBy(_GROUP).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    total = F.sum(value).over(inside) + F.coalesce(F.col("__earlier"), F.lit(0))
    return tagged.withColumn(name, total).select(*df.columns, name)


def value_at(
    spine: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    lags: dict[str, int],
) -> DataFrame:
    """Exact lookups ``n`` hours before each spine row. ``lags``: new column -> n.

    The history is shifted onto the hours it is wanted at, so all lags cost one
    aggregation and one equi-join.
    """
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), (F.col(order) + hours(h)).alias("at"))
                  for n, h in lags.items()])
    )
    shifted = (
        history.select(*keys, F.col(value).alias("__v"), wanted.alias("__w"))
        .groupBy(*keys, F.col("__w.at").alias(order))
        .agg(*[F.max(F.when(F.col("__w.name") == n, F.col("__v"))).alias(n) for n in lags])
    )
    return spine.join(shifted, [*keys, order], "left")


def asof_backward(
    spine: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    offset_hours: int = 0,
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """For each spine row the last history row at or before ``order`` less the offset.

    Both sides are stacked and the last history row is carried forward, so no
    pairs are formed.
    """
    packed = F.struct(*[F.col(c) for c in columns])
    seen = history.select(*keys, order, packed.alias("__found"), F.lit(0).alias("__kind"))
    asked = spine.select(
        *keys,
        (F.col(order) - hours(offset_hours)).alias(order),
        F.struct(*[F.col(c) for c in spine.columns]).alias("__row"),
        F.lit(1).alias("__kind"),
    )
    stacked = seen.unionByName(asked, allowMissingColumns=True)
    filled = carry_forward(stacked, keys, order, {"__asof": "__found"}, "__kind", slot_hours)
    return filled.where(F.col("__kind") == 1).select(
        "__row.*", *[F.col(f"__asof.{c}").alias(c) for c in columns]
    )


def rolling_hours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    windows: dict[str, int],
    block_hours: int = 4096,
) -> DataFrame:
    """Mean over the last ``n`` hours, ``(t - n h, t]``, of whatever rows exist.

    ``windows``: new column -> n. Blocks of time get the rows of the time before
    them that their frames reach into. A mean is the difference of two running
    sums, now and ``n`` hours ago, so its cost does not grow with the frame. Rows
    without a timestamp stay and have no mean.
    """
    reach = max(windows.values())
    at = epoch_hours(order)
    halo = df.withColumn(_HOME, F.floor(at / block_hours)).withColumn(
        _BLOCK, F.explode_outer(F.sequence(F.col(_HOME), F.floor((at + reach) / block_hours)))
    )
    ordered = W.partitionBy(*keys, _BLOCK).orderBy("__sec")
    upto = ordered.rangeBetween(W.unboundedPreceding, W.currentRow)
    halo = halo.withColumn("__sec", epoch_seconds(order)).withColumns(
        {f"__{k}": F.sum(v).over(upto) for k, v in _summands(value).items()}
    )

    def since(running: str, n: int) -> Column:
        ago = ordered.rangeBetween(W.unboundedPreceding, -n * 3600)
        return F.col(running) - F.coalesce(F.last(running).over(ago), F.lit(0))

    timed = F.col(_HOME).isNotNull()
    made = {
        name: F.when(timed, _mean({k: since(f"__{k}", n) for k in _SUMMANDS}))
        for name, n in windows.items()
    }
    out = halo.withColumns(made).where(F.col(_BLOCK).eqNullSafe(F.col(_HOME)))
    return out.select(*df.columns, *made)


def gap_minutes(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "utc_timestamp",
    name: str = "step_minutes",
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """Minutes since the previous row; NULL on the first."""
    found = previous_row(df, keys, order, {"__previous": order}, slot_hours)
    return found.withColumn(
        name, minutes_between("__previous", order)
    ).drop("__previous")


def join_small(
    rows: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join many rows to one or few rows per key without shuffling the many for nothing.

    The small side is usually a fresh aggregate whose size no one knows, and Spark would
    shuffle both sides to be safe. It is written first: then its true size is known, Spark
    broadcasts it where that is small enough, and otherwise joins by shuffle, where adaptive
    execution splits hot keys.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join_small does inner and left joins, not {how!r}")
    from noonwatt.sources.tables import write_table

    return rows.join(write_table(per_key, rows.sparkSession, "small_side"), list(on), how)
