"""Exact quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.operators.ordered import join_small


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    accuracy: int = 10000,
) -> DataFrame:
    """Interpolated quantiles per key; ``probabilities``: new column -> p in [0, 1].

    A bounded sketch per key gives, for each p, a lower and an upper cut that its rank cannot
    miss by more than the sketch's error. Values below the lower cut are only counted; just
    the values between the cuts, a share of 4 / ``accuracy`` of the rows, are ranked.
    """
    margin = 2 / accuracy
    ends = [min(1.0, max(0.0, p + d)) for p in probabilities.values() for d in (-margin, margin)]
    # The group is a struct, which is never NULL itself: a key that is NULL is one like any other.
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__k")
    valued = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("__v"))
    sketch = valued.groupBy("__k").agg(
        F.percentile_approx("__v", ends, accuracy).alias("__cuts"), F.count(F.lit(1)).alias("__n")
    )
    cut = join_small(valued, sketch, ["__k"])
    v = F.col("__v")
    low = [F.get("__cuts", F.lit(2 * i)) for i in range(len(probabilities))]
    high = [F.get("__cuts", F.lit(2 * i + 1)) for i in range(len(probabilities))]
    # The wanted ranks may lie one value outside the cuts, so those two are kept as well.
    outside = [
        agg
        for i in range(len(probabilities))
        for agg in (
            F.count_if(v < low[i]).alias(f"__below{i}"),
            F.max(F.when(v < low[i], v)).alias(f"__before{i}"),
            F.min(F.when(v > high[i], v)).alias(f"__after{i}"),
        )
    ]
    around = cut.groupBy("__k").agg(F.max("__n").alias("__n"), *outside)
    wanted = F.array_compact(
        F.array(*[F.when(v.between(low[i], high[i]), F.lit(i)) for i in range(len(probabilities))])
    )
    between = (
        cut.select("__k", "__v", F.explode(wanted).alias("__p"))
        .groupBy("__k", "__p", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    upto = F.sum("__c").over(
        W.partitionBy("__k", "__p").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    )
    ranked = join_small(between.withColumn("__upto", upto), around, ["__k"])

    def at(i: int, index) -> F.Column:
        """The value at a 0-based place among all values of the key."""
        place = index - F.col(f"__below{i}")
        here = (F.col("__p") == i) & (F.col("__upto") > place) & (F.col("__upto") - F.col("__c") <= place)
        total = F.max(F.when(F.col("__p") == i, F.col("__upto")))
        place_ = F.max(place)
        return (
            F.when(place_ < 0, F.max(f"__before{i}"))
            .when(place_ >= total, F.max(f"__after{i}"))
            .otherwise(F.max(F.when(here, v)))
        )

    picks = []
    for i, (name, p) in enumerate(probabilities.items()):
        rank = F.lit(float(p)) * (F.col("__n") - 1)
        first, second = at(i, F.floor(rank)), at(i, F.ceil(rank))
        picks.append((first + (second - first) * F.max(rank - F.floor(rank))).alias(name))
    found = ranked.groupBy("__k").agg(*picks)
    named = [F.col(f"__k.k{i}").alias(k) for i, k in enumerate(keys)]
    return found.select(*named, *probabilities)
