"""Text columns: channel names, hour lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noonwatt import vocab


def channel_parts(channel: Column | str) -> dict[str, Column]:
    """Building, building type and device read from a channel name; NULL where
    the name does not follow the pattern."""

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(channel, vocab.CHANNEL_PATTERN, group), F.lit(""))

    return {"building": part(1), "building_type": part(2), "device": part(3)}


def hour_list(hours: Column | str) -> Column:
    """An array of hours -> ``"02:00, 03:00"``, sorted and without repeats."""
    label = F.transform(
        F.array_sort(F.array_distinct(hours)),
        lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00")),
    )
    return F.concat_ws(", ", label)
