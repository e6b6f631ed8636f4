"""Numeric columns: null rules, units, error terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division that yields NULL on a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def to_number(value: Column | str) -> Column:
    """Text or number -> double; anything unreadable, NaN and infinities become NULL."""
    number = _c(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def clip_unit(value: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(value)))


def watts_clean(value: Column | str) -> Column:
    """Solver noise below 1e-9 is zero; the rest is rounded to six places."""
    value = _c(value)
    return F.round(F.when(F.abs(value) < 1e-9, 0.0).otherwise(value), 6)


def gw_to_mw(value: Column | str) -> Column:
    return to_number(value) * 1000


def kwh_to_mw(value: Column | str) -> Column:
    """Energy over one hour in kWh is mean power in kW; a thousandth of it is MW."""
    return _c(value) / 1000


def mw_to_kw(value: Column | str) -> Column:
    return _c(value) * 1000


def array_output_mw(capacity_factor: Column | str, kwp: Column | str) -> Column:
    """Output of a PV array of ``kwp`` at the national capacity factor."""
    return _c(capacity_factor) * (_c(kwp) / 1000)


def consumption(grid_import: Column | str, pv: Column | str, grid_export: Column | str) -> Column:
    """Household demand: what was bought, plus own output, less what was sold."""
    return _c(grid_import) + F.coalesce(_c(pv), F.lit(0.0)) - F.coalesce(_c(grid_export), F.lit(0.0))


def mae(error: Column | str) -> Column:
    return F.avg(F.abs(_c(error)))


def rmse(error: Column | str) -> Column:
    return F.sqrt(F.avg(_c(error) * _c(error)))
