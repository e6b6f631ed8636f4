"""Models, backtest, live features, saved forecasts."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions import calendar as cal
from noonwatt.operators import ordered, profile, reshape, scoring
from noonwatt.plans import backtest as bt
from noonwatt.plans import boosting, forecast, live, marts
from noonwatt.session import shared_folder
from noonwatt.sources import layout
from workload import ridge_sql
from workload.ctes import LOCATION_NAMES, calendar, gate, local, national, pivot, utc
from workload.explore_queries import BY_DAY, PROFILE_CTES
from workload.registry import register
from workload.staging_queries import CYCLES, HISTORY, WEATHER

TS = "utc_timestamp"

# The 30-day test series needs a short warm-up.
TRAIN_DAYS, TEST_DAYS = 10, 5
TRAIN_UPTO = "2024-01-20 12:00:00"
NOW = "2024-01-25 10:00:00"

# --- point lookups -----------------------------------------------------------------------


@register(
    "lag_join",
    "SELECT s.zone, s.utc_timestamp, a.solar_capacity_factor AS capacity_factor_lag_48h, "
    "b.solar_capacity_factor AS capacity_factor_lag_72h, c.solar_capacity_factor AS "
    "capacity_factor_lag_168h FROM stg_solar s "
    "LEFT JOIN stg_solar a ON a.utc_timestamp = s.utc_timestamp - INTERVAL 48 HOUR "
    "LEFT JOIN stg_solar b ON b.utc_timestamp = s.utc_timestamp - INTERVAL 72 HOUR "
    "LEFT JOIN stg_solar c ON c.utc_timestamp = s.utc_timestamp - INTERVAL 168 HOUR",
    "capacity_factor_lag_48h capacity_factor_lag_72h capacity_factor_lag_168h",
)
def lag_join(t):
    solar = t.stored("stg_solar").select("zone", TS, vocab.TARGET)
    return ordered.value_at(
        solar.select("zone", TS), solar, ["zone"], TS, vocab.TARGET, marts.SOLAR_LAGS
    )


@register(
    "asof_backward",
    "SELECT w.zone, w.utc_timestamp, s.solar_mw FROM stg_weather_national w ASOF LEFT JOIN "
    "stg_generation s ON w.zone = s.zone AND w.utc_timestamp - INTERVAL 48 HOUR >= s.utc_timestamp",
)
def asof_backward(t):
    hours = t.stg_weather_national.select("zone", TS)
    history = t.stored("stg_generation").select("zone", TS, "solar_mw")
    return ordered.asof_backward(hours, history, ["zone"], TS, ["solar_mw"], offset_hours=48)


@register(
    "lookup_fallback",
    "SELECT m.zone, m.utc_timestamp, coalesce(c.v, h.v, o.v) AS looked_up FROM (SELECT *, "
    "(day_of_year - 1) // 7 AS week FROM mart) m LEFT JOIN (SELECT (day_of_year - 1) // 7 AS week, "
    "hour_of_day, avg(solar_capacity_factor) AS v FROM past GROUP BY ALL) c USING (week, hour_of_day) "
    "LEFT JOIN (SELECT hour_of_day, avg(solar_capacity_factor) AS v FROM past GROUP BY ALL) h "
    "USING (hour_of_day) CROSS JOIN (SELECT avg(solar_capacity_factor) AS v FROM past) o",
    "looked_up",
    past="SELECT * FROM mart WHERE utc_timestamp <= TIMESTAMP '2024-01-05 12:00:00'",
)
def lookup_fallback(t):
    """Cell mean, else hour mean, else overall mean of the first five days."""
    mart = t.stored("mart")
    past = reshape.time_slice(mart, upto=cal.instant("2024-01-05 12:00:00"))
    found = forecast.predict_climatology(mart, t.keep(forecast.climatology_cells(past)))
    return found.select("zone", TS, F.col(forecast.CLIMATOLOGY).alias("looked_up"))


# --- forecasters ---------------------------------------------------------------------------

PAST = f"SELECT * FROM mart WHERE utc_timestamp <= TIMESTAMP '{TRAIN_UPTO}'"


def _past(t):
    return reshape.time_slice(t.stored("mart"), upto=cal.instant(TRAIN_UPTO))


@register(
    "fit_persistence",
    "SELECT zone, utc_timestamp, greatest(0.0, least(1.0, coalesce(capacity_factor_lag_48h, "
    "(SELECT avg(solar_capacity_factor) FROM past)))) AS persistence_48h FROM mart",
    "persistence_48h",
    past=PAST,
)
def fit_persistence(t):
    fitted = forecast.fit_persistence(_past(t))
    return forecast.predict_persistence(t.stored("mart"), fitted).select("zone", TS, forecast.PERSISTENCE)


@register(
    "fit_climatology",
    "SELECT m.zone, m.utc_timestamp, greatest(0.0, least(1.0, coalesce(c.v, h.v, o.v))) AS climatology "
    "FROM (SELECT *, (day_of_year - 1) // 7 AS week FROM mart WHERE utc_timestamp > TIMESTAMP "
    f"'{TRAIN_UPTO}') m LEFT JOIN (SELECT (day_of_year - 1) // 7 AS week, hour_of_day, "
    "avg(solar_capacity_factor) AS v FROM past GROUP BY ALL) c USING (week, hour_of_day) LEFT JOIN "
    "(SELECT hour_of_day, avg(solar_capacity_factor) AS v FROM past GROUP BY ALL) h USING "
    "(hour_of_day) CROSS JOIN (SELECT avg(solar_capacity_factor) AS v FROM past) o",
    "climatology",
    past=PAST,
)
def fit_climatology(t):
    future = t.stored("mart").where(F.col(TS) > cal.instant(TRAIN_UPTO))
    cells = t.keep(forecast.climatology_cells(_past(t)))
    return forecast.predict_climatology(future, cells).select("zone", TS, forecast.CLIMATOLOGY)


@register("fit_ridge", ridge_sql.SQL, "coefficient:6", **ridge_sql.ctes())
def fit_ridge(t):
    """One row per zone and coefficient."""
    names = F.array(F.lit("(intercept)"), *[F.lit(f) for f in vocab.FEATURES])
    fitted = forecast.fit_ridge(t.stored("frame"))
    pairs = F.arrays_zip(
        names.alias("feature"), F.concat(F.array("intercept"), "coefficients").alias("coefficient")
    )
    return fitted.select("zone", "train_rows", F.explode(pairs).alias("p")).select(
        "zone", "train_rows", "p.feature", "p.coefficient"
    )


#: Leaves of few rows: the fixture has some hundred hours.
SMALL_TREES = boosting.Boosted(min_leaf=5)


@register("fit_gbt")
def fit_gbt(t):
    """Boosted trees fitted per zone, over the rows they were fitted on."""
    frame = t.stored("frame")
    made = boosting.boosted_per_key(frame, frame, forecast.BOOSTED, SMALL_TREES)
    return frame.select("zone", TS, vocab.TARGET).join(made, ["zone", TS])


@register(
    "predict_clipped",
    "SELECT zone, utc_timestamp, greatest(0.0, least(1.0, slope * ghi_mean + "
    "intercept)) AS clipped FROM mart CROSS JOIN (SELECT regr_slope(3 * solar_capacity_factor - 1, "
    "ghi_mean) AS slope, regr_intercept(3 * solar_capacity_factor - 1, ghi_mean) AS intercept "
    "FROM mart)",
    "clipped:8",
)
def predict_clipped(t):
    """A fitted ml pipeline with clipped output: a line through stretched targets,
    so that both bounds are hit."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    mart = t.stored("mart")
    line = Pipeline(
        stages=[
            VectorAssembler(inputCols=["ghi_mean"], outputCol="__features"),
            LinearRegression(
                featuresCol="__features", labelCol="stretched", predictionCol="__predicted",
                solver="normal",
            ),
        ]
    )
    model = line.fit(mart.withColumn("stretched", F.col(vocab.TARGET) * 3 - 1))
    return forecast.predict_fitted(mart, model, "clipped").select("zone", TS, "clipped")


# --- household profiles ----------------------------------------------------------------------


@register(
    "fit_load_profile",
    "SELECT building, hw AS hour_of_week, avg(consumption_kwh) AS mean_kwh, count(*) AS cell_hours, "
    "any_value(overall) AS overall_mean_kwh, any_value(n) AS hours_observed FROM prof_rows JOIN "
    "prof_level USING (building) GROUP BY building, hw",
    "mean_kwh overall_mean_kwh",
    **PROFILE_CTES,
)
def fit_load_profile(t):
    return profile.fit_profiles(t.mart_household)


PROFILE_DAYS = {
    **PROFILE_CTES,
    "prof_days": f"SELECT DISTINCT building, CAST(local_datetime AS DATE) AS day FROM mart_household",
    "prof_hours": "SELECT building, day, "
    + utc("CAST(day AS TIMESTAMP)")
    + " + INTERVAL '1' HOUR * CAST(k AS INT) AS utc_timestamp FROM prof_days CROSS JOIN range(24) r(k)",
    "prof_daily": "SELECT building, avg(mean_kwh) * 24 AS daily_kwh FROM prof_cells GROUP BY building",
}


@register(
    "profile_for_day",
    "SELECT h.building, h.day, h.utc_timestamp, coalesce(c.mean_kwh, l.overall) AS load_kwh, "
    "d.daily_kwh FROM prof_hours h JOIN prof_level l USING (building) JOIN prof_daily d USING (building) "
    f"LEFT JOIN prof_cells c ON c.building = h.building AND c.hw = (isodow({local('h.utc_timestamp')}) "
    f"- 1) * 24 + hour({local('h.utc_timestamp')})",
    "load_kwh daily_kwh",
    **PROFILE_DAYS,
)
def profile_for_day(t):
    """The profile's 24 hours for every day each building was observed."""
    load = t.stored("mart_household")
    fitted = profile.fit_profiles(load)
    days = load.select("building", F.to_date("local_datetime").alias("day")).distinct()
    daily = profile.profile_level(fitted).select("building", "daily_kwh")
    return ordered.join_small(profile.profile_for_days(fitted, days), daily, ["building"])


# --- backtest ------------------------------------------------------------------------------------

BT_CTES = {
    "bt_span": f"SELECT min(utc_timestamp) + INTERVAL {TRAIN_DAYS} DAY AS origin, "
    "max(utc_timestamp) AS fin FROM frame",
    "bt_folds": f"SELECT 'DE' AS zone, k AS fold, {gate(local('test_start'))} AS train_end, test_start, "
    f"least(test_start + INTERVAL {TEST_DAYS} DAY, fin) AS test_end FROM (SELECT k, fin, origin + "
    f"INTERVAL '1' DAY * CAST(k * {TEST_DAYS} AS INT) AS test_start FROM bt_span CROSS JOIN range(1000) r(k)) "
    "WHERE test_start < fin",
    "bt_train": "SELECT d.fold, f.* FROM bt_folds d JOIN frame f ON f.utc_timestamp <= d.train_end",
    "bt_test": "SELECT d.fold, f.*, (f.day_of_year - 1) // 7 AS week FROM bt_folds d JOIN frame f "
    "ON f.utc_timestamp >= d.test_start AND f.utc_timestamp < d.test_end",
    "bt_cell": "SELECT fold, (day_of_year - 1) // 7 AS week, hour_of_day, avg(solar_capacity_factor) "
    "AS v FROM bt_train GROUP BY ALL",
    "bt_hour": "SELECT fold, hour_of_day, avg(solar_capacity_factor) AS v FROM bt_train GROUP BY ALL",
    "bt_all": "SELECT fold, avg(solar_capacity_factor) AS v FROM bt_train GROUP BY ALL",
    "bt_pred": "SELECT t.zone, t.fold, t.utc_timestamp, t.solar_capacity_factor AS actual, "
    "t.ghi_max > 0 AS daylight, t.tso_solar_forecast_capacity_factor, "
    "greatest(0.0, least(1.0, coalesce(t.capacity_factor_lag_48h, o.v))) AS persistence_48h, "
    "greatest(0.0, least(1.0, coalesce(c.v, h.v, o.v))) AS climatology FROM bt_test t "
    "JOIN bt_all o USING (fold) LEFT JOIN bt_hour h USING (fold, hour_of_day) "
    "LEFT JOIN bt_cell c USING (fold, week, hour_of_day) "
    "WHERE t.tso_solar_forecast_capacity_factor IS NOT NULL",
}
SIMPLE = (forecast.PERSISTENCE, forecast.CLIMATOLOGY)


@register("folds", "SELECT * FROM bt_folds", **BT_CTES)
def folds(t):
    return bt.folds(t.frame, TRAIN_DAYS, TEST_DAYS)


@register(
    "backtest",
    "SELECT * FROM bt_pred",
    f"actual {vocab.BENCHMARK} persistence_48h climatology",
    **BT_CTES,
)
def backtest(t):
    return bt.backtest(t.stored("frame"), SIMPLE, TRAIN_DAYS, TEST_DAYS, strict=False)


@register("backtest_fitted")
def backtest_fitted(t):
    """All four models, refitted on every fold."""
    models = (*bt.SINGLE_PASS, forecast.BOOSTED)
    return bt.backtest(t.stored("frame"), models, TRAIN_DAYS, TEST_DAYS, strict=False, boosted=SMALL_TREES)


METRICS = (
    "SELECT zone, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, 1 - avg(abs(e)) "
    "/ nullif((SELECT avg(abs(tso_solar_forecast_capacity_factor - actual)) FROM bt_pred WHERE daylight), 0) "
    "AS skill_vs_tso FROM (SELECT zone, 'persistence_48h' AS model, persistence_48h - actual AS e "
    "FROM bt_pred WHERE daylight UNION ALL SELECT zone, 'climatology', climatology - actual FROM "
    "bt_pred WHERE daylight UNION ALL SELECT zone, 'TSO forecast', "
    "tso_solar_forecast_capacity_factor - actual FROM bt_pred WHERE daylight) GROUP BY zone, model"
)


@register("backtest_summary", METRICS, "mae rmse bias skill_vs_tso", **BT_CTES)
def backtest_summary(t):
    predictions = bt.backtest(t.stored("frame"), SIMPLE, TRAIN_DAYS, TEST_DAYS, strict=False)
    return bt.summary(predictions, SIMPLE).orderBy("mae")


@register(
    "agg_error_metrics",
    "SELECT zone, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, 1 - avg(abs(e)) "
    "/ nullif((SELECT avg(abs(tso_solar_forecast_capacity_factor - solar_capacity_factor)) FROM mart WHERE "
    "ghi_max > 0), 0) AS skill_vs_tso FROM (SELECT zone, 'capacity_factor_lag_72h' AS model, "
    "capacity_factor_lag_72h - solar_capacity_factor AS e FROM mart WHERE ghi_max > 0 UNION ALL "
    "SELECT zone, 'capacity_factor_mean_7d', capacity_factor_mean_7d - solar_capacity_factor FROM mart "
    "WHERE ghi_max > 0 UNION ALL SELECT zone, 'TSO forecast', tso_solar_forecast_capacity_factor - "
    "solar_capacity_factor FROM mart WHERE ghi_max > 0) GROUP BY zone, model",
    "mae rmse bias skill_vs_tso",
)
def agg_error_metrics(t):
    """The mart's own lag and mean, scored as if they were forecasts."""
    predictions = t.mart.withColumns(
        {"actual": F.col(vocab.TARGET), "daylight": F.col("ghi_max") > 0}
    )
    return scoring.error_metrics(
        predictions, ["capacity_factor_lag_72h", "capacity_factor_mean_7d"]
    )


# --- live features -----------------------------------------------------------------------------

DAY_SQL = f"(CAST({local(f'TIMESTAMP {chr(39)}{NOW}{chr(39)}')} AS DATE) + 1)"
LIVE_CTES = {
    "lv_now": f"SELECT TIMESTAMP '{NOW}' AS now",
    "lv_spine": f"SELECT 'DE' AS zone, {DAY_SQL} AS target_date, {utc(f'CAST({DAY_SQL} AS TIMESTAMP)')} "
    "+ INTERVAL '1' HOUR * CAST(k AS INT) AS utc_timestamp FROM range(24) r(k)",
    "lv_history": "SELECT zone, utc_timestamp, solar_capacity_factor, solar_ac_mw FROM stg_solar, lv_now "
    "WHERE utc_timestamp <= now AND utc_timestamp >= now - INTERVAL 40 DAY "
    "AND solar_capacity_factor IS NOT NULL",
    "lv_weather": f"SELECT zone, utc_timestamp, "
    f"{pivot('avg', 'location', 'ghi_wm2', LOCATION_NAMES)}, "
    f"{national('ghi_wm2', 'direct_radiation_wm2', 'diffuse_radiation_wm2', 'temperature_c', 'cloud_cover_pct')} "
    "FROM raw_weather GROUP BY zone, utc_timestamp",
    "lv_rolled": "SELECT utc_timestamp, avg(solar_capacity_factor) OVER (ORDER BY utc_timestamp RANGE "
    "BETWEEN INTERVAL 167 HOUR PRECEDING AND CURRENT ROW) AS m7, avg(solar_capacity_factor) OVER "
    "(ORDER BY utc_timestamp RANGE BETWEEN INTERVAL 719 HOUR PRECEDING AND CURRENT ROW) AS m30 "
    "FROM lv_history",
    "lv_hist": "SELECT s.zone, s.target_date, s.utc_timestamp, a.solar_capacity_factor AS capacity_factor_lag_48h, "
    "b.solar_capacity_factor AS capacity_factor_lag_72h, c.solar_capacity_factor AS "
    "capacity_factor_lag_168h, r.m7 AS capacity_factor_mean_7d, r.m30 AS capacity_factor_mean_30d "
    "FROM lv_spine s LEFT JOIN lv_history a ON a.utc_timestamp = s.utc_timestamp - INTERVAL 48 HOUR "
    "LEFT JOIN lv_history b ON b.utc_timestamp = s.utc_timestamp - INTERVAL 72 HOUR "
    "LEFT JOIN lv_history c ON c.utc_timestamp = s.utc_timestamp - INTERVAL 168 HOUR "
    "ASOF LEFT JOIN lv_rolled r ON s.utc_timestamp - INTERVAL 48 HOUR >= r.utc_timestamp",
    "lv_cal": f"SELECT zone, target_date, utc_timestamp, {calendar('l')} FROM (SELECT *, "
    f"{local('utc_timestamp')} AS l FROM lv_spine)",
}


def _now():
    return cal.instant(NOW)


def _history(t):
    seen = reshape.time_slice(t.stored("stg_solar"), upto=_now())
    return marts.recent_generation(seen, _now())


def _spine(t):
    return live.day_hours(_history(t), cal.target_day(_now()))


@register(
    "scan_recent",
    "SELECT zone, utc_timestamp, solar_capacity_factor, solar_ac_mw FROM stg_solar WHERE utc_timestamp "
    f">= TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND solar_capacity_factor IS NOT NULL",
)
def scan_recent(t):
    """From a table with daily partitions; only the last ten days are listed and read."""
    path = os.path.join(shared_folder(t.spark), "stg_solar")
    layout.create_windowed(t.stg_solar, path)
    return marts.recent_generation(t.spark.read.parquet(path), _now(), days=10)


@register(
    "live_weather_features", "SELECT * FROM lv_weather",
    WEATHER + " " + " ".join(vocab.LOCATION_FEATURES), **LIVE_CTES,
)
def live_weather_features(t):
    return live.weather_features(t.raw_weather)


@register("live_calendar_features", "SELECT * FROM lv_cal", CYCLES, **LIVE_CTES)
def live_calendar_features(t):
    return live.calendar_features(_spine(t))


@register("live_history_features", "SELECT * FROM lv_hist", HISTORY, **LIVE_CTES)
def live_history_features(t):
    return live.history_features(_spine(t), _history(t))


LIVE = (
    f"SELECT h.zone, h.target_date, h.utc_timestamp, {', '.join('w.' + c for c in vocab.WEATHER_FEATURES)}, "
    f"{', '.join('c.' + x for x in vocab.CALENDAR_FEATURES)}, "
    f"{', '.join('h.' + x for x in vocab.HISTORY_FEATURES)}, (SELECT max_by(solar_ac_mw, utc_timestamp) "
    "FROM lv_history) AS solar_ac_mw FROM lv_hist h JOIN lv_cal c USING (utc_timestamp) "
    "LEFT JOIN lv_weather w USING (utc_timestamp)"
)
LIVE_ROUNDED = f"{CYCLES} {HISTORY} {WEATHER} {' '.join(vocab.LOCATION_FEATURES)}"


@register("live_features", LIVE, LIVE_ROUNDED, **LIVE_CTES)
def live_features(t):
    return live.live_features(_history(t), t.raw_weather, cal.target_day(_now()))


@register(
    "assemble_columns",
    f"SELECT zone, target_date, utc_timestamp, ghi_mean, hour_of_day, hour_sin, capacity_factor_lag_48h, "
    "capacity_factor_mean_7d FROM lv_all",
    "ghi_mean hour_sin capacity_factor_lag_48h capacity_factor_mean_7d",
    lv_all=LIVE, **LIVE_CTES,
)
def assemble_columns(t):
    """Weather, calendar and history side by side on the hours of the target day."""
    built = live.live_features(_history(t), t.raw_weather, cal.target_day(_now()))
    return built.select(
        "zone", "target_date", TS, "ghi_mean", "hour_of_day", "hour_sin",
        "capacity_factor_lag_48h", "capacity_factor_mean_7d",
    )


@register("predict_day")
def predict_day(t):
    """Train on the mart up to now, forecast the target day with boosted trees."""
    frame = reshape.time_slice(t.stored("frame"), upto=_now())
    features = live.live_features(_history(t), t.raw_weather, cal.target_day(_now()))

    def predict(rows):
        made = boosting.boosted_per_key(frame, rows, "predicted", SMALL_TREES)
        return rows.join(made, ["zone", TS])

    return live.predict_day(features, predict, _now())


# --- saved forecasts -----------------------------------------------------------------------------


@register(
    "join_score",
    "SELECT p.zone, p.utc_timestamp, p.target_date, p.issued_at, p.model_name, "
    "p.predicted_capacity_factor, p.ghi_mean_forecast, p.actual_capacity_factor, p.tso_capacity_factor "
    "FROM scored_all p",
    "predicted_capacity_factor actual_capacity_factor tso_capacity_factor",
)
def join_score(t):
    return scoring.score_log(t.prediction_log, t.stg_solar, t.stg_tso, latest_only=False)


@register("score_predictions", "scored", "actual_capacity_factor tso_capacity_factor")
def score_predictions(t):
    return scoring.score_log(t.prediction_log, t.stg_solar, t.stg_tso)


@register(
    "score_report",
    "SELECT zone, 'our forecast' AS source, CAST(NULL AS DATE) AS target_date, count(*) AS hours, "
    "avg(abs(predicted_capacity_factor - actual_capacity_factor)) AS mae FROM scored WHERE "
    "ghi_mean_forecast > 0 GROUP BY zone UNION ALL SELECT zone, 'TSO forecast', NULL, count(*), "
    "avg(abs(tso_capacity_factor - actual_capacity_factor)) FROM scored WHERE ghi_mean_forecast > 0 "
    "AND tso_capacity_factor IS NOT NULL GROUP BY zone UNION ALL SELECT zone, 'our forecast', "
    "target_date, hours, mae FROM by_day",
    "mae",
    by_day=BY_DAY,
)
def score_report(t):
    return scoring.score_report(scoring.score_log(t.prediction_log, t.stg_solar, t.stg_tso))
