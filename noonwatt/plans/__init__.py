"""Models: staging tables, feature marts, forecasts, backtests and schedules."""
