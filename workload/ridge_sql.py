"""Standardised ridge regression in SQL: Gauss-Jordan elimination, one query per column."""

from __future__ import annotations

from string import ascii_lowercase

from noonwatt import vocab

N = len(vocab.FEATURES)


def _name(k: int) -> str:
    return f"gj_{ascii_lowercase[k // 26]}{ascii_lowercase[k % 26]}"


def ctes(frame: str = "frame", alpha: float = vocab.RIDGE_ALPHA) -> dict[str, str]:
    """Queries that end in ``ridge_weight``: (i, weight), and ``ridge_level``: (n, y)."""
    columns = ", ".join(f"CAST({c} AS DOUBLE)" for c in vocab.FEATURES)
    out = {
        "ridge_cell": f"SELECT utc_timestamp AS r, {vocab.TARGET} AS y, unnest([{columns}]) AS v, unnest(range(1, {N + 1})) AS i FROM {frame}",
        "ridge_level": f"SELECT count(*) AS n, avg({vocab.TARGET}) AS y FROM {frame}",
        "ridge_scale": "SELECT i, mean, flat, CASE WHEN flat THEN 1.0 ELSE sqrt(variance) END AS scale FROM (SELECT i, avg(v) AS mean, "
        "var_pop(v) AS variance, var_pop(v) <= 1e-18 * (1 + avg(v) * avg(v)) AS flat FROM ridge_cell GROUP BY i)",
        "ridge_z": "SELECT r, i, CASE WHEN flat THEN 0.0 ELSE (v - mean) / scale END AS z, c.y - l.y AS y FROM ridge_cell c "
        "JOIN ridge_scale USING (i) CROSS JOIN ridge_level l",
        _name(0): f"SELECT a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN {alpha} ELSE 0 END AS v FROM ridge_z a "
        f"JOIN ridge_z b USING (r) GROUP BY a.i, b.i UNION ALL SELECT i, {N + 1}, sum(z * y) FROM ridge_z GROUP BY i",
    }
    for k in range(1, N + 1):
        m = _name(k - 1)
        out[_name(k)] = (
            f"SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM {m} a "
            f"JOIN (SELECT j, v FROM {m} WHERE i = {k}) r ON r.j = a.j JOIN (SELECT i, v FROM {m} WHERE j = {k}) c ON c.i = a.i "
            f"CROSS JOIN (SELECT v FROM {m} WHERE i = {k} AND j = {k}) p"
        )
    out["ridge_weight"] = f"SELECT i, mean, m.v / scale AS weight FROM {_name(N)} m JOIN ridge_scale USING (i) WHERE m.j = {N + 1}"
    return out


_NAMES = "[" + ", ".join(f"'{c}'" for c in vocab.FEATURES) + "]"
SQL = (
    f"SELECT 'DE' AS zone, n AS train_rows, {_NAMES}[i] AS feature, weight AS coefficient FROM ridge_weight CROSS JOIN ridge_level "
    "UNION ALL SELECT 'DE', any_value(n), '(intercept)', any_value(y) - sum(weight * mean) FROM ridge_weight CROSS JOIN ridge_level "
    "HAVING count(*) > 0"
)
