"""SQL that checks the URL filter: the same rules, counts and models, written as one query."""

from __future__ import annotations

from noonwatt.llm import url_filter as u


def _case(rules: list[u.Rule], value: str) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
        for r in ranked
    ]
    return f"CASE {' '.join(fits)} END"


def _levels() -> list[str]:
    """Per gram length: events with their probabilities, and the table of ratios and escapes."""
    out = [
        f"""e1 AS (SELECT gram, ab, rb, (a + {u.PRIOR / u.ALPHABET}) / (ta + {u.PRIOR}) AS pa,
                (r + {u.PRIOR / u.ALPHABET}) / (tr + {u.PRIOR}) AS pr, 0.0 AS above FROM kept WHERE n = 1)"""
    ]
    for n in range(1, u.ORDER + 1):
        longer = f"""x{n} AS (SELECT k.gram, k.ab, k.rb, substr(k.gram, 1, {n}) AS head,
                     (k.a + {u.PRIOR} * s.pa) / (h.ab + {u.PRIOR}) AS pa, (k.r + {u.PRIOR} * s.pr) / (h.rb + {u.PRIOR}) AS pr,
                     s.pa AS qa, s.pr AS qr
                     FROM kept k JOIN e{n} h ON h.gram = substr(k.gram, 1, {n}) JOIN e{n} s ON s.gram = substr(k.gram, 2, {n})
                     WHERE k.n = {n + 1})"""
        left = lambda c: f"ln(greatest(1 - sum({c}), 1e-6))"
        own = f"o{n} AS (SELECT head, {left('pa')} - {left('qa')} - {left('pr')} + {left('qr')} AS own FROM x{n} GROUP BY head)"
        up = f"JOIN t{n - 1} z ON z.gram = substr(e.gram, 2, {n - 1})" if n > 1 else ""
        table = f"""t{n} AS (SELECT e.gram, ln(e.pa) - ln(e.pr) - e.above AS ratio,
                    coalesce(o.own, 0) + {'z.escape' if n > 1 else '0'} AS escape
                    FROM e{n} e LEFT JOIN o{n} o ON o.head = e.gram {up})"""
        out += [longer, own, table]
        if n < u.ORDER:
            out.append(f"e{n + 1} AS (SELECT x.gram, ab, rb, pa, pr, t.escape AS above FROM x{n} x JOIN t{n} t ON t.gram = x.head)")
    return out


def sql(rules: list[u.Rule]) -> str:
    """page_id, host, path, rule, verdict."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    orders = range(1, u.ORDER + 1)
    ratios = " ".join(f"LEFT JOIN t{n} r{n} ON pos >= {n} AND r{n}.gram = substr(url, pos - {n - 1}, {n})" for n in orders)
    escapes = " ".join(f"LEFT JOIN t{n} c{n} ON pos > {n} AND c{n}.gram = substr(url, pos - {n}, {n})" for n in orders if n < u.ORDER)
    longest = lambda stem, col, most: ", ".join(f"{stem}{n}.{col}" for n in range(most, 0, -1))
    reach = u.RANGE * u.STEPS
    return f"""
WITH p AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT *, {lower.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT *, {_case(rules, 'name')} AS rule, {_case(rules, 'verdict')} AS by_rule,
             substr(md5(url), 1, 1) < '{u.HELD_BELOW}' AS held FROM h),
g AS (SELECT by_rule = 'allow' AS accepted, n, substr(url, pos - n + 1, n) AS gram, pos = length(url) AS last
      FROM (SELECT *, unnest(range(1, length(url) + 1)) AS pos FROM f WHERE by_rule IS NOT NULL AND NOT held) AS u,
           range(1, {u.ORDER + 1}) AS o(n) WHERE pos >= n),
counted AS (SELECT n, gram, count(*) FILTER (accepted) AS a, count(*) FILTER (NOT accepted) AS r,
                   count(*) FILTER (accepted AND NOT last) AS ab, count(*) FILTER (NOT accepted AND NOT last) AS rb
            FROM g GROUP BY n, gram),
total AS (SELECT sum(a) AS ta, sum(r) AS tr FROM counted WHERE n = 1),
kept AS (SELECT counted.*, ta::DOUBLE AS ta, tr::DOUBLE AS tr FROM counted, total
         WHERE a + r >= greatest(2, ceil((ta + tr) / {u.MODEL_ROWS}))),
{", ".join(_levels())},
s AS (SELECT row, sum(round((coalesce({longest('r', 'ratio', u.ORDER)}, 0.0)
                             + coalesce({longest('c', 'escape', u.ORDER - 1)}, 0.0)) * 1000000)::BIGINT) AS total
      FROM (SELECT *, unnest(range(1, length(url) + 1)) AS pos FROM f WHERE by_rule IS NULL OR held) AS u
      {ratios} {escapes} GROUP BY row),
scored AS (SELECT f.*, coalesce(total, 0)::DOUBLE / greatest(length(url), 1) / 1000000 AS score FROM f LEFT JOIN s USING (row)),
bins AS (SELECT round(greatest(least(score, {u.RANGE}), -{u.RANGE}) * {u.STEPS})::INT AS bin,
                count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS r
         FROM scored WHERE by_rule IS NOT NULL AND held GROUP BY 1),
cuts AS (SELECT round(coalesce(coalesce(sum(a) OVER b, 0) / nullif(sum(a) OVER w, 0), 0) + 1
                      - coalesce(coalesce(sum(r) OVER b, 0) / nullif(sum(r) OVER w, 0), 0), 9) AS error,
                least(bin - 0.5, greatest(coalesce(lag(bin) OVER (ORDER BY bin), {-reach - 1}) + 0.5, 0.0)) AS pos
         FROM bins WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                          w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
best AS (SELECT coalesce((SELECT pos FROM cuts ORDER BY error, abs(pos), pos LIMIT 1), 0) / {u.STEPS} AS cut,
                (SELECT count(DISTINCT accepted) FROM g) = 2 AS two)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN NOT two OR score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM scored, best
"""
