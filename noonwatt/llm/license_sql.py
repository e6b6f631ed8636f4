"""DuckDB SQL that checks the license scan: every alignment of every template, by a join."""

from __future__ import annotations

from collections.abc import Sequence

from noonwatt.llm.license_scan import Template

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sql(templates: Sequence[Template]) -> str:
    rows = ",\n".join(
        f"({i}, '{t.label}', {t.base}, {q}, '{w.decode()}', {q in t.key}, "
        f"{t.threshold.numerator}, {t.threshold.denominator})"
        for i, t in enumerate(templates)
        for q, w in enumerate(t.words)
    )
    return f"""
WITH tpl(t, label, base, q, word, is_key, num, den) AS (VALUES {rows}),
doc AS (SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
        FROM documents),
pos AS (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS word FROM doc),
held AS (SELECT word, count(DISTINCT r) AS df FROM pos SEMI JOIN tpl USING (word) GROUP BY word),
weighed AS (SELECT tpl.*, floor(1000 * ln(2 + (SELECT count(*) FROM documents)::DOUBLE / (1 + coalesce(df, 0))))::BIGINT AS weight
            FROM tpl LEFT JOIN held USING (word)),
whole AS (SELECT t, sum(weight)::BIGINT AS total, count_if(is_key) AS n_key FROM weighed GROUP BY t),
met AS (SELECT r, t, any_value(label) AS label, any_value(base) AS base, any_value(num) AS num, any_value(den) AS den,
               p - q AS start, sum(weight)::BIGINT AS got, count_if(is_key) AS keys
        FROM pos JOIN weighed USING (word) GROUP BY r, t, p - q),
hit AS (SELECT r, label, base, start, got::DOUBLE / total::DOUBLE AS score
        FROM met JOIN whole USING (t) WHERE got * den >= num * total AND keys = n_key),
per AS (SELECT r, count_if(base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
        FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM doc LEFT JOIN per USING (r)
"""
