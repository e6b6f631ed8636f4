"""License scan against a comparison of every alignment by hand."""

import math
import re
from collections import Counter

import pytest

from noonwatt.llm import license_scan
from noonwatt.llm.license_scan import BASE, SENTENCES, Index, base, template

SCHEMA = "doc_id bigint, text string, hits string, n_words int, label string"
LONG = "lorem ipsum " * 50_000 + "Released under the MIT License. " + "all rights reserved " * 1000
TEXTS = [
    None,
    "",
    " .,; ",
    "CC BY-NC 4.0, cc-by, CC  by",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "licensed beneath the apache license version 2 0",  # one word another
    "licensed under the apache licence version 2 0",  # key phrase broken
    "the Apache License, Version 2.0",  # starts before the text
    "General Public License general public license",
    "all rights all rights reserved rights reserved",
    "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "É all RIGHTS Reserved É",
    LONG,
]


def words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(texts, templates=BASE + SENTENCES):
    split = [words(t) for t in texts]
    held = Counter(w for s in split for w in set(s))
    out = []
    for s in split:
        found = []
        for t in templates:
            spelt = [w.decode() for w in t.words]
            weights = [math.floor(1000 * math.log(2 + len(texts) / (1 + held[w]))) for w in spelt]
            starts = {i - q for q, w in enumerate(spelt) for i, x in enumerate(s) if w == x}
            for start in starts:
                met = [0 <= start + q < len(s) and s[start + q] == w for q, w in enumerate(spelt)]
                got = sum(w for w, m in zip(weights, met) if m)
                if got >= t.threshold * sum(weights) and all(met[q] for q in t.key):
                    found.append((t.label, start, got / sum(weights), t.base))
        found.sort()
        first = [h[1] for h in found if h[3]]
        out.append((
            len(s), len(first), min(first, default=None), max(first, default=None),
            ",".join(sorted({h[0] for h in found if h[3]})), ",".join(sorted({h[0] for h in found})),
            max((h[2] for h in found), default=0.0),
        ))
    return out


def test_like_every_alignment_by_hand(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(TEXTS)], SCHEMA)
    got = license_scan.report(docs)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = {r[0]: tuple(r)[1:] for r in got.collect()}
    want = expected(TEXTS)
    for i, text in enumerate(TEXTS):
        assert rows[i] == pytest.approx(want[i]), (text or "")[:60]


def test_what_the_labels_say(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(TEXTS)], SCHEMA)
    labels = {r.doc_id: r.labels for r in license_scan.report(docs).collect()}
    assert labels[4] == "cc-by,cc-by-nc-4.0"
    assert labels[5] == "apache-2.0" and labels[6] == "apache-2.0"
    assert labels[7] == ""
    assert labels[11] == "gpl,gpl-3.0"
    assert labels[12] == "mit"
    assert labels[14] == "mit,reserved"


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "all rights reserved", None, None, None)] * 3 + [(1, None, None, None, None)], SCHEMA)
    got = license_scan.report(docs).collect()
    assert sorted((r.doc_id is None, r.n_base) for r in got) == [(False, 0), (True, 1), (True, 1), (True, 1)]
    assert license_scan.report(docs.limit(0)).count() == 0


def test_own_templates_and_text_column(spark):
    docs = spark.createDataFrame([("a", "do not copy this do not copy")], "key string, body string")
    got = license_scan.scan(docs, [base("no", "do not copy")], text="body", doc_id="key").collect()
    assert [(h.label, h.start) for h in got[0].hits] == [("no", 0), ("no", 4)]
    assert got[0].doc_id == "a"


def test_the_index_posts_rare_words_only():
    index = Index([base("gpl", "general public license")], 1000, Counter({b"general": 900, b"public": 5, b"license": 50}))
    assert dict(index.postings) == {b"public": [(0, 1)]}


def test_a_key_phrase_must_be_in_its_template():
    with pytest.raises(ValueError):
        template("x", "some words", "other words")
    with pytest.raises(ValueError):
        template("x", "...")
