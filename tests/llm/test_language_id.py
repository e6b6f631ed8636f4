"""Language identification against the same evidence added up by hand."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from noonwatt.llm import language_id as li

SCHEMA = "doc_id bigint, text string, lang string, source string, suffix string, language string, host int, prior string"
WORDS = {"en": "the of and with that thing".split(), "fr": "le la été où que ça".split(), "de": "der über und nicht für".split()}


def rows():
    rng = random.Random(3)
    out = []
    for i in range(240):
        lang = rng.choice(["en", "en", "fr", "de"])
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([1, 3, 40])))
        told = lang if rng.random() < 0.85 else rng.choice([None, "de", "xx"])
        out.append((i, text, told, {"en": "a", "fr": "b", "de": None}[lang] if rng.random() < 0.8 else "c", lang[:1], "x", 1, None))
    out += [(900, None, "en", "a", "e", "x", 1, None), (901, "", None, None, None, "x", 1, None), (902, "1234 !!", "fr", "d", "d", "x", 1, None), (903, "the " * 60_000, None, "new", "q", "x", 1, None)]
    return out + out[:3]


def letters(text):
    b = [c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in b" " + (text or "").encode() + b" "]
    grams = [(b[i], b[i + 1], b[i + 2]) for i in range(len(b) - 2) if b[i + 1] != 32]
    return [((x << 16 | y << 8 | z) * 0x9E3779B1 % (1 << 32)) >> (32 - li.BITS) for x, y, z in grams]


def by_hand(data, with_suffix):
    told = Counter(r[2] for r in data if r[2] is not None)
    names = sorted(x for x, n in told.items() if n > 0)
    seen = {x: Counter(g for r in data if r[2] == x for g in letters(r[1])) for x in names}
    total = {x: sum(c.values()) + 0.5 * 2**li.BITS for x, c in seen.items()}
    scores = []
    for r in data:
        s = {x: sum(math.log((seen[x][g] + 0.5) / total[x]) for g in letters(r[1])) / li.EVIDENCE for x in names}
        if r[2] in names:
            s = {x: v + math.log(li.DECLARED if x == r[2] else (1 - li.DECLARED) / (len(names) - 1)) for x, v in s.items()}
        scores.append(s)
    place = [(r[4] if with_suffix else "", r[3]) for r in data]
    votes, by_suffix, every = defaultdict(Counter), defaultdict(Counter), Counter()
    for r, s, p in zip(data, scores, place):
        if letters(r[1]):
            best = max(names, key=lambda x: (s[x], [-ord(c) for c in x]))
            votes[p][best] += 1
            by_suffix[p[0]][best] += 1
            every[best] += 1
    out = []
    for r, s, p in zip(data, scores, place):
        if p in votes:
            root = {x: (every[x] + 1) / (sum(every.values()) + len(names)) for x in names}
            up = {x: (by_suffix[p[0]][x] + li.PRIOR * root[x]) / (sum(by_suffix[p[0]].values()) + li.PRIOR) for x in names}
            s = {x: v + math.log((votes[p][x] + li.PRIOR * up[x]) / (sum(votes[p].values()) + li.PRIOR)) for x, v in s.items()}
        top = max(s.values())
        post = 1 / sum(math.exp(v - top) for v in s.values())
        out.append((r[0], max(names, key=lambda x: s[x]), post, len(letters(r[1])), not letters(r[1]) or post < li.MIN_POSTERIOR))
    return out


@pytest.mark.parametrize("with_suffix", [False, True])
def test_like_evidence_by_hand(spark, with_suffix):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    got = li.report(docs, suffix=F.col("suffix") if with_suffix else None)
    assert got.columns == ["doc_id", "language", "posterior", "letters", "rejected"]
    want = by_hand(data, with_suffix)
    for g, w in zip(sorted(map(tuple, got.collect())), sorted(want), strict=True):
        assert (g[0], g[1], g[3], g[4]) == (w[0], w[1], w[3], w[4])
        assert g[2] == pytest.approx(w[2], abs=1e-4)
    right = {r[0]: next(x for x, ws in WORDS.items() if r[1].split()[0] in ws) for r in data[:240]}
    assert sum(right[g[0]] == g[1] for g in want[:240]) > 225


def test_accepted_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = li.accepted(docs)
    assert got.columns == docs.columns
    gone = {r.doc_id for r in li.report(docs).collect() if r.rejected}
    assert {900, 901, 902} <= gone
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows() if r[0] not in gone)


def test_without_declared_languages(spark):
    docs = spark.createDataFrame([(1, "word", None, "a"), (2, "12", None, None), (3, None, None, "a"), (4, "é", None, "a")], "doc_id int, text string, lang string, source string")
    got = {r.doc_id: (r.language, r.posterior, r.rejected) for r in li.report(docs).collect()}
    assert got == {1: (None, None, False), 2: (None, None, True), 3: (None, None, True), 4: (None, None, False)}
    assert li.report(docs.limit(0)).count() == 0


def test_languages_of_few_rows_are_told(spark):
    rows = [(i, "the of and with that thing " * 3, "en", "a") for i in range(400)]
    rows += [(1000, "over het niet naar zijn wordt " * 3, "nl", "b"), (1001, "over het niet naar zijn wordt " * 3, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: (r.language, r.rejected) for r in li.report(docs).collect()}
    assert got[1000] == got[1001] == ("nl", False) and got[0] == ("en", False)


def test_too_many_languages_raise(spark):
    docs = spark.range(li.MAX_LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.col("id").cast("string").alias("lang"), F.lit("a").alias("source"))
    with pytest.raises(ValueError, match="languages"):
        li.report(docs)


def test_gibberish_and_undeclared_scripts_are_rejected(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[x]) for _ in range(rng.choice([3, 40, 80]))), x if i % 5 else None, "a") for i in range(3000) for x in [rng.choice(list(WORDS))]]
    letters = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(7)) for _ in range(60))
    odd = [letters("abcdefghijklmnopqrstuvwxyz"), letters("ABCDEFGHabcdefgh0123456789+/"), letters("αβγδεζηθικλμνξοπρστυφχψω"), letters("абвгдежзийклмнопрстуфхцчшщ")]
    rows += [(1000 + i, text, None, "a") for i, text in enumerate(odd)]
    # A false declaration does not help where its language has many other rows.
    rows += [(2000, letters("bcdfghjklmnpqrstvwxz"), "en", "a")]
    rows += [(3000, "the", None, "b"), (3001, "für", None, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in li.report(docs).collect() if r.rejected} == {1000, 1001, 1002, 1003, 2000}


def test_pages_like_their_text_markup_and_host_by_hand(spark, tmp_path):
    from noonwatt.llm.queries import language_id_of_pages

    data, pages = [], []
    for i, (_, text, lang, host, suffix, *_) in enumerate(rows()):
        if text and len(text) > 100_000:
            continue
        name = f"{host or 'www'}.example.{suffix}"
        declared = None if lang is None else f' class="x" lang="{lang}"'
        page = f"<HTML{declared or ''}><script>var the = 'le la';</script><style>p {{}}</style><p>{text or ''}</p><br/>&nbsp;</HTML>"
        pages.append((i, f"https://{name.upper()}/{i}?q", page))
        data.append((i, text or "", lang, name, suffix))
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, language_id_of_pages(spark, str(tmp_path)).collect()))
    want = sorted(by_hand(data, True))
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[1], g[3], g[4]) == (w[0], w[1], w[3], w[4])
        assert g[2] == pytest.approx(w[2], abs=1e-4)
