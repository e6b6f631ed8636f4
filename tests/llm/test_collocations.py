"""Phrase collocations against counting by hand; filters read back."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from noonwatt.llm import collocations
from noonwatt.llm.collocations import permute, packed, merged, unpacked

SCHEMA = "doc_id bigint, text string, lang string, rank int, phrase string, n string"


def made(seed=1, n=200):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "Über", "x-y", "\x01"]
    rows = []
    for i in range(n):
        said = random.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=random.randint(0, 60))
        said = " ".join(said).replace("w3 ", random.choice(["New York City ", "new york ", "w3. ", "a\tb  c\n"]))
        rows.append((i, said, random.choice(["en", "de", None, "und"]), None, "p", "n"))
    return rows + [(n, None, None, None, None, None), (n + 1, "", "en", None, None, None), (n + 2, "hapax", "fr", 1, "", "")]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def expected(rows, least=10, top=2000, percent=50):
    f, total = Counter(), Counter()
    for row in rows:
        lang = row[2] if row[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(row[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in total:
        found = []
        candidates = {p: a for (g, p), a in f.items() if g == lang and a >= least and len(p) > 1}
        for p, a in candidates.items():
            best = min(
                (1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                for k in range(1, len(p))
            )
            around = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * b >= percent * a for b in around):
                found.append((-best[0], -a, " ".join(p).encode(), best[2], best[3]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"task_words": 50, "shard_words": 100}])
def test_like_counting_by_hand(spark, options):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collocations.collocations(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected(rows)
    assert len(want) > 20
    assert sorted(map(tuple, got.collect())) == want


def test_a_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 1000)
    text = " ".join(r[1] for r in made(3) if r[1]).encode()
    whole = [t for part in collocations.tokens(text) for t in part]
    monkeypatch.setattr(collocations, "SLICE", len(text))
    assert whole == [t for part in collocations.tokens(text) for t in part]


def test_few_best_and_least(spark):
    rows = made(2)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = collocations.collocations(docs, least=4, top=7, inside_percent=80)
    assert sorted(map(tuple, got.collect())) == expected(rows, 4, 7, 80)


def test_an_empty_table_and_one_without_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "one two", "en", None, None, None), (2, None, None, None, None, None)], SCHEMA)
    assert collocations.collocations(docs).count() == 0


def test_many_repeats_of_one_text(spark):
    rows = [(i, "aa bb cc", "en", None, None, None) for i in range(500)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "aa bb cc", 500, 500, 500, 1500, 1000000)]


def test_ids_are_widened_or_reseeded_until_no_two_words_share_one(spark):
    docs = spark.createDataFrame([(i, " ".join(f"a{j}" for j in range(i, i + 40)), "en") for i in range(60)], "doc_id int, text string, lang string")
    words, seed, width = collocations.dictionary(collocations._spoken(docs, "text", "lang"))
    assert words.select("id").distinct().count() == words.count() == 99
    # Ids of 12 bits collide under most seeds; one that holds is looked for, or an error raised.
    try:
        words, seed, width = collocations.dictionary(collocations._spoken(docs, "text", "lang"), widest=14)
        assert width <= 14 and words.select("id").distinct().count() == 99
    except RuntimeError:
        pass
    with pytest.raises(RuntimeError):
        collocations.dictionary(collocations._spoken(docs, "text", "lang"), widest=6)


@pytest.mark.parametrize("length", [2, 3])
@pytest.mark.parametrize("width", [9, 21, 40, 63])
def test_filters_lose_nothing(length, width):
    rng = np.random.default_rng(length * width)
    ids = [rng.integers(0, 1 << min(width, 9), 3000, np.uint64) << np.uint64(max(0, width - 9)) for _ in range(length)]
    spread = permute(ids, width)
    assert all((a == b).all() for a, b in zip(ids, permute(spread, width, back=True)))
    counts = rng.integers(1, 1000, 3000)
    lanes, total = merged(spread, counts)
    want = Counter()
    for gram, n in zip(zip(*[x.tolist() for x in spread]), counts.tolist()):
        want[gram] += n
    assert dict(zip(zip(*[x.tolist() for x in lanes]), total.tolist())) == want
    shard_bits = 3
    shard = (lanes[0] >> np.uint64(width - shard_bits)).astype(int)
    for s in range(8):
        of = shard == s
        back, n = unpacked(packed([x[of] for x in lanes], total[of], width, shard_bits), s, length, width, shard_bits)
        assert (n == total[of]).all()
        assert all((a == b[of]).all() for a, b in zip(back, lanes))


def test_the_map_and_its_single_probe_agree():
    x = np.array([0, 1, 12345, 2**62], np.uint64)
    assert [collocations._mix_one(int(v)) for v in x] == collocations._mix(x).tolist()
