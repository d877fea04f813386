"""Source divergence against a plain sum over all kept terms."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimlark.llm import divergence as D

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    rows = [tuple(v or "" for v in r) for r in rows]
    held, own, groups = defaultdict(Counter), defaultdict(Counter), sorted({(r[0], r[1]) for r in rows})
    for lang, source, text in rows:
        found = LETTERS.findall(text.translate(LOWER))
        held[lang].update(set(found))
        own[lang, source].update(found)
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in held.items()}
    p, q = {}, {}
    for lang, source in groups:
        terms = kept[lang]
        n = {t: own[lang, source][t] for t in terms}
        p[lang, source] = {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(terms)) for t in terms}
    for lang in {g[0] for g in groups}:
        n = {t: sum(own[g][t] for g in groups if g[0] == lang) for t in kept[lang]}
        q[lang] = {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(n)) for t in n}
    out = []
    for lang, source in groups:
        x = p[lang, source]
        pairs = [(sum((x[t] - y) ** 2 // y for t, y in p[lang, s].items()), s) for k, s in groups if k == lang and s != source]
        terms = [((x[t] - q[lang][t]) ** 2 // q[lang][t], t) for t in x if own[lang, source][t] and x[t] > q[lang][t]]
        for part, found, cut in (("pair", pairs, None), ("term", terms, 200)):
            ordered = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:cut]
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def corpus(n, seed=1):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("The", "ent", "éo", "漢", "zz") for b in ("a", "bb", "É", "xyz", "q", "r", "ss")]
    rows = []
    for i in range(n):
        lang, source = draw.choice(["en", "en", "fr", None]), draw.choice([f"s{k}" for k in range(7)] + ["hot"] * 5 + [None])
        rows.append((lang, source, draw.choice([" ", ", ", "1"]).join(draw.choice(words[: 10 + ord((source or "0")[-1]) % 20]) for _ in range(draw.randint(0, 30)))))
    return rows + [("en", "s1", None), ("de", "only", "few words here"), ("de", "other", ""), ("xx", "", "@@ 123"), ("en", "bare", "1 2 3")]


def got(df, **kw):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in D.audited(df, **kw).collect())


@pytest.mark.parametrize("entries,block", [(D.ENTRIES, D.BLOCK), (5, 2), (1, 3)])
def test_equals_the_plain_sum(spark, monkeypatch, entries, block):
    monkeypatch.setattr(D.columns_of, "__defaults__", (entries,))
    monkeypatch.setattr(D.pair_sums, "__defaults__", (block,))
    monkeypatch.setattr(D, "HELD", 11)
    rows = corpus(300)
    df = spark.createDataFrame([(*r, 0, 2.0) for r in rows], "lang string, source string, text string, n int, place double")
    assert got(df.withColumn("sources", F.lit("x")).repartition(5)) == brute(rows)


def test_odd_tables(spark):
    schema = "lang string, source string, text string"
    assert got(spark.createDataFrame([], schema)) == []
    assert got(spark.createDataFrame([(None, None, None)], schema)) == []
    rows = [("en", "a", "x"), ("en", "b", "y")] + [("", "a", "same same")] * 4
    assert got(spark.createDataFrame(rows, schema)) == brute(rows)
    long = [("en", "a", "alpha beta " * 200_000)] * 3 + [("en", "b", "alpha")]
    assert got(spark.createDataFrame(long, schema)) == brute(long)


def test_ranks_end_at_the_limit(spark):
    rows = [("en", "a", " ".join("w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)))] * 3 + [("en", "b", "other words only")] * 3
    assert got(spark.createDataFrame(rows, "lang string, source string, text string")) == brute(rows)


def test_runs_of_two_columns():
    rng = np.random.default_rng(4)
    for _ in range(100):
        lengths = rng.integers(1, 5, 12)
        p, q = rng.integers(1, 4, 12), rng.integers(1, 4, 12)
        there, back = D.summed(D.runs(p, lengths), D.runs(q, lengths))
        assert there == int((D.gap(p, q) * lengths).sum()) and back == int((D.gap(q, p) * lengths).sum())
    for a, b in combinations(range(3), 2):
        assert D.summed(D.runs(np.array([a + 1]), np.array([7])), D.runs(np.array([b + 1]), np.array([7])))[0] == 7 * ((a - b) ** 2 // (b + 1))


def test_shares_beyond_64_bits():
    big = np.array([10**13, 5], np.int64)
    assert D.shares(big, 2 * 10**13, 2).tolist() == [1 + (int(c) + 1) * 10**9 // (2 * 10**13 + 2) for c in big]
