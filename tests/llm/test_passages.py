"""Work that passages does once: comparisons of anchors in line, hashes of many texts, shuffles behind written tables."""

import os
import time

import numpy as np
import pytest

from skimlark.functions import order
from skimlark.llm import frames, passages, text

ODD = [None, "", " ", "a", "a b c d", "one two three four five", "\x00b c\x1f d e f g", "Ü\t\n\v\f\r x", " lead and trail ", "é " * 7, "日本語 テキスト"]


def words(seed: int, n: int, of: int = 5000) -> str:
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, of, n))


@pytest.mark.parametrize("together", [1, 300, 1 << 20])
def test_texts_hashed_together_have_the_hashes_of_each(monkeypatch, together):
    monkeypatch.setattr(text, "TOGETHER", together)
    texts = [*ODD, words(1, 300), *ODD, words(2, 3)]
    for t, s in zip(texts, text.all_shingles(texts), strict=True):
        assert s.tolist() == text.shingles(t).tolist()
    own = [text.word_hashes(r, *text.word_spans(r)).tolist() for r in map(text.lowered, texts)]
    got = [words[a:b].tolist() for words, begins in text.several(texts) for a, b in zip(begins, begins[1:], strict=False)]
    assert got == own and list(text.several([])) == []


def test_keys_of_word_sequences_tell_order_and_length():
    texts = ["a b", "b a", "a b a b", "", "a b", "A  B", None, "a a", "a", "a a a"]
    (hashes, begins), = text.several(texts)
    keys = passages.sequence_keys(hashes, begins).tolist()
    assert keys[0] == keys[4] == keys[5] and keys[3] == keys[6] and len(set(keys)) == 7


def test_word_spans_of_every_byte():
    raw = bytes(range(256)) + b"x  y" + bytes(range(255, -1, -1))
    starts, ends = passages.text.word_spans(raw)
    parts = [bytes(p) for p in raw.translate(bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))).split(b" ") if p]
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == parts


def test_nearest_smaller_and_fewest_distinct_by_brute_force():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 50, 300):
        for values in (rng.permutation(n), np.arange(n), np.arange(n)[::-1]):
            want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
            assert passages.nearest_smaller(values.astype(np.uint64)).tolist() == want
    for n in (3, passages.WIDTH, 90):
        for of in (20, 10**9):
            s = rng.integers(0, of, n).astype(np.uint64)
            runs = [len(set(s[k : k + passages.WIDTH].tolist())) for k in range(n - passages.WIDTH + 1)]
            assert passages.fewest_distinct(s) == min(runs, default=passages.WIDTH)


def test_anchors_in_line_are_compared_once(monkeypatch):
    """300 anchors of one line in two documents that share every second stretch: their surroundings are looked up once, not for each."""
    rng = np.random.default_rng(9)
    y = rng.integers(1, 2**60, 3000).astype(np.uint64)
    x = y.copy()
    other = (np.arange(3000) // 10) % 2 == 1
    x[other] = rng.integers(1, 2**60, int(other.sum())).astype(np.uint64)
    anchors = [(int(k), int(k)) for k in np.flatnonzero(~other)[::5]]
    calls = []
    found = passages._found
    monkeypatch.setattr(passages, "_found", lambda *a: (calls.append(1), found(*a))[1])
    assert passages.shared_spans(x, y, anchors) == []
    assert len(calls) <= 10  # 603 before

    edited = y.copy()
    edited[[500, 1200, 1207, 2000]] = 7
    spans = passages.shared_spans(edited, y, anchors)
    assert spans == [(0, 2999, 0, 2999)]


def test_written_rows_leave_no_shuffles(spark):
    def left() -> int:
        tops = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
        return sum(os.path.getsize(os.path.join(d, f)) for top in tops for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_"))

    rows = spark.range(200_000).selectExpr("id", "uuid() AS u")
    before = left()
    kept = frames.kept(rows.repartition(4, "id"))
    until = time.time() + 20  # they are removed in the background
    while left() - before > 1_000_000 and time.time() < until:
        time.sleep(0.2)
    assert left() - before < 1_000_000  # 200000 rows of 36 characters
    assert kept.count() == 200_000 and kept.select("id").distinct().count() == 200_000
    with order.passing(spark):
        assert rows.groupBy("id").count().count() == 200_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"


def test_places_outside_of_spans_by_brute_force(spark):
    rng = np.random.default_rng(12)
    spans = [(int(b), int(f), int(f + n), "x") for b, f, n in zip(rng.integers(0, 6, 80), rng.integers(0, 400, 80), rng.integers(0, 30, 80), strict=True)]
    places = [(int(k), int(b), int(y)) for k, b, y in zip(rng.integers(0, 9, 900), rng.integers(0, 8, 900), rng.integers(0, 450, 900), strict=True)] + [(1, 7, 5)] * 2
    ends = [(9, b, f + d) for b, f, e, _ in spans[:20] for d in (-1, 0, e - f, e - f + 1)]
    rows = spark.createDataFrame(places + ends, "key long, b long, y int")
    got = sorted(map(tuple, passages.outside(rows, "b", "y", spark.createDataFrame(spans + spans[:5], "b long, b_first long, b_last long, other string")).collect()))
    assert got == sorted((k, b, y) for k, b, y in places + ends if not any(b == d and f <= y <= e for d, f, e, _ in spans))
    assert passages.outside(rows, "b", "y", spark.createDataFrame([], "b long, b_first long, b_last long")).count() == len(places + ends)
