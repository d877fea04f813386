"""Repetition coverage against a plain count of windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimlark.llm import repetition as R


def brute(text):
    """The same counts window by window."""
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    def cover(n, first):
        seen, where = {}, set()
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i:i + n]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                for i in at if first else at[1:]:
                    where |= set(range(i, i + n))
        return where

    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover(3, True))}
    for n in R.LIMITS:
        out[f"chars_{n}"] = sum(len(words[j]) for j in cover(n, False))
    seen, chars = set(), 0
    for x in lines:
        chars += sum(c not in " \t\n\x0b\x0c\r" for c in x) if x in seen else 0
        seen.add(x)
    return out | {"line_chars": chars}


def texts():
    draw = random.Random(3)
    out = [None, "", "  \n\t", "a", "a\n a\na", "é é é é é é é", "x " * 70, "same line here\n" * 40, "# * $ % & | < >" * 9]
    for size in (3, 8, 60, 400):
        for words in (2, 6, 40, 900):
            line = [draw.choice("abcdefgh") * draw.randint(1, 4) + str(draw.randrange(words)) for _ in range(size)]
            out += [" ".join(line), " ".join(line + line[: size // 2] + line), draw.choice([" ", "\n", "\x0b"]).join(line) + "\n" + " ".join(line[:9])]
    return out


def test_counts_equal_the_plain_count():
    for text in texts():
        assert R.measured(text) == brute(text)


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that is always the same, classes come from the words."""
    monkeypatch.setattr(R, "rolled", lambda ids, places, n: np.zeros(len(places), np.uint64))
    for text in texts():
        if text and len(text) < 600:
            assert R.measured(text) == brute(text)


def test_rows(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    half = prose + " " + " ".join(f"word{i}" for i in range(14))
    rows = [(1, prose), (1, prose), (None, prose), (2**60 + 1, prose), (2, None), (3, ""), (4, "a b c " * 30), (5, half), (6, "x" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(1)).withColumn("kept", F.lit("x"))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in R.judged(df).collect() if r["doc_id"] is not None)
    assert got == [(False, 1, 80, False, True), (False, 1, 80, False, True), (False, 2, 0, True, False), (False, 3, 0, True, False),
                   (False, 4, 90, True, False), (False, 5, 94, False, False), (False, 6, 1, True, False), (False, 2**60 + 1, 80, False, True)]
    assert R.judged(df.where("doc_id is null")).first()["kept"]
    assert R.judged(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit,kept", [(100, True), (10, False)])
def test_limits_are_parameters(spark, limit, kept):
    text = " ".join(f"w{i % 75}" for i in range(95))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert R.judged(df, limits={6: limit}, line_limit=100).first()["kept"] is kept
