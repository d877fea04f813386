"""Long ids beside nulls, and rows that share a doc_id."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skimlark.llm import bpe, decontaminate, fingerprints, jaccard, language_model, passages, queries, repetition, text, wrappers
from skimlark.llm.queries import vocabulary

BIG = [2**60 + 1, 2**60 + 3, 2**60 + 5]


def words(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def ids(df, c="doc_id"):
    return sorted(r[c] for r in df.collect() if r[c] is not None)


def test_long_ids_beside_nulls(spark):
    texts = [words(1, 60), words(2, 60), words(3, 60), words(4, 60)]
    docs = spark.createDataFrame(list(zip([*BIG, None], texts, strict=True)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i + 1, " ".join(t.split()[10:40])) for i, t in zip(BIG, texts)] + [(None, texts[3])], "item_id long, text string")
    found = decontaminate.contaminated(docs, items)
    assert ids(found) == BIG and ids(found, "item_id") == [i + 1 for i in BIG]
    assert ids(fingerprints.fingerprints(docs)) == ids(jaccard.linked(docs)) == ids(repetition.judged(docs)) == BIG
    assert ids(jaccard.linked(docs), "component_id") == BIG
    assert ids(bpe.token_digests(docs, vocabulary())) == BIG
    assert ids(language_model.scores(docs, F.lit(True))) == BIG
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.concat(F.lit("<article><p>"), "text").alias("html"))
    assert ids(wrappers.extracted(pages), "page_id") == BIG


def test_rows_of_one_document_are_linked(spark):
    """0 and 7 share a text, 7 and 3 another one: all three are one component, in the operator and in its SQL."""
    x, y = words(1, 100), words(2, 100)
    rows = [(0, x), (7, x.replace(x.split()[50], "other", 1)), (7, y.replace(y.split()[50], "other", 1)), (3, y), (9, words(3, 100)), (9, None), (4, "a b")]
    got = sorted(map(tuple, jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [(r[0], r[2]) for r in got] == [(0, 0), (3, 0), (4, 4), (7, 0), (7, 0), (9, 9), (9, 9)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(con.execute(queries.ORACLES["op9_ngram_jaccard"]).fetchall()) == got


def test_passages_of_rows_that_share_an_id(spark):
    a, p = words(1, 120), words(2, 80)
    rows = [(0, f"{a} {p}"), (5, f"{a} {p}"), (5, f"{words(3, 40)} {p}"), (6, words(4, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in passages.repeated(df).collect())
    assert (5, 0, 0, 200) in got and any(r[0] == 5 and r[2] == 40 and r[3] == 120 for r in got)


def test_pipeline_cuts_only_the_row_that_repeats(spark):
    p, own = words(2, 80), words(3, 80)
    rows = [(0, p, "en", "s", len(p)), (5, f"{words(5, 70)} {p}", "en", "s", 9), (5, own, "en", "s", len(own))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["text"] for r in corpus_pipeline.without_repeats(spark, df, "").collect())
    assert got == sorted([p, words(5, 70), own])


def test_caches_of_a_task_are_bounded_and_given_back():
    automaton = bpe.Automaton(bpe.compiled(vocabulary()))
    before = automaton.encode("hello world " + "x" * 5000)
    assert not any(len(k) > bpe.LONG for k in automaton) and len(automaton) == 2
    automaton.forget()
    assert not automaton and not automaton.arcs and automaton.encode("hello world " + "x" * 5000) == before


@pytest.mark.parametrize("known", [5, 40, 200])
def test_most_frequent_words_are_exact(spark, monkeypatch, known):
    monkeypatch.setattr(language_model, "KNOWN", known)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"word": rng.permutation(100), "c": rng.integers(1, 6, 100)})
    rows.loc[:7, "c"] = 20_000 + np.arange(8)
    got = language_model.most_frequent(spark.createDataFrame(rows), len(rows))
    want = rows.sort_values(["c", "word"], ascending=[False, True]).head(known)
    assert got["word"].tolist() == want["word"].tolist()


def test_what_another_operator_kept_is_given_back():
    given = []
    text.keeps("one", lambda: given.append("one"))
    text.alone("one")
    assert given == []
    text.alone("other")
    text.alone("other")
    assert given == ["one"]
