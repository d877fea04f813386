"""Source divergence audit: how far the term shares of each (lang, source) group lie from every other source of the language.

Terms are runs of letters: bytes other than 0x00-0x40, 0x5B-0x60 and 0x7B-0x7F after A-Z are lower-cased. A language keeps the
terms that at least ``LEAST_DOCS`` of its rows hold. The share of a term in a group, in parts of ``SCALE``, is
``p = 1 + floor(SCALE * (count + 1) / (N + V))``; a pair of shares gives ``f = floor((p - q)**2 / q)``.

Pairs of sources go by run-length columns. A term is the list of its (source, count) cells, and terms of equal lists are one
entry with a length. Entries are dealt into bundles, sorted there so that equal counts cluster, and each source's counts down
the bundle become runs. For two sources the boundaries of their runs are intersected, and f of the two counts is multiplied
by the length of each common run. Only runs are shuffled, and only source blocks meet, so no task holds a language.

Null text, lang or source are the empty string. A language without kept terms gives zeros for its pairs; a group without
terms still has shares. Rows are counted each for itself, whatever their doc_id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimlark.llm.frames import kept, written

SCALE = 1_000_000_000
LEAST_DOCS = 3
RANKS = 200
ENTRIES = 8192  # entries of a bundle
BLOCK = 32  # sources of a block; two blocks meet in a task
HELD = 200_000  # counted cells that a task holds before it passes them on
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """All terms of a text in order."""
    return (text or b"").translate(_LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and rows of each term, summed as far as one task meets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        rows: dict[tuple, Counter] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = Counter(terms(text))
                if not found:
                    continue
                key = lang, source
                mine, docs_with = n.setdefault(key, Counter()), rows.setdefault(key, Counter())
                before = len(mine)
                mine.update(found)
                docs_with.update(found.keys())
                size += len(mine) - before
                if size >= HELD:
                    yield _cells(n, rows)
                    n, rows, size = {}, {}, 0
        if n:
            yield _cells(n, rows)

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _cells(n: dict[tuple, Counter], rows: dict[tuple, Counter]) -> pa.RecordBatch:
    keys = [k for k, c in n.items() for _ in c]
    return pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
        pa.array([t.decode("utf-8", "replace") for c in n.values() for t in c], pa.string()),
        pa.array([x for c in n.values() for x in c.values()], pa.int64()),
        pa.array([rows[k][t] for k, c in n.items() for t in c], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n`` of the terms that ``least_docs`` rows of their language hold, written once."""
    cells = counted(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("docs").alias("docs"))
    return written(of_term.where(F.col("docs") >= least_docs).select("lang", "term", F.inline("cells")), "divergence-counts")


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """The share p of a count, exact."""
    wide = "decimal(28,0)"
    return 1 + F.call_function("div", (count + 1).cast(wide) * F.lit(SCALE).cast("decimal(10,0)"), (total + vocabulary).cast(wide))


def shares(counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """The same of whole columns."""
    if int(counts.max(initial=0)) < 9_000_000_000:
        return 1 + (counts.astype(np.int64) + 1) * SCALE // max(total + vocabulary, 1)
    return np.array([1 + (int(c) + 1) * SCALE // (total + vocabulary) for c in counts], np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of shares p and q."""
    return (p - q) * (p - q) // q


def runs(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length form of a column of entries: the end of each run, in terms, and its value."""
    last = np.r_[values[1:] != values[:-1], True]
    return np.cumsum(lengths)[last], values[last]


def summed(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sum of f over the terms of two columns of runs, from p to q and from q to p."""
    ends = np.union1d(p[0], q[0])
    x, y = p[1][np.searchsorted(p[0], ends)], q[1][np.searchsorted(q[0], ends)]
    length = np.diff(ends, prepend=0)
    d = (x - y) * (x - y)
    return int((d // y * length).sum()), int((d // x * length).sum())


def columns_of(entries: DataFrame, entries_of_bundle: int = ENTRIES) -> DataFrame:
    """``lang, bundle, place, ends, counts``: the run-length column of every source in every bundle.

    ``entries`` are ``lang, cells, length, sources``; a column's arrays are little-endian 64-bit integers.
    """
    many = entries.groupBy("lang").agg(F.ceil(F.count("*") / entries_of_bundle).alias("bundles"))
    dealt = entries.join(F.broadcast(many) if many.count() <= 100_000 else many, "lang").withColumn(
        "bundle", F.pmod(F.xxhash64("cells"), F.col("bundles")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [sorted((int(c["place"]), int(c["n"])) for c in x) for x in pdf["cells"]]
        order = sorted(range(len(cells)), key=cells.__getitem__)
        length = pdf["length"].to_numpy(np.int64)[order]
        place = np.array([p for i in order for p, _ in cells[i]], np.int64)
        count = np.array([n for i in order for _, n in cells[i]], np.int64)
        row = np.repeat(np.arange(len(order)), [len(cells[i]) for i in order])
        by_place = np.argsort(place, kind="stable")
        place, count, row = place[by_place], count[by_place], row[by_place]
        out = []
        for s in range(int(pdf["sources"].iloc[0])):
            a, b = np.searchsorted(place, [s, s + 1])
            values = np.zeros(len(order), np.int64)
            values[row[a:b]] = count[a:b]
            ends, held = runs(values, length)
            out.append((pdf["lang"].iloc[0], int(pdf["bundle"].iloc[0]), s, ends.astype("<i8").tobytes(), held.astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["lang", "bundle", "place", "ends", "counts"])

    return dealt.groupBy("lang", "bundle").applyInPandas(run, "lang string, bundle long, place int, ends binary, counts binary")


def pair_sums(columns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang, place, other, value`` of every ordered pair of sources; ``columns`` also hold N, V and the number of sources."""
    mine = F.floor(F.col("place") / block)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / block))
    sent = columns.withColumn("mine", mine).withColumn("theirs", F.explode(blocks)).withColumn(
        "low", F.least("mine", "theirs")).withColumn("high", F.greatest("mine", "theirs")).drop("sources", "theirs")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        made = []
        for place, own, ends, counts, total, vocabulary in zip(*(pdf[c] for c in ("place", "mine", "ends", "counts", "total", "vocabulary")), strict=True):
            made.append((int(place), int(own), np.frombuffer(ends, "<i8"), shares(np.frombuffer(counts, "<i8"), int(total), int(vocabulary))))
        out = []
        for i, (a, block_a, *p) in enumerate(made):
            for b, block_b, *q in made[i + 1 :]:
                if low == high or block_a != block_b:
                    there, back = summed(tuple(p), tuple(q))
                    out += [(a, b, there), (b, a, back)]
        table = pd.DataFrame(out, columns=["place", "other", "value"])
        table.insert(0, "lang", pdf["lang"].iloc[0])
        return table

    parts = sent.groupBy("lang", "bundle", "low", "high").applyInPandas(run, "lang string, place int, other int, value long")
    return parts.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: for every (lang, source) group each other source of the language, value the sum of f over all kept terms.
    Part ``term``: the group's terms of greater share than in the language, value f, the ``ranks`` first. Value descending, then item ascending.
    """
    counts = kept_counts(docs, least_docs)
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    of_lang = langs.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("lang_total"))
    by_source = Window.partitionBy("lang").orderBy("source")  # one row a group; its square is the result
    facts = kept(groups.withColumn("place", F.row_number().over(by_source) - 1)
                 .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
                 .join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
                 .na.fill(0, ["total", "vocabulary", "lang_total"]))
    few = facts.count() <= 100_000
    small = F.broadcast(facts) if few else facts

    placed = counts.join(small, ["lang", "source"]).groupBy("lang", "term", "sources").agg(
        F.sort_array(F.collect_list(F.struct("place", "n"))).alias("cells"))
    entries = kept(placed.groupBy("lang", "cells", "sources").agg(F.count("*").alias("length")))
    columns = columns_of(entries).join(small, ["lang", "place"])
    sums = pair_sums(columns.select("lang", "bundle", "place", "ends", "counts", "total", "vocabulary", "sources"))
    theirs = facts.select("lang", F.col("source").alias("item"), F.col("place").alias("other"))
    pairs = facts.join(F.broadcast(theirs) if few else theirs, "lang").where("place <> other").join(sums, ["lang", "place", "other"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    cells = langs.select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells")).join(small, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("vocabulary")), share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    more = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    second = more.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    second = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return first.withColumn("rank", F.row_number().over(order)).unionByName(second)
