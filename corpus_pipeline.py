"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of documents; the last returns tokens.
Stage outputs are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimlark.llm import bpe, decontaminate, frames, jaccard, passages, text, toxicity
from skimlark.llm.queries import remainder, vocabulary

#: The stages' decisions rest on a trained network and on min-hashes, which SQL cannot express.
ORACLE_SQL = None


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject."""
    labels = frames.reader(spark, sf_dir, "labels")
    judged = toxicity.scores(docs, labels, remainder(4) != 2, carried=True)
    return judged.where("predicted = 0").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id; rows without doc_id stay."""
    groups = jaccard.linked(docs)
    extra = frames.kept(groups.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct())
    return passages.among(docs, extra, "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; documents of which nothing is left go."""
    keyed, _ = passages.keyed(docs)  # rows that share a doc_id are cut each by its own spans
    spans = frames.kept(passages.repeated_keys(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "start_word", "end_word"))
    return cut(keyed, spans, "_key").drop("_key")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, frames.reader(spark, sf_dir, "benchmark"))
    return passages.among(docs, frames.kept(found.select("doc_id").distinct()), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every document that is left, ids as little-endian 32-bit integers."""
    return bpe.tokenized(docs, vocabulary(), decoded=False).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def cut(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts without word spans ``(key, start_word, end_word)``; only documents with spans are looked at by word."""
    lists = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("_cut"))
    small = lists.count() <= jaccard.NEEDED // 10
    joined = docs.join(F.broadcast(lists) if small else lists, key, "left").select(*docs.columns, "_cut")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            values, parts = (batch.column(names.index(c)).to_pylist() for c in ("text", "_cut"))
            new = [shortened(v, [(r["start_word"], r["end_word"]) for r in p]) if v is not None else None for v, p in zip(values, parts, strict=True)]
            columns = {c: batch.column(names.index(c)) for c in names if c != "_cut"} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array([t is None or bool(t) for t in new], pa.bool_()))

    touched = joined.where("_cut is not null").mapInArrow(text.tidy(run), schema)
    return joined.where("_cut is null").select(docs.columns).unionByName(touched)


def shortened(value: str, parts: list[tuple[int, int]]) -> str:
    """The text without the words of these spans; white space around a cut becomes one line feed."""
    raw, low = value.encode("utf-8", "replace"), text.lowered(value)
    starts, ends = text.word_spans(low)
    left, at = [], 0
    for first, last in parts:
        if first < len(starts):
            left.append(raw[at : starts[first]])
            at = ends[min(last, len(ends)) - 1]
    left.append(raw[at:])
    pieces = [p.strip(b" \t\n\r\x0b\x0c") for p in left]
    return b"\n".join(p for p in pieces if p).decode()


STAGES = [("toxicity", keep_clean), ("near_duplicates", one_of_each), ("passages", without_repeats), ("benchmark", without_benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = frames.reader(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = frames.written(stage(spark, docs, sf_dir), name)
    return docs
