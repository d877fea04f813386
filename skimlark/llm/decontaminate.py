"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set: (u/2, u] for powers of two u. For each partition a document is cut
into blocks of 2u shingles that overlap by u, so every passage of up to u shingles lies whole in one block, and containment of
an item bounds its Jaccard similarity with that block from below. From this bound follows the number of min-hashes that
miss a block with probability ``MISS`` at most; one equal min-hash makes a candidate. Items of up to ``SMALL`` shingles are looked up by
shingles instead: a document that holds an item has one of any ``n - needed + 1`` of its n shingles, so none is missed. Candidates are verified by exact shingle
containment in the whole document: 100 * shared >= 75 * item's shingles.

Items go out in slabs of ``ITEMS`` rows, each broadcast with that bound; documents are only mapped, never shuffled. Null and
empty texts have no shingle and match nothing; an item of fewer than five words matches documents of the same words only.
Repeated documents and items give repeated rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimlark.llm import text

U = np.uint64
SMALL = 8
ITEMS = 10_000
MISS = 1e-4
CONTAINED = 75
GATHERED = 400_000
SCHEMA = "doc_id string, item_id long, n_item long, n_shared long, containment double"


def partition(n: int) -> int:
    """Upper bound of the size partition."""
    return max(SMALL, 1 << max(0, (n - 1).bit_length()))


def hashes_needed(u: int) -> int:
    """Min-hashes after which a block that holds the item is missed with probability MISS at most."""
    t = CONTAINED / 100
    jaccard = min(t * q / (2 * u + q - t * q) for q in (max(1, u // 2), u))
    return math.ceil(math.log(MISS) / math.log(1 - jaccard))


class Index:
    """Signatures of one slab of items, by partition and hash function."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(i, s) for i, s in items if len(s)]
        self.classes = sorted({partition(len(s)) for _, s in self.items} - {SMALL})
        self.holders: dict[int, list[int]] = {}
        self.k = {u: hashes_needed(u) for u in self.classes}
        most = max(self.k.values(), default=0)
        self.turns = np.random.default_rng(5).integers(1, 2**63, most, dtype=np.uint64) | U(1)
        self.owners: dict[tuple[int, int, int], list[int]] = {}
        self.marks = {u: np.zeros((self.k[u], 1 << 16), bool) for u in self.classes}
        for at, (_, s) in enumerate(self.items):
            u = partition(len(s))
            if u == SMALL:
                for g in s[: len(s) - -(-CONTAINED * len(s) // 100) + 1].tolist():
                    self.holders.setdefault(g, []).append(at)
                continue
            for f in range(self.k[u]):
                low = int((s * self.turns[f]).min())
                self.owners.setdefault((u, f, low), []).append(at)
                self.marks[u][f, self.slot(np.uint64(low))] = True

        self.held = np.array(sorted(self.holders), np.uint64)

    @staticmethod
    def slot(low: np.ndarray) -> np.ndarray:
        return (low ^ (low >> U(20)) ^ (low >> U(40))) & U(0xFFFF)

    def candidates(self, sets: list[np.ndarray]) -> list[set[int]]:
        """For each ordered shingle array the items that share a min-hash with one of its blocks, or a looked-up shingle."""
        found: list[set[int]] = [set() for _ in sets]
        filled = [(d, s) for d, s in enumerate(sets) if len(s)]
        if filled and len(self.held):
            every = np.concatenate([s for _, s in filled])
            place = np.minimum(np.searchsorted(self.held, every), len(self.held) - 1)
            ends = np.cumsum([len(s) for _, s in filled])
            for at in np.flatnonzero(self.held[place] == every):
                found[filled[int(np.searchsorted(ends, at, side="right"))][0]].update(self.holders[int(every[at])])
        if not filled or not self.classes:
            return found
        padded = [np.concatenate([s, np.repeat(s[-1:], -len(s) % SMALL)]) for _, s in filled]
        cells = np.array([len(p) // SMALL for p in padded])
        first = np.concatenate([[0], np.cumsum(cells)[:-1]])
        flat = np.concatenate(padded)
        layouts = {}
        for u in self.classes:
            step = u // SMALL
            starts = np.concatenate([np.arange(f, f + c, step) for f, c in zip(first, cells, strict=True)])
            owner = np.repeat(np.arange(len(filled)), -(-cells // step))
            layouts[u] = starts, owner, np.flatnonzero(owner[1:] == owner[:-1])
        for f, turn in enumerate(self.turns):
            base = (flat * turn).reshape(-1, SMALL).min(axis=1)
            for u in self.classes:
                if f >= self.k[u]:
                    continue
                starts, owner, joined = layouts[u]
                low = np.minimum.reduceat(base, starts)
                low[joined] = np.minimum(low[joined], low[joined + 1])
                for at in np.flatnonzero(self.marks[u][f, self.slot(low)]):
                    hits = self.owners.get((u, f, int(low[at])))
                    if hits:
                        found[filled[owner[at]][0]].update(hits)
        return found


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` of every document that holds an item."""
    slabs = max(1, -(-items.count() // (ITEMS // 2)))
    d = docs.select(F.col(key).cast("long").cast("string").alias("doc_id"), "text")  # as text: pandas would round long ids beside nulls
    out = None
    for slab in range(slabs):
        part = items if slabs == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slabs)) == slab)
        rows = part.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").collect()
        index = Index([(r["item_id"], text.shingle_set(r["text"])) for r in rows])
        found = _searched(d, docs.sparkSession.sparkContext.broadcast(index))
        out = found if out is None else out.union(found)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _searched(docs: DataFrame, shipped) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shipped.value
        ids, sets, size = [], [], 0
        for pdf in batches:
            for i, t in zip(pdf["doc_id"].array, pdf["text"], strict=True):
                ids.append(i)
                sets.append(text.shingles(t))
                size += len(sets[-1])
                if size >= GATHERED:
                    yield _verified(index, ids, sets)
                    ids, sets, size = [], [], 0
        yield _verified(index, ids, sets)

    return docs.mapInPandas(text.tidy(run), SCHEMA)


def _verified(index: Index, ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
    rows = []
    for i, s, found in zip(ids, sets, index.candidates(sets), strict=True):
        own = np.unique(s) if found else None
        for at in sorted(found):
            item, wanted = index.items[at]
            shared = int(np.isin(wanted, own, assume_unique=True).sum())
            if 100 * shared >= CONTAINED * len(wanted):
                rows.append((i, item, len(wanted), shared, shared / len(wanted)))
    doc, item, n, shared, containment = zip(*rows, strict=True) if rows else [()] * 5
    return pd.DataFrame({"doc_id": pd.Series(doc, dtype=object), "item_id": pd.array(item, "Int64"), "n_item": np.array(n, np.int64),
                         "n_shared": np.array(shared, np.int64), "containment": np.array(containment, float)})
