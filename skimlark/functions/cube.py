"""Ranks of many columns under many null masks: one count of values by presence pattern serves every pair.

The ranks of column a beside column b go over the rows that hold both. Columns present in the same rows are one presence
class. Cells are ordered once per column, and the counts of cells below, one for each class, are the ranks under every mask at
the same time: a vector instead of a column and a sort for each mask. The number of jobs and of plan columns is the same for
any number of masks.

Split points of each column, frequent values and bounds between them, come from a sample; they choose the plan, not the
result. One pass over all rows counts the cells at and between them by class, which is all that the ranks of frequent values
need. The other cells leave their rows in chunks: sorted integers of the same order as the values, packed by differences, with
the bits of their row's classes and their place in the chunk. Parts of a column, bounded in cells, return their ranks to the
chunks by differences too, so a cell with its ranks takes a few bytes on disk. Products of pairs are summed by chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimlark.config import Config
from skimlark.functions.order import passing

HELD = 2_000_000  # numbers of the table of counts that every task holds: split points, and gaps between them, x classes
SAMPLED = 2_000_000  # numbers of the sample that split points come from
TENSOR = 4_000_000  # numbers of one block of rank products
CHUNK = 16_000_000  # ranks of one chunk of rows
PLACES = 1 << 16  # rows of a chunk at most: places have 16 bits
BLOCK = 4096  # counts that are summed over the tasks at a time


class Plan(NamedTuple):
    """What every task knows: split points of each column, where its gaps begin among all, and the classes' columns."""

    splits: list[np.ndarray]
    starts: np.ndarray
    firsts: np.ndarray


def presence_classes(n: np.ndarray) -> np.ndarray:
    """For each column the first one that is present in the same rows; ``n`` counts the rows that two columns share."""
    out = np.arange(len(n))
    for i in range(len(n)):
        same = np.flatnonzero((n[i, :i] == n[i, i]) & (n.diagonal()[:i] == n[i, i]))
        if len(same):
            out[i] = out[same[0]]
    return out


def rank_products(base: DataFrame, columns: Sequence[str], rows: int, n: np.ndarray, config: Config) -> pd.DataFrame:
    """``i, j, sxx, syy, sxy`` for all pairs i < j: sums of squares and products of the average ranks' deviations, doubled."""
    width = len(columns)
    firsts, of_column = np.unique(presence_classes(n), return_inverse=True)
    classes = len(firsts)
    context = base.sparkSession.sparkContext
    base = base.select(*columns)
    most = max(1, config.single_task_rows // classes)
    splits = _splits(base, rows, n.diagonal(), max(1, HELD // (2 * classes)), most, config)
    starts = np.cumsum([0, *[2 * len(s) + 1 for s in splits]])
    plan = Plan(splits, starts, firsts)
    shipped = context.broadcast(plan)
    below, part = _counted(base, plan, shipped, most)
    held = context.broadcast((below, part, n[:, firsts]))

    size = np.int32 if 2 * rows < np.iinfo(np.int32).max else np.int64
    length = max(1, min(PLACES, CHUNK // (width * classes)))
    cells = base.mapInArrow(_dealt(shipped, held, length), "feature int, part long, chunk long, cells int, places binary, keys binary, bits binary")
    ranks = cells.groupBy("feature", "part").applyInPandas(
        _ranked(shipped, held), "chunk long, feature int, cells int, places binary, head binary, body binary")
    together = ranks.repartition("chunk").sortWithinPartitions("chunk", "feature")
    sums = together.mapInPandas(_products(shipped, held, of_column, size), "i int, j int, sxx double, syy double, sxy double")
    with passing(base.sparkSession):  # one row a pair
        out = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("sxx", "syy", "sxy")]).toPandas()
    shipped.destroy()
    held.destroy()
    return out


def _keys(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; both zeros are one."""
    bits = (v + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.iinfo(np.int64).max)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    """The rows, ``length`` at a time."""
    held, size = [], 0
    for x in _matrices(batches):
        while size + len(x) >= length:
            yield np.concatenate([*held, x[: length - size]])
            held, x, size = [], x[length - size :], 0
        held.append(x)
        size += len(x)
    if size:
        yield np.concatenate(held)


def _splits(base: DataFrame, rows: int, n: np.ndarray, held: int, most: int, config: Config) -> list[np.ndarray]:
    """Split points of each column: its frequent values, and bounds that leave about half of ``most`` other cells between them."""
    width = len(n)
    share = min(1.0, SAMPLED / width / max(1, rows))
    sample = (base.sample(share, seed=config.random_seed) if share < 1 else base).toArrow()
    values, counts = [], []
    for c in sample.columns:
        x = c.to_numpy()
        v, k = np.unique(_keys(x[~np.isnan(x)]), return_counts=True)
        values.append(v)
        counts.append(k)
    every = np.sort(np.concatenate(counts))[::-1]
    least = max(3, every[held // 4] + 1 if len(every) > held // 4 else 0)
    out = []
    for v, k, present in zip(values, counts, n, strict=True):
        rare = np.repeat(v[k < least], k[k < least])
        wanted = int(2 * present * len(rare) / max(1, k.sum()) / most)
        wanted = min(wanted, config.range_parts, 3 * held // 4 // width, len(rare))
        bounds = rare[np.arange(1, wanted + 1) * len(rare) // (wanted + 1)]
        out.append(np.unique(np.concatenate([v[k >= least], bounds])))
    return out


def _gaps(splits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of each cell's place: 2i + 1 at the i-th split point, 2i before it."""
    at = np.searchsorted(splits, keys)
    if not len(splits):
        return at
    return 2 * at + (splits[np.minimum(at, len(splits) - 1)] == keys)


def _counted(base: DataFrame, plan: Plan, shipped, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many cells by class lie before each place of its column, and to which part the place belongs: at most ``most`` cells, or one gap."""
    classes, places, width = len(plan.firsts), plan.starts[-1], len(plan.splits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, starts, firsts = shipped.value
        total = np.zeros((classes + 1, places), np.int64)  # the last counts all
        for x in _chunks(batches, max(1, TENSOR // width)):
            there = ~np.isnan(x)
            for f in range(width):
                row = np.flatnonzero(there[:, f])
                at, own = _gaps(splits[f], _keys(x[row, f])), total[:, starts[f] : starts[f + 1]]
                own[-1] += np.bincount(at, minlength=own.shape[1])
                for c, first in enumerate(firsts):
                    own[c] += np.bincount(at[there[row, first]], minlength=own.shape[1])
        flat = total.ravel()
        blocks = [b for b in range(0, len(flat), BLOCK) if flat[b : b + BLOCK].any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "c": pa.array([zlib.compress(flat[b : b + BLOCK].tobytes(), 1) for b in blocks], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for c in pdf["c"]:
            total = total + np.frombuffer(zlib.decompress(c), np.int64)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "c": [total.tobytes()]})

    summed = base.mapInArrow(count, "block long, c binary").groupBy("block").applyInPandas(add, "block long, c binary")
    total = np.zeros((classes + 1, places), np.int64)
    with passing(base.sparkSession):
        for block, c in summed.toPandas().itertuples(index=False):
            total.reshape(-1)[block : block + BLOCK] = np.frombuffer(c, np.int64)
    below, part = np.zeros((places + 1, classes), np.int64), np.zeros(places, np.int64)
    for a, b in zip(plan.starts, plan.starts[1:], strict=False):
        below[a + 1 : b] = np.cumsum(total[:-1, a : b - 1], axis=1).T
        cells, number = 0, 0
        for k in range(a, b, 2):
            if cells and cells + total[-1, k] > most:
                cells, number = 0, number + 1
            cells += total[-1, k]
            part[k] = number
    return below, part


def _bytes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: those of small numbers are mostly zero."""
    return np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _dealt(shipped, held, length: int):
    """Cells of each chunk by column and part, in order; and, as column -1, the places of frequent values in its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (splits, starts, firsts), (_, part, _) = shipped.value, held.value
        code = np.uint16 if max(map(len, splits)) < 1 << 16 else np.uint32
        task = TaskContext.get().partitionId() << 32
        for number, x in enumerate(_chunks(batches, length)):
            there = ~np.isnan(x)
            bits = np.packbits(there[:, firsts], axis=1)
            frequent = np.zeros(x.shape[::-1], code)
            out = []
            for f in range(x.shape[1]):
                row = np.flatnonzero(there[:, f])
                key = _keys(x[row, f])
                at = _gaps(splits[f], key)
                hit = at & 1 == 1
                frequent[f, row[hit]] = (at[hit] >> 1) + 1
                row, key, at = row[~hit], key[~hit], at[~hit]
                order = np.argsort(key, kind="stable")
                row, key, of = row[order], key[order], part[starts[f] + at[order]]
                ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else []
                begin = 0
                for end in ends:
                    own = slice(begin, end)
                    steps = np.diff(key[own], prepend=0)  # modulo 2**64
                    out.append((f, of[begin], end - begin, row[own].astype(np.uint16).tobytes(), _bytes(steps), bits[row[own]].T.tobytes()))
                    begin = end
            out.append((-1, task + number, len(x), zlib.compress(_bytes(frequent), 1), b"", b""))
            feature, of, cells, places, keys, classes = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(feature, pa.int32()), "part": pa.array(of, pa.int64()), "chunk": pa.array([task + number] * len(out), pa.int64()),
                "cells": pa.array(cells, pa.int32()), "places": pa.array(places, pa.binary()), "keys": pa.array(keys, pa.binary()), "bits": pa.array(classes, pa.binary())})
    return run


def _ranked(shipped, held):
    """Twice the rank deviations of a part's cells, for their chunks."""
    names = ["chunk", "feature", "cells", "places", "head", "body"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["feature"].iloc[0])
        if f < 0:
            return pdf.assign(head=b"", body=b"")[names]
        (splits, starts, firsts), (below, _, n) = shipped.value, held.value
        key = np.concatenate([np.cumsum(_numbers(k, np.int64)) for k in pdf["keys"]])
        per = -(-len(firsts) // 8)
        bits = np.concatenate([np.frombuffer(b, np.uint8).reshape(per, -1).T for b in pdf["bits"]])
        order = np.argsort(key, kind="stable")
        key, bits = key[order], bits[order]
        opens = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(opens)
        value = np.empty(len(key), np.int64)
        value[order] = np.cumsum(opens) - 1
        gap = _gaps(splits[f], key[first])
        new = np.r_[True, gap[1:] != gap[:-1]]
        begun = np.flatnonzero(new)[np.cumsum(new) - 1]
        d = np.empty((len(first), len(firsts)), np.int64)
        for c in range(len(firsts)):
            equal = np.add.reduceat((bits[:, c >> 3] >> (7 - (c & 7))) & 1, first, dtype=np.int64)
            before = np.cumsum(equal) - equal
            d[:, c] = 2 * (before - before[begun] + below[starts[f] + gap, c]) + equal - n[f, c]
        heads, bodies = [], []
        end = np.cumsum(pdf["cells"].to_numpy())
        for begin, stop in zip(end - pdf["cells"].to_numpy(), end, strict=True):
            head, body = _packed(d[value[begin:stop]])
            heads.append(head)
            bodies.append(body)
        return pdf.assign(head=heads, body=bodies)[names]
    return run


def _packed(d: np.ndarray) -> tuple[bytes, bytes]:
    """Rising rows as the first one and differences; those of other columns as what they are more or less than by the first one's."""
    steps = np.diff(d, axis=0)
    rate = ((d[-1] - d[0]) << 16) // max(1, d[-1, 0] - d[0, 0])
    rate[0] = 0
    steps -= (steps[:, :1] * rate) >> 16
    steps = (steps << 1) ^ (steps >> 63)
    most = steps.max(initial=0)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return np.concatenate([d[0], rate]).tobytes(), _bytes(steps.T.astype(kind))


def _unpacked(head: bytes, body: bytes, cells: int) -> np.ndarray:
    first, rate = np.frombuffer(head, np.int64).reshape(2, -1)
    out = np.empty((cells, len(first)), np.int64)
    out[0] = first
    if cells > 1:
        size = len(body) // ((cells - 1) * len(first))
        steps = _numbers(body, np.dtype(f"u{size}")).reshape(len(first), -1).T.astype(np.int64)
        steps = (steps >> 1) ^ -(steps & 1)
        steps += (steps[:, :1] * rate) >> 16
        out[1:] = steps
        np.cumsum(out, axis=0, out=out)
    return out


def _products(shipped, held, of_column: np.ndarray, kind: type):
    """Sums of products over the chunks of a task, one after the other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (splits, starts, firsts), (below, _, n) = shipped.value, held.value
        width, classes = len(splits), len(firsts)
        low, high = np.triu_indices(width, 1)
        block = max(1, TENSOR // (width * width))
        square, product = np.zeros((width, width)), np.zeros((width, width))
        code = np.uint16 if max(map(len, splits)) < 1 << 16 else np.uint32
        frequent = [below[starts[f] + 1 : starts[f + 1] : 2] + below[starts[f] + 2 : starts[f + 1] : 2] - n[f] for f in range(width)]

        def add(ranks: np.ndarray, there: np.ndarray) -> None:
            for start in range(0, len(ranks), block):
                own = slice(start, start + block)
                x = ranks[own][:, :, of_column] * there[own, None, :].astype(float)
                np.add(square, np.einsum("rab,rab->ab", x, x), out=square)
                np.add(product, np.einsum("rab,rba->ab", x, x), out=product)

        now, ranks, there = None, None, None
        for pdf in batches:
            for chunk, feature, cells, places, head, body in pdf.itertuples(index=False):
                if chunk != now:  # column -1 comes first
                    if now is not None:
                        add(ranks, there)
                    now, ranks, there = chunk, np.zeros((cells, width, classes), kind), np.zeros((cells, width), bool)
                    codes = _numbers(zlib.decompress(places), code).reshape(width, -1)
                    for f in range(width):
                        row = np.flatnonzero(codes[f])
                        ranks[row, f] = frequent[f][codes[f, row].astype(np.int64) - 1]
                        there[row, f] = True
                else:
                    row = np.frombuffer(places, np.uint16)
                    ranks[row, feature] = _unpacked(head, body, cells)
                    there[row, feature] = True
        if now is not None:
            add(ranks, there)
        yield pd.DataFrame({"i": low, "j": high, "sxx": square[low, high], "syy": square.T[low, high], "sxy": product[low, high]})
    return run
