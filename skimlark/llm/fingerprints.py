"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds polynomial hashes of all its prefixes modulo a Mersenne prime, for two bases. Any span's
hash follows from two entries, so spans compare in constant time and the longest common extension of two positions is
found by binary search. A fingerprint is the hash of the whole text and the smallest hashes among all spans of
``SPAN`` code points; its likeness is the share of equal values among the smallest of both.

Null text is the empty text: its fingerprint has no span, and two empty texts have likeness 1. A text shorter than a
span is one span. Rows that share a doc_id follow each other by text. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimlark.llm import frames

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353 % PRIME)
_BACK = {b: pow(b, -1, PRIME) for b in BASES}
SPAN = 16
KEPT = 32
U = np.uint64
_P = U(PRIME)
_tables: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """Residues of fresh numbers below 2**62, taken in place."""
    for _ in range(2):
        high = x >> U(31)
        x &= _P
        x += high
    return np.subtract(x, _P, out=x, where=x >= _P)


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 4096):
            have = np.concatenate([have, _fold(have * U(pow(base, len(have), PRIME)))])
        _tables[base] = have
    return have[:n]


class Prefixes:
    """Prefix hashes of one text under both bases."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for base in BASES:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold((points.astype(np.uint64) + U(1)) * _powers(base, self.n)), out=sums[1:])
            self.sums.append(_fold(sums))

    def spans(self, starts: np.ndarray, length: int, bases: int = 2) -> list[np.ndarray]:
        """Hashes of the spans of one length, comparable between texts and places."""
        out = []
        for base, sums in zip(BASES[:bases], self.sums, strict=False):
            back = _powers(_BACK[base], self.n + 1)
            out.append(_fold(_fold(sums[starts + length] + _P - sums[starts]) * back[starts]))
        return out

    def span(self, start: int, length: int) -> tuple[int, ...]:
        out = []
        for base, sums in zip(BASES, self.sums, strict=True):
            out.append((int(sums[start + length]) - int(sums[start])) * int(_powers(_BACK[base], self.n + 1)[start]) % PRIME)
        return tuple(out)

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        return self.span(start, length) == other.span(at, length)

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """Longest length for which both texts agree from these positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, at, middle) else (low, middle - 1)
        return low


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)


def smallest(prefixes: Prefixes) -> np.ndarray:
    """The KEPT smallest distinct span hashes, ascending."""
    n = prefixes.n
    if not n:
        return np.zeros(0, np.uint64)
    length = min(SPAN, n)
    (h,) = prefixes.spans(np.arange(n - length + 1), length, 1)
    h = _fold((h ^ (h >> U(15))) * U(0x45D9F3B))
    bar = 4 * KEPT * PRIME // len(h)
    while bar < PRIME:
        low = np.unique(h[h < U(bar)])
        if len(low) >= KEPT:
            return low[:KEPT]
        bar *= 8
    return np.unique(h)[:KEPT]


def fingerprint(prefixes: Prefixes) -> tuple[str, np.ndarray]:
    low = smallest(prefixes)
    whole = "".join(f"{x:08x}" for x in prefixes.span(0, prefixes.n)) if prefixes.n else "0" * 16
    return f"{prefixes.n:08x}{whole}" + low.astype(">u4").tobytes().hex(), low


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values among the smallest of both fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    mine, other = set(a.tolist()), set(b.tolist())
    joint = sorted(mine | other)[:KEPT]
    return sum(x in mine and x in other for x in joint) / len(joint)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one task in order of (bucket, doc_id, text); each bucket ends with the first document of the next."""
    import hashlib

    last = None
    for pdf in batches:
        out = []
        for bucket, guest, doc, text in zip(pdf["bucket"], pdf["guest"], pdf["doc_id"], pdf["text"], strict=True):
            now = points(text)
            one = Prefixes(now)
            mine = (bucket, guest, doc, now, one, fingerprint(one))
            if last is not None and last[0] == bucket and not last[1]:
                out.append(_compared(last, mine, hashlib))
            last = mine
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                         "near_edited", "near_next", "common_prefix"])


def _compared(a: tuple, b: tuple, hashlib) -> tuple:
    half = len(a[3]) // 2
    edited = np.concatenate([a[3][: len(a[3]) - half], b[3][:half]])
    prefixes = Prefixes(edited)
    text, low = fingerprint(prefixes)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
    return (a[2], len(a[3]), digest, a[5][0], text, likeness(a[5][1], low), likeness(a[5][1], b[5][1]),
            a[4].extension(0, prefixes, 0))


SCHEMA = ("doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_prefix long")


def _bucket(key, cuts: list[int], width: int = 128):
    """How many cuts lie below the key, counted in two steps: groups of cuts, then cuts of the group."""
    longs = "array<bigint>"
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    group = F.size(F.filter(F.lit([g[0] for g in groups[1:]]).cast(longs), lambda c: c < key)) if len(groups) > 1 else F.lit(0)
    own = F.element_at(F.array(*[F.lit(g).cast(longs) for g in groups]), group + 1)
    return (group * width + F.size(F.filter(own, lambda c: c < key))).cast("int")


def fingerprints(docs: DataFrame, rows_per_bucket: int = 4000) -> DataFrame:
    """Fingerprint of each text, of its edited text, and likeness to it and to the next document's.

    Documents are dealt once, by ranges of doc_id; each range also gets the first document of the next one, so that
    every neighbour is at hand. Ranges follow approximate quantiles, whose number grows with the rows.
    A null doc_id sorts first. An only document is its own next.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = d.sparkSession
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    known = d.select(key.alias("k"))
    n = known.count()
    parts = max(1, min(n // rows_per_bucket, 20_000))
    cuts = sorted({int(x) for x in known.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    placed = d.withColumn("bucket", _bucket(key, cuts))
    firsts = placed.groupBy("bucket").agg(F.min(key).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], SCHEMA.replace("doc_id string", "doc_id long"))
    before = {r["first"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    guests = F.broadcast(spark.createDataFrame(list(before.items()), "first long, goes int"))
    rows = placed.join(guests, key == F.col("first"), "left").select(
        "doc_id", "text", F.explode(F.when(F.col("goes").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))).otherwise(
            F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("goes").alias("bucket"), F.lit(1).alias("guest"))))).alias("p"))
    dealt = rows.select("p.bucket", "p.guest", "doc_id", "text").repartition(max(1, len(firsts)), "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "guest", "doc_id", "text")
    # ids as text: pandas would round long ones beside nulls
    found = ordered.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_rows, SCHEMA)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
