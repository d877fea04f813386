"""Substring dedup: near-duplicate passages across documents by compact windows.

For each of four hash functions the Cartesian tree over a document's min-hashes groups all its subsequences by their
minimum: a compact window (l, c, r) stands for every subsequence that holds c inside [l, r]. Only windows of at least
``WIDTH`` shingles (50 words) matter, and only minima of such windows can bound them, so the tree is built over those. Windows of
functions 0 and 1, and of 2 and 3, are joined by interval: two windows that share a subsequence of ``WIDTH`` give one signature of
both minima. Passages that agree in three of four functions agree in one signature at least. Documents that share a signature are
candidates; their shared passages are verified by exact Jaccard similarity (0.75) of the shingles of both passages.

Copies of a whole document (equal word sequences) are found first; only the one of smallest doc_id is searched. Signatures
shared by up to ``LIST`` documents give all pairs; for more, each document meets the first one. Documents of such lists whose anchor then
lies in no passage found are searched once more by exact runs: 40 common shingles of 46 stand in two runs at most, so a passage of
similarity 0.75 has a common run of ``COMMON`` shingles, and of its windows of ``RUN`` shingles both documents pick the same least one.
Picked windows of up to ``LIST`` documents give all pairs again, others link each document with the first. Places of long lists that lie
in no passage found meet further hubs, the smallest document left of each list, ``TURNS`` times; what is then left is compared with all
smaller documents of its lists that have one of the rarest shingles of its surroundings in common, as any two similar passages do.

``repeated`` returns one row per passage that a document with a smaller doc_id has, overlapping ones merged. Null, empty and
short texts have no passage. Rows with null doc_id are not searched. Rows that share a doc_id are told apart by keys of their
own, which come after (or before) all ids: the passages of each that another document has are reported under the doc_id. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skimlark.llm import frames, text
from skimlark.llm.jaccard import BUCKET, NEEDED, _dealt, packed, unpacked

U = np.uint64
LEAST_WORDS = 50
WIDTH = LEAST_WORDS - text.WORDS + 1
LEAST_COMMON = -(-2 * 75 * WIDTH // 175)  # shingles that two sets of WIDTH of similarity 0.75 have in common
FUNCTIONS = 4
LIST = 24
TURNS = 3
RUN = 16
COMMON = 20
GAP = 12
GATHERED = 300_000
AT_ONCE = 150_000  # shingles whose signatures a task makes at a time
PIECE = 8_000_000  # longer documents are taken in overlapping pieces: places have 24 bits
SEEDS = np.random.default_rng(3).integers(1, 2**63, FUNCTIONS, dtype=np.uint64)
_PLACE = U((1 << 24) - 1)


def sequence_keys(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Keys of word sequences that stand one after the other: equal sequences have equal keys."""
    place = np.arange(len(words)) - np.repeat(begins[:-1], np.diff(begins))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text.mix(words + text.mix(place.astype(np.uint64))))])
    return text.signed(text.mix(sums[begins[1:]] - sums[begins[:-1]]))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def compact_windows(order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimum's place for every subsequence of WIDTH, and places, left and right ends of all compact windows that have such ones.

    ``order`` has distinct values whose low 24 bits are the place; values below 2**24 separate documents.
    """
    least = (sliding_least(order, WIDTH) & _PLACE).astype(np.int64)
    places = _distinct(least)  # the place of the least never goes back
    values, at = order[places], np.append(places, [len(order), -1])  # the last for none on the left, the one before for none on the right
    left, right = at[nearest_smaller(values)], at[len(places) - 1 - nearest_smaller(values[::-1])[::-1]]
    return least, places, left + 1, right - 1


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller one before each of some distinct values, or -1: what stands between is larger at every step."""
    out = np.arange(-1, len(values) - 1)
    left = np.flatnonzero(values[1:] < values[:-1]) + 1
    while len(left):
        out[left] = out[out[left]]
        left = left[out[left] >= 0]
        left = left[values[out[left]] > values[left]]
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, document, anchor, first, last)`` of every signature of some documents: shingle places within the document."""
    gap = np.zeros(1, np.uint64)
    flat = np.concatenate([x for s in sets for x in (gap, s)] + [gap])
    starts = np.cumsum([0, *[len(s) + 1 for s in sets]])
    separators = starts
    place = np.arange(len(flat), dtype=np.uint64)
    out = []
    per = []
    for seed in SEEDS:
        value = text.mix(flat ^ seed)
        order = (value & ~_PLACE) | place
        order[separators] = separators.astype(np.uint64)
        per.append((value, *compact_windows(order)))
    for f in range(0, FUNCTIONS, 2):
        (value, least, places, left, right), (value2, least2, places2, left2, right2) = per[f], per[f + 1]
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (least2[1:] != least2[:-1])]))
        c, c2 = least[new], least2[new]
        whole = (flat[c] != 0) & (flat[c2] != 0)
        c, c2 = c[whole], c2[whole]
        i, j = np.searchsorted(places, c), np.searchsorted(places2, c2)
        first, last = np.maximum(left[i], left2[j]), np.minimum(right[i], right2[j])
        doc = np.searchsorted(starts, c, side="right") - 1
        base = starts[doc] + 1
        out.append((text.mix(value[c] ^ (value2[c2] * U(3)) ^ U(f)), doc, c - base, first - base, last - base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, rep)`` of every row with an id: rep is the smallest id with the same word sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, n = [], []
            for words, begins in text.several(pdf["text"]):
                keys.append(sequence_keys(words, begins))
                n.append(np.diff(begins))
            if keys:
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "n_words": np.concatenate(n), "cls": np.concatenate(keys)})

    rows = frames.kept(docs.mapInPandas(text.tidy(run), "doc_id long, n_words long, cls long"))
    least = rows.groupBy("cls", "n_words").agg(F.min("doc_id").alias("rep"))
    return frames.kept(rows.join(least, ["cls", "n_words"]).select("doc_id", "n_words", "rep"))


def among(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents with, or without, these ids; the ids are broadcast if they are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= NEEDED else ids, "doc_id", how)


def candidates(docs: DataFrame, total: int) -> DataFrame:
    """``(kind, key, a, b, x, y)``: kind 0 documents a < b with anchors x and y; kind 1 document b with anchor y in a long list."""
    bits = min(20, max(4, int(total // (4 * BUCKET)).bit_length()))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sets, bases, size = [], [], [], 0

        def deal() -> pd.DataFrame:
            key, doc, anchor, _, _ = signatures(sets)
            return _dealt(key >> U(64 - bits), {"key": key, "doc": np.array(ids, np.int64)[doc], "anchor": (anchor + np.array(bases)[doc]).astype(np.int32)})

        for pdf in batches:
            for i, s in zip(pdf["doc_id"], text.all_shingles(pdf["text"]), strict=True):
                for start in range(0, len(s), PIECE):
                    base = max(0, start - WIDTH)
                    ids.append(i)
                    bases.append(base)
                    sets.append(s[base : start + PIECE])
                    size += len(sets[-1]) + 1
                    if size >= AT_ONCE:
                        yield from [deal()] if size > WIDTH + 2 else []
                        ids, sets, bases, size = [], [], [], 0
        if size > WIDTH + 2:
            yield deal()

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        key, doc, anchor = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("key", U), ("doc", np.int64), ("anchor", np.int32)))
        order = np.lexsort((anchor, doc, key))
        key, doc, anchor = key[order], doc[order], anchor[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc, anchor = key[fresh], doc[fresh], anchor[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        run = np.repeat(length, length)
        long = run > LIST
        out = [pd.DataFrame({"kind": 1, "key": text.signed(key[long]), "a": doc[long], "b": doc[long], "x": anchor[long], "y": anchor[long]})]
        cold = (run > 1) & ~long
        key, doc, anchor = key[cold], doc[cold], anchor[cold]
        for gap in range(1, LIST):
            same = np.flatnonzero(key[gap:] == key[:-gap]) if len(key) > gap else []
            if not len(same):
                break
            out.append(pd.DataFrame({"kind": 0, "key": 0, "a": doc[same], "b": doc[same + gap], "x": anchor[same], "y": anchor[same + gap]}))
        return pd.concat(out)

    rows = docs.mapInPandas(text.tidy(index), "bucket long, key binary, doc binary, anchor binary")
    return rows.groupBy("bucket").applyInPandas(text.settled(pairs), "kind int, key long, a long, b long, x int, y int")


def run_keys(docs: DataFrame) -> DataFrame:
    """``(key, doc, place)`` of the picked windows of RUN shingles: any COMMON shingles in a row hold one, and equal ones the same."""
    back = U(pow(int(SEEDS[0] | U(1)), -1, 1 << 64))
    near = COMMON - RUN + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, s in zip(pdf["doc_id"], text.all_shingles(pdf["text"]), strict=True):
                if len(s) >= COMMON:
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * text.powers(SEEDS[0] | U(1), len(s)))])
                    keys = text.mix((sums[RUN:] - sums[:-RUN]) * text.powers(back, len(s))[: len(s) - RUN + 1])
                    picked = np.lib.stride_tricks.sliding_window_view(keys, near).argmin(axis=1) + np.arange(len(keys) - near + 1)
                    keys, first = np.unique(keys[_distinct(picked)], return_index=True)
                    yield pd.DataFrame({"key": text.signed(keys), "doc": i, "place": _distinct(picked)[first]})

    return docs.mapInPandas(text.tidy(run), "key long, doc long, place long")


def fewest_distinct(s: np.ndarray) -> int:
    """The least number of different shingles among WIDTH in a row; WIDTH if there are fewer."""
    if len(s) < WIDTH or len(np.unique(s)) == len(s):
        return WIDTH
    return min(len(np.unique(s[low : low + WIDTH])) for low in range(len(s) - WIDTH + 1))


def contexts(docs: DataFrame, places: DataFrame, before: int, after: int, then: Callable | None = None, schema: str = "key long, doc long, place long, least int, own array<long>") -> DataFrame:
    """``(key, doc, place, least, own)`` for ``places`` (key, doc, place): distinct shingles from ``before`` ahead of a place to ``after`` behind it.

    Similar passages around two such places share ``least`` of these shingles at least. ``then`` makes rows of ``schema`` of these in the same worker.
    """
    wanted = frames.kept(places.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "place")).alias("at")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, s, at in zip(pdf["doc_id"], text.all_shingles(pdf["text"]), pdf["at"], strict=True):
                for r in at:
                    k = r["place"]
                    fewest = fewest_distinct(s[max(0, k + RUN - WIDTH) : max(0, min(k, len(s) - WIDTH) + WIDTH)])
                    rows.append((r["key"], i, k, -(-3 * fewest // 4), np.unique(s[max(0, k - before) : k + after]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "doc", "place", "least", "own"])

    return docs.join(wanted, "doc_id").mapInPandas(text.tidy(run if then is None else lambda batches: then(run(batches))), schema)


def remaining_pairs(docs: DataFrame, left: DataFrame, keys: DataFrame) -> DataFrame:
    """``(a, b, x, y)``: places of long lists left over, with every place of a smaller document of the list that may be similar.

    Of two sets with ``least`` common shingles, each has one of them among all but its last ``least - 1``, in any order. Frequent
    shingles come last, so a line that all have in common links nobody.
    """
    mine = frames.kept(contexts(docs, left, WIDTH - RUN, WIDTH))
    lists = frames.kept(left.select("key").distinct())
    counts = mine.select("doc", F.explode("own").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(f"n > {LIST}")
    often = counts.orderBy(F.desc("n"), "g").limit(GATHERED // 10).toPandas()
    shipped = docs.sparkSession.sparkContext.broadcast(np.sort(often["g"].to_numpy(np.int64)))

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, picked = [], []
            for own, least in zip(pdf["own"], pdf["least"], strict=True):
                own = np.sort(np.asarray(own, np.int64))
                order = own[np.argsort(_found(own, shipped.value), kind="stable")]
                picked.append(order[: max(0, len(order) - least + 1)])
                n.append(len(picked[-1]))
            n = np.array(n, np.int64)
            g = np.concatenate(picked).view(U) if picked else np.zeros(0, np.uint64)
            both = text.mix(np.repeat(pdf["key"].to_numpy(np.int64).view(U), n) ^ text.mix(g))
            yield pd.DataFrame({"at": text.signed(both), "doc": np.repeat(pdf["doc"].to_numpy(np.int64), n), "place": np.repeat(pdf["place"].to_numpy(np.int64), n)})

    schema = "at long, doc long, place long"  # list and shingle go as one hash: pairs of a collision are compared in vain
    b = mine.mapInPandas(text.tidy(rarest), schema).select("at", F.col("doc").alias("b"), F.col("place").alias("y"))
    theirs = contexts(docs, keys.join(lists, "key", "left_semi").select("key", "doc", "place"), WIDTH - 1, RUN + WIDTH, rarest, schema)
    a = theirs.select("at", F.col("doc").alias("a"), F.col("place").alias("x"))
    rows = mine.agg(F.sum(F.greatest(F.lit(0), F.size("own") - F.col("least") + 1))).first()[0] or 0
    return a.join(F.broadcast(b) if rows <= NEEDED else b, "at").where("a < b").select("a", "b", "x", "y")


def _found(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered.take(ordered.searchsorted(values), mode="clip") == values


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def _widened(low: int, high: int, n: int) -> tuple[int, int]:
    """A place range around this one of WIDTH shingles at least, as far as a document of n shingles has them."""
    missing = max(0, WIDTH - (high - low + 1))
    low = max(0, min(low - missing // 2, n - WIDTH))
    return low, min(n - 1, max(high, low + WIDTH - 1))


def shared_spans(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Passages ``(first, last)`` in shingles of y, then of x, that hold an anchor and are similar enough, of 50 words at least."""
    out: list[tuple[int, int, int, int]] = []
    at = np.flatnonzero(_found(y, np.sort(x)))
    if not len(at) or len(y) < WIDTH:
        return out
    places, gaps = at.tolist(), at[1:] - at[:-1]
    runs = [np.flatnonzero(gaps > gap).tolist() for gap in (GAP, 6, 2, 1)]
    partner = _partners(x, y, places)

    def covered(place: int) -> bool:
        return any(a <= place <= b for a, b, _, _ in out)

    def tried(cx: int, cy: int) -> None:
        here = bisect_left(places, cy)
        if here >= len(places) or places[here] != cy:
            return
        before = None
        for breaks in runs:
            k = bisect_left(breaks, here)
            run = breaks[k - 1] + 1 if k else 0, breaks[k] if k < len(breaks) else len(places) - 1
            if run == before:
                continue
            before = run
            low, high = places[run[0]], places[run[1]]
            if high - low + 1 < LEAST_COMMON:
                return
            low, high = _widened(low, high, len(y))
            span = partner(cx, cy, low, high)
            if span is not None:
                out.append((low, high, *span))
                return

    for cx, cy in anchors:
        if not covered(cy):
            tried(cx, cy)
    for breaks in (runs[0], runs[-1]):  # the same passage may stand in y again, where no anchor is left
        for begin, end in zip([0, *[k + 1 for k in breaks]], [*breaks, len(places) - 1], strict=True):
            if places[end] - places[begin] < LEAST_COMMON - 1:
                continue
            middle = places[(begin + end) // 2]
            if not covered(middle):
                for cx in np.flatnonzero(x == y[middle]):
                    if covered(middle):
                        break
                    tried(int(cx), middle)
    return out


def _partners(x: np.ndarray, y: np.ndarray, places: list[int]) -> Callable[[int, int, int, int], tuple[int, int] | None]:
    """The passage of x around an anchor that fits y's passage, if their sets are similar enough; ``places`` are those of y that x has too.

    Anchors of equal distance between their places have the same surroundings in x, and those of one run there the same answer. A
    passage of y with less than 75 hundredths of its set in x has no partner.
    """
    sets: dict[tuple[int, int], np.ndarray | None] = {}
    near: dict[tuple[int, int, int], tuple[int, list[int], list[int], dict]] = {}

    def answer(a: np.ndarray, begin: int, hits: list[int], breaks: list[int], k: int) -> tuple[int, int] | None:
        first = hits[breaks[k - 1] + 1] if k else hits[0]
        last = hits[breaks[k]] if k < len(breaks) else hits[-1]
        first, last = _widened(begin + first, begin + last, len(x))
        b = _distinct(np.sort(x[first : last + 1]))
        both = int(np.count_nonzero(_found(b, a)))
        return (first, last) if last - first + 1 >= WIDTH and 100 * both >= 75 * (len(a) + len(b) - both) else None

    def partner(cx: int, cy: int, low: int, high: int) -> tuple[int, int] | None:
        if (low, high) not in sets:
            a = _distinct(np.sort(y[low : high + 1]))
            most = bisect_left(places, high + 1) - bisect_left(places, low)
            sets[low, high] = a if 100 * most >= 75 * len(a) else None
        a = sets[low, high]
        if a is None:
            return None
        key = low, high, cx - cy
        if key not in near:
            slack = (high - low + 1) // 3 + 8
            begin, end = max(0, cx - cy + low - slack), min(len(x), cx - cy + high + slack + 1)
            hits = np.flatnonzero(_found(x[begin:end], a))
            near[key] = begin, hits.tolist(), np.flatnonzero(hits[1:] - hits[:-1] > GAP).tolist(), {}
        begin, hits, breaks, answers = near[key]
        if not hits:
            return None
        k = bisect_left(breaks, bisect_left(hits, cx - begin))
        if k not in answers:
            answers[k] = answer(a, begin, hits, breaks, k)
        return answers[k]

    return partner


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared passages ``(a, b, a_first, a_last, b_first, b_last)`` of documents a < b with anchors ``places``."""
    used = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "own": [packed(s) for s in text.all_shingles(pdf["text"])]})

    blobs = frames.kept(among(docs, frames.kept(used), "left_semi").mapInPandas(text.tidy(arrays), "doc_id long, own binary"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, places, p, q in zip(pdf["a"], pdf["b"], pdf["places"], pdf["p"], pdf["q"], strict=True):
                x, y = unpacked(p), unpacked(q)
                for low, high, first, last in shared_spans(x, y, sorted((r["x"], r["y"]) for r in places)):
                    rows.append((a, b, first, last, low, high))
            yield pd.DataFrame(rows, columns=["a", "b", "a_first", "a_last", "b_first", "b_last"])

    both = pairs.join(blobs.select(F.col("doc_id").alias("a"), F.col("own").alias("p")), "a").join(
        blobs.select(F.col("doc_id").alias("b"), F.col("own").alias("q")), "b")
    return both.select("a", "b", "places", "p", "q").mapInPandas(text.tidy(compare), "a long, b long, a_first long, a_last long, b_first long, b_last long")


def outside(rows: DataFrame, doc: str, place: str, spans: DataFrame) -> DataFrame:
    """The rows whose place lies in none of the spans ``(b, b_first, b_last)`` of their document.

    Places and spans stand in one order of each document, and the furthest end of the spans begun so far tells: no row meets each span.
    """
    at, end = F.col(place).cast("long").alias("_at"), F.col("b_last").cast("long").alias("_end")
    begun = spans.select(F.col("b").alias("_doc"), F.col("b_first").cast("long").alias("_at"), end).distinct()
    places = rows.select(F.col(doc).alias("_doc"), at, F.struct(*rows.columns).alias("_row"))
    so_far = W.partitionBy("_doc").orderBy("_at", F.col("_end").isNull()).rowsBetween(W.unboundedPreceding, 0)
    both = begun.unionByName(places, allowMissingColumns=True).withColumn("_reached", F.max("_end").over(so_far))
    return both.where("_row IS NOT NULL AND (_reached IS NULL OR _reached < _at)").select("_row.*")


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with ``_key``: their doc_id, or a number of its own for rows that share one; and whether there are such rows."""
    own = docs.withColumn("_key", F.col("doc_id").cast("long"))
    several = frames.kept(own.where("_key is not null").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    if several.isEmpty():
        return own, False
    ends = own.agg(F.min("_key"), F.max("_key")).first()
    number = F.monotonically_increasing_id()
    if ends[1] < 1 << 61:
        number = F.lit(ends[1] + 1) + number
    elif ends[0] > -(1 << 61):
        number = F.lit(ends[0] - 1) - number
    else:
        raise ValueError("doc_ids that rows share leave no room for keys of their own: ids reach to both ends of 64 bits")
    marked = several.withColumn("_several", F.lit(True))
    joined = own.join(F.broadcast(marked) if several.count() <= NEEDED else marked, "_key", "left")
    return frames.written(joined.withColumn("_key", F.when(F.col("_several"), number).otherwise(F.col("_key"))).drop("_several"), "keyed"), True


def repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, source_id, start_word, end_word)``: passages that a document of smaller doc_id has, overlapping and touching ones as one; end is exclusive."""
    own, several = keyed(docs.select("doc_id", "text"))
    found = repeated_keys(own.select(F.col("_key").alias("doc_id"), "text"))
    if not several:
        return found
    ids = frames.kept(own.where("_key <> doc_id").select("_key", F.col("doc_id").cast("long").alias("_id")))
    ids = F.broadcast(ids) if ids.count() <= NEEDED else ids
    for c in ("doc_id", "source_id"):
        found = found.join(ids, F.col(c) == F.col("_key"), "left").withColumn(c, F.coalesce("_id", c)).drop("_key", "_id")
    return found.where("doc_id <> source_id")


def repeated_keys(docs: DataFrame) -> DataFrame:
    """The same of rows whose doc_id is theirs alone, or null."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    known = copies(d)
    total = known.agg(F.sum("n_words")).first()[0] or 0
    extra = known.where("doc_id <> rep").select("doc_id").distinct()
    singles = among(d, frames.kept(extra), "left_anti")
    rows = frames.kept(candidates(singles, total))
    grouped = lambda r: r.groupBy("a", "b").agg(F.collect_list(F.struct("x", "y")).alias("places"))

    lists = rows.where("kind = 1").select("key", F.col("b").alias("doc"), "y").groupBy("key", "doc").agg(F.min("y").alias("y"))
    hubs = lists.groupBy("key").agg(F.min(F.struct("doc", "y")).alias("hub"))
    starred = lists.join(hubs, "key").where(F.col("doc") != F.col("hub.doc"))
    star = starred.select(F.col("hub.doc").alias("a"), F.col("doc").alias("b"), F.col("hub.y").alias("x"), "y")
    first = frames.kept(grouped(rows.where("kind = 0").select("a", "b", "x", "y").union(star)))
    spans = frames.kept(verified(singles, first))

    alone = outside(starred, "doc", "y", spans).select("doc").distinct()
    listed = among(singles, frames.kept(lists.select(F.col("doc").alias("doc_id")).distinct()), "left_semi")
    keys = frames.kept(run_keys(listed))
    own = keys.join(frames.kept(alone), "doc", "left_semi")
    own = outside(own, "doc", "place", spans).select("key", F.col("doc").alias("b"), F.col("place").alias("y"))
    lists = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("hub")).where("n > 1")
    met = own.join(lists.where(f"n > {LIST}"), "key").select(F.col("hub.doc").alias("a"), "b", F.col("hub.place").alias("x"), "y")
    short = keys.join(lists.where(f"n <= {LIST}").select("key"), "key", "left_semi").select("key", F.col("doc").alias("a"), F.col("place").alias("x"))
    second = met.union(own.join(short, "key").select("a", "b", "x", "y")).where("a < b")
    second = second.groupBy("a", "b").agg(F.array(F.min(F.struct("x", "y"))).alias("places"))
    second = frames.kept(second.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    if not second.isEmpty():
        spans = frames.kept(spans.union(verified(singles, second)))

    def new(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        once = pairs.groupBy("a", "b").agg(F.array(F.min(F.struct("x", "y"))).alias("places"))
        return frames.kept(once.join(tried, ["a", "b"], "left_anti"))

    tried = first.select("a", "b").union(second.select("a", "b"))
    left = own.join(lists.where(f"n > {LIST}").select("key", F.col("hub.doc").alias("least")), "key").where("b > least").drop("least")
    left = frames.kept(outside(left, "b", "y", spans))
    waiting = left
    for _ in range(TURNS):
        if waiting.isEmpty():
            break
        hubs = frames.kept(waiting.groupBy("key").agg(F.min(F.struct("b", "y")).alias("hub")))
        waiting = frames.kept(waiting.join(hubs, "key").where("b > hub.b"))
        pairs = new(waiting.select(F.col("hub.b").alias("a"), "b", F.col("hub.y").alias("x"), "y"), tried)
        waiting = waiting.drop("hub")
        if not pairs.isEmpty():
            got = frames.kept(verified(singles, pairs))
            tried, spans = tried.union(pairs.select("a", "b")), spans.union(got)
            left, waiting = frames.kept(outside(left, "b", "y", got)), frames.kept(outside(waiting, "b", "y", got))
    if not left.isEmpty():
        pairs = new(remaining_pairs(singles, left.select("key", F.col("b").alias("doc"), F.col("y").alias("place")), keys), tried)
        if not pairs.isEmpty():
            spans = spans.union(verified(singles, pairs))

    found = spans.select(F.col("b").alias("doc_id"), F.col("a").alias("source_id"), F.col("b_first").alias("start_word"), (F.col("b_last") + text.WORDS).alias("end_word"))
    before = W.partitionBy("doc_id").orderBy("start_word", "end_word")
    reached = F.max("end_word").over(before.rowsBetween(W.unboundedPreceding, -1))
    opened = found.distinct().withColumn("opens", F.coalesce((F.col("start_word") > reached).cast("int"), F.lit(1)))
    merged = opened.withColumn("island", F.sum("opens").over(before)).groupBy("doc_id", "island").agg(
        F.min("source_id").alias("source_id"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")
    whole = known.where(f"doc_id <> rep and n_words >= {LEAST_WORDS}").select("doc_id", F.col("rep").alias("source_id"), F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"))
    return merged.union(whole)

