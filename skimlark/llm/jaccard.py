"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its five-word shingles; documents link when 100 * intersection >= 75 * union. Documents with
equal sets form a class, of which one member is compared. Shingles have one global order, rare ones first. Two linked sets
share at least m shingles of their m-prefixes (the first n - ceil(0.75 n) + m). Each document chooses its m by estimated cost: a
longer prefix meets more lists but fewer candidates share m of them. Pairs that share fewer than the smaller m are not verified.
Pairs that are left are verified with whole sets.

Two bounds, both without loss, drop pairs before they are counted. By place: what two sets share is at most what lies behind a common
shingle in the shorter rest, plus the matches before it. By parity: each set has 256 bits, each the parity of the shingles that
fall on it; two sets differ in as many shingles at least as in bits.

Lists of up to ``LIST`` members give all their pairs. Longer lists first link each member with one hub of its size class: the member
with the fewest rare shingles before the list's own, which in a group of near copies is the one least edited. While meeting the
rest would cost more than ``COMPARED`` comparisons, those outside the list's largest component are linked with another of its members,
up to ``TURNS`` times; at last members still outside meet the others under both bounds, so no link between components is lost.

Null and empty texts have no shingle, link with nothing and are their own component; fewer than five words are one shingle.
Rows that share a doc_id are one document with several texts: these are in one component, and each row tells the size of its own set. A row without doc_id lends its links but gets component
null if no member has an id. Other columns are not read. Classes are told apart by 64 bits: among 10**9 different sets two
coincide with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimlark.llm import frames, text

U = np.uint64
LIST = 48
MATCHES = 6
TURNS = 6
COMPARED = 1_000_000_000
PARITY = [f"bits{i}" for i in range(4)]
HEAVY = 1 << 18
BITMAP = 1 << 26
BUCKET = 2_000_000
NEEDED = 1_000_000
MEMBERS = 128


def class_key(s: np.ndarray) -> int:
    """Key of a set of shingles: sums of its mixed members, so order does not matter."""
    return int(text.signed(text.mix(np.array([text.mix(s).sum(dtype=np.uint64) + U(len(s))], np.uint64)))[0])


def parity(s: np.ndarray) -> np.ndarray:
    """256 bits of a set as four longs: the parity of its members on each bit."""
    return np.packbits(np.bincount((s >> U(20) & U(255)).astype(np.int64), minlength=256) & 1).view(np.int64)


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, cls)`` of every row, and its set's parity bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [text.shingle_set(t) for t in pdf["text"]]
            bits = np.array([parity(s) for s in sets], np.int64).reshape(-1, len(PARITY))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "n": [len(s) for s in sets], "cls": [class_key(s) for s in sets]} | dict(zip(PARITY, bits.T, strict=True)))

    # ids as text: pandas would round long ones beside nulls
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(
        text.tidy(run), "doc_id string, n long, cls long, " + ", ".join(f"{b} long" for b in PARITY))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _sets(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Sets of different classes, gathered until they hold ``most`` shingles."""
    sets, keys, size, seen = [], [], 0, set()
    for pdf in batches:
        for t in pdf["text"]:
            s = text.shingle_set(t)
            if len(s) and (k := class_key(s)) not in seen:
                seen.add(k)
                sets.append(s)
                keys.append(k)
                size += len(s)
                if size >= most:
                    yield sets, keys
                    sets, keys, size = [], [], 0
        if len(seen) > 1_000_000:
            seen.clear()
    if sets:
        yield sets, keys


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 more bits of a shingle."""
    return (h >> U(64 - bits)) << U(32) | (h & U(0xFFFFFFFF))


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row of bytes for each bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    firsts = np.concatenate([[0], cuts]).astype(int)
    out = {"bucket": b[firsts].astype(np.int64)}
    for name, values in columns.items():
        out[name] = [x.tobytes() for x in np.split(values[order], cuts)]
    return pd.DataFrame(out)


def steps(ascending: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as their differences, seven bits a byte, the last byte of each marked."""
    d = np.diff(ascending.astype(np.uint64), prepend=U(0))
    width = 1 + sum((d >= U(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)
    out = (np.repeat(d, width) >> (U(7) * place.astype(np.uint64)) & U(127)).astype(np.uint8)
    out[ends - 1] |= 128
    return out.tobytes()


def unstepped(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b & 128)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    parts = (b & 127).astype(np.uint64) << (U(7) * place.astype(np.uint64))
    return np.cumsum(np.add.reduceat(parts, starts) if len(starts) else parts).astype(np.uint32)


class Frequencies:
    """What one pass over all documents tells about shingles, in a fixed size: the most frequent with their document frequencies, and a
    bitmap that marks every shingle of two or more documents (and some others, the more the fuller it is)."""

    def __init__(self, bits: int, keys: np.ndarray, counts: np.ndarray, bitmap: np.ndarray):
        order = np.argsort(keys)
        self.bits, self.keys, self.counts, self.bitmap = bits, keys[order], counts[order], bitmap

    def of(self, h: np.ndarray) -> np.ndarray:
        """Document frequency, 1 if not among the most frequent."""
        out = np.ones(len(h), np.int64)
        if len(self.keys):
            short = _short(h, self.bits)
            at = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
            same = self.keys[at] == short
            out[same] = self.counts[at[same]]
        return out

    def shared(self, h: np.ndarray) -> np.ndarray:
        """False only for shingles that stand in one document."""
        width = U(BITMAP >> self.bits)
        at = (h >> U(64 - self.bits)) * width + (h & U(0xFFFFFFFF)) % width
        return (self.bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def frequencies(docs: DataFrame, bits: int) -> Frequencies:
    """Document frequencies over all documents, counted in buckets of about BUCKET shingles."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sets, _ in _sets(batches, BUCKET):
            h = np.concatenate(sets)
            h = h[np.argsort(_short(h, bits))]
            rows = _dealt(h >> U(64 - bits), {"low": (h & U(0xFFFFFFFF)).astype(np.uint32)})
            rows["low"] = [steps(np.frombuffer(x, np.uint32)) for x in rows["low"]]
            yield rows

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        low, n = np.unique(np.concatenate([unstepped(x) for x in pdf["low"]]), return_counts=True)
        marks = np.zeros(BITMAP >> bits, bool)
        marks[low[n > 1] % len(marks)] = True
        often = np.flatnonzero(n >= 3)
        often = often[np.argsort(-n[often], kind="stable")][: max(1, HEAVY >> bits)]
        key = (U(pdf["bucket"].iloc[0]) << U(32)) | low[often].astype(np.uint64)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1].array, "keys": [key.tobytes()], "counts": [n[often].astype(np.int64).tobytes()],
                             "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    rows = docs.select("text").mapInPandas(text.tidy(count), "bucket long, low binary").groupBy("bucket").applyInPandas(
        top, "bucket long, keys binary, counts binary, marks binary").collect()
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    each = BITMAP // 8 >> bits
    for r in rows:
        bitmap[r["bucket"] * each : (r["bucket"] + 1) * each] = np.frombuffer(r["marks"], np.uint8)
    joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows] or [np.zeros(0, kind)])
    return Frequencies(bits, joined("keys", np.uint64), joined("counts", np.int64), bitmap)


def prefix(s: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """Positions of a set's prefix in the global order, and how many of them a partner must share.

    The cost of m matches: entries of the prefix's lists, and one verification of the set for each expected candidate, which
    are the entries shared out over m squared.
    """
    n = len(s)
    order = np.lexsort((s, frequency))
    base = n - (3 * n + 3) // 4
    best, least = 1, None
    entries = np.cumsum(frequency[order[: base + MATCHES]] - 1)
    for m in range(1, min(MATCHES, n - base) + 1):
        listed = float(entries[base + m - 1])
        cost = listed + 0.05 * n * listed / m**2 + 4 * m
        if least is None or cost < least:
            best, least = m, cost
    return order[: base + best], best


def candidates(docs: DataFrame, total: int) -> DataFrame:
    """Rows ``(kind, a, b, c, need)``: kind 0 pairs of classes with c shared prefix shingles; kind 1 members b of a long list a, c the
    shingles of b from the list's own on."""
    bits = min(20, max(4, int(total // BUCKET).bit_length()))
    shipped = docs.sparkSession.sparkContext.broadcast(frequencies(docs, bits))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for sets, cls in _sets(batches, BUCKET):
            tokens, owner, sizes, rests, needs = [], [], [], [], []
            for s, k in zip(sets, cls, strict=True):
                frequency = known.of(s)
                where, need = prefix(s, frequency)
                met = np.flatnonzero(known.shared(s[where]))  # a shingle of one document meets nothing
                where = where[met]
                token = s[where]
                rests.append((len(s) - met).astype(np.uint32))
                tokens.append(token)
                owner.append(np.full(len(token), k, np.int64))
                sizes.append(np.full(len(token), len(s) if len(s) < 1 << 24 else (1 << 24) - 1, np.uint32) << np.uint32(8) | np.uint32(need))
                needs.append(frequency[where] > LIST)
            if not sum(map(len, tokens)):
                continue
            token, k, hot = np.concatenate(tokens), np.concatenate(owner), np.concatenate(needs)
            bucket = np.where(hot, text.mix(k.view(np.uint64)), token * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
            yield _dealt(bucket, {"token": token, "owner": k, "size": np.concatenate(sizes), "rest": np.concatenate(rests), "hot": hot})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = (("token", U), ("owner", np.int64), ("size", np.uint32), ("rest", np.uint32), ("hot", bool))
        token, owner, size, rest, hot = (np.frombuffer(b"".join(pdf[c]), t) for c, t in kinds)
        order = np.lexsort((owner, token))
        token, owner, size, rest, hot = token[order], owner[order], size[order], rest[order].astype(np.int64), hot[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner, size, rest, hot = token[fresh], owner[fresh], size[fresh], rest[fresh], hot[fresh]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(first, len(token)))
        run = np.repeat(length, length)
        long = hot | (run > LIST)
        out = [pd.DataFrame({"kind": 1, "a": text.signed(token[long]), "b": owner[long], "c": rest[long], "need": (size[long] & 255).astype(np.int64)})]
        cold = (run > 1) & ~long
        token, owner, size, rest = token[cold], owner[cold], size[cold].astype(np.int64), rest[cold]
        found = []
        for gap in range(1, LIST):
            same = np.flatnonzero(token[gap:] == token[:-gap]) if len(token) > gap else []
            if not len(same):
                break
            x, y = size[same] >> 8, size[same + gap] >> 8
            near = 4 * np.minimum(x, y) >= 3 * np.maximum(x, y)
            least = np.minimum(size[same] & 255, size[same + gap] & 255)
            near &= 7 * (np.minimum(rest[same], rest[same + gap]) + least - 1) >= 3 * (x + y)
            same = same[near]
            found.append(np.stack([owner[same], owner[same + gap], least[near]]))
        if found:
            a, b, need = np.concatenate(found, axis=1)
            one = pd.DataFrame({"a": a, "b": b, "need": need}).groupby(["a", "b", "need"]).size().reset_index(name="c")
            out.append(one.assign(kind=0)[["kind", "a", "b", "c", "need"]])
        return pd.concat(out)

    rows = docs.select("text").mapInPandas(text.tidy(index), "bucket long, token binary, owner binary, size binary, rest binary, hot binary")
    return rows.groupBy("bucket").applyInPandas(text.settled(pairs), "kind int, a long, b long, c long, need long")


def packed(s: np.ndarray) -> bytes:
    """The upper 40 bits of shingles; two different ones of a pair of 1000 shingles agree in them with probability 10**-6."""
    return np.ascontiguousarray((s >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _placed(pairs: DataFrame) -> DataFrame:
    """``(cls, at)``: the blocks ``(hub, salt)`` to which a class's set goes. A block holds a hub and about ``MEMBERS`` of its partners, so a hub of many is many blocks."""
    hub = F.col("hub") if "hub" in pairs.columns else F.col("a")
    links = pairs.select(hub.alias("hub"), F.when(hub == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    heavy = links.groupBy("hub").agg(F.count("*").alias("many")).where(F.col("many") > MEMBERS)
    salted = links.join(F.broadcast(heavy) if heavy.count() <= NEEDED else heavy, "hub", "left").select(
        "hub", "other", F.coalesce(F.pmod(F.xxhash64("other"), F.ceil(F.col("many") / MEMBERS)), F.lit(0)).cast("int").alias("salt"))
    places = salted.select(F.col("other").alias("cls"), "hub", "salt").union(salted.select(F.col("hub").alias("cls"), "hub", "salt")).distinct()
    return places.groupBy("cls").agg(F.collect_list(F.struct("hub", "salt")).alias("at")).select(
        "cls", F.transform("at", lambda x: x["hub"]).alias("hubs"), F.transform("at", lambda x: x["salt"]).alias("salts"))


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs ``(a, b)`` of classes whose sets are similar enough; ``members`` has the classes' documents.

    A set is shuffled once for each block it takes part in. ``hub`` names the member of a pair that has many partners, if known.
    """
    least = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    wanted = frames.kept(least.join(_placed(pairs), "cls"))
    alone = wanted.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    alone = frames.kept(alone)  # documents of several texts
    many = not alone.isEmpty()
    simple = wanted.where("doc_id is not null")
    simple = simple.join(alone, "doc_id", "left_anti") if many else simple
    small = wanted.agg(F.sum(F.size("hubs") + 1)).first()[0] or 0
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "hub long, salt int, cls long, own binary"

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of blocks; of rows with equal sets one a task."""
        seen = set()
        for pdf in batches:
            rows, size = [], 0
            for t, cls, hubs, salts in zip(pdf["text"], pdf["cls"], pdf["hubs"], pdf["salts"], strict=True):
                s = text.shingle_set(t)
                if cls in seen or class_key(s) != cls:
                    continue
                seen.add(cls)
                own = packed(s)
                for hub, salt in zip(hubs, salts, strict=True):
                    rows.append((hub, salt, cls, own))
                    size += len(own)
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=["hub", "salt", "cls", "own"])
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["hub", "salt", "cls", "own"])
            if len(seen) > 1_000_000:
                seen.clear()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cls": [class_key(text.shingle_set(t)) for t in pdf["text"]], "text": pdf["text"].array})

    blocks = d.join(F.broadcast(simple) if small <= NEEDED else simple, "doc_id").select("text", "cls", "hubs", "salts").mapInPandas(text.tidy(sets), schema)
    odd = wanted.where("doc_id is null")
    if many or not odd.isEmpty():  # rows without id and documents of several texts are found by their sets
        odd = odd.union(wanted.join(alone, "doc_id", "left_semi").select(wanted.columns))
        some = d.where("doc_id is null").union(d.join(alone, "doc_id", "left_semi")).select("text").mapInPandas(text.tidy(keys), "cls long, text string")
        blocks = blocks.union(some.dropDuplicates(["cls"]).join(odd, "cls").select("text", "cls", "hubs", "salts").mapInPandas(text.tidy(sets), schema))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(pdf["cls"], pdf["own"], strict=True))
        hub = int(pdf["hub"].iloc[0])
        found = []
        if hub in own:
            x = unpacked(own.pop(hub))
            for cls, o in own.items():
                y = unpacked(o)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    found.append((min(hub, cls), max(hub, cls)))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return blocks.groupBy("hub", "salt").applyInPandas(compare, "a long, b long")


def one_document(members: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the classes of rows that share a doc_id."""
    own = members.where("n > 0 and doc_id is not null").select("doc_id", "cls")
    several = own.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).where("a < last").select("doc_id", "a")
    return own.join(several, "doc_id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: component_id is the smallest doc_id reachable by links."""
    members = frames.kept(classes(docs))
    total = members.agg(F.sum("n")).first()[0] or 0
    rows = frames.kept(candidates(docs, total))
    cold = frames.kept(rows.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")))
    known = members.where("n > 0").groupBy("cls").agg(*[F.min(c).alias(c) for c in ("n", *PARITY)])
    lists = rows.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cls"), F.col("c").alias("rest"), "need").distinct()
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    leveled = frames.kept(lists.join(known, "cls").withColumn("level", level))
    told = ("cls", "n", "need", "rest", *PARITY)

    def possible(other: str) -> Column:
        """Whether the row's class and the struct's may be linked, by size, place and parity."""
        both = F.col("n") + F.col(f"{other}.n")
        behind = F.least("rest", f"{other}.rest") + F.least("need", f"{other}.need") - 1
        bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}.{c}"))) for c in PARITY), F.lit(0))
        return (4 * F.least("n", f"{other}.n") >= 3 * F.greatest("n", f"{other}.n")) & (7 * behind >= 3 * both) & (7 * bits <= both)

    hubs = leveled.groupBy("token", "level").agg(F.min(F.struct(-F.col("rest"), *told)).alias("hub"))
    star = leveled.join(hubs, ["token", "level"]).where((F.col("cls") != F.col("hub.cls")) & possible("hub")).select(
        F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"), F.col("hub.cls").alias("hub"))
    near = cold.where("c >= need").select("a", "b", F.lit(None).cast("long").alias("hub"))
    first = frames.kept(near.union(star).groupBy("a", "b").agg(F.coalesce(F.min("hub"), "a").alias("hub")))
    links = frames.kept(verified(docs, members, first).union(one_document(members)))
    comps = frames.kept(frames.components(links))

    left_before = None
    for turn in range(TURNS + 1):
        placed = frames.kept(leveled.join(comps, F.col("cls") == F.col("node"), "left").select(
            "token", *told, "level", F.coalesce("component", "cls").alias("component")))
        sizes = placed.groupBy("token", "component").agg(F.count("*").alias("k"))
        mixed = frames.kept(sizes.groupBy("token").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("kinds"), F.sum("k").alias("all")).where(
            "kinds > 1").select("token", "top.component", (F.col("all") - F.col("top.k")).alias("left"), "all"))
        cost = mixed.agg(F.sum("all"), F.sum("left"), F.sum(F.col("left") * F.col("all"))).first()
        if turn == TURNS or not cost[0] or cost[2] <= COMPARED or (left_before is not None and 10 * cost[1] > 9 * left_before):
            break
        left_before = cost[1]
        met = placed.join(mixed.select("token", F.col("component").alias("top")), "token")
        hubs = met.where("component = top").groupBy("token", "level").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "cls"), *told)).alias("hub"))
        star = met.where("component <> top").join(hubs, ["token", "level"]).where(possible("hub")).select(
            F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"), F.col("hub.cls").alias("hub")).groupBy("a", "b").agg(F.min("hub").alias("hub"))
        star = frames.kept(star.join(first, ["a", "b"], "left_anti"))
        links = frames.kept(links.union(verified(docs, members, star)))
        first = frames.kept(first.union(star))
        comps = frames.kept(frames.components(links))
    mixed = mixed.select("token", "component")
    some = placed.join(mixed.withColumnRenamed("component", "top"), "token")
    left = some.where("component <> top").select("token", F.struct(*told, "component").alias("other"))
    meet = some.join(left, "token").where((F.col("other.component") != F.col("component")) & possible("other") & (
        (F.col("component") == F.col("top")) | (F.col("other.cls") < F.col("cls"))))
    met = meet.select(F.least("other.cls", "cls").alias("a"), F.greatest("other.cls", "cls").alias("b"), F.lit(1).cast("long").alias("c"), F.least("other.need", "need").alias("need"))
    short = cold.where("c < need")
    second = met.union(short).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")
    second = frames.kept(second.join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = frames.kept(verified(docs, members, second))
        if not more.isEmpty():
            comps = frames.kept(frames.components(links.union(more)))

    whole = members.join(comps, F.col("cls") == F.col("node"), "left").select("doc_id", "n", "cls", F.coalesce("component", "cls").alias("component"))
    least = whole.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = whole.join(least, "component", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
