"""Alignment of two tokenizers against the plain walk over whole texts."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skimlark.llm import alignment as A
from skimlark.llm.queries import vocabulary

pytest.importorskip("public_tokenizers")
PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a b  c\n d", "\n\nx y\tz", "<|endoftext|> <s> </s> <0x41>", "a▁b", "a ▁ b", "x▁ y",
       "naïve café 東京 タワー", "　 a  b  c", "🙂🙂 🙂", "don't 'll stop", "1234 5678", "a\x00b c", "zero​width \x1c x", "x" * 3000,
       "漢字" * 900, ("word " * 500).strip(), " ".join("ab" * (i % 40) for i in range(300))]


def walk(texts):
    """Per text: n_a, n_b, groups text, link pairs; both tokenizers over the whole text."""
    e = A.Encoders(*PATHS)
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = e.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = e.b.encode(text or "")
        if not text or b"".join(e.a_bytes[i] for i in a) != raw or b"".join(e.b_bytes[i] for i in b) != raw:
            out.append((0, 0, "", []))
            continue

        def spans(ids, table):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(table[i]), i))
                at += len(table[i])
            return found

        x, y = spans(a, e.a_bytes), spans(b, e.b_bytes)
        links, start = [], 0
        for lo, hi, i in x:
            while start < len(y) and y[start][1] <= lo:
                start += 1
            k = start
            while k < len(y) and y[k][0] < hi:
                links.append((i, y[k][2]))
                k += 1
        cuts = sorted({s[1] for s in x} & {s[1] for s in y})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(s[2]) for s in x if low < s[1] <= cut) + "|" + ",".join(str(s[2]) for s in y if low < s[1] <= cut)
                          if len(x) < 3000 else None)
            low = cut
        if groups and groups[0] is None:
            groups, i, j = [], 0, 0
            for cut in cuts:
                p, q = i, j
                while i < len(x) and x[i][1] <= cut:
                    i += 1
                while j < len(y) and y[j][1] <= cut:
                    j += 1
                groups.append(",".join(str(s[2]) for s in x[p:i]) + "|" + ",".join(str(s[2]) for s in y[q:j]))
        out.append((len(x), len(y), ";".join(groups), links))
    return out


def expected(ids, texts):
    done = walk(texts)
    counts = Counter(p for d in done for p in d[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted((i, n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                   hashlib.sha256(g.encode()).hexdigest() if g else "") for i, (n_a, n_b, g, links) in zip(ids, done, strict=True))


def rows(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("chunk,heavy", [(A.CHUNK, A.HEAVY), (700, 60)])
def test_whole_table_equals_the_walk(spark, chunk, heavy):
    sf = "/root/testdata/sf0.001/documents.parquet"
    texts = duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}' ORDER BY doc_id").fetchall()
    got = rows(A.aligned(spark.read.parquet(sf), *PATHS, chunk=chunk, heavy=heavy))
    assert got == expected([r[0] for r in texts], [r[1] for r in texts])


@pytest.mark.parametrize("chunk", [A.CHUNK, 5, 64])
def test_odd_texts(spark, chunk):
    ids = [2**60 + i for i in range(len(ODD))]
    df = spark.createDataFrame(list(zip(ids, ODD, strict=True)), "doc_id long, text string")
    extra = df.withColumn("row", F.lit("x")).withColumn("n_a", F.lit(9)).withColumn("part", F.lit(0.5)).repartition(3)
    assert rows(A.aligned(extra, *PATHS, chunk=chunk)) == expected(ids, ODD)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "one two"), (2**60 + 1, None)], "doc_id long, text string")
    got = A.aligned(df, *PATHS).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_links"]) for r in got if r["doc_id"] is not None) == [(False, 7, 2), (False, 2**60 + 1, 0)]
    assert [(r["n_links"], r["count_sum"]) for r in got if r["doc_id"] is None] == [(2, 6), (2, 6)]
    assert A.aligned(df.limit(0), *PATHS).count() == 0


def test_composition_is_associative():
    draw = random.Random(5)
    for _ in range(300):
        a = sorted(draw.sample(range(1, 40), draw.randint(1, 14))) + [40]
        b = sorted(draw.sample(range(1, 40), draw.randint(1, 14))) + [40]
        tokens = A.Open(np.arange(len(a)), np.array(a), np.arange(100, 100 + len(b)), np.array(b))
        bounds = [0, *sorted(draw.sample(range(1, 40), draw.randint(1, 6))), 40]
        cut = [(np.searchsorted(a, bounds, "right"), np.searchsorted(b, bounds, "right"))][0]
        parts = [A.fragment(tokens.part(slice(cut[0][i], cut[0][i + 1]), slice(cut[1][i], cut[1][i + 1]))) for i in range(len(bounds) - 1)]
        once = A.whole(A.fragment(tokens))
        while len(parts) > 1:
            k = draw.randrange(len(parts) - 1)
            parts[k:k + 2] = [A.compose(parts[k], parts[k + 1])]
        assert A.whole(parts[0]) == once
        assert A.whole(A.compose(A.IDENTITY, parts[0])) == once == A.whole(A.compose(parts[0], A.IDENTITY))


def test_forgotten_units_are_encoded_again(monkeypatch):
    monkeypatch.setattr(A, "CACHED", 300)
    texts = [t for t in ODD if t and len(t) < 1000]
    known = A.Known(*PATHS)
    for text, (n_a, n_b, groups, links) in zip(texts, walk(texts), strict=True):
        closed = known.texts([A.units_of(text)])[0]
        assert (closed.n_a, closed.n_b, closed.text.decode()) == (n_a, n_b, groups)
        assert np.frombuffer(closed.links, "<u4").tolist() == [x << 16 | y for x, y in links]


def test_ranges_cover_the_text_once():
    draw = random.Random(9)
    for _ in range(200):
        units = ["x" * draw.choice([1, 2, 5, 30, 90]) for _ in range(draw.randint(1, 40))]
        parts = list(A.ranges(units, 20))
        size = sum(1 + len(u) for u in units)
        assert parts[0][0] == 0 and parts[-1][1] == size
        assert all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
        for low, high, at, part in parts:
            assert at <= low < high <= at + sum(1 + len(u) for u in part)
            assert sum(len(u) > 20 for u in part if high - low <= 20) <= 2


def test_units_encoded_together_are_those_encoded_alone(monkeypatch):
    e = A.Encoders(*PATHS)
    units = [u for text in ODD for u in (A.units_of(text or "") + [text or ""])] + [f"unit{i}," for i in range(1000)]
    for some in (units, units[-1000:], ["ﬁne", " a"], []):
        (a, a_n), (b, b_n), ok = e.encode(some)
        (c, c_n), (d, d_n), alone = e.each(some)
        assert ok.tolist() == alone.tolist() and a_n.tolist() == c_n.tolist() and b_n.tolist() == d_n.tolist()
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
    monkeypatch.setattr(A.Encoders, "each", lambda self, texts: pytest.fail("a unit alone") if texts else (((z := np.zeros(0, np.int64)), z), (z, z), np.zeros(0, bool)))
    assert e.encode(units[-1000:])[2].all()


def test_single_spaces_need_no_search(monkeypatch):
    for text in ODD[1:] + ["a b\nc d", "a b \nc", "a\n b", "\na b\n", " \n", "a b\n ", "a\tb c", "a b c"]:
        assert A.units_of(text) == (A._CUT.split(text) if A._ODD.search(text) else text.split(" "))
    monkeypatch.setattr(A, "_ODD", None)
    assert A.units_of("a b\nc d") == ["a", "b\nc", "d"]
