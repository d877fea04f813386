"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word enters as a hashed embedding, its log odds among the labelled texts, and the mean embedding of its byte trigrams. All overlapping
windows of ``WINDOW`` words, ``STRIDE`` apart, of every whole text are scored; a text's logit is that of its worst window, turned into a
probability by a logistic calibration that undoes the sampling of classes.

The network is trained in numpy on at most ``most_bad`` texts labelled 1 and ``most_good`` labelled 0 (smallest hashes of the id); texts are
fetched by broadcast of these ids. In each epoch the worst window of each text, and for label 0 a second one, is learnt from.
Without labels of both kinds every score is 0. Null and empty texts have one empty window. Rows are scored one for one; a document with several
labels has the largest, null labels are left out. Labels are only the target; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimlark.llm import text

U = np.uint64
WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
WORD_ROWS, WORD_DIM = 1 << 14, 8
CHAR_ROWS, CHAR_DIM = 1 << 12, 4
INPUTS = WORD_DIM + 1 + CHAR_DIM
EPOCHS, STEPS, BATCH, RATE = 6, 200, 64, 0.01
WINDOWS_AT_ONCE = 2048
WORDS_AT_ONCE = 100_000
THRESHOLD = 0.3
RESULT = ["score", "predicted", "n_windows", "worst_word"]


class Words:
    """Inputs of one text: word hashes and, for each byte of a word, its trigram's row."""

    def __init__(self, value: str | None):
        raw = text.lowered(value)
        self.starts, self.ends = text.word_spans(raw)
        self.hashes = text.word_hashes(raw, self.starts, self.ends)
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        before, after = np.concatenate([b[:0] if not len(b) else [32], b[:-1]]), np.concatenate([b[1:], b[:0] if not len(b) else [32]])
        self.odds: np.ndarray | None = None  # of a training text: without the text's own share
        self.grams = ((before * 7919 + b * 104729 + after * 1299709) % CHAR_ROWS).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)


def fresh(seed: int = 2) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
    p = {"words": draw(WORD_ROWS, WORD_DIM, by=0.1), "chars": draw(CHAR_ROWS, CHAR_DIM, by=0.1), "A": draw(2 * HIDDEN, ATTENTION, by=0.3),
         "v": draw(ATTENTION, by=0.3), "o": draw(2 * HIDDEN, by=0.3), "c": np.zeros(1, np.float32)}
    for way in "fb":
        p |= {f"W{way}": draw(INPUTS, 3 * HIDDEN, by=0.3), f"U{way}": draw(HIDDEN, 2 * HIDDEN, by=0.3), f"V{way}": draw(HIDDEN, HIDDEN, by=0.3),
              f"B{way}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def odds_of(odds: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    known, value = odds
    if not len(known):
        return np.zeros(len(h), np.float32)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, value[at], np.float32(0))


def inputs(p: dict, odds: tuple, w: Words) -> np.ndarray:
    """One row for each word and a last one of zeros for padding."""
    out = np.zeros((len(w) + 1, INPUTS), np.float32)
    if len(w):
        out[:-1, :WORD_DIM] = p["words"][(w.hashes % U(WORD_ROWS)).astype(np.int64)]
        out[:-1, WORD_DIM] = odds_of(odds, w.hashes) if w.odds is None else w.odds
        sums = np.zeros((len(w.grams) + 1, CHAR_DIM))
        np.cumsum(p["chars"][w.grams], axis=0, out=sums[1:])
        out[:-1, WORD_DIM + 1 :] = (sums[w.ends] - sums[w.starts]) / (w.ends - w.starts)[:, None]
    return out


def window_starts(n: int) -> np.ndarray:
    """Every STRIDE-th word begins a window; the last window ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def one_way(p: dict, way: str, projected: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction over all places of the windows; places outside a text leave the state as it is."""
    n, (batch, places, _) = HIDDEN, projected.shape
    h, states, kept = np.zeros((batch, n), np.float32), np.empty((batch, places, n), np.float32), []
    u, v = p[f"U{way}"], p[f"V{way}"]
    for t in range(places) if way == "f" else range(places - 1, -1, -1):
        x = projected[:, t]
        zr = sigmoid(x[:, : 2 * n] + h @ u)
        z, r = zr[:, :n] * mask[:, t, None], zr[:, n:]
        new = np.tanh(x[:, 2 * n :] + (r * h) @ v)
        if keep:
            kept.append((t, h, zr[:, :n], r, new))
        h = h + z * (new - h)
        states[:, t] = h
    return states, kept


def pooled(p: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of windows by attention over their places."""
    q = np.tanh(states @ p["A"])
    e = np.where(mask > 0, q @ p["v"], np.float32(-30))
    a = np.exp(e - e.max(axis=1, keepdims=True)) * mask
    a /= np.maximum(a.sum(axis=1, keepdims=True), np.float32(1e-9))
    mean = np.einsum("bt,bth->bh", a, states)
    return mean @ p["o"] + p["c"], q, a, mean


def logits(p: dict, odds: tuple, texts: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every window of some texts, and its text's number."""
    rows, base, owner, starts, lengths = [], 0, [], [], []
    for k, w in enumerate(texts):
        rows.append(inputs(p, odds, w))
        s = window_starts(len(w))
        starts.append(s + base)
        lengths.append(np.minimum(WINDOW, len(w) - s))
        owner.append(np.full(len(s), k))
        base += len(w) + 1
    x = np.concatenate(rows)
    starts, lengths, owner = np.concatenate(starts), np.concatenate(lengths), np.concatenate(owner)
    ways = {way: x @ p[f"W{way}"] + p[f"B{way}"] for way in "fb"}
    out = np.empty(len(starts), np.float32)
    for at in range(0, len(starts), WINDOWS_AT_ONCE):
        s, n = starts[at : at + WINDOWS_AT_ONCE], lengths[at : at + WINDOWS_AT_ONCE]
        places = np.arange(max(1, n.max()))
        mask = (places < n[:, None]).astype(np.float32)
        where = s[:, None] + np.minimum(places, np.maximum(n[:, None] - 1, 0))
        states = np.concatenate([one_way(p, way, ways[way][where], mask, False)[0] for way in "fb"], axis=2)
        out[at : at + len(s)] = pooled(p, states, mask)[0]
    return out, owner


def all_logits(p: dict, odds: tuple, texts: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows and their texts, about ``WORDS_AT_ONCE`` words at a time, so that memory does not grow with the texts."""
    found, owners, at = [], [], 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= WORDS_AT_ONCE:
            size += len(texts[stop])
            stop += 1
        z, owner = logits(p, odds, texts[at:stop])
        found.append(z)
        owners.append(owner + at)
        at = stop
    return np.concatenate(found), np.concatenate(owners)


def gradients(p: dict, odds: tuple, chosen: list[tuple[Words, int]], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted logistic loss for one window of each text."""
    rows = [(w, np.arange(s, min(len(w), s + WINDOW))) for w, s in chosen]
    x = np.zeros((len(rows), WINDOW, INPUTS), np.float32)
    mask = np.zeros((len(rows), WINDOW), np.float32)
    for k, (w, place) in enumerate(rows):
        x[k, : len(place)] = inputs(p, odds, w)[place]
        mask[k, : len(place)] = 1
    kept, states = {}, []
    for way in "fb":
        s, kept[way] = one_way(p, way, x @ p[f"W{way}"] + p[f"B{way}"], mask, True)
        states.append(s)
    s = np.concatenate(states, axis=2)
    z, q, a, mean = pooled(p, s, mask)
    d = ((sigmoid(z) - labels) * weights / weights.sum()).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"], g["c"] = mean.T @ d, d.sum(keepdims=True)
    dmean = d[:, None] * p["o"]
    ds = a[:, :, None] * dmean[:, None, :]
    da = np.einsum("bth,bh->bt", s, dmean)
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    dq = de[:, :, None] * p["v"] * (1 - q * q)
    g["v"] = np.einsum("bt,bth->h", de, q)
    g["A"] = np.einsum("btj,btk->jk", s, dq)
    ds += dq @ p["A"].T
    dx = np.zeros_like(x)
    n = HIDDEN
    for way, own in (("f", ds[:, :, :n]), ("b", ds[:, :, n:])):
        carry = np.zeros((len(rows), n), np.float32)
        dp = np.zeros((len(rows), WINDOW, 3 * n), np.float32)
        u, v = p[f"U{way}"], p[f"V{way}"]
        for t, before, gate, r, new in reversed(kept[way]):
            m = mask[:, t, None]
            dh = own[:, t] + carry
            dnew = dh * gate * m * (1 - new * new)
            drh = dnew @ v.T
            gates = np.concatenate([dh * (new - before) * m * gate * (1 - gate), drh * before * r * (1 - r)], axis=1)
            g[f"U{way}"] += before.T @ gates
            g[f"V{way}"] += (r * before).T @ dnew
            dp[:, t, : 2 * n], dp[:, t, 2 * n :] = gates, dnew
            carry = dh * (1 - gate * m) + drh * r + gates @ u.T
        g[f"W{way}"] = np.einsum("bti,btj->ij", x, dp)
        g[f"B{way}"] = dp.sum(axis=(0, 1))
        dx += dp @ p[f"W{way}"].T
    for k, (w, place) in enumerate(rows):
        if len(place):
            np.add.at(g["words"], (w.hashes[place] % U(WORD_ROWS)).astype(np.int64), dx[k, : len(place), :WORD_DIM])
            size = w.ends[place] - w.starts[place]
            bytes_of = np.repeat(w.starts[place] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            np.add.at(g["chars"], w.grams[bytes_of], np.repeat(dx[k, : len(place), WORD_DIM + 1 :] / size[:, None], size, axis=0))
    return g


def _odds(ones: np.ndarray, n: np.ndarray, bad: int, good: int) -> np.ndarray:
    value = np.log((ones + 0.5) / (bad + 1)) - np.log((n - ones + 0.5) / (good + 1))
    return np.where(n >= 2, np.clip(value, -3, 3), 0).astype(np.float32)


def log_odds(texts: list[Words], labels: np.ndarray, most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of label 1 for words of at least two training texts, by texts that hold them.

    The training texts themselves keep odds from the other texts, so that the network doesn't learn to trust words it has seen the label of.
    """
    own = [np.unique(w.hashes) for w in texts]
    word, n = np.unique(np.concatenate(own), return_counts=True)
    bad = [x for x, y in zip(own, labels, strict=True) if y]
    ones = np.bincount(np.searchsorted(word, np.concatenate(bad)), minlength=len(word)) if bad else np.zeros(len(word), np.int64)
    total, rest = int(labels.sum()), int((1 - labels).sum())
    value = _odds(ones, n, total, rest)
    for w, y in zip(texts, labels, strict=True):
        at = np.searchsorted(word, w.hashes)
        w.odds = _odds(ones[at] - int(y), n[at] - 1, total - int(y), rest - int(1 - y))
    keep = np.flatnonzero(n >= 2)
    keep = np.sort(keep[np.argsort(-np.abs(value[keep]) * np.sqrt(n[keep]), kind="stable")][:most])
    return word[keep], value[keep]


def calibration(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make logits probabilities on the weighted texts (Newton steps)."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        e, c = weights * (q - labels), weights * np.maximum(q * (1 - q), 1e-6)
        hessian = np.array([[(c * z * z).sum() + 1e-2, (c * z).sum()], [(c * z).sum(), c.sum() + 1e-2]])
        step = np.linalg.solve(hessian, np.array([(e * z).sum() + 1e-2 * (slope - 1), e.sum()]))
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
    return max(float(slope), 1e-3), float(offset)


def trained(values: list[str | None], labels: np.ndarray, weights: np.ndarray, seed: int = 4) -> tuple[dict, tuple, tuple[float, float]]:
    """Weights, log odds and calibration. One text in five calibrates instead of training, so the calibration isn't too sure of itself."""
    texts = [Words(v) for v in values]
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(texts)) % 5 == 0
    learn = np.flatnonzero(~held)
    odds = log_odds([texts[k] for k in learn], labels[learn])
    p = fresh()
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    time = 0
    for epoch in range(max(EPOCHS, min(4 * EPOCHS, STEPS * BATCH // (2 * len(learn))))):  # few texts: more epochs
        z, owner = all_logits(p, odds, [texts[k] for k in learn])
        chosen = []
        for j, k in enumerate(learn):
            own = z[np.searchsorted(owner, j) : np.searchsorted(owner, j, side="right")]
            starts = window_starts(len(texts[k]))
            if epoch < 2:  # the network can't tell windows yet: take the one whose words have the highest odds
                sums = np.concatenate([[0.0], np.cumsum(np.maximum(texts[k].odds, 0) ** 2)])
                own = sums[np.minimum(starts + WINDOW, len(texts[k]))] - sums[starts]
            chosen.append((k, int(starts[own.argmax()])))
            if not labels[k]:
                chosen.append((k, int(rng.choice(starts))))
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // min(BATCH, max(8, len(chosen) // 40)))):
            some = [chosen[i] for i in part]
            g = gradients(p, odds, [(texts[k], s) for k, s in some], labels[[k for k, _ in some]], np.ones(len(some)))
            time += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= (RATE * (m / (1 - 0.9**time)) / (np.sqrt(s / (1 - 0.999**time)) + 1e-7)).astype(np.float32)
    aside = np.flatnonzero(held) if len(set(labels[held].tolist())) > 1 else np.arange(len(texts))
    z, owner = all_logits(p, odds, [texts[k] for k in aside])
    worst = np.maximum.reduceat(z, np.searchsorted(owner, np.arange(len(aside))))
    return p, odds, calibration(worst.astype(float), labels[aside], weights[aside])


def scores(docs: DataFrame, labels: DataFrame, training: Column, most_bad: int = 800, most_good: int = 1600, carried: bool = False) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_windows, worst_word)`` of every row.

    ``labels`` has (doc_id, toxic); ``training`` is a condition on doc_id: which labels may be learnt from. With ``carried`` the rows have
    all columns of ``docs`` before these; names that clash are the documents'.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(training).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [usable.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(most) for y, most in ((1, most_bad), (0, most_good))]
    ids = picked[0].union(picked[1]).toPandas()
    if len(ids):
        listed = spark.createDataFrame(pa.Table.from_pandas(ids, preserve_index=False))  # as Arrow: rows of pandas would start Python workers of another pool
        sample = d.join(F.broadcast(listed), "doc_id").toPandas().sort_values(["doc_id", "text"], na_position="first")
    model = None
    if len(ids) and sample["toxic"].nunique() > 1:
        y = sample["toxic"].to_numpy(np.float64)
        each = {k: totals[k] / max(1, int((ids["toxic"] == k).sum())) for k in (0, 1)}
        model = trained(sample["text"].tolist(), y, np.where(y > 0, each[1], each[0]))
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text.alone("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = part.column(part.schema.get_field_index("text")).to_pylist()
                score, n, worst = np.zeros(len(values)), np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
                if shipped.value is not None:
                    p, odds, (slope, offset) = shipped.value
                    texts = [Words(t) for t in values]
                    z, owner = all_logits(p, odds, texts)
                    first = np.searchsorted(owner, np.arange(len(values)))
                    n = np.diff(np.append(first, len(z)))
                    top = np.maximum.reduceat(z, first)
                    score = 1 / (1 + np.exp(-np.clip(slope * top.astype(float) + offset, -30, 30)))
                    worst = np.array([window_starts(len(w))[z[f : f + k].argmax()] for w, f, k in zip(texts, first, n, strict=True)], np.int64)
                new = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(worst)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *RESULT])

    result = T.StructType([T.StructField(c, t) for c, t in zip(RESULT, (T.DoubleType(), T.IntegerType(), T.LongType(), T.LongType()), strict=True)])
    if carried:
        taken = docs.drop(*RESULT)
        return taken.mapInArrow(text.tidy(run), T.StructType(taken.schema.fields + result.fields))
    d = d.withColumn("held_out", ~F.coalesce(training, F.lit(True)))
    return d.mapInArrow(text.tidy(run), T.StructType(d.schema.fields + result.fields)).drop("text")
