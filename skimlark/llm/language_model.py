"""Language-model scoring with a gated recurrent network whose softmax is factored by word classes.

Words are lower-cased (A-Z) runs of bytes other than space and 0x09-0x0D; each document ends with an end token. Counts of all training
words are taken over the whole corpus. The ``HEADS`` most frequent words form classes of equal probability mass with a softmax inside
each class; all other words form tail classes by hash, within which a word has its smoothed share of the class's counts,
unknown words together one count. The network gives P(class | history) * P(word | class, history).

Training is truncated backpropagation through time in numpy, on all training documents, or one in ``share`` of them if that is asked for:
each task trains on its own documents, ``GATHERED`` tokens at a time, from common weights, and the weights are averaged by tokens, ``ROUNDS``
times. Steps take more documents side by side where a task has many, so that the cost of a step is spread over them. The state is carried from window to window, in training and in
scoring, so a document's score is its complete log-likelihood.

Null and empty texts are the end token alone. Rows are scored one for one, repeated rows alike. An empty training set gives the
uniform model over one unknown word. Rows with null doc_id count as training rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimlark.llm import frames, text

U = np.uint64
HEADS = 4096
CLASSES = 64
TAILS = 16
HIDDEN = 24
WINDOW = 16
BATCH = 64
WIDE = 512
GATHERED = 1 << 18
ROUNDS = 2
KNOWN = 1 << 17
END = np.array([1], np.uint64)


def tokens(value: str | None) -> np.ndarray:
    """Word hashes of a whole text and the end token."""
    raw = text.lowered(value)
    return np.concatenate([text.word_hashes(raw, *text.word_spans(raw)), END])


def counted(docs: DataFrame) -> DataFrame:
    """``(word, c)``: count of every token of these texts, first within tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [tokens(t) for t in pdf["text"]]
            word, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), [])
            yield pd.DataFrame({"word": text.signed(word), "c": c})

    return docs.select("text").mapInPandas(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words with their counts (a fixed number), classes and totals; words beyond are rare."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, tail_totals: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.distinct = total, distinct
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((self.words, -self.counts))] = np.arange(len(order))
        heads = min(HEADS, len(order))
        by_rank = np.empty(len(order), np.int64)
        by_rank[rank] = np.arange(len(order))
        mass = np.cumsum(np.sqrt(self.counts[by_rank[:heads]].astype(float)))
        cut = np.minimum((mass / mass[-1] * (CLASSES - TAILS) - 1e-9).astype(np.int64), CLASSES - TAILS - 1) if heads else np.zeros(0, np.int64)
        cut = np.maximum.accumulate(np.unique(cut, return_inverse=True)[1]) if heads else cut
        self.rank, self.class_of = rank, cut
        self.first = np.searchsorted(cut, np.arange(CLASSES + 1))
        self.tail_totals = tail_totals  # counts of tail words and of the unknown one, by tail class
        self.width = int(max(np.diff(self.first).max(), 1)) if heads else 1

    def looked_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or -1) and count (0 if rare or unknown) of tokens."""
        if not len(self.words):
            return np.full(len(h), -1), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        same = self.words[at] == h
        return np.where(same, self.rank[at], -1), np.where(same, self.counts[at], 0)

    def coded(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input row, class, place in class (-1 in a tail class) and count of tokens."""
        rank, c = self.looked_up(h)
        head = (rank >= 0) & (rank < len(self.class_of))
        tail = (text.mix(h) % U(TAILS)).astype(np.int64)
        if len(self.class_of):
            safe = np.where(head, rank, 0)
            own = np.where(head, self.class_of[safe], CLASSES - TAILS + tail)
            place = np.where(head, safe - self.first[self.class_of[safe]], -1)
        else:
            own, place = CLASSES - TAILS + tail, np.full(len(h), -1)
        return np.where(head, rank, HEADS + tail), own, place, c


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    """Weights before training; rows of ``heads`` follow the classes."""
    rng, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
    return {"x": draw(HEADS + TAILS, 3 * h), "u": draw(h, 2 * h), "v": draw(h, h), "b": np.zeros(3 * h, np.float32),
            "c": draw(h, CLASSES) * 0.1, "d": np.zeros(CLASSES, np.float32), "w": draw(HEADS, h) * 0.1, "o": np.zeros(HEADS, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def advanced(p: dict, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
    """State after one more input."""
    n = HIDDEN
    gates = p["x"][rows] + p["b"]
    zr = sigmoid(gates[:, : 2 * n] + h @ p["u"])
    z, r = zr[:, :n], zr[:, n:]
    new = np.tanh(gates[:, 2 * n :] + (r * h) @ p["v"])
    return h + z * (new - h), (h, z, r, new, rows)


def class_logs(p: dict, states: np.ndarray) -> np.ndarray:
    logits = states @ p["c"] + p["d"]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def word_logs(p: dict, vocabulary: Vocabulary, states: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list]:
    """Log probability of head words within their classes; tail words get 0 here."""
    out, parts = np.zeros(len(own), np.float32), []
    heads = np.flatnonzero(place >= 0)
    order = heads[np.argsort(own[heads], kind="stable")]
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        k = own[group[0]]
        span = slice(vocabulary.first[k], vocabulary.first[k + 1])
        logits = states[group] @ p["w"][span].T + p["o"][span]
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(axis=1)
        out[group] = logits[np.arange(len(group)), place[group]] - np.log(total)
        parts.append((group, span, e / total[:, None]))
    return out, parts


def prior(p: dict, vocabulary: Vocabulary) -> None:
    """Output biases from counts, so that training starts at the unigram model."""
    head_counts = np.zeros(len(vocabulary.class_of))
    head = vocabulary.rank < len(vocabulary.class_of)
    head_counts[vocabulary.rank[head]] = vocabulary.counts[head]
    sums = np.ones(CLASSES)
    np.add.at(sums, vocabulary.class_of, head_counts)
    sums[CLASSES - TAILS :] += vocabulary.tail_totals
    p["d"] = np.log(sums / sums.sum()).astype(np.float32)
    p["o"][: len(head_counts)] = np.log(head_counts + 1)


def trained(p: dict, vocabulary: Vocabulary, streams: list[np.ndarray], rate: float = 0.01, state: dict | None = None) -> tuple[dict, int]:
    """Truncated backpropagation over windows of parallel documents, with Adam steps; returns weights and tokens seen.

    ``state`` keeps the moments of the steps from call to call.
    """
    p = {k: v.copy() for k, v in p.items()}
    state = {} if state is None else state
    moment = state.setdefault("moment", {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()})
    flat = np.concatenate(streams)
    size = len(flat)
    lanes = max(1, min(BATCH, size // (4 * WINDOW)), min(WIDE, size // (32 * WINDOW)))
    steps = -(-size // lanes)
    flat = np.concatenate([flat, np.repeat(END, lanes * steps - size)]).reshape(lanes, steps)
    real = (np.arange(lanes * steps) < size).reshape(lanes, steps)
    h, n = np.zeros((lanes, HIDDEN), np.float32), HIDDEN
    for start in range(0, steps - 1, WINDOW):
        window = flat[:, start : start + WINDOW + 1]
        if window.shape[1] < 2:
            break
        rows, own, place, _ = (x.reshape(window.shape) for x in vocabulary.coded(window.ravel()))
        kept, states = [], []
        for t in range(window.shape[1] - 1):
            h = np.where((window[:, t] == END)[:, None], np.float32(0), h)
            h, step = advanced(p, h, rows[:, t])
            kept.append(step)
            states.append(h)
        flat_states = np.concatenate(states)
        want, at = own[:, 1:].T.ravel(), place[:, 1:].T.ravel()
        probability = np.exp(class_logs(p, flat_states))
        _, parts = word_logs(p, vocabulary, flat_states, want, at)
        probability[np.arange(len(want)), want] -= 1
        filled = None if real[-1, min(start + WINDOW, steps - 1)] else real[:, start + 1 : start + window.shape[1]].T.ravel()
        if filled is not None:  # nothing is learnt from what fills the last lane
            probability[~filled] = 0
        scale = np.float32(1 / lanes)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"], g["d"] = flat_states.T @ probability * scale, probability.sum(axis=0) * scale
        back = probability @ p["c"].T
        for group, span, e in parts:
            e[np.arange(len(group)), at[group]] -= 1
            if filled is not None:
                e[~filled[group]] = 0
            g["w"][span] += e.T @ flat_states[group] * scale
            g["o"][span] += e.sum(axis=0) * scale
            back[group] += e @ p["w"][span]
        back = (back * scale).reshape(len(states), lanes, n)
        carry, inputs = np.zeros((lanes, n), np.float32), []
        for t in range(len(states) - 1, -1, -1):
            before, z, r, new, row = kept[t]
            dh = back[t] + carry
            dnew = dh * z * (1 - new * new)
            drh = dnew @ p["v"].T
            dz, dr = dh * (new - before) * z * (1 - z), drh * before * r * (1 - r)
            gates = np.concatenate([dz, dr, dnew], axis=1)
            g["u"] += before.T @ gates[:, : 2 * n]
            g["v"] += (r * before).T @ dnew
            inputs.append(gates)
            carry = dh * (1 - z) + drh * r + gates[:, : 2 * n] @ p["u"].T
            carry = np.where((window[:, t] == END)[:, None], np.float32(0), carry)
        gates, row = np.concatenate(inputs), np.concatenate([step[4] for step in reversed(kept)])
        order = np.argsort(row, kind="stable")
        begins = np.flatnonzero(np.diff(row[order], prepend=-1))
        g["x"][row[order][begins]] = np.add.reduceat(gates[order], begins, axis=0)
        g["b"] = gates.sum(axis=0)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        time = state["time"] = state.get("time", 0) + 1
        for k, v in g.items():
            v *= min(1.0, 5.0 / (size + 1e-9))
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            p[k] -= (rate * (m / (1 - 0.9**time)) / (np.sqrt(s / (1 - 0.99**time)) + 1e-6)).astype(np.float32)
    return p, int(real.sum())


def scored(p: dict, vocabulary: Vocabulary, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Log10 probability of class and head-word choices of each document; tail classes and counts of its tokens.

    Documents of similar length run side by side; the state goes on from window to window to the end of each.
    """
    out, tails, counts = np.zeros(len(docs)), [np.zeros(0, np.int64)] * len(docs), [np.zeros(0, np.int64)] * len(docs)
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for start in range(0, len(order), 512):
        part = order[start : start + 512]
        lengths = np.array([len(docs[i]) for i in part])
        coded = vocabulary.coded(np.concatenate([docs[i] for i in part]))
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h = np.zeros((len(part), HIDDEN), np.float32)
        total = np.zeros(len(part))
        for k, i in enumerate(part):
            c, own, place = (coded[j][first[k] : first[k] + lengths[k]] for j in (3, 1, 2))
            counts[i], tails[i] = c, np.where(place < 0, own - (CLASSES - TAILS), -1)
        t, live = 0, len(part)
        while live:
            span = min(WINDOW, int(lengths[0]) - t)
            states, where = [], []
            for s in range(t, t + span):
                live = int(np.searchsorted(-lengths, -s, side="left"))  # documents longer than s
                at = first[:live] + s
                states.append(h[:live].copy())
                where.append(at)
                nxt, _ = advanced(p, h[:live], coded[0][at])
                h[:live] = nxt
            at, flat = np.concatenate(where), np.concatenate(states)
            own, place = coded[1][at], coded[2][at]
            logs = class_logs(p, flat)[np.arange(len(at)), own] + word_logs(p, vocabulary, flat, own, place)[0]
            who = np.concatenate([np.arange(len(w)) for w in where])
            total += np.bincount(who, weights=logs, minlength=len(part))
            t += span
            live = int(np.searchsorted(-lengths, -t, side="left"))
        out[part] = total / np.log(10)
    return out, tails, counts


def scores(docs: DataFrame, training: Column, share: int = 1) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row; ``training`` says which rows are learnt from."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", F.coalesce(training, F.lit(True)).alias("learn"))
    words = frames.written(counted(d.where("learn")), "words")
    total, distinct = (x or 0 for x in words.agg(F.sum("c"), F.count("*")).first())
    frequent = most_frequent(words, distinct)
    known_words, known_counts = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["c"].to_numpy(np.int64)
    head_words = known_words[:HEADS].view(np.int64)

    def by_tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = pdf["word"].to_numpy(np.int64)
            keep = ~np.isin(w, head_words)
            sums = np.bincount((text.mix(w[keep].view(np.uint64)) % U(TAILS)).astype(np.int64), weights=pdf["c"].to_numpy()[keep] + 1, minlength=TAILS)
            yield pd.DataFrame({"tail": np.arange(TAILS), "mass": sums.astype(np.int64)})

    mass = np.ones(TAILS)
    for r in words.mapInPandas(by_tail, "tail int, mass long").groupBy("tail").agg(F.sum("mass").alias("m")).collect():
        mass[r["tail"]] += r["m"]
    vocabulary = Vocabulary(known_words, known_counts, total, distinct, mass)
    p = fresh()
    prior(p, vocabulary)
    sample = d.where("learn").select("text")
    if share > 1:
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    for _ in range(ROUNDS):
        p = _averaged(sample, p, vocabulary)
    rows = _scored(d, spark.sparkContext.broadcast((p, vocabulary)))
    return _with_rare(rows, words, total, distinct, vocabulary)


def most_frequent(words: DataFrame, distinct: int) -> pd.DataFrame:
    """The ``KNOWN`` most frequent words: a count is found that few enough words pass, so tasks do not each send a list of that length."""
    least = 0
    if distinct > KNOWN:
        by_count = words.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()  # 10,000 rows at most
        passed = 0
        for r in by_count:
            passed += r["n"]
            if passed >= KNOWN:
                least = r["c"]
                break
        near, missing = words.where(F.col("c") == least), KNOWN - (passed - r["n"])
        if missing < r["n"] and least < 10_000:  # the smallest words of this count: those below a value that enough pass
            cut = near.approxQuantile("word", [min(1.0, 1.1 * missing / r["n"] + 0.01)], 0.005)[0]
            near = near.where(F.col("word") <= F.lit(int(cut)))
        words = words.where(F.col("c") > least).unionByName(near)
    return words.orderBy(F.desc("c"), "word").limit(KNOWN).toPandas()


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """Token streams of all texts, GATHERED tokens or a little more at a time, and what is left; longer texts are cut there."""
    streams, size = [], 0
    for pdf in batches:
        for t in pdf["text"]:
            own = tokens(t)
            for start in range(0, len(own), GATHERED):
                streams.append(own[start : start + GATHERED])
                size += len(streams[-1])
                if size >= GATHERED:
                    yield streams
                    streams, size = [], 0
    if size > 1:
        yield streams


def _averaged(sample: DataFrame, p: dict, vocabulary: Vocabulary) -> dict:
    """One round: every task trains on its documents from the same weights; weighted mean of the results, summed slice by slice."""
    names = sorted(p)
    shipped = sample.sparkSession.sparkContext.broadcast((p, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, words = shipped.value
        seen, now, state = 0, start, {}
        for streams in _gathered(batches):
            now, n = trained(now, words, streams, state=state)
            seen += n
        if seen:
            flat = np.concatenate([now[k].ravel() for k in names]).astype(np.float64) * seen
            cuts = np.array_split(flat, 64)
            yield pd.DataFrame({"slice": range(64), "n": seen, "sums": [c.tobytes() for c in cuts]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float64) for b in pdf["sums"])
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "mean": [(total / pdf["n"].sum()).astype(np.float32).tobytes()]})

    parts = sample.mapInPandas(run, "slice int, n long, sums binary").groupBy("slice").applyInPandas(added, "slice int, mean binary").collect()
    if not parts:
        return p
    flat = np.concatenate([np.frombuffer(r["mean"], np.float32) for r in sorted(parts, key=lambda r: r["slice"])])
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + p[k].size].reshape(p[k].shape).copy()
        at += p[k].size
    return out


def _scored(d: DataFrame, shipped) -> DataFrame:
    """Per document the network's part, and for each rare word ``(word, n)`` what is still to be looked up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, vocabulary = shipped.value
        bottom = np.log10(vocabulary.total + vocabulary.distinct + 1.0)
        for pdf in batches:
            found = [tokens(t) for t in pdf["text"]]
            model, tails, counts = scored(p, vocabulary, found)
            out = []
            for h, tail, c, m in zip(found, tails, counts, model, strict=True):
                here = c > 0
                base = float(np.log10(c[here] + 1.0).sum() - len(c) * bottom)
                tailed = tail >= 0
                m -= float(np.log10(vocabulary.tail_totals[tail[tailed]]).sum())
                m += float(np.log10(c[tailed & here] + 1.0).sum())
                rare, n = np.unique(h[~here], return_counts=True)
                out.append((len(h), int(here.sum()), base, m, text.signed(rare), n.astype(np.int64)))
            got = pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "model", "rare", "times"])
            got["doc_id"], got["held_out"] = pdf["doc_id"].array, (~pdf["learn"]).array
            yield got

    return d.mapInPandas(run, "n_tokens long, n_known long, base double, model double, rare array<long>, times array<long>, doc_id string, held_out boolean")


def _with_rare(rows: DataFrame, words: DataFrame, total: int, distinct: int, vocabulary: Vocabulary) -> DataFrame:
    """Adds the counts of rare words by a join on the word: both scores gain log10(c + 1) of each."""
    rows = frames.written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    if distinct <= KNOWN:
        return _result(rows.drop("rare", "times"), total)
    left = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    gained = left.join(words, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("found"))
    full = rows.drop("rare", "times").join(gained, "row", "left").withColumns({
        "n_known": F.col("n_known") + F.coalesce("found", F.lit(0)), "base": F.col("base") + F.coalesce("more", F.lit(0.0)), "model": F.col("model") + F.coalesce("more", F.lit(0.0))})
    return _result(full, total)


def _result(rows: DataFrame, total: int) -> DataFrame:
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))
