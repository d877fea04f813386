"""Cross-tokenizer alignment: tokens of a byte-level BPE (A) and of a piece model (B) cut into the smallest groups that both end.

Fragments of a text form a monoid. The tokens that end in a byte range give an open prefix (up to the first offset where tokens
of both kinds end), closed groups, and an open suffix; two neighbours compose by closing the group that the first one's suffix
and the second one's prefix make together. Composition is associative, so a short text is folded in its task, while a text
above ``CHUNK`` bytes is dealt to the cluster by byte ranges, whose fragments a tree of grouped reductions composes.

Neither tokenizer joins a space between two other characters to what precedes it, so texts are encoded by units that begin with
such a space; a byte range encodes the units it touches and keeps the tokens that end in it. A unit longer than ``CHUNK`` lies in
one range. Tokens of units met before are kept, bounded in bytes, for the time of a task; short texts are walked as one stream.

Links are the pairs of overlapping tokens. Their corpus-wide counts are summed by pair; pairs above one in ``HEAVY`` of all links
(or all pairs, while no more than ``HEAVY`` differ) go to every task as one sorted table, the others are joined by shuffle.

Null and empty texts, and texts whose joined token bytes differ from space + text, have no tokens: zeros and an empty digest. Rows
count each for itself, repeated rows too; null doc_ids are carried; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimlark.llm.bpe import byte_letters
from skimlark.llm.frames import kept, written

CHUNK = 65_536  # bytes of a range
FAN_IN = 8  # fragments that one reduction composes
HEAVY = 1_000_000  # pairs sent to every task at most
SLICE = 1_000_000  # bytes encoded together
TOGETHER = 64  # units encoded as one text
CACHED = 64_000_000  # bytes of units kept by a task, about
WIDEST = 65_536  # tokens of a vocabulary
HELD = 1_000_000  # distinct pairs that a task holds while counting
_ODD = re.compile(r"\s |^ | $| \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Open(NamedTuple):
    """Tokens of both kinds in order, with the byte offset where each ends."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def part(self, a: slice, b: slice) -> Open:
        return Open(self.a[a], self.a_ends[a], self.b[b], self.b_ends[b])


class Closed(NamedTuple):
    """Whole groups: their text form, packed links, and counts."""

    text: bytes
    links: bytes
    n_a: int
    n_b: int
    n_groups: int


class Fragment(NamedTuple):
    """Open prefix, closed groups, open suffix; ``cut``: some group ends inside (else all tokens are in the prefix)."""

    ok: bool
    cut: bool
    head: Open
    closed: Closed
    tail: Open


NO_TOKENS = Open(*[np.zeros(0, np.int64)] * 4)
NOTHING = Closed(b"", b"", 0, 0, 0)
IDENTITY = Fragment(True, False, NO_TOKENS, NOTHING, NO_TOKENS)


@cache
def spelled() -> list[bytes]:
    """Token numbers with the mark that follows: comma, bar after the last A, semicolon after the last B of a group."""
    return [b"%d%b" % (i, mark) for mark in (b",", b"|", b";") for i in range(WIDEST)]


def walked(tokens: Open) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of ``spelled`` in writing order, links and the offset where each ends, and the offsets where groups end."""
    a, a_ends, b, b_ends = tokens
    base = min(a_ends[0], b_ends[0])
    ending = np.zeros((2, a_ends[-1] - base + 1), bool)  # by offset: whether a token of A, of B ends there
    ending[0, a_ends - base] = ending[1, b_ends - base] = True
    both = ending[1, a_ends - base]
    last_a, last_b = np.flatnonzero(both), np.flatnonzero(ending[0, b_ends - base])
    links_end = np.flatnonzero(ending[0] | ending[1])
    of_a, of_b = (np.cumsum(ends[links_end]) - ends[links_end] for ends in ending)  # the tokens that the bytes up to there belong to
    links, links_end = a[of_a] << 16 | b[of_b], links_end + base
    codes = np.empty(len(a) + len(b), np.int64)
    marked_a, marked_b = a.copy(), b.copy()
    marked_a[last_a] += WIDEST
    marked_b[last_b] += 2 * WIDEST
    before = np.r_[0, last_b[:-1] + 1]  # B tokens of earlier groups
    codes[np.arange(len(a)) + np.repeat(before, np.diff(last_a, prepend=-1))] = marked_a
    codes[np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))] = marked_b
    return codes, links.astype("<u4"), links_end, a_ends[both]


def joined(tokens: Open) -> Closed:
    """The groups of tokens whose last ones end together."""
    if not len(tokens.a):
        return NOTHING
    codes, links, _, groups = walked(tokens)
    return Closed(b"".join(map(spelled().__getitem__, codes.tolist()))[:-1], links.tobytes(), len(tokens.a), len(tokens.b), len(groups))


def beside(x: Open, y: Open) -> Open:
    return Open(*[np.concatenate(v) for v in zip(x, y, strict=True)])


def merged(parts: list[Closed]) -> Closed:
    """Neighbouring groups as one run of groups."""
    parts = [p for p in parts if p.n_groups]
    if len(parts) < 2:
        return parts[0] if parts else NOTHING
    return Closed(b";".join([p.text for p in parts]), b"".join([p.links for p in parts]), sum([p.n_a for p in parts]),
                  sum([p.n_b for p in parts]), sum([p.n_groups for p in parts]))


def fragment(tokens: Open, ok: bool = True) -> Fragment:
    """The fragment of the tokens that end in a byte range."""
    cuts = np.intersect1d(tokens.a_ends, tokens.b_ends)
    if not len(cuts):
        return Fragment(ok, False, tokens, NOTHING, NO_TOKENS)
    (a, x), (b, y) = (np.searchsorted(e, cuts[[0, -1]], "right") for e in (tokens.a_ends, tokens.b_ends))
    return Fragment(ok, True, tokens.part(slice(a), slice(b)), joined(tokens.part(slice(a, x), slice(b, y))), tokens.part(slice(x, None), slice(y, None)))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with ``IDENTITY``."""
    ok = x.ok and y.ok
    if not y.cut:
        return Fragment(ok, True, x.head, x.closed, beside(x.tail, y.head)) if x.cut else Fragment(ok, False, beside(x.head, y.head), NOTHING, NO_TOKENS)
    if not x.cut:
        return Fragment(ok, True, beside(x.head, y.head), y.closed, y.tail)
    return Fragment(ok, True, x.head, merged([x.closed, joined(beside(x.tail, y.head)), y.closed]), y.tail)


def whole(x: Fragment) -> Closed:
    """All groups of a text whose ranges are all composed."""
    return merged([joined(x.head), x.closed, joined(x.tail)]) if x.ok else NOTHING


def units_of(text: str) -> list[str]:
    """The text cut at single spaces between other characters; these spaces belong to the units' beginnings."""
    single = "\n".join([" ".join(line.split()) for line in text.split("\n")]) == text
    return text.split(" ") if single or not _ODD.search(text) else _CUT.split(text)


class Encoders:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_letter = {letter: byte for byte, letter in byte_letters().items()}
        letters = {t: i for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(letters.values(), default=0) >= WIDEST or len(pieces) > WIDEST:
            raise ValueError(f"links are packed for vocabularies of at most {WIDEST} tokens")
        self.a_bytes = [b""] * (1 + max(letters.values(), default=0))
        for t, i in letters.items():
            self.a_bytes[i] = bytes(of_letter[c] for c in t) if all(c in of_letter for c in t) else t.encode()
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(v) for v in table], np.int64) for table in (self.a_bytes, self.b_bytes))

    def encode(self, units: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The tokens of each unit with a space before, each kind as one array with the number of each unit, and whether both spell it.

        ``TOGETHER`` units are encoded as one text: neither tokenizer joins a space between two other characters to what precedes it.
        Units that begin or end with white space, and texts that their tokens do not spell unit by unit, are encoded unit by unit.
        """
        fit = [i for i, u in enumerate(units) if u and not (u[0].isspace() or u[-1].isspace())]
        calls = [fit[at : at + TOGETHER] for at in range(0, len(fit), TOGETHER)]
        texts = [" ".join([units[i] for i in c]) for c in calls]
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b_ids = self.b.encode(texts, num_threads=1)
        order, rest, found = [], sorted(set(range(len(units))).difference(fit)), []

        def parted(c: list[int], calls: slice) -> bool:
            raw, ends = "".join([" " + t for t in texts[calls]]).encode(), np.cumsum([1 + len(units[i].encode()) for i in c])
            own = [_parted(list(chain.from_iterable(ids[calls])), *sizes, raw, ends) for ids, sizes in ((a_ids, (self.a_bytes, self.a_size)), (b_ids, (self.b_bytes, self.b_size)))]
            if own[0] is None or own[1] is None:
                return False
            order.extend(c)
            found.append((*own[0], *own[1]))
            return True

        if fit and not parted(fit, slice(None)):
            for k, c in enumerate(calls):
                if not parted(c, slice(k, k + 1)):
                    rest += c
        a, b, ok = self.each([units[i] for i in rest])
        found.append((*a, *b))
        a, a_counts, b, b_counts = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = np.r_[np.ones(len(order), bool), ok]
        if rest:
            back = np.argsort(order + rest)
            a, b = (v[_spread((np.cumsum(n) - n)[back], n[back])] for v, n in ((a, a_counts), (b, b_counts)))
            a_counts, b_counts, ok = a_counts[back], b_counts[back], ok[back]
        return (a, a_counts), (b, b_counts), ok

    def each(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The same of texts that are encoded each for itself."""
        spaced = [" " + t for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        raw = "".join(spaced).encode()
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in spaced), np.int64, len(texts)))
        ok, out = np.ones(len(texts), bool), []
        for ids, table, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = list(chain.from_iterable(ids))
            values = np.array(flat, np.int64)
            out.append((values, counts))
            if not np.array_equal(np.r_[0, np.cumsum(size[values])][np.cumsum(counts)], ends) or b"".join(map(table.__getitem__, flat)) != raw:
                ok &= [b"".join([table[i] for i in x]) == t.encode() for x, t in zip(ids, spaced, strict=True)]
        return *out, ok


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of lists that begin at these places, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _parted(ids: list[int], table: list[bytes], size: np.ndarray, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The tokens of a text and how many end each of its units, if they spell it and each unit's end is one of theirs."""
    values = np.array(ids, np.int64)
    token_ends = np.cumsum(size[values])
    at = np.searchsorted(token_ends, ends, "right") - 1
    if not len(values) or (at < 0).any() or not np.array_equal(token_ends[at], ends) or b"".join(map(table.__getitem__, ids)) != raw:
        return None
    return values, np.diff(at, prepend=-1)


class Lists:
    """Lists of numbers under one another, added to and gathered as arrays."""

    def __init__(self):
        self.values, self.starts = np.zeros(1 << 16, np.uint16), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        ends = self.starts[-1] + np.cumsum(counts)
        if ends[-1] > len(self.values):
            self.values = np.r_[self.values[: self.starts[-1]], np.zeros(2 * int(ends[-1]), np.uint16)]
        self.values[self.starts[-1] : ends[-1]] = values
        self.starts = np.r_[self.starts, ends]

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.starts[at + 1] - self.starts[at]

    def gather(self, at: np.ndarray) -> np.ndarray:
        return self.values[_spread(self.starts[at], self.sizes(at))].astype(np.int64)


_ready: dict[tuple[str, str], Encoders] = {}


class Known:
    """The tokens of units encoded by one task; all are forgotten when they pass ``CACHED`` bytes, about."""

    def __init__(self, a_path: str, b_path: str):
        self.encoders = _ready.get((a_path, b_path)) or _ready.setdefault((a_path, b_path), Encoders(a_path, b_path))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.a, self.b, self.ok, self.bytes = Lists(), Lists(), np.zeros(0, bool), 0

    def places(self, units: list[str]) -> np.ndarray:
        """The number of each unit; units not met before are encoded."""
        if self.bytes > CACHED:
            self.forget()
        at = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            missing = list(dict.fromkeys([units[i] for i in new]))
            a, b, ok = self.encoders.encode(missing)
            n = len(self.place)
            self.place.update(zip(missing, range(n, n + len(missing)), strict=True))
            self.a.add(*a)
            self.b.add(*b)
            self.ok = np.r_[self.ok, ok]
            self.bytes += sum([200 + 3 * len(u) for u in missing])
            at[new] = np.fromiter(map(self.place.__getitem__, [units[i] for i in new]), np.int64, len(new))
        return at

    def tokens(self, at: np.ndarray, start: int = 0) -> Open:
        """The tokens of these units beside one another, the first of which begins at a byte offset."""
        a, b = self.a.gather(at), self.b.gather(at)
        return Open(a, start + np.cumsum(self.encoders.a_size[a]), b, start + np.cumsum(self.encoders.b_size[b]))

    def texts(self, lists: list[list[str]]) -> list[Closed]:
        """The groups of whole texts, each given by its units: all are walked as one stream in which each text ends a group."""
        at = self.places(list(chain.from_iterable(lists)))
        size = np.array([len(x) for x in lists], np.int64)
        text = np.repeat(np.arange(len(lists)), size)
        bad = np.zeros(len(lists), bool)
        bad[text[~self.ok[at]]] = True
        at, text = at[~bad[text]], text[~bad[text]]
        if not len(at):
            return [NOTHING] * len(lists)
        tokens = self.tokens(at)
        codes, links, links_end, groups = walked(tokens)
        n_a, n_b = (np.bincount(text, x.sizes(at), len(lists)).astype(np.int64) for x in (self.a, self.b))
        done = np.r_[0, tokens.a_ends][np.cumsum(n_a)]  # the offset where each text ends
        last_link, last_group, last_code = np.searchsorted(links_end, done, "right"), np.searchsorted(groups, done, "right"), np.cumsum(n_a + n_b)
        written_out, out = list(map(spelled().__getitem__, codes.tolist())), []
        link = group = code = 0
        for i in range(len(lists)):
            out.append(Closed(b"".join(written_out[code : last_code[i]])[:-1], links[link : last_link[i]].tobytes(), int(n_a[i]), int(n_b[i]), int(last_group[i] - group))
                       if n_a[i] else NOTHING)
            link, group, code = last_link[i], last_group[i], last_code[i]
        return out


def ranged(known: Known, units: list[str], at: int, low: int, high: int) -> Fragment:
    """The fragment of the byte range (low, high] from the units that touch it, the first of which begins at ``at``."""
    places = known.places(units)
    if not known.ok[places].all():
        return IDENTITY._replace(ok=False)
    tokens = known.tokens(places, at)
    a, b = (slice(*np.searchsorted(e, [low, high], "right")) for e in (tokens.a_ends, tokens.b_ends))
    return fragment(tokens.part(a, b))


def ranges(units: list[str], chunk: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """``low, high, at, units`` of the byte ranges of a long text; a unit longer than a range is in one of them."""
    ends = list(accumulate(1 + len(u.encode()) for u in units))
    starts = [0, *ends[:-1]]
    bounds, at = [0], 0
    for i, end in enumerate(ends):
        while (bound := bounds[-1] + chunk) < end and bound < ends[-1]:
            if end - starts[i] <= chunk:
                bounds.append(bound)
            elif starts[i] > bounds[-1]:
                bounds.append(starts[i])
            else:
                bounds.append(end)
    bounds = [b for b in bounds if b < ends[-1]] + [ends[-1]]
    for low, high in zip(bounds, bounds[1:], strict=False):
        while ends[at] <= low:
            at += 1
        last = at
        while starts[last] < high:
            last += 1
            if last == len(units):
                break
        yield low, high, starts[at], units[at:last]


RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def result(x: Closed) -> tuple:
    return x.n_a, x.n_b, x.n_groups, len(x.links) // 4, hashlib.sha256(x.text).hexdigest() if x.n_groups else "", x.links


def encoded(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """Finished rows of short texts and the byte ranges of long ones, by row number, written once."""
    names = ["part", "low", "high", "at", "piece", *[f.split()[0] for f in RESULT.split(", ")]]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(a_path, b_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            start = 0
            while start < len(texts):
                rows, size, stop = [], 0, start
                while stop < len(texts) and size < SLICE:
                    size += len(texts[stop] or b"") + 1
                    stop += 1
                values = [t.decode("utf-8", "replace") if t else "" for t in texts[start:stop]]
                # a replaced byte is not the row's text: bytes differ, no tokens
                lists = [units_of(v) if v and v.encode() == t else [] for v, t in zip(values, texts[start:stop], strict=True)]
                short = [u if t is None or len(t) <= chunk else [] for u, t in zip(lists, texts[start:stop], strict=True)]
                for i, (units, groups) in enumerate(zip(lists, known.texts(short), strict=True)):
                    if units and not short[i]:
                        rows += [(i, k, low, high, at, " ".join(part), *[None] * 6) for k, (low, high, at, part) in enumerate(ranges(units, chunk))]
                    else:
                        rows.append((i, None, None, None, None, None, *result(groups)))
                take = pa.array([start + r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take),
                     *[pa.array([r[1 + j] for r in rows], kind) for j, kind in enumerate(kinds)]], names=["row", "doc_id", *names])
                start = stop

    plain = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    table = plain.mapInArrow(run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, part int, low long, high long, at long, piece string, {RESULT}")
    return written(table, "alignment", compression="zstd")


_OPEN = ["a", "a_ends", "b", "b_ends"]
FRAGMENT = ("row long, part int, ok boolean, cut boolean, " + ", ".join(f"{side}_{f} array<long>" for side in ("head", "tail") for f in _OPEN)
            + ", text binary, links binary, n_a long, n_b long, n_groups long")
_COLUMNS = [f.split()[0] for f in FRAGMENT.split(", ")]


def _row(row: int, part: int, x: Fragment) -> tuple:
    return (row, part, x.ok, x.cut, *x.head, *x.tail, *x.closed)


def _fragment(r) -> Fragment:
    head, tail = (Open(*[np.asarray(getattr(r, f"{side}_{f}"), np.int64) for f in _OPEN]) for side in ("head", "tail"))
    return Fragment(bool(r.ok), bool(r.cut), head, Closed(bytes(r.text), bytes(r.links), int(r.n_a), int(r.n_b), int(r.n_groups)), tail)


def fragments(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The fragment of every byte range of long texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(a_path, b_path)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                rows.append(_row(r.row, r.part, ranged(known, units_of(r.piece), r.at, r.low, r.high)))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    dealt = pieces.select("row", "part", "low", "high", "at", "piece").repartition("row", "part")
    return dealt.mapInPandas(run, FRAGMENT)


def reduced(parts: DataFrame, most: int, fan_in: int = FAN_IN) -> DataFrame:
    """One fragment for each text: neighbours are composed ``fan_in`` at a time, round by round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = IDENTITY
        for r in pdf.sort_values("part").itertuples():
            out = compose(out, _fragment(r))
        return pd.DataFrame([_row(int(pdf["row"].iloc[0]), int(pdf["part"].iloc[0]) // fan_in, out)], columns=_COLUMNS)

    while most > 0:
        parts = parts.groupBy("row", F.floor(F.col("part") / fan_in).alias("next")).applyInPandas(run, FRAGMENT)
        most //= fan_in
    return parts


def finished(parts: DataFrame) -> DataFrame:
    """``row`` and the result of every long text."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r.row, *result(whole(_fragment(r)))) for r in pdf.itertuples()], columns=["row", *names])

    return parts.mapInPandas(run, "row long, " + RESULT)


def link_counts(links: DataFrame) -> DataFrame:
    """``pair, n`` of the packed pairs of all rows, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, "<u4"), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            values = [v for v in batch.column(0).to_pylist() if v]
            for part in _sliced(values):
                pair, inverse = np.unique(np.r_[held, np.frombuffer(part, "<u4")], return_inverse=True)
                n = np.bincount(inverse, np.r_[n, np.ones(len(part) // 4, np.int64)], len(pair)).astype(np.int64)
                held = pair
                if len(held) > HELD:
                    yield out()
                    held, n = held[:0], n[:0]
        yield out()

    return links.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _sliced(values: list[bytes], size: int = 16_000_000) -> Iterator[bytes]:
    part, held = [], 0
    for v in values:
        part.append(v)
        held += len(v)
        if held > size:
            yield b"".join(part)
            part, held = [], 0
    if part:
        yield b"".join(part)


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best``: links whose pair is the most frequent one of its B token in the corpus; ``count_sum``: their pairs' counts, summed.
    """
    spark = docs.sparkSession
    table = encoded(docs, a_path, b_path, chunk)
    names = [f.split()[0] for f in RESULT.split(", ")]
    rows = table.where("part is null").select("row", "doc_id", *names)
    most = table.agg(F.max("part")).first()[0]
    if most is not None:
        pieces = table.where("part is not null")
        long = written(finished(reduced(fragments(pieces, a_path, b_path), most)), "alignment-long", compression="zstd")
        rows = rows.unionByName(pieces.where("part = 0").select("row", "doc_id").join(long, "row").select("row", "doc_id", *names))
    counts = kept(link_counts(rows.select("links")))
    best = counts.groupBy(F.col("pair").bitwiseAND(65535).alias("b")).agg(F.max("n").alias("most"))  # one row a B token
    judged = counts.withColumn("b", F.col("pair").bitwiseAND(65535)).join(F.broadcast(best), "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    facts = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("links")).first()
    every = facts["pairs"] <= heavy
    common = judged if every else judged.where(F.col("n") * F.lit(heavy) >= F.lit(facts["links"]))
    sent = common.orderBy("pair").toArrow()  # at most ``heavy`` rows
    shipped = spark.sparkContext.broadcast(tuple(sent.column(c).to_numpy() for c in ("pair", "n", "best")))
    schema = f"row long, doc_id {dict(docs.dtypes)['doc_id']}, " + RESULT.replace(", links binary", "") + ", n_best long, count_sum long, rest binary, times binary"
    head = ["row", "doc_id", *names[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shipped.value
        for batch in batches:
            out = []
            for links in batch.column(len(head)).to_pylist():
                own, times = np.unique(np.frombuffer(links or b"", "<u4"), return_counts=True)
                own = own.astype(np.int64)
                at = np.searchsorted(pair, own)
                found = (pair[np.minimum(at, len(pair) - 1)] == own) if len(pair) else np.zeros(len(own), bool)
                at, m = at[found], times[found]
                out.append((int(m[best[at]].sum()), int((m * n[at]).sum()), own[~found].astype("<u4").tobytes(), times[~found].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(head)], *[pa.array([o[j] for o in out], kind) for j, kind in enumerate([pa.int64(), pa.int64(), pa.binary(), pa.binary()])]],
                names=[*head, "n_best", "count_sum", "rest", "times"])

    scored = rows.select(*head, "links").mapInArrow(run, schema)
    if every:
        return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    scored = written(scored, "alignment-scored", compression="zstd")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rest, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(rest, "<u4")
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row, np.int64)), pa.array(own.astype(np.int64)), pa.array(np.frombuffer(times, "<i8"))],
                                                     names=["row", "pair", "times"])

    other = scored.select("row", "rest", "times").mapInArrow(spread, "row long, pair long, times long")
    rare = judged.where(F.col("n") * F.lit(heavy) < F.lit(facts["links"]))
    added = other.join(rare, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return scored.join(added, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
