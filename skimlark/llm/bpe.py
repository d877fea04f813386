"""BPE encoding and decoding with a tokenization automaton.

The merges of a vocabulary are compiled, one after the other, into a deterministic automaton whose arcs are tokens and
whose accepted arc sequences are exactly the tokenizations that the merges produce. It starts with one state and one
loop for each byte symbol. The gadget of a merge ``u v -> z`` copies the state that ``u`` leads to, takes the ``v`` arc out
of the copy, leads ``u`` to the copy, and adds ``z`` arcs beside the ``u`` arcs, leading where ``v`` led. All arcs of one label
lead to one state, so a state is its parent, the arc taken out and its time; arcs are looked up in these tables and kept.
A pre-split word is encoded by following arcs that spell it; exactly one path is accepted. Decoding emits the arcs' labels.

Null text is the empty text: no tokens, empty decoded text. Rows keep their order number only; repeated rows are
encoded each for itself. Special strings of the vocabulary inside a text are their tokens.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimlark.llm import text as text_tools

#: The vocabulary's pre-split pattern and the white space of its normalizer.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
_SPLIT = re.compile(f"[{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")
END = "</w>"
CACHED = 400_000  # strings, and pieces, of at most LONG characters kept by a Python worker: about 70 MB each, 250 MB at the very most
FEW = 100_000  # the same in an operator that others follow in the same workers
ARCS = 800_000  # arcs kept by a Python worker
LONG = 64  # longer strings are not kept
AT_ONCE = 256  # texts encoded before their tokens are handed on


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: Latin-1's printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def compiled(path: str) -> dict:
    """Tables of the automaton for a vocabulary file; their size depends on the vocabulary only."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab = model["vocab"]
    size = 1 + max(vocab.values())
    born, left, target = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for letter in byte_letters().values():
        born[[vocab[letter], vocab[letter + END]]] = 0
    parent, removed, since = [0], [-1], [0]
    tables = {"born": born, "left": left, "parent": parent, "removed": removed, "since": since}
    for time, pair in enumerate(model["merges"], 1):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        u, v, z = vocab[a], vocab[b], vocab[a + b]
        state = target[u]
        if born[u] < 0 or born[v] < 0 or born[z] >= 0 or not allowed(tables, state, v):
            continue  # no path spells this pair any more
        born[z], left[z], target[z] = time, u, target[v]
        parent.append(int(state))
        removed.append(v)
        since.append(time)
        target[u] = len(parent) - 1
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    labels = [""] * max(size, 1 + max(special.values(), default=0))
    for token, i in [*vocab.items(), *special.items()]:
        labels[i] = token
    return tables | {"born": born.tolist(), "left": left.tolist(), "target": target.tolist(), "labels": labels, "special": special} | spans(parent, removed)


def spans(parent: list[int], removed: list[int]) -> dict:
    """Each state's place in a walk down from the first one, and by label the spans of places below the states that took it out.

    Spans of one label are apart, as a path takes an arc out once.
    """
    size = [1] * len(parent)
    for state in range(len(parent) - 1, 0, -1):
        size[parent[state]] += size[state]
    place, free, below = [0] * len(parent), [1] * len(parent), {}
    for state in range(1, len(parent)):
        place[state] = free[parent[state]]
        free[parent[state]] += size[state]
        free[state] = place[state] + 1
        below.setdefault(removed[state], []).append((place[state], place[state] + size[state]))
    return {"place": place, "below": {label: [x for span in sorted(found) for x in span] for label, found in below.items()}}


def has_arc(tables: dict, state: int, label: int) -> bool:
    """Like ``allowed`` over finished tables: whether a state above took the label out is looked up among its spans."""
    born, left, since, parent, place, below = (tables[k] for k in ("born", "left", "since", "parent", "place", "below"))
    while state:
        time = born[label]
        if time < since[state]:
            if (edges := below.get(label)) and bisect.bisect_right(edges, place[state]) % 2:
                return False
            if not time:
                return True
            while since[state] > time:
                state = parent[state]
            if not state:
                return True
        label = left[label]
    return True


def allowed(tables: dict, state: int, label: int) -> bool:
    """Whether the state has an arc of this label. A later label is there if its left part is; an earlier arc if the parent has it."""
    born, left, since, removed, parent = (tables[k] for k in ("born", "left", "since", "removed", "parent"))
    while state:
        if born[label] >= since[state]:
            label = left[label]
        elif label == removed[state]:
            return False
        else:
            state = parent[state]
    return True


class Automaton(dict):
    """Encoder of white-space-free strings; as a dict it keeps the token bytes of strings seen lately."""

    def __init__(self, tables: dict, most: int = CACHED):
        super().__init__()
        self.most = most
        self.tables, self.labels, self.special = tables, tables["labels"], tables["special"]
        self.letters = byte_letters()
        known = [(t, i) for i, t in enumerate(self.labels) if i < len(tables["born"]) and tables["born"][i] >= 0]
        self.inner = {t: i for t, i in known if not t.endswith(END) or len(t) == len(END)}
        self.final = {t[: -len(END)]: i for t, i in known if t.endswith(END) and len(t) > len(END)}
        self.longest = max((len(t) for t, _ in known), default=1)
        self.arcs: dict[int, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = {t[:2] for t in self.special}

    def step(self, state: int, label: int) -> int:
        """The state that an arc leads to, or -1."""
        key = state << 20 | label
        to = self.arcs.get(key)
        if to is None:
            if len(self.arcs) > ARCS:
                self.arcs.clear()
            to = self.arcs[key] = self.tables["target"][label] if has_arc(self.tables, state, label) else -1
        return to

    def word(self, word: str) -> list[int]:
        """Labels of the accepted path that spells the word: depth first, long arcs first; places that failed in a state stay closed."""
        s = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8", "replace")])
        n, path, dead = len(s), [], set()
        inner, final, known, step, longest = self.inner.get, self.final.get, self.arcs.get, self.step, self.longest
        at, state, length = 0, 0, min(n, longest)
        while at < n:
            if at + length == n:  # the rest of the word
                label = final(s[at:])
                if label is not None:
                    to = known(state << 20 | label)
                    if to is None:
                        to = step(state, label)
                    if to >= 0 and not (dead and (n, to) in dead):
                        path.append((at, state, length, label))
                        break
                length -= 1
            while length:
                label = inner(s[at : at + length])
                if label is not None:
                    to = known(state << 20 | label)
                    if to is None:
                        to = step(state, label)
                    if to >= 0 and not (dead and (at + length, to) in dead):
                        break
                length -= 1
            if length:
                path.append((at, state, length, label))
                at, state = at + length, to
                length = min(n - at, longest)
            else:
                dead.add((at, state))
                at, state, length, _ = path.pop()
                length -= 1
        return [x[3] for x in path]

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.replace("Σ", "σ").lower()
        if low.isascii() and low.isalpha():  # one piece
            out = self.piece(low)
        else:
            out = b"".join(map(self.piece, PIECES.findall(low)))
        if len(chunk) <= LONG:
            self[chunk] = out
        return out

    def piece(self, piece: str) -> bytes:
        """Token bytes of one lower-cased piece: words that differ in capitals or the marks around them share it."""
        out = self.pieces.get(piece)
        if out is None:
            ids = self.word(piece)
            out = pack(f"<{len(ids)}I", *ids)
            if len(piece) <= LONG:
                if len(self.pieces) > self.most:
                    self.pieces.clear()
                self.pieces[piece] = out
        return out

    def forget(self) -> None:
        """What was kept is given back."""
        self.clear()
        self.pieces.clear()
        self.arcs.clear()

    def encode(self, text: str | None) -> bytes:
        """Token numbers of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut and any(m in text for m in self.marks):
            parts = self.cut.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        text = unicodedata.normalize("NFC", text)
        chunks = [c for c in _SPLIT.split(text) if c] if _ODD.search(text) else text.split()
        return b"".join(map(self.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs in order, with one space between."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ready: dict[int, Automaton] = {}


def _forget() -> None:
    for automaton in _ready.values():
        automaton.forget()
    _ready.clear()


def _automaton(shipped, most: int) -> Automaton:
    """One automaton for each Python worker and vocabulary."""
    if id(shipped.value) not in _ready:
        _ready.clear()
        _ready[id(shipped.value)] = Automaton(shipped.value, most)
        text_tools.keeps("bpe", _forget)
    return _ready[id(shipped.value)]


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", decoded: bool = True) -> DataFrame:
    """``(key, ids binary, decoded string)`` of every row: the tokens as 32-bit integers and, if asked for, the text decoded from them.

    What a task kept is given back at its end: other operators may follow in the same workers.
    """
    if not decoded:
        return _mapped(docs, path, key, "ids binary", [pa.binary()], lambda automaton, ids: (ids,), small=True)
    return _mapped(docs, path, key, "ids binary, decoded string", [pa.binary(), pa.string()], lambda automaton, ids: (
        ids, automaton.decode(ids).encode("utf-8", "replace").decode()), small=True)


def token_digests(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Like ``tokenized``, but number of tokens and SHA-256 of both outputs, taken in the same task."""
    return _mapped(docs, path, key, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], lambda automaton, ids: (
        len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(automaton.decode(ids).encode("utf-8", "replace")).hexdigest()))


def _mapped(docs: DataFrame, path: str, key: str, schema: str, kinds: list[pa.DataType], result, small: bool = False) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(compiled(path))
    names = [key, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shipped, FEW if small else CACHED)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    rows = [result(automaton, automaton.encode(t)) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)
        finally:
            if small:
                _forget()
                text_tools.trimmed()

    rows = docs.select(F.col(key).alias("k"), F.col("text"))
    return rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {schema}")
