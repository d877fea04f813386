"""Quality rules by repetition coverage: how much of a text lies inside n-grams and lines that the text had before.

Words are numbered within their text; n-grams of several lengths get rolling hashes over these numbers in numpy. A longer
n-gram can only repeat where a shorter one does, so each length looks at the places left by the one before. Places of equal
hash are compared word by word with the first of them, so a collision never counts. Covered characters are those of words
that lie in an n-gram (or line) equal to an earlier one, each word once however many n-grams cover it.

Null text is a text without words: all counts zero, ``base_failed`` true (fewer than 50 words), not kept. Rows are judged each
for itself, so repeated rows get equal results and rows without doc_id theirs; other columns are not read. A text is held
whole; memory is in proportion to the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Characters counted as symbols, and the published shares (in hundredths of a text's characters) that
#: repeated n-grams of each length, and repeated lines, may cover.
SYMBOLS = b"#*$%&|<>"
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
LEAST_WORDS = 50
REPEAT_WORDS = 50  # hundredths of the words that may lie in 3-word windows found twice
WINDOW = 3
_BASE = U(0x9E3779B97F4A7C15)
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word (equal words, equal numbers, from 1) and its code points."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), U, len(words))
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in known), np.int64, len(known))
    return ids, chars[ids.astype(np.int64) - 1] if len(words) else chars


def rolled(ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of the n words from each place on."""
    h = ids[places]
    for k in range(1, n):
        h = h * _BASE + ids[places + k]
    return h


def repeats(ids: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places among ``places`` whose n-gram stands at another of them too, and whether an earlier one has it."""
    places = places[places + n <= len(ids)]
    if len(places) < 2:
        return places[:0], np.zeros(0, bool)
    h = rolled(ids, places, n)
    order = np.argsort(h, kind="stable")
    sorted_hash, at = h[order], places[order]
    fresh = np.r_[True, sorted_hash[1:] != sorted_hash[:-1]]
    first = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
    same = np.ones(len(at), bool)
    for k in range(n):
        same &= ids[at + k] == ids[first + k]
    if not same.all():  # two n-grams share a hash: classes by the words themselves
        _, kind = np.unique(ids[at[:, None] + np.arange(n)], axis=0, return_inverse=True)
        order = np.lexsort((at, kind.ravel()))
        at, kind = at[order], kind.ravel()[order]
        fresh = np.r_[True, kind[1:] != kind[:-1]]
    many = ~fresh | np.r_[~fresh[1:], False]
    found, later = at[many], ~fresh[many]
    order = np.argsort(found)
    return found[order], later[order]


def covered(places: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in an n-gram that starts at one of the places."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + n, -1)
    return np.cumsum(step[:-1]) > 0


def measured(text: str | None, lengths: tuple[int, ...] = tuple(LIMITS)) -> dict[str, int]:
    """All counts of one text: ``FIELDS``, ``chars_{n}`` for each n-gram length and ``line_chars``."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # bytes are split at space and 0x09-0x0D
    ids, chars = numbered(words)
    seen: set[bytes] = set()
    dup_lines = line_chars = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                dup_lines += 1
                line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            seen.add(line)
    places, _ = repeats(ids, np.arange(len(ids)), WINDOW)
    out = {"n_words": len(words), "word_chars": int(chars.sum()), "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
           "n_dup_lines": dup_lines, "n_repeat_words": int(covered(places, WINDOW, len(ids)).sum())}
    left = places
    for n in sorted(lengths):
        left, later = repeats(ids, left if n >= WINDOW else np.arange(len(ids)), n)
        out[f"chars_{n}"] = int(chars[covered(left[later], n, len(ids))].sum()) if later.any() else 0
    out["line_chars"] = line_chars
    return out


def judged(docs: DataFrame, limits: Mapping[int, int] = LIMITS, line_limit: int = LINE_LIMIT) -> DataFrame:
    """``doc_id``, the counts of ``measured``, ``base_failed`` and ``kept`` of every row.

    ``limits`` are the hundredths of a text's word characters that repeated n-grams of each length may cover.
    """
    lengths = tuple(sorted(limits))
    counts = [*FIELDS, *[f"chars_{n}" for n in lengths], "line_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(t.decode("utf-8", "replace") if t is not None else None, lengths) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[c] for r in rows], pa.int64()) for c in counts]], names=["doc_id", *counts])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    table = texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in counts))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_WORDS * F.col("n_words"))
    over = 100 * F.col("line_chars") > line_limit * F.col("word_chars")
    for n in lengths:
        over |= 100 * F.col(f"chars_{n}") > limits[n] * F.col("word_chars")
    return table.select("doc_id", *FIELDS, failed.alias("base_failed"), (~failed & ~over).alias("kept"), *counts[len(FIELDS):])
