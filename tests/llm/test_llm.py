"""The training-data operators on small and awkward tables, against brute force, round trips and the tokenizers library."""

from __future__ import annotations

import collections
import hashlib
import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skimlark.llm import bpe, chat, decontaminate, fingerprints, jaccard, language_model, passages, text, toxicity, urls, wrappers
from skimlark.llm.queries import HOST_RULES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, rep string"


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and short texts, ties, repeated rows, extra columns that clash with inner names."""
    long = words(1, 300)
    edited = long.replace(long.split()[150], "other", 1)
    texts = [(0, long), (1, edited), (2, long), (3, None), (4, ""), (5, "a b"), (6, "A  b"), (7, words(2, 200)), (7, words(2, 200)), (8, words(3, 80) + " " + " ".join(long.split()[20:90])),
             (None, words(4, 60)), (9, words(5, 3000))]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", None) for i, t in texts], DOCS)


def similar(a: str | None, b: str | None) -> bool:
    x, y = set(text.shingles(a).tolist()), set(text.shingles(b).tolist())
    return bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)


def test_word_hashes_equal_exactly_for_equal_words():
    raw = text.lowered("Ab aB \x0bab ba")
    h = text.word_hashes(raw, *text.word_spans(raw))
    assert h[0] == h[1] == h[2] != h[3]
    assert len(text.shingles(None)) == 0 and len(text.shingles("x")) == 1 and len(text.shingles("a b c d e f")) == 2


def test_jaccard_components_match_brute_force(odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked(odd).collect()}
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i, t in rows:
        reach = {i} | {j for j, u in rows if j is not None and similar(t, u)}
        want = min((x for x in reach if x is not None), default=None)
        assert (i, len(text.shingle_set(t)), want) in got
    assert jaccard.linked(odd.where("false")).count() == 0


def test_jaccard_long_lists_link_near_copies(spark):
    base = words(9, 120).split()
    rows = [(i, " ".join(base[:i % 100] + [f"own{i}"] + base[i % 100 + 1:])) for i in range(120)]
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_jaccard_row_without_id_links_two_documents(spark):
    w = words(150, 200).split()
    rows = [(1, " ".join(w)), (None, " ".join([*w[:180], *words(151, 12).split()])), (2, " ".join([*w[:150], *words(151, 12).split()])), (3, words(152, 100))]
    assert similar(rows[0][1], rows[1][1]) and similar(rows[1][1], rows[2][1]) and not similar(rows[0][1], rows[2][1])
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, 1), (2, 1), (3, 3)}


def test_passages_find_copies_and_shared_passages(odd):
    got = [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in passages.repeated(odd).collect()]
    assert (2, 0, 0, 300) in got and (8, 0, 80, 150) in got
    assert {g[0] for g in got} == {1, 2, 8}
    assert passages.repeated(odd.where("false")).count() == 0


@pytest.mark.parametrize("turns", [0, 3])
def test_passages_of_long_lists_whose_first_documents_hold_parts_only(spark, monkeypatch, turns):
    monkeypatch.setattr(passages, "TURNS", turns)
    whole, other = words(60, 60).split(), words(61, 60).split()
    rows = [(0, " ".join([words(100, 50), *whole[:40], words(101, 50)])), (1, " ".join([words(102, 50), *whole[20:], words(103, 50)]))]
    rows += [(2, " ".join([words(104, 50), *other[:38], words(105, 50)]))]
    rows += [(10 + k, " ".join([words(200 + 2 * k, 60), *whole, words(201 + 2 * k, 60)])) for k in range(30)]
    rows += [(50 + k, " ".join([words(300 + 2 * k, 60), *other[:38], words(301 + 2 * k, 60)])) for k in range(30)]  # a line in common, no passage
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(range(11, 40)) <= set(got.doc_id) and not set(got.doc_id) & set(range(50, 90))
    here = got[got.doc_id.between(11, 39)]
    assert (here.start_word <= 62).all() and (here.end_word >= 118).all()


def test_passages_behind_a_repeated_line_and_with_an_edit_near_their_end():
    line, passage = words(70, 12), words(71, 60)
    x = " ".join([*(f"{line} {words(80 + k, 40)}" for k in range(7)), words(90, 30), passage.replace(passage.split()[30], line, 1), words(91, 30)])
    changed = passage.replace(passage.split()[30], line, 1)
    y = " ".join([words(92, 100), changed, words(93, 90), changed, words(94, 30)])
    own, other = text.shingles(x), text.shingles(y)
    first = 100
    anchor = (int(np.flatnonzero(own == other[first + 5])[0]), first + 5)
    spans = passages.shared_spans(own, other, [anchor])
    second = 100 + len(changed.split()) + 90
    assert any(low <= second + 5 and high >= second + 45 for low, high, _, _ in spans)
    whole = words(95, 50).split()
    for k in range(50):
        edited = [*whole[:k], "edited", *whole[k + 1 :]]
        x, y = text.shingles(" ".join([words(96, 80), *whole, words(97, 80)])), text.shingles(" ".join([words(98, 70), *edited, words(99, 70)]))
        at = [(80 + (35 if k < 25 else 5), 70 + (35 if k < 25 else 5))]
        assert passages.shared_spans(x, y, at), k


def test_decontamination_finds_items_in_long_documents(spark, odd):
    item = " ".join(words(5, 3000).split()[1000:1030])
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "a b", "x"), (4, words(77, 30), "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect())
    assert got == [(5, 3), (6, 3), (9, 1), (9, 1)]
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_decontamination_misses_no_short_item_in_long_documents():
    docs = [text.shingles(words(k, 2000)) for k in range(20)]
    items = [(100 * k + 10 * n + j, words(k, 2000).split()[97 * j + 3 :][: n + 4]) for k in range(20) for n in (1, 2, 8) for j in range(20)]
    index = decontaminate.Index([(i, text.shingle_set(" ".join(w))) for i, w in items])
    found = index.candidates(docs)
    for at, (i, wanted) in enumerate(index.items):
        for d, s in zip(docs, found, strict=True):
            if 100 * int(np.isin(wanted, d).sum()) >= decontaminate.CONTAINED * len(wanted):
                assert at in s, i


def test_bpe_equals_the_library_and_decodes(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    extra = spark.createDataFrame([(20, "It's <|endoftext|> ΣΑΣ İx don't\x85x 12 ½ aaaaaaaaaaaa </w> 中文😀")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").union(extra)
    for got, row in zip(bpe.tokenized(rows, vocabulary()).collect(), rows.collect(), strict=True):
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(got["ids"], "<u4").tolist() == ids
        assert got["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_fingerprints_edit_with_the_next_document(odd):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(fingerprints.fingerprints(odd, rows_per_bucket=3).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]))
    assert len(got) == len(rows)
    for k, r in enumerate(got):
        own, following = rows[k][1], rows[(k + 1) % len(rows)][1]
        half = len(own) // 2
        assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()
    by_text = {}
    for (_, t), r in zip(rows, got, strict=True):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    a, b = (fingerprints.Prefixes(fingerprints.points(t)) for t in ("xxabcdef", "abcdxy"))
    assert a.extension(2, b, 0) == 4 and a.equal(2, b, 0, 4) and not a.equal(2, b, 0, 5)
    assert fingerprints.fingerprints(odd.where("false")).count() == 0


def test_chat_round_trip_with_attachments(spark):
    rows = [(1, 0, "user", [("text", "a <turn> <\\turn> </turn>\n", None, None), ("image", None, "r1", 2.0), ("audio", None, None, None)]), (1, 1, "assistant", [("text", "<image 0/> ok", None, None)]),
            (None, None, None, None), (2, 5, "x\ny\\n<turn>", [("other", None, "q", -1.0)])]
    m = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = {r["conv_id"]: r for r in chat.read_back(chat.formatted(m)).collect()}
    assert out[1]["learned"] == ["<image 0/> ok"] and out[1]["expanded_tokens"] == 512
    assert [t["role"] for t in out[1]["turns"]] == ["user", "assistant"]
    assert out[2]["turns"][0]["role"] == "x\ny\\n<turn>" and out[2]["attachments"][0]["attachment"]["ref"] == "q"
    assert len(out[None]["turns"]) == 1


def test_urls_follow_the_longest_rule_and_mined_rules(spark):
    rows = [(1, "https://A.Example.net/en/x"), (2, "http://b.example.net/fr"), (3, "no url"), (4, None), (5, "http://x.org/fr/?a"), (6, "http://net"), (1, "https://A.Example.net/en/x")]
    rows += [(100 + i, f"http://spam{i % 2}.example.org/p/{i}") for i in range(40)] + [(200 + i, f"http://fine.example.org/p/{i}") for i in range(40)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(100 + i, True) for i in range(40)] + [(200 + i, False) for i in range(40)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judged(pages, labels, HOST_RULES).collect()}
    assert [got[k]["rule"] for k in (1, 2, 3, 4, 5, 6)] == ["example.net/en/", "net/", None, None, "org/fr/", None]
    assert [got[k]["verdict"] for k in (1, 2, 3, 4, 5)] == ["allow", "block", "allow", "allow", "allow"]
    assert all(got[100 + i]["verdict"] == "block" and got[200 + i]["verdict"] == "allow" for i in range(40))
    assert urls.judged(pages, labels.where("false"), HOST_RULES).where("verdict = 'block'").count() == 1
    assert urls.judged(pages, labels, HOST_RULES).count() == len(rows)


def test_wrappers_keep_the_article_only(spark):
    page = lambda a: f"<html><nav>Menu</nav><div class=ad>Buy</div><article><h1>T &amp; {a}</h1><p>One\n  {a}<br><p>Two<script>x</script></article><div class='comments'>no</div><footer>f</footer>"
    plain = lambda a: f"<body><div id=menu><a>Home</a></div><div><p>{a} first long text</p><p>same line</p></div><p>Imprint</p></body>"
    rows = [(1, "http://h/1", page("x")), (2, "http://h/2", page("y")), (3, "http://h/3", None), (4, None, ""), (1, "http://h/1", page("x")), (5, "http://k/1", plain("p")), (6, "http://k/2", plain("q"))]
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, n string")).collect()}
    assert got[1] == "T & x\nOne x\nTwo" and got[2] == "T & y\nOne y\nTwo" and got[3] == got[4] == ""
    assert got[5] == "p first long text\nsame line"


def test_wrappers_drop_blocks_constant_over_the_host_inside_the_article():
    body = lambda k, edit="": "".join(f"<p>{words(10 * k + j, 30)}{edit}</p>" for j in range(1 + k))
    page = lambda k, edit="": f"<body><article><h4>Reader service</h4>{body(k, edit)}<p>By <b>{words(k, 2)}</b></p><p>All rights reserved</p></article></body>"
    lines = lambda k, edit="": [words(10 * k + j, 30) + edit for j in range(1 + k)] + [f"By {words(k, 2)}"]
    assert [t.split("\n") for t in wrappers.main_texts([page(k) for k in range(4)])] == [lines(k) for k in range(4)]
    # copies and near copies of one page do not agree on its text, three pages that differ do
    near = wrappers.main_texts([page(2, e) for e in ("", "", " x", " y", " z")])
    assert [t.split("\n") for t in near] == [["Reader service", *lines(2, e), "All rights reserved"] for e in ("", "", " x", " y", " z")]
    mixed = wrappers.main_texts([page(2), page(2, " x"), page(2), page(1), page(3), None])
    assert [t.split("\n") for t in mixed] == [lines(2), lines(2, " x"), lines(2), lines(1), lines(3), [""]]
    # an article that is template is not the region
    note = lambda k: f"<body><article><p>Read our terms</p></article><div><p>{words(k, 40)}</p><p>{words(k + 50, 40)}</p></div></body>"
    assert wrappers.main_texts([note(k) for k in range(3)]) == [f"{words(k, 40)}\n{words(k + 50, 40)}" for k in range(3)]


def test_language_model_learns_and_counts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(("a b c d" if i % 2 else "e f g h").split()[k % 4] for k in range(int(rng.integers(20, 60))))) for i in range(400)] + [(900, None), (901, ""), (900, "zzz")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = language_model.scores(d, F.col("doc_id") % 7 != 2, share=1).toPandas()
    assert len(got) == len(rows)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert set(got[got.doc_id >= 900].n_tokens) == {1, 2}
    assert language_model.scores(d.where("false"), F.lit(True)).count() == 0


def test_language_model_trains_on_every_training_document(spark):
    rows = [(i, words(i, 5 + i % 40)) for i in range(300)]
    found = [language_model.tokens(t) for _, t in rows]
    every, counts = np.unique(np.concatenate(found), return_counts=True)
    vocabulary = language_model.Vocabulary(every, counts, int(counts.sum()), len(every), np.ones(language_model.TAILS))
    batches = [pd.DataFrame({"text": [t]}) for _, t in rows]
    gathered = list(language_model._gathered(iter(batches)))
    assert sum(len(x) for streams in gathered for x in streams) == counts.sum()
    assert sum(language_model.trained(language_model.fresh(), vocabulary, streams)[1] for streams in gathered) == counts.sum()
    few = spark.createDataFrame([(t,) for _, t in rows], "text string").repartition(60)  # about 125 tokens in a task
    assert any((language_model._averaged(few, language_model.fresh(), vocabulary)[k] != v).any() for k, v in language_model.fresh().items())
    assert inspect.signature(language_model.scores).parameters["share"].default == 1


def test_toxicity_ranks_planted_words(spark):
    rows = [(i, words(i, 60) + (" vile scum" if i % 3 == 0 else "") + " " + words(1000 + i, 40)) for i in range(300)] + [(900, None), (901, ""), (902, "scum")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    got = toxicity.scores(d, labels, F.col("doc_id") % 4 != 2).toPandas()
    held = got[got.held_out & (got.doc_id < 300)]
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert (held.predicted == (held.doc_id % 3 == 0)).mean() > 0.95
    assert toxicity.scores(d, labels.where("false"), F.lit(True)).toPandas().score.eq(0).all()


def test_pipeline_cuts_passages_by_word(odd):
    assert corpus_pipeline.shortened("a b  c\nd e", [(1, 3)]) == "a\nd e"
    spans = passages.repeated(odd).select("doc_id", "start_word", "end_word")
    left = {r["doc_id"]: r for r in corpus_pipeline.cut(odd, spans).where("doc_id in (1, 2, 8)").collect()}
    assert 2 not in left and left[8]["text"] == words(3, 80) and left[8]["n_chars"] == len(left[8]["text"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "passages", "benchmark", "tokens"]


@pytest.mark.parametrize("compared", [0, jaccard.COMPARED])
def test_jaccard_loose_group_takes_more_hubs_and_loses_no_link(spark, monkeypatch, compared):
    monkeypatch.setattr(jaccard, "COMPARED", compared)
    rng = np.random.default_rng(12)
    base = words(31, 200).split()
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(200, int(rng.integers(2, 10)), replace=False):
            own[at] = f"own{i}x{at}"
        rows.append((i, " ".join(own)))
    sets = [set(text.shingles(t).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(group))


def test_jaccard_bounds_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both, x, y = (rng.integers(1, 2**63, int(rng.integers(0, 300)), dtype=np.uint64) for _ in range(3))
        bits = jaccard.parity(np.concatenate([both, x])) ^ jaccard.parity(np.concatenate([both, y]))
        assert sum(int(b).bit_count() for b in bits.view(np.uint64)) <= len(x) + len(y)


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_steps_round_trip(n):
    for top in (2, 300, 2**20, 2**32):
        x = np.sort(np.random.default_rng(n).integers(0, top, n)).astype(np.uint32)
        assert (jaccard.unstepped(jaccard.steps(x)) == x).all() and len(jaccard.steps(x)) <= 5 * n


@pytest.mark.parametrize("longest, members", [(12, 128), (60, 3), (400, 128)])
def test_jaccard_components_of_short_and_medium_texts(spark, monkeypatch, longest, members):
    """Near copies of short to medium texts, a frequent line in a third of them: components equal brute force."""
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    rng = np.random.default_rng(longest)
    texts, line = [], " ".join(f"menu{i}" for i in range(8))
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10_000, rng.integers(1, longest))]
        for _ in range(rng.integers(1, 5)):
            copy = list(words)
            for at in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[at] = f"n{rng.integers(0, 100_000)}"
            texts.append(" ".join(copy) + (" " + line if rng.random() < 0.34 else ""))
    hot = [f"h{x}" for x in range(longest)]
    texts += [" ".join([*hot[:i], f"e{i}", *hot[i + 1 :]]) for i in range(min(longest, 80))]
    sets = [text.shingle_set(t) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    got = jaccard.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i in range(len(texts))}


def test_arcs_looked_up_by_spans_are_those_of_the_walk():
    tables = bpe.compiled(vocabulary())
    rng = np.random.default_rng(3)
    labels = [i for i, born in enumerate(tables["born"]) if born >= 0]
    pairs = [(tables["target"][u], v) for u, v in zip(rng.choice(labels, 20_000).tolist(), rng.choice(labels[:3000], 20_000).tolist(), strict=True)]
    walked = [bpe.allowed(tables, *p) for p in pairs]
    assert [bpe.has_arc(tables, *p) for p in pairs] == walked and 0 < sum(walked) < len(walked)


def test_workers_keep_nothing_after_tokens(spark):
    """The pipeline's last operator gives its caches back at the end of each task."""
    docs = spark.createDataFrame([(i, words(i, 50)) for i in range(80)], "doc_id long, text string").repartition(8)
    bpe.tokenized(docs, vocabulary()).write.format("noop").mode("overwrite").save()

    def kept(batches):
        for _ in batches:
            yield pd.DataFrame({"n": [sum(len(a) + len(a.arcs) for a in bpe._ready.values())]})

    found = [r["n"] for r in spark.range(0, 8, 1, 8).mapInPandas(kept, "n long").collect()]
    assert found == [0] * 8


def test_words_that_differ_in_marks_and_capitals_are_walked_once(monkeypatch):
    automaton, walked, word = bpe.Automaton(bpe.compiled(vocabulary())), [], bpe.Automaton.word
    monkeypatch.setattr(bpe.Automaton, "word", lambda self, w: (walked.append(w), word(self, w))[1])
    got = automaton.encode("lineitem Lineitem lineitem, (LINEITEM) lineitem")
    assert walked.count("lineitem") == 1
    assert got == b"".join(bpe.Automaton(automaton.tables).encode(w) for w in "lineitem Lineitem lineitem, (LINEITEM) lineitem".split())


def test_words_take_their_letters_as_they_are_only_if_printable():
    from tokenizers import Tokenizer

    library, automaton = Tokenizer.from_file(vocabulary()), bpe.Automaton(bpe.compiled(vocabulary()))
    for t in ("a\x7fb \x01\x02 ~!x", "naïve\xad x", "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(33, 0x250)))):
        assert np.frombuffer(automaton.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_pipeline_tokens_are_not_decoded(spark):
    """Its tasks hold and send no decoded texts, which are longer than the texts."""
    docs = spark.createDataFrame([(i, words(i, 50)) for i in range(1000)], "doc_id long, text string").coalesce(1)
    wanted = {r["doc_id"]: bytes(r["ids"]) for r in bpe.tokenized(docs, vocabulary()).collect()}
    got = corpus_pipeline.tokens(spark, docs, "")
    assert {r["doc_id"]: bytes(r["ids"]) for r in got.collect()} == wanted and all(r["n_tokens"] * 4 == len(r["ids"]) for r in got.collect())
    plain = bpe.tokenized(docs, vocabulary(), decoded=False)
    assert plain.columns == ["doc_id", "ids"]
    assert {r["doc_id"]: bytes(r["ids"]) for r in plain.collect()} == wanted


def test_tasks_of_the_pipeline_leave_workers_small(spark):
    """Tables that a task of passages or toxicity grew, which a later one would find beside its own, are given back at its end."""
    docs = spark.createDataFrame([(i, words(i % 8, 80), "en", "s", 1) for i in range(16)], "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, toxic int")

    def kept(batches):
        for _ in batches:
            yield pd.DataFrame({"n": [len(text._powers)]})

    left = lambda: {r["n"] for r in spark.range(0, 8, 1, 8).mapInPandas(kept, "n long").collect()}
    toxicity.scores(docs, labels, F.lit(True), carried=True).write.format("noop").mode("overwrite").save()
    assert left() == {0}
    passages.repeated(docs.select("doc_id", "text")).write.format("noop").mode("overwrite").save()
    assert left() == {0}


def test_groups_of_signatures_give_memory_back_and_small_steps_find_the_same(spark, monkeypatch):
    order = []
    monkeypatch.setattr(text, "trimmed", lambda: order.append("trimmed"))
    assert text.settled(lambda x: (order.append("run"), x)[1])(3) == 3 and order == ["run", "trimmed"]
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, f"{words(i, 90)} {words(100 + i % 5, 80)} {words(50 + i, 60)}") for i in range(30)], "doc_id long, text string")
    wanted = sorted(map(tuple, passages.repeated(docs).collect()))
    monkeypatch.setattr(passages, "AT_ONCE", 400)
    assert wanted and sorted(map(tuple, passages.repeated(docs).collect())) == wanted


def test_toxicity_starts_no_second_pool_of_workers(spark, monkeypatch):
    """Ids for the sample reach Spark as Arrow: local rows would pass Python workers beside those of the operators, and both pools stay."""
    docs = spark.createDataFrame([(i, words(i % 8, 80)) for i in range(16)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, toxic int")

    def refused(*args, **kwargs):
        raise AssertionError("local rows were sent as an RDD")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert toxicity.scores(docs, labels, F.lit(True)).count() == 16


@pytest.mark.parametrize("needed", [0, 1_000_000])
def test_last_search_of_passages_meets_the_same_places_by_either_join_with_one_worker_a_task(spark, monkeypatch, needed):
    docs = spark.createDataFrame([(i, f"{words(i % 7, 70)} {words(200, 30)} {words(60 + i % 3, 70)}") for i in range(40)], "doc_id long, text string")
    keys = spark.createDataFrame([(k, i, 66 + k) for i in range(40) for k in (0, 2)], "key long, doc long, place long")
    left = keys.where("doc % 3 = 1")
    monkeypatch.setattr(passages, "NEEDED", needed)
    pairs = passages.remaining_pairs(docs, left, keys)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas ") == 2 and ("BroadcastHashJoin [at" in plan) == (needed > 0)
    got = {tuple(r) for r in pairs.collect()}

    def rows(before, after, some):  # the rarest shingles of each place, as the documents that were left have them
        found = [tuple(r) for r in passages.contexts(docs, some, before, after).collect()]
        often = {g for g, n in collections.Counter(g for r in mine for g in r[4]).items() if n > passages.LIST}
        return {(r[0], g, r[1], r[2]) for r in found for g in sorted(r[4], key=lambda g: (g in often, g))[: max(0, len(r[4]) - r[3] + 1)]}

    mine = [tuple(r) for r in passages.contexts(docs, left, passages.WIDTH - passages.RUN, passages.WIDTH).collect()]
    b, a = rows(passages.WIDTH - passages.RUN, passages.WIDTH, left), rows(passages.WIDTH - 1, passages.RUN + passages.WIDTH, keys)
    held = collections.defaultdict(list)
    for k, g, doc, place in a:
        held[k, g].append((doc, place))
    wanted = {(i, doc, x, place) for k, g, doc, place in b for i, x in held[k, g] if i < doc}
    assert wanted and got == wanted
