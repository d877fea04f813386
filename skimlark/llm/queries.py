"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimlark.llm import (
    alignment, bpe, chat, decontaminate, divergence, fingerprints, jaccard, language_model, passages, repetition, toxicity, urls, wrappers)
from skimlark.llm.frames import reader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = reader(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judged(reader(spark, sf_dir, "pages"), labels, HOST_RULES)


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = reader(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat.read_back(chat.formatted(chat.single_parts(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op5_chat_format"] = r"""
WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
marked AS (SELECT *, regexp_replace(text, '<(\\*)(/?(?:turn|image|audio|document|attachment))', '<\\\1\2', 'g') AS safe,
  regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)(/?(?:turn|image|audio|document|attachment))', '<\\\1\2', 'g') AS safe_role FROM own)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + length(safe_role) + 15)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""


@query
def op7_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(reader(spark, sf_dir, "documents"), vocabulary())


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(reader(spark, sf_dir, "documents"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(reader(spark, sf_dir, "pages"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(reader(spark, sf_dir, "documents"))


#: Words, and the distinct five-word shingles of each document.
SHINGLES_SQL = r"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))"""
ORACLES["op9_ngram_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, text FROM documents),
{SHINGLES_SQL.replace("FROM documents", "FROM d")},
sizes AS (SELECT d.doc_id, any_value(d.id) AS id, count(g.g) AS n FROM d LEFT JOIN grams g ON d.doc_id = g.doc_id GROUP BY d.doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN sizes p ON p.doc_id = x.doc_id
  JOIN sizes q ON q.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
  UNION SELECT x.doc_id, y.doc_id FROM sizes x JOIN sizes y ON x.id = y.id AND x.doc_id <> y.doc_id WHERE x.n > 0 AND y.n > 0),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.id AS doc_id, s.n AS n_shingles, min(o.id) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id JOIN sizes o ON o.doc_id = r.b
GROUP BY s.doc_id, s.id, s.n"""


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(reader(spark, sf_dir, "documents"), reader(spark, sf_dir, "benchmark"))


ORACLES["op1_decontamination"] = f"""
WITH {SHINGLES_SQL},
item_words AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
item_grams AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id)
SELECT d.doc_id, i.item_id, s.n AS n_item, count(*) AS n_shared, count(*) / s.n AS containment
FROM grams d JOIN item_grams i ON d.g = i.g JOIN sizes s ON s.item_id = i.item_id GROUP BY d.doc_id, i.item_id, s.n HAVING 100 * count(*) >= 75 * s.n"""


@query
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(reader(spark, sf_dir, "documents"))


def remainder(divisor: int):
    """crc32 of doc_id as text, modulo the divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(reader(spark, sf_dir, "documents"), remainder(7) != 2)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(reader(spark, sf_dir, "documents"), reader(spark, sf_dir, "labels"), remainder(4) != 2)


@query
def op11_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judged(reader(spark, sf_dir, "documents"))


def _repetition_sql() -> str:
    """Word windows as text, counted and numbered within their document; later ones cover their words."""
    lengths = sorted(repetition.LIMITS)
    windows = "\nUNION ALL ".join(
        f"SELECT doc_id, {n} AS n, i, list_aggregate(w[i:i+{n - 1}], 'string_agg', ' ') AS g FROM words, unnest(range(1, len(w) - {n - 2})) t(i) WHERE len(w) >= {n}"
        for n in (repetition.WINDOW, *lengths))
    covers = ", ".join(f"coalesce(sum(chars) FILTER (n = {n}), 0)::BIGINT AS chars_{n}" for n in lengths)
    over = " OR ".join(f"100 * coalesce(chars_{n}, 0) > {limit} * word_chars" for n, limit in sorted(repetition.LIMITS.items()))
    shown = ", ".join(f"coalesce(chars_{n}, 0)::BIGINT AS chars_{n}" for n in lengths)
    return rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS ({windows}),
marked AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS c, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS r FROM windows),
places AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM marked WHERE CASE WHEN n = {repetition.WINDOW} THEN c > 1 ELSE r > 1 END),
cover AS (SELECT p.doc_id, n, length(w[j]) AS chars FROM places p JOIN words USING (doc_id)),
covered AS (SELECT doc_id, count(*) FILTER (n = {repetition.WINDOW}) AS repeat_words, {covers} FROM cover GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
line_cover AS (SELECT doc_id, sum((c - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS line_chars
  FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) GROUP BY doc_id, line) GROUP BY doc_id),
facts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(repeat_words, 0)::BIGINT AS n_repeat_words, {shown}, coalesce(line_chars, 0)::BIGINT AS line_chars
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN line_cover USING (doc_id)),
judged AS (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_WORDS} * n_words AS base_failed,
  {over} OR 100 * line_chars > {repetition.LINE_LIMIT} * word_chars AS over FROM facts)
SELECT * EXCLUDE (over), NOT base_failed AND NOT over AS kept FROM judged"""


ORACLES["op11_repetition_rules"] = _repetition_sql()


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(reader(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(reader(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occurrences AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, v.term, v.n AS lang_n, coalesce(o.n, 0) AS n, sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
  count(*) OVER (PARTITION BY g.lang, g.source) AS v, sum(v.n) OVER (PARTITION BY g.lang, g.source) AS lang_total
  FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = v.term),
shares AS (SELECT lang, source, term, n, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // (total + v) AS p,
  1 + ({divergence.SCALE}::HUGEINT * (lang_n + 1)) // (lang_total + v) AS q FROM grid),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
QUALIFY part = 'pair' OR rank <= {divergence.RANKS}"""
