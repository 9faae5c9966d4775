"""The queries that apply this subpackage's operators to the driver's tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, hard_negatives, licenses, line_dedup, media, packing, phrases, pii, quality, simhash, token_counts
from .base import read_table

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file on the driver; MNEMORA_TOKENIZERS names another folder."""
    if folder := os.environ.get("MNEMORA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(read_table(spark, sf_dir, "documents"), tokenizer(WORD_VOCABULARY))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer(BYTE_VOCABULARY)
    decoded = bpe.bpe_decode(bpe.bpe_encode(read_table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_column(read_table(spark, sf_dir, "documents")))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed shots of op5's files."""
    return media.clips(media.media_column(read_table(spark, sf_dir, "documents")))


#: Both turns of the conversation that op6 adds.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    digests = chat.conversation_digests(chat.format_conversations(turns.unionByName(added)))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("cleaned_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_report(token_counts.length_histogram(read_table(spark, sf_dir, "documents"), tokenizer(BYTE_VOCABULARY)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), 6).alias("containment"),
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.personal_data(read_table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(given.select("vec_id", "embedding", label.alias("label")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_simhash, op3_packing, op4_bpe, op5_media, op6_chat, op7_line_dedup, op8_quality, op9_token_counts, op10_license_scan, op11_pii, op12_hard_negatives, op13_phrases, media_clips,
    )
}

# DuckDB reads '\x20' in patterns as RE2 does.
_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, max(length(t)) AS longest FROM d GROUP BY norm),
k AS (SELECT d.norm, min(d.doc_id) AS keep_id FROM d JOIN g ON d.norm = g.norm AND length(d.t) = g.longest GROUP BY d.norm)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm) JOIN k USING (norm)
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
i AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3),
w AS (SELECT doc_id, i, array_to_string(ls[i:i + 2], chr(10)) AS w FROM i),
f AS (SELECT w, min(doc_id::HUGEINT * 10000000000 + i) AS place FROM w WHERE NOT regexp_full_match(w, '[\x20\x09-\x0D]*') GROUP BY w HAVING count(*) > 1),
l AS (SELECT DISTINCT w.doc_id, w.i + s.k AS line FROM w JOIN f USING (w) CROSS JOIN (VALUES (0), (1), (2)) s(k) WHERE w.doc_id::HUGEINT * 10000000000 + w.i > f.place),
r AS (SELECT doc_id, list(line) AS gone FROM l GROUP BY doc_id),
c AS (SELECT d.doc_id, len(d.ls) AS n, CASE WHEN r.gone IS NULL THEN d.ls ELSE list_transform(list_filter(range(1, len(d.ls) + 1), lambda x: NOT list_contains(r.gone, x)), lambda x: d.ls[x]) END AS ls
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n AS n_lines, n - len(ls) AS n_removed, length(array_to_string(ls, chr(10))) AS kept_chars, sha256(array_to_string(ls, chr(10))) AS cleaned_sha256 FROM c
"""

_OP6 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '[\\<"]', '\\\0', 'g')) + length(regexp_replace(text, '[\\<"]', '\\\0', 'g')) + 23 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


_OP12 = """
WITH e AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.place, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0
),
p AS (
  SELECT place, anchor_id, id, score, row_number() OVER (PARTITION BY place ORDER BY score DESC, id) AS k
  FROM s WHERE same AND id <> anchor_id QUALIFY k <= 5
),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.place, p.k ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.place = s.place AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

_OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM i CROSS JOIN (VALUES (1), (2), (3), (4), (5)) s(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
k AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
c AS (
  SELECT k.lang, k.m, k.phrase, k.a, x.a AS l, y.a AS r, n.n, ((1000 * k.a::HUGEINT * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM k JOIN n USING (lang)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1
),
o AS (
  SELECT * FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = c.lang AND q.m > c.m AND 100 * q.a >= 100 * c.a AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    """Exact containment in the same windows, of every template, without retrieval by MinHash."""
    given = sorted(licenses.TEMPLATES.items())
    long = [(name, licenses.span_of(text), licenses.template_shingles(text)) for name, text in given if licenses.template_shingles(text)]
    rows = ", ".join(f"({_sql_text(name)}, {span}, {len(s)}, [{', '.join(_sql_text(' '.join(x)) for x in s)}])" for name, span, s in long)
    short = ", ".join(f"({_sql_text(name)}, {_sql_text(' ' + ' '.join(licenses.words_of(text)) + ' ')})" for name, text in given if not licenses.template_shingles(text))
    return rf"""
WITH t(license, span, m, shingles) AS (VALUES {rows}),
z(license, words) AS (VALUES {short}),
s AS (SELECT license, span, m, unnest(shingles) AS shingle FROM t),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
p AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS shingle FROM i),
h AS (SELECT p.doc_id, p.pos, s.license, s.span, s.m, s.shingle FROM p JOIN s USING (shingle)),
w AS (SELECT doc_id, license, m, pos // span - k AS win, shingle FROM h CROSS JOIN (VALUES (0), (1), (2)) x(k) WHERE pos // span - k >= 0),
c AS (SELECT doc_id, license, win, count(DISTINCT shingle)::DOUBLE / any_value(m) AS share FROM w GROUP BY ALL),
b AS (SELECT doc_id, license, max(share) AS share FROM c GROUP BY ALL HAVING max(share) >= {licenses.CONTAINMENT}
  UNION ALL SELECT doc_id, license, 1.0 FROM d JOIN z ON contains(' ' || array_to_string(w, ' ') || ' ', z.words))
SELECT documents.doc_id, count(b.license) AS n_matches, coalesce(string_agg(b.license, ',' ORDER BY b.license), '') AS licenses, round(coalesce(max(b.share), 0), 6) AS containment
FROM documents LEFT JOIN b USING (doc_id) GROUP BY documents.doc_id
"""


ORACLE_SQL = {"op1_exact_dedup": _OP1, "op6_chat": _OP6, "op7_line_dedup": _OP7, "op10_license_scan": _license_sql(), "op12_hard_negatives": _OP12, "op13_phrases": _OP13}
