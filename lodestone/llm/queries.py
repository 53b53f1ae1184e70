"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, decontaminate, html_cut, lines, packing, quality, setsketch, suffixes, token_counts, wavelet
from .common import new_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "wavelet-shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return wavelet.read_documents(spark, path)


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), width=lines.SHORT_WIDTH)
    return out.select("doc_id", "n_lines", "n_removed", "n_fuzzy", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shard_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_wavelet_tokens": op1_wavelet_tokens,
        "op2_quality_cascade": op2_quality_cascade,
        "op3_suffix_array": op3_suffix_array,
        "op4_decontaminate": op4_decontaminate,
        "op5_setsketch": op5_setsketch,
        "op6_token_counts": op6_token_counts,
        "op7_html_main_text": op7_html_main_text,
        "op8_bpe_automaton": op8_bpe_automaton,
        "op9_fuzzy_lines": op9_fuzzy_lines,
        "op10_vector_packing": op10_vector_packing,
    }


#: Statistics and verdict of op2 in SQL.
_QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
),
tri AS (
  SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n >= 2),
g AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS kinds FROM (SELECT doc_id, substr(text, i::BIGINT, 12) AS x FROM (SELECT doc_id, text, unnest(range(1, length(text) - 10)) AS i FROM d)) GROUP BY doc_id),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS al,
    length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, coalesce(g.n, 0) AS grams, coalesce(g.kinds, 0) AS gram_kinds
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
    OR word_chars > 12 * n_words OR 10 * n_dup_lines > 6 * greatest(n_lines, 1) OR 10 * up > 6 * greatest(al, 1) OR 10 * letters < 7 * word_chars OR 10 * gram_kinds < 6 * grams) AS kept
FROM s
"""


#: Decontamination in SQL: all windows of all documents against all windows of all items.
_DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, ws[s : s + least(13, len(ws)) - 1] AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)
),
dw AS (
  SELECT doc_id, s, k, ws[s : s + k - 1] AS w
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)
),
m AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN bw USING (w)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


#: Removal of repeated bytes in SQL: every string of 50 bytes of every document (as hexadecimal digits), and the smallest document it starts in.
_REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, i, substr(hx, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN m USING (s) WHERE doc_id > least),
b AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM c),
r AS (SELECT doc_id, span, min(i) AS lo, max(i) + 50 AS hi FROM b GROUP BY doc_id, span),
k AS (SELECT d.doc_id, coalesce(lag(hi) OVER x, 0) AS begin, lo AS until FROM r JOIN d USING (doc_id) WINDOW x AS (PARTITION BY d.doc_id ORDER BY lo)
  UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), length(hx) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, hx),
t AS (SELECT doc_id, string_agg(substr(hx, (2 * begin + 1)::BIGINT, (2 * (until - begin))::BIGINT), '' ORDER BY begin) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Near-duplicates in SQL: all pairs with a common shingle, and what can be reached over links.
_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_cascade": _QUALITY_SQL, "op3_suffix_array": _REPEATS_SQL, "op4_decontaminate": _DECONTAMINATE_SQL, "op5_setsketch": _NEAR_SQL}
