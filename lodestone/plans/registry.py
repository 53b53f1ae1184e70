"""The library's own operators as queries over the driver's tables, with SQL.

``conversations`` plays the indexed rows: a row's id is ``1000 * conv_id + turn``,
a conversation is a session, and projects and times are derived from it.
Prompts are the rows whose id is divisible by 100.  Scores and places are given
in whole millionths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import ACKNOWLEDGEMENTS, CATEGORIES, CORRECTIONS, ENVELOPES, INJECTED, STOP_WORDS, above_floor, classify_prompt, content_terms, is_noise, looks_like_correction
from ..functions.text import LOWER, UPPER, head_of_command, squeeze, stable_key, text_of, wikilinks, word_count
from ..operators import condense as logs
from ..operators import curate, evaluate, graph, recurrence, retrieve, search, sessions, vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rowid, text, asks, role, project, session, ts, file`` of the conversations."""
    c = table(spark, sf_dir, "conversations")
    two = lambda x: F.lpad((x + 1).cast("string"), 2, "0")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    ts = F.concat(F.lit("2026-"), two(F.col("conv_id") % 12), F.lit("-"), two(F.col("conv_id") % 28), F.lit("T"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("Z"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rowid"), "text", F.lit("").alias("asks"), "role", name("p", F.col("conv_id") % 7).alias("project"), name("s", F.col("conv_id")).alias("session"), ts.alias("ts"), name("f", F.col("conv_id")).alias("file"))


#: What the stand-in conversations lack, by ``rowid % 23``: a text put before the row's own, or (with False) in its place.
SPLICES = (
    (1, "<system-reminder> ", True), (2, "No, that's wrong: ", True), (3, "From now on ", True), (4, "We decided to ", True), (5, "I think the fix is ", True),
    (6, "See https://example.org/x ", True), (7, "**OK!**", False), (8, " \t ", False), (9, "three words only", False), (10, "x", False), (11, "hook success: ", True),
)


def spoken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with envelopes, corrections, preferences and acknowledgements spliced in."""
    text = F.col("text")
    for k, piece, before in SPLICES:
        text = F.when(F.col("rowid") % 23 == k, F.concat(F.lit(piece), text_of("text")) if before else F.lit(piece)).otherwise(text)
    return memory_rows(spark, sf_dir).withColumn("text", text)


def asked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows, and a third of them asked again later in another session, with two more words."""
    asks = memory_rows(spark, sf_dir).where(F.col("role") == "user").select("rowid", "text", "session", "ts")
    again = asks.where(F.col("rowid") % 3 == 0).select((F.col("rowid") + 1_000_000_000).alias("rowid"), F.concat(text_of("text"), F.lit(" once more")).alias("text"), F.concat(F.lit("r"), "session").alias("session"), F.concat(F.lit("3"), "ts").alias("ts"))
    return asks.unionByName(again)


_INDEXES: dict[tuple, search.Index] = {}


def index_of(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("text",), tokenizer: str = "simple") -> search.Index:
    """The lane's index, staged once for a session and read by all its queries."""
    key = (spark.sparkContext.applicationId, sf_dir, columns, tokenizer)
    if key not in _INDEXES:
        rows = memory_rows(spark, sf_dir).withColumn("asks", F.when(F.col("rowid") % 3 == 0, F.substring(text_of("text"), 1, 40)).otherwise(F.lit("")))
        _INDEXES[key] = search.build_index(rows, columns, tokenizer).stage()
    return _INDEXES[key]


def gists(rows: DataFrame) -> DataFrame:
    """A stand-in for verdicts: the first words of assistant rows with an even turn."""
    return rows.where((F.col("role") == "assistant") & (F.col("rowid") % 2 == 1)).groupBy(stable_key("session", "ts", "role", "text").alias("key")).agg(F.max(squeeze("text", 60)).alias("gist"))


def micro(c: Column) -> Column:
    return F.round(c * 1_000_000).cast("bigint")


_ROWS = """rows_ AS (SELECT conv_id * 1000 + turn AS rowid, text, role, 'p' || (conv_id % 7) AS project, 's' || conv_id AS session,
  '2026-' || lpad((conv_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || 'T' || lpad(turn::VARCHAR, 6, '0') || 'Z' AS ts,
  'f' || conv_id AS file FROM conversations)"""
_TOKENS = r"""toks AS (SELECT rowid, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ts FROM rows_),
dls AS (SELECT rowid, len(ts) AS dl FROM toks), totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)"""
_BM25 = "greatest(ln((n - df + 0.5) / (df + 0.5)), 0) + CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE 0 END"


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _has(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q([n])})" for n in needles) + ")"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


def _squeeze(x: str, most: int) -> str:
    flat = rf"trim(regexp_replace(coalesce({x}, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"
    return f"CASE WHEN strlen({flat}) <= {most} THEN {flat} ELSE left({flat}, list_max(list_filter(range(0, {most + 1}), lambda k: strlen(left({flat}, k::INT)) <= {most}))::INT) || '…' END"


def _folded(x: str) -> str:
    return _low(f"regexp_replace(coalesce({x}, ''), '[''’]', '', 'g')")


def _noise(x: str) -> str:
    t = _trim(f"coalesce({x}, '')")
    starts = " OR ".join(f"starts_with({t}, {_q([e])})" for e in ENVELOPES)
    bare = _folded(f"regexp_replace({t}, '^[^A-Za-z0-9/]+|[^A-Za-z0-9/]+$', '', 'g')")
    return f"({t} = '' OR {starts} OR {_has(t, INJECTED)} OR {bare} IN ({_q(ACKNOWLEDGEMENTS)}))"


def _key(p: str = "") -> str:
    return f"coalesce({p}session, '') || '|' || coalesce({p}ts, '') || '|' || coalesce({p}role, '') || '|' || left(coalesce({p}text, ''), 64)"


_TERMS = f"""list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: {_low('x')}),
  lambda x: strlen(x) >= 3 AND NOT list_contains([{_q(STOP_WORDS)}], x))"""
_DISTINCT_TERMS = f"(SELECT rowid, list(t ORDER BY i)[1:12] AS terms FROM (SELECT rowid, t, min(i) AS i FROM (SELECT rowid, unnest({_TERMS}) AS t, generate_subscripts({_TERMS}, 1) AS i FROM rows_) GROUP BY rowid, t) GROUP BY rowid)"


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all rows: every term has to occur; all matches with their scores."""
    return search.match(index_of(spark, sf_dir), ["the", "of", "that"]).select("rowid", micro(F.col("score")).alias("score_micro"))


_KEYWORD = f"""WITH {_ROWS}, {_TOKENS},
tf AS (SELECT rowid, t AS term, count(*) AS tf FROM (SELECT rowid, unnest(ts) AS t FROM toks) WHERE t IN ('the', 'of', 'that') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT rowid, round(sum(({_BM25}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 1000000)::BIGINT AS score_micro
FROM tf JOIN df USING (term) JOIN dls USING (rowid), totals GROUP BY rowid HAVING count(*) = 3"""


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed search: the best 60, then a project filter, then twelve lines."""
    rows = memory_rows(spark, sf_dir)
    return search.search(index_of(spark, sf_dir), rows, ["the", "of"], gists=gists(rows), project="P3", limit=12).select("rowid", "line")


def _scored(terms: list[str]) -> str:
    return f"""tf AS (SELECT rowid, t AS term, count(*) AS tf FROM (SELECT rowid, unnest(ts) AS t FROM toks) WHERE t IN ({_q(terms)}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT rowid, sum(({_BM25}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN df USING (term) JOIN dls USING (rowid), totals GROUP BY rowid HAVING count(*) = {len(terms)})"""


_GISTS = f"g AS (SELECT {_key()} AS key, max({_squeeze('text', 60)}) AS gist FROM rows_ WHERE role = 'assistant' AND rowid % 2 = 1 GROUP BY ALL)"


def _padded(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) < {n} THEN rpad({x}, {n}, ' ') ELSE {x} END"


_LINES = f"""WITH {_ROWS}, {_TOKENS}, {_scored(["the", "of"])}, {_GISTS},
c AS (SELECT * FROM s ORDER BY s DESC, rowid LIMIT 60),
f AS (SELECT rowid, s, left(ts, 10) || ' ' || {_padded('role', 9)} || ' ' || {_padded('project', 14)} || ' ' || left(session, 8) || ' | ' || {_squeeze("coalesce(nullif(gist, ''), left(coalesce(text, ''), 170))", 170)} AS line
  FROM c JOIN rows_ r USING (rowid) LEFT JOIN g ON g.key = {_key('r.')} WHERE contains(project, 'p3') ORDER BY s DESC, rowid LIMIT 12)
SELECT rowid, line FROM f"""


def batch_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every prompt the five best rows by BM25 over any of its content terms, all of them."""
    rows = memory_rows(spark, sf_dir)
    asked = rows.where(F.col("rowid") % 100 == 0).select(F.col("rowid").alias("qid"), F.explode(content_terms("text", None)).alias("term"))
    return search.ranked_batch(index_of(spark, sf_dir), asked, 5).select("qid", F.col("rank").cast("bigint").alias("rank"), micro(F.col("score")).alias("score_micro"))


_BATCH = f"""WITH {_ROWS}, {_TOKENS},
asked AS (SELECT rowid AS qid, unnest(terms) AS term FROM {_DISTINCT_TERMS.replace("[1:12]", "")} WHERE rowid % 100 = 0),
tf AS (SELECT rowid, t AS term, count(*) AS tf FROM (SELECT rowid, unnest(ts) AS t FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, rowid, sum(({_BM25}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN tf ON tf.term = lower(asked.term) JOIN df ON df.term = tf.term JOIN dls USING (rowid), totals GROUP BY ALL)
SELECT qid, rank, round(score * 1000000)::BIGINT AS score_micro FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) - 1 AS rank FROM s) WHERE rank < 5"""


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many rows every term occurs that a prompt asks for."""
    rows = memory_rows(spark, sf_dir)
    asked = rows.where(F.col("rowid") % 100 == 0).select(F.explode(content_terms("text")).alias("term")).distinct()
    return search.document_frequency(index_of(spark, sf_dir), asked)


_DF = f"""WITH {_ROWS}, {_TOKENS},
asked AS (SELECT DISTINCT unnest(terms) AS term FROM {_DISTINCT_TERMS} WHERE rowid % 100 = 0)
SELECT asked.term, count(DISTINCT rowid) AS df FROM (SELECT rowid, unnest(ts) AS token FROM toks) JOIN asked ON token = lower(asked.term) GROUP BY asked.term"""


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many rows every term of the index occurs: all terms of all rows."""
    return index_of(spark, sf_dir).postings.groupBy(F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("df"))


_ALL_DF = f"WITH {_ROWS}, {_TOKENS} SELECT term, count(DISTINCT rowid) AS df FROM (SELECT rowid, unnest(ts) AS term FROM toks) GROUP BY term"


def gated_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates for all prompts, their own session left out."""
    rows = memory_rows(spark, sf_dir)
    asked = rows.where(F.col("rowid") % 100 == 0).select(F.col("rowid").alias("qid"), F.col("text").alias("prompt"), F.col("session").alias("exclude"))
    return retrieve.retrieve(index_of(spark, sf_dir), rows, asked, 3, gists=gists(rows)).select("qid", "rowid", "rank", "line")


def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_rows(spark, sf_dir)
    return evaluate.recall_at_k(index_of(spark, sf_dir), rows)


def _gated(prompts: str) -> str:
    """Common table expressions from ``prompts`` (``qid, prompt, exclude``) to ``hits`` (``qid, rowid, rank, line``)."""
    terms = _TERMS.replace("coalesce(text, '')", "coalesce(prompt, '')")
    low, echo = _low("head"), lambda x: _squeeze(_low(x), 400)
    return f"""prompts AS MATERIALIZED ({prompts}),
given AS (SELECT qid, list(t ORDER BY i)[1:12] AS terms FROM (SELECT qid, t, min(i) AS i FROM (SELECT qid, unnest({terms}) AS t, generate_subscripts({terms}, 1) AS i FROM prompts WHERE NOT {_noise('prompt')}) GROUP BY qid, t) GROUP BY qid HAVING count(*) >= 2),
tf AS MATERIALIZED (SELECT rowid, t AS term, count(*) AS tf FROM (SELECT rowid, unnest(ts) AS t FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
rare AS (SELECT qid, list(e.term ORDER BY i) AS terms FROM (SELECT qid, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM given) e LEFT JOIN df ON df.term = lower(e.term), totals
  WHERE n < 200 OR df <= greatest(5, floor(n * 6 / 100)) GROUP BY qid HAVING count(*) >= 2),
s AS (SELECT qid, rowid, sum(({_BM25}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT qid, unnest(terms) AS term FROM rare) a JOIN df ON df.term = lower(a.term) JOIN tf ON tf.term = df.term JOIN dls USING (rowid), totals GROUP BY ALL),
c AS (SELECT qid, rowid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS r FROM s QUALIFY r <= 40),
found AS (SELECT qid, rowid, r, rows_.ts, role, project, session, left(coalesce(text, ''), 400) AS head, {_key('rows_.')} AS key, prompt, exclude, terms FROM c JOIN rows_ USING (rowid) JOIN rare USING (qid) JOIN prompts USING (qid)),
{_GISTS},
hits AS (SELECT qid, rowid, row_number() OVER (PARTITION BY qid ORDER BY r)::INT AS rank, left(ts, 10) || ' ' || role || '/' || project || ': ' || {_squeeze("coalesce(nullif(gist, ''), head)", 160)} AS line
  FROM found LEFT JOIN g USING (key)
  WHERE (exclude = '' OR session <> exclude) AND len(list_filter(terms, lambda t: contains({low}, t))) >= 2
    AND NOT (strlen({echo('prompt')}) >= 25 AND (contains({echo('head')}, {echo('prompt')}) OR contains({echo('prompt')}, {echo('head')}))) QUALIFY rank <= 3)"""


_GATED = f"""WITH {_ROWS}, {_TOKENS}, {_gated("SELECT rowid AS qid, text AS prompt, session AS exclude FROM rows_ WHERE rowid % 100 = 0")} SELECT qid, rowid, rank, line FROM hits"""


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.qa_pairs(memory_rows(spark, sf_dir)).select("qid", F.octet_length("question").cast("bigint").alias("question_bytes"), "session", "answer_rowid")


_QA = f"""WITH {_ROWS},
t AS (SELECT rowid, role, session, coalesce(text, '') AS text, lag(role) OVER w AS before, lag(coalesce(text, '')) OVER w AS question
  FROM rows_ WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session ORDER BY ts, rowid))
SELECT rowid AS qid, strlen(question)::BIGINT AS question_bytes, session, rowid AS answer_rowid FROM t
WHERE role = 'assistant' AND before = 'user' AND strlen(text) >= 80 AND strlen(question) >= 20 AND NOT {_noise('question')}"""


_RECALL = f"""WITH {_ROWS}, {_TOKENS},
talk AS (SELECT rowid, role, session, ts, coalesce(text, '') AS text, lag(role) OVER w AS before, lag(coalesce(text, '')) OVER w AS question
  FROM rows_ WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session ORDER BY ts, rowid)),
pairs AS MATERIALIZED (SELECT rowid, question, session, ts FROM talk WHERE role = 'assistant' AND before = 'user' AND strlen(text) >= 80 AND strlen(question) >= 20 AND NOT {_noise('question')}),
sample AS (SELECT rowid, question FROM (SELECT *, row_number() OVER (ORDER BY session, ts, rowid) - 1 AS i, count(*) OVER () AS n FROM pairs) WHERE i % greatest(ceil(n / 400), 1)::BIGINT = 0),
{_gated("SELECT rowid AS qid, question AS prompt, '' AS exclude FROM sample")},
m AS (SELECT count(*) AS fired, count(hit) AS hit_at_k, count(*) FILTER (hit = 1) AS hit_at_1 FROM (SELECT qid, min(rank) FILTER (rowid = qid) AS hit FROM hits GROUP BY qid)),
z AS (SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM sample) AS sampled, fired, hit_at_k, hit_at_1 FROM m)
SELECT *, CASE WHEN sampled > 0 THEN 100.0::DOUBLE * fired / sampled ELSE 0 END AS fired_pct, CASE WHEN sampled > 0 THEN 100.0::DOUBLE * hit_at_k / sampled ELSE 0 END AS recall_k_pct,
  CASE WHEN sampled > 0 THEN 100.0::DOUBLE * hit_at_1 / sampled ELSE 0 END AS recall_1_pct FROM z"""


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ten nearest neighbours of every vector whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding")
    q = v.where(F.col("rowid") % 100 == 0).select(F.col("rowid").alias("qid"), F.col("embedding").alias("query"))
    return vectors.knn(v, q, 10).select("qid", F.col("rank").cast("bigint").alias("rank"), micro(F.col("distance")).alias("distance_micro"))


_KNN = """WITH p AS (SELECT q.vec_id AS qid, v.vec_id AS rowid, sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT qid, rank, round(d * 1000000)::BIGINT AS distance_micro FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rowid) - 1 AS rank FROM p) WHERE rank < 10"""


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword ranks fused with a second ranking (longest rows first), which only re-ranks."""
    rows = memory_rows(spark, sf_dir)
    one = search.top(search.match(index_of(spark, sf_dir), ["the", "of"]))
    two = search.top(rows.select("rowid", F.char_length(text_of("text")).cast("double").alias("score")))
    return vectors.fuse(one, two).select("rowid", micro(F.col("score")).alias("score_micro"))


_FUSE = f"""WITH {_ROWS}, {_TOKENS},
tf AS (SELECT rowid, t AS term, count(*) AS tf FROM (SELECT rowid, unnest(ts) AS t FROM toks) WHERE t IN ('the', 'of') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
k AS (SELECT rowid, sum(({_BM25}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN df USING (term) JOIN dls USING (rowid), totals GROUP BY rowid HAVING count(*) = 2),
a AS (SELECT rowid, row_number() OVER (ORDER BY s DESC, rowid) - 1 AS r FROM k QUALIFY r < 60),
b AS (SELECT rowid, row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, rowid) - 1 AS r FROM rows_ QUALIFY r < 60)
SELECT a.rowid, round((1.0::DOUBLE / (60 + a.r) + coalesce(1.0::DOUBLE / (60 + b.r), 0)) * 1000000)::BIGINT AS score_micro FROM a LEFT JOIN b USING (rowid)"""


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise, correction, category and signal floor of every row."""
    return spoken_rows(spark, sf_dir).select("rowid", is_noise("text").alias("noise"), looks_like_correction("text").alias("correction"), classify_prompt("text").alias("category"), above_floor("role", "text").alias("above_floor"))


_PADDED = "(' ' || " + _low("coalesce(text, '')") + " || ' ')"
_WORDS = rf"CASE WHEN {_trim('coalesce(text, $$$$)')} = '' THEN 0 ELSE len(regexp_split_to_array({_trim('coalesce(text, $$$$)')}, '[ \t\n\r\f\v]+')) END".replace("$$$$", "''")
_SPOKEN = "(SELECT rowid, role, CASE rowid % 23 " + " ".join(f"WHEN {k} THEN {_q([piece])}" + " || coalesce(text, '')" * before for k, piece, before in SPLICES) + " ELSE text END AS text FROM rows_)"
_PREDICATES = f"""WITH {_ROWS}
SELECT rowid, {_noise('text')} AS noise, {_has(_folded('text'), CORRECTIONS)} AS correction,
  CASE WHEN {_has(_folded('text'), CORRECTIONS)} THEN 'correction' {' '.join(f"WHEN {_has(_PADDED, ps)} THEN '{name}'" for name, ps in CATEGORIES)} END AS category,
  length({_trim("coalesce(text, '')")}) >= 4 AND (role <> 'assistant' OR length({_trim("coalesce(text, '')")}) >= 80) AND (role <> 'user' OR {_WORDS} >= 4) AS above_floor
FROM {_SPOKEN}"""


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions on every document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(squeeze("text", 100), 256).alias("squeezed"), word_count("text").cast("bigint").alias("words"), F.sha2(head_of_command("text"), 256).alias("command"), F.size(wikilinks(F.replace("text", F.lit("The "), F.lit("[[ The ]] [[]] ")))).cast("bigint").alias("links"))


_SCALARS = rf"""SELECT doc_id, sha256({_squeeze('text', 100)}) AS squeezed, ({_WORDS})::BIGINT AS words,
  sha256({_squeeze("list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\n;]'), lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+', '')), lambda x: x <> '' AND NOT starts_with(x, '#'))[1]", 48)}) AS command,
  len(list_filter(list_transform(regexp_extract_all(replace(coalesce(text, ''), 'The ', '[[ The ]] [[]] '), '(?s)\[\[(.*?)\]\]', 1), lambda x: trim(x)), lambda x: strlen(x) BETWEEN 1 AND 99))::BIGINT AS links FROM documents"""


def content_term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_rows(spark, sf_dir).select("rowid", F.array_join(content_terms("text"), " ").alias("terms"))


_TERM_LISTS = f"WITH {_ROWS} SELECT r.rowid, coalesce(array_to_string(terms, ' '), '') AS terms FROM rows_ r LEFT JOIN {_DISTINCT_TERMS} t USING (rowid)"


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rollup(memory_rows(spark, sf_dir))


_ROLLUP = f"WITH {_ROWS} SELECT session, min_by(project, rowid) AS project, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n_rows FROM rows_ WHERE role IN ('user', 'assistant', 'system') GROUP BY session HAVING count(*) >= 5"


def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all sessions under a budget that cuts the longer ones."""
    return sessions.digests(memory_rows(spark, sf_dir), cap=900).select("session", F.sha2("digest", 256).alias("digest_sha256"))


def _digest_of(rows: str, cap: int = 900) -> str:
    """``session, digest`` as SQL."""
    return f"""WITH l AS (SELECT session, role || ': ' || {_squeeze("left(coalesce(text, ''), 300)", 300)} AS line, row_number() OVER (PARTITION BY session ORDER BY ts, rowid) - 1 AS i FROM {rows} WHERE role IN ('user', 'assistant', 'system')),
b AS (SELECT *, strlen(line) + 1 AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY session) AS total, sum(CASE WHEN i < 2 THEN n ELSE 0 END) OVER (PARTITION BY session) AS head, sum(n) OVER (PARTITION BY session ORDER BY i DESC) AS rest FROM b),
k AS (SELECT *, total <= {cap} OR i < 2 OR head + rest <= {cap} AS keep FROM c)
SELECT session, coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (i < 2), '') ||
  CASE WHEN count(*) FILTER (NOT keep) > 0 THEN '[... ' || count(*) FILTER (NOT keep) || ' turns omitted ...]' || chr(10) ELSE '' END ||
  coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (i >= 2 AND keep), '') AS digest FROM k GROUP BY session"""


_DIGESTS = f"WITH {_ROWS} SELECT session, sha256(digest) AS digest_sha256 FROM ({_digest_of('rows_')})"


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.role_counts(memory_rows(spark, sf_dir))


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.project_rollup(memory_rows(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_rows(spark, sf_dir)
    return sessions.stats(rows, gists(rows))


_STATS = f"""WITH {_ROWS}, g AS (SELECT DISTINCT {_key()} AS key FROM rows_ WHERE role = 'assistant' AND rowid % 2 = 1 AND {_trim("coalesce(text, '')")} <> '')
SELECT count(*) AS n_rows, count(DISTINCT session) FILTER (role IN ('user', 'assistant', 'system')) AS sessions, count(DISTINCT file) AS files, count(*) FILTER (role IN ('memory', 'wiki')) AS notes,
  (SELECT count(*) FROM g) AS gists, count(*) FILTER (role IN ('memory', 'wiki')) + (SELECT count(*) FROM g) AS knowledge FROM rows_"""


def newest_gists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_rows(spark, sf_dir)
    return sessions.newest_gists(rows, gists(rows))


_NEWEST = f"""WITH {_ROWS}, {_GISTS},
t AS (SELECT *, {_key()} AS key, row_number() OVER (PARTITION BY project ORDER BY ts DESC, rowid DESC) AS i FROM rows_ WHERE role IN ('assistant', 'user') QUALIFY i <= 36),
k AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY i)::INT AS nth, left(ts, 10) || ' ' || {_squeeze('gist', 160)} AS line FROM t JOIN g USING (key) WHERE strlen(gist) >= 20 AND NOT starts_with(coalesce(text, ''), '# Learning inbox'))
SELECT project, nth, line FROM k WHERE nth <= 3"""


def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each key, with two sessions known and one project forgotten."""
    rows = memory_rows(spark, sf_dir)
    key = stable_key("session", "ts", "role", "text").alias("key")
    return curate.new_rows(rows, rows.where(F.col("session").isin("s1", "s2")).select(key), rows.where(F.col("project") == "p3").select(key)).select("rowid", F.sha2("key", 256).alias("key_sha256"))


_DEDUPE = f"WITH {_ROWS}, k AS (SELECT *, {_key()} AS key FROM rows_) SELECT min(rowid) AS rowid, sha256(key) AS key_sha256 FROM k WHERE session NOT IN ('s1', 's2') AND project <> 'p3' GROUP BY key"


def recurring_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group (founding row) of every ask of five tokens or more."""
    return recurrence.group_asks(asked_rows(spark, sf_dir))


def similar_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other distinct asks each one resembles."""
    return _links(asked_rows(spark, sf_dir))


def _links(rows: DataFrame) -> DataFrame:
    """``id, n_links`` of the distinct token sets of ``rowid, text`` that resemble another."""
    asks = rows.select(recurrence.ask_tokens("text").alias("tokens"), "rowid")
    sets = asks.where(F.size("tokens") >= recurrence.MIN_TOKENS).groupBy("tokens").agg(F.min("rowid").alias("id")).select("id", "tokens")
    pairs = recurrence.similar_sets(sets)
    both = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))


def _sets(asks: str) -> str:
    """Common table expressions from ``asks`` (``rowid, text, ts``) to pairs ``p`` of distinct token sets ``o``, numbered in order of time."""
    return f"""asks AS ({asks}),
t AS MATERIALIZED (SELECT rowid, ts, list_sort(list_distinct(regexp_extract_all({_low("coalesce(text, '')")}, '[a-z0-9]{{2,}}'))) AS toks FROM asks),
o AS MATERIALIZED (SELECT toks, len(toks) AS n, min_by(rowid, (ts, rowid)) AS id, min(rowid) AS least, row_number() OVER (ORDER BY min((ts, rowid))) AS i FROM t WHERE len(toks) >= 5 GROUP BY toks),
k AS (SELECT i, n, unnest(toks) AS token FROM o),
p AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM k a JOIN k b USING (token) WHERE a.i < b.i GROUP BY a.i, b.i, a.n, b.n HAVING 100 * count(*) >= 60 * (a.n + b.n - count(*)))"""


def _recurring(asks: str) -> str:
    """First-fit grouping in order of time: a set founds a group unless a founder before it resembles it."""
    return f"""WITH RECURSIVE {_ROWS}, {_sets(asks)},
l AS MATERIALIZED (SELECT b, list(a) AS near FROM p GROUP BY b),
f AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS founders UNION ALL
  SELECT f.i + 1, CASE WHEN near IS NOT NULL AND list_has_any(founders, near) THEN founders ELSE list_append(founders, f.i + 1) END FROM f LEFT JOIN l ON l.b = f.i + 1 WHERE f.i < (SELECT count(*) FROM o)),
d AS (SELECT unnest(founders) AS i FROM f WHERE i = (SELECT count(*) FROM o)),
h AS (SELECT o.toks, coalesce(min(p.a) FILTER (p.a IN (SELECT i FROM d)), o.i) AS home FROM o LEFT JOIN p ON p.b = o.i AND o.i NOT IN (SELECT i FROM d) GROUP BY o.toks, o.i)
SELECT t.rowid, o.id AS founder FROM t JOIN h USING (toks) JOIN o ON o.i = h.home"""


_ASKED = """SELECT rowid, text, ts FROM rows_ WHERE role = 'user' UNION ALL SELECT rowid + 1000000000, coalesce(text, '') || ' once more', '3' || ts FROM rows_ WHERE role = 'user' AND rowid % 3 = 0"""
_DOCUMENT_ASKS = "SELECT doc_id AS rowid, text, lpad(doc_id::VARCHAR, 20, '0') AS ts FROM documents"


def _similar(asks: str) -> str:
    return f"WITH {_ROWS}, {_sets(asks)}, e AS (SELECT a AS i FROM p UNION ALL SELECT b FROM p) SELECT least AS id, count(*) AS n_links FROM e JOIN o USING (i) GROUP BY ALL"


def _documents_as_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an ask: its source is the session, its id stands for the time."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rowid"), "text", F.col("source").alias("session"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("ts"))


def recurring_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group (founding document) of every document of five tokens or more."""
    return recurrence.group_asks(_documents_as_asks(spark, sf_dir))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other distinct documents each one resembles."""
    return _links(_documents_as_asks(spark, sf_dir))


#: Words of the stand-in logs that flag a line, as none of the real needles occurs in them.
LOG_NEEDLES = (*logs.NEEDLES, "hewh", "onsh", "reble", "chsch")


def log_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken as a log: a line a sentence, lines that begin with A to M indented."""
    lines = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(lines, "\n([A-M])", "\n  $1").alias("body"))


def condensed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs condensed: edges, flagged lines, what hangs on them, and marks for what is left out."""
    out = logs.condense(log_bodies(spark, sf_dir), needles=LOG_NEEDLES)
    return out.select("doc_id", "elided", "flagged", "grew", F.sha2(text_of("text"), 256).alias("text_sha256"))


_LOGS = r"regexp_replace(replace(coalesce(text, ''), '. ', '.' || chr(10)), '\n([A-M])', chr(10) || '  \1', 'g')"
_CONDENSED = f"""WITH d AS (SELECT doc_id, {_LOGS} AS body, string_split({_LOGS}, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, body, CASE WHEN ls[-1] = '' THEN ls[1:-2] ELSE ls END AS ls FROM d),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM e),
a AS (SELECT *, {_has(_low('line'), LOG_NEEDLES)} AS needle, line[1:1] IN (' ', chr(9)) AS ind FROM l),
b AS (SELECT *, sum(CASE WHEN ind THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM a),
c AS (SELECT *, max(needle::INT) OVER (PARTITION BY doc_id, island ORDER BY i) = 1 AS seed FROM b),
k AS (SELECT *, i < 5 OR i + 15 >= n OR seed OR (coalesce(lead(seed) OVER (PARTITION BY doc_id ORDER BY i), false) AND line <> '') AS keep FROM c),
r AS (SELECT *, sum(keep::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run, coalesce(lag(keep) OVER (PARTITION BY doc_id ORDER BY i), true) AS before FROM k),
g AS (SELECT *, count(*) FILTER (NOT keep) OVER (PARTITION BY doc_id, run) AS gap FROM r),
m AS (SELECT doc_id, count(*) FILTER (NOT keep) AS elided, count(*) FILTER (needle) AS flagged,
  string_agg(CASE WHEN keep THEN line || chr(10) WHEN before THEN '⟨… ' || gap || ' line' || CASE WHEN gap = 1 THEN '' ELSE 's' END || ' …⟩' || chr(10) END, '' ORDER BY i) AS kept FROM g GROUP BY doc_id),
f AS (SELECT e.doc_id, body, elided, flagged, '⟨lodestone: ' || elided || ' line' || CASE WHEN elided = 1 THEN '' ELSE 's' END || ' elided · ' || flagged || ' flagged⟩' || chr(10) || kept AS made FROM e LEFT JOIN m USING (doc_id)),
x AS (SELECT *, made IS NULL OR strlen(made) >= strlen(body) AS grew FROM f)
SELECT doc_id, CASE WHEN grew THEN 0 ELSE elided END::BIGINT AS elided, CASE WHEN grew THEN 0 ELSE flagged END::BIGINT AS flagged, grew, sha256(CASE WHEN grew THEN body ELSE made END) AS text_sha256 FROM x"""


def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all message nodes."""
    rows = memory_rows(spark, sf_dir)
    out = graph.message_nodes(rows, *graph.places(rows))
    return out.select("rowid", "id", "parent", *[micro(F.col(c)).alias(f"{c}_micro") for c in ("fx", "fy", "fz")])


def _sphere(i: str, n: str) -> tuple[str, str, str]:
    y = f"(1.0::DOUBLE - 2.0::DOUBLE * ({i} + 0.5::DOUBLE) / {n})"
    r = f"sqrt(greatest(1.0::DOUBLE - {y} * {y}, 0))"
    phi = f"({i}::DOUBLE * 2.399963229728653::DOUBLE)"
    return f"{r} * cos({phi})", y, f"{r} * sin({phi})"


def _jit(seed: str) -> str:
    step = f"(({seed}::HUGEINT * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"(({step} // 8589934592::HUGEINT)::DOUBLE / 4294967295.0::DOUBLE * 2 - 1)"


_S, _M = _sphere("i", "n"), _sphere("i", "n")
_LAYOUT = f"""WITH {_ROWS},
pk AS (SELECT project, row_number() OVER (ORDER BY max(rowid) DESC) - 1 AS k, count(*) OVER () AS slots FROM rows_ GROUP BY project),
p AS (SELECT project, 300 * cos(2 * pi() * k / slots) AS px, (k % 3 - 1.0::DOUBLE) * 46 AS py, 300 * sin(2 * pi() * k / slots) AS pz FROM pk),
sn AS (SELECT session, max_by(project, rowid) AS project, max(rowid) AS last FROM rows_ GROUP BY session),
si AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last DESC) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM sn),
s AS (SELECT session, px + {_S[0]} * (110 + sqrt(n) * 7) AS sx, py + {_S[1]} * (110 + sqrt(n) * 7) * 0.72::DOUBLE AS sy, pz + {_S[2]} * (110 + sqrt(n) * 7) AS sz FROM si JOIN p USING (project)),
m AS (SELECT rowid, session, row_number() OVER (PARTITION BY session ORDER BY rowid DESC) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM rows_)
SELECT rowid, 'm:' || rowid AS id, 's:' || session AS parent,
  round((sx + {_M[0]} * (26 + cbrt(n) * 7) + {_jit('rowid')} * 4) * 1000000)::BIGINT AS fx_micro,
  round((sy + {_M[1]} * (26 + cbrt(n) * 7) + {_jit('xor(rowid, 42405)')} * 4) * 1000000)::BIGINT AS fy_micro,
  round((sz + {_M[2]} * (26 + cbrt(n) * 7) + {_jit('xor(rowid, 23130)')} * 4) * 1000000)::BIGINT AS fz_micro
FROM m JOIN s USING (session)"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        keyword_search, search_lines, batch_bm25, document_frequency, term_document_frequency, gated_retrieval, recall_report, qa_pairs, knn, rank_fusion, predicates, scalars, content_term_lists,
        session_rollup, session_digests, role_counts, project_rollup, stats, newest_gists, dedupe_rows, recurring_asks, similar_asks, recurring_documents, similar_documents, condensed_logs, graph_layout,
    )
}

SQL: dict[str, str] = {
    "keyword_search": _KEYWORD,
    "batch_bm25": _BATCH,
    "document_frequency": _DF,
    "term_document_frequency": _ALL_DF,
    "qa_pairs": _QA,
    "knn": _KNN,
    "rank_fusion": _FUSE,
    "predicates": _PREDICATES,
    "scalars": _SCALARS,
    "content_term_lists": _TERM_LISTS,
    "session_rollup": _ROLLUP,
    "session_digests": _DIGESTS,
    "role_counts": f"WITH {_ROWS} SELECT role, count(*) AS n_rows FROM rows_ GROUP BY role",
    "project_rollup": f"WITH {_ROWS} SELECT project, count(DISTINCT session) AS sessions, max(ts) AS last_ts, count(*) AS n_rows FROM rows_ GROUP BY project",
    "stats": _STATS,
    "dedupe_rows": _DEDUPE,
    "similar_asks": _similar(_ASKED),
    "similar_documents": _similar(_DOCUMENT_ASKS),
    "recurring_asks": _recurring(_ASKED),
    "recurring_documents": _recurring(_DOCUMENT_ASKS),
    "search_lines": _LINES,
    "gated_retrieval": _GATED,
    "recall_report": _RECALL,
    "newest_gists": _NEWEST,
    "condensed_logs": _CONDENSED,
    "graph_layout": _LAYOUT,
}
