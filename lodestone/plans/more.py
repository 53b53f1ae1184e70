"""Further queries with SQL: stemmed search, turn digests, curation, briefs, coverage, calibration, the graph.

They stand on the same stand-in rows as those of :mod:`.registry`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import CORRECTIONS
from ..functions.text import stable_key, text_of
from ..functions.tokens import porter
from ..functions.wordpiece import WordPiece
from ..operators import briefing, condense, curate, encoders, graph, retrieve, search, sessions, work
from ..sources.transcripts import messages
from ..streaming.events import ADVICE, hints
from . import registry as base
from .registry import _BM25, _GISTS, _LOGS, _ROWS, _SPOKEN, LOG_NEEDLES, _digest_of, _has, _key, _low, _noise, _q, _squeeze, index_of, memory_rows, micro, spoken_rows, table

# ---- stemmed search, phrases, one column


def _forms(stem: str) -> list[str]:
    """Words that Porter's rules bring to a stem: the stem with the endings that they take off, one or two of them."""
    ends = "s es ed ing ly er e al ance ence able ible ant ement ment ent ion ou ism ate iti ous ive ize ful ness ational tional enci anci izer logi bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti icate ative alize iciti ical".split()
    one = {stem, *(stem + e for e in ends), *(stem + stem[-1] + e for e in ("ed", "ing", "er"))}
    return sorted(w for w in one | {x + e for x in one for e in ("s", "ed", "ing", "ly")} if porter(w) == stem)


PORTER_TERMS = ("the of", "ands", "things")


def porter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of a phrase and two words by their stems, in texts and expansions."""
    found = search.match(index_of(spark, sf_dir, ("text", "asks"), "porter"), list(PORTER_TERMS), "or")
    return found.select("rowid", micro(F.col("score")).alias("score_micro"))


def asks_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of two words, one column read; lengths are those of whole rows."""
    found = search.match(index_of(spark, sf_dir, ("text", "asks")), ["the", "of"], column="asks")
    return found.select("rowid", micro(F.col("score")).alias("score_micro"))


_TWO = r"""two AS (SELECT rowid, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t, CASE WHEN rowid % 3 = 0 THEN regexp_extract_all(lower(left(coalesce(text, ''), 40)), '[\p{L}\p{N}]+') ELSE [] END AS a FROM rows_),
dls AS (SELECT rowid, len(t) + len(a) AS dl FROM two), totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)"""


def _two_column(tfs: list[str], test: str) -> str:
    """Scores from expressions of each phrase's frequency over the token lists ``t`` and ``a``."""
    each = ", ".join(f"({x}) AS f{k}" for k, x in enumerate(tfs))
    parts = " + ".join("({idf}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))".format(idf=_BM25.replace("df", f"d{k}"), k=k) for k in range(len(tfs)))
    return f"""f AS MATERIALIZED (SELECT rowid, {each} FROM two), d AS (SELECT {", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(tfs)))} FROM f)
SELECT rowid, round(({parts}) * 1000000)::BIGINT AS score_micro FROM f JOIN dls USING (rowid), d, totals WHERE {test}"""


def _stemmed(phrase: str) -> str:
    forms = [_q(_forms(porter(w))) for w in phrase.split()]
    count = lambda c: f"len(list_filter(range(1, len({c}) - {len(forms) - 2}), lambda i: {' AND '.join(f'{c}[i + {j}] IN ({x})' for j, x in enumerate(forms))}))"
    return f"{count('t')} + {count('a')}"


_PORTER = f"WITH {_ROWS}, {_TWO}, {_two_column([_stemmed(x) for x in PORTER_TERMS], ' OR '.join(f'f{k} > 0' for k in range(len(PORTER_TERMS))))}"
_ASKS = f"WITH {_ROWS}, {_TWO}, {_two_column([f'''len(list_filter(a, lambda x: x = '{w}'))''' for w in ('the', 'of')], 'f0 > 0 AND f1 > 0')}"

# ---- turn digests, from transcripts made of the rows


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as transcript lines: every other answer edits a file and runs a command, some results fail."""
    r = memory_rows(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    turn, conv = (F.col("rowid") % 1000).cast("int"), F.floor(F.col("rowid") / 1000).cast("int")
    said = F.struct(F.lit("text").alias("type"), text_of("text").alias("text"))
    edit = F.struct(F.lit("tool_use").alias("type"), F.lit("Edit").alias("name"), F.struct(F.concat(F.lit("/src/f"), (conv % 5).cast("string"), F.lit(".py")).alias("file_path"), F.lit("x").alias("note")).alias("input"))
    run = F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("# first\n"), text_of("text")).alias("command")).alias("input"))
    failed = F.struct(F.lit("tool_result").alias("type"), (conv % 3 == 0).alias("is_error"), F.lit("out").alias("content"))
    j = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(x) for x in xs]), F.lit("]"))
    line = lambda role, content: F.concat(F.lit(f'{{"type":"{role}","message":{{"role":"{role}","content":'), content, F.lit('},"sessionId":"x"}'))
    quoted = F.regexp_extract(F.to_json(F.struct(text_of("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    first = F.when(F.col("role") == "user", line("user", quoted)).when(turn % 2 == 1, line("assistant", j(said, edit, run))).otherwise(line("assistant", j(said)))
    both = F.when((F.col("role") == "assistant") & (turn % 2 == 1), F.array(first, line("user", j(failed)))).otherwise(F.array(first))
    return r.select("file", "rowid", F.posexplode(both).alias("k", "value")).select("file", (F.col("rowid") * 2 + F.col("k")).alias("line_no"), "value")


def turn_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's last turn did."""
    d = work.digest(work.turn_steps(messages(transcript_lines(spark, sf_dir))))
    return d.select("file", F.sha2("ask", 256).alias("ask_sha256"), F.array_join("files", ",").alias("files"), F.array_join("commands", "|").alias("commands"), "failures", "outcome", F.array_join(work.detail_lines(), "\n").alias("details"))


_HEAD = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\n;]'), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\v]+', '')), lambda x: x <> '' AND NOT starts_with(x, '#'))[1]"
_DIGEST = f"""WITH {_ROWS},
m AS (SELECT file, rowid, role, rowid % 1000 AS turn, rowid // 1000 AS conv, coalesce(text, '') AS text, role = 'user' AND NOT {_noise('text')} AS real FROM rows_ WHERE role IN ('user', 'assistant')),
n AS (SELECT *, sum(real::INT) OVER (PARTITION BY file ORDER BY rowid) AS t FROM m), l AS (SELECT * FROM n QUALIFY t = max(t) OVER (PARTITION BY file)),
c AS (SELECT file, rowid, row_number() OVER (PARTITION BY file, cmd ORDER BY rowid) AS again, cmd FROM (SELECT file, rowid, {_squeeze(_HEAD, 48)} AS cmd FROM l WHERE role = 'assistant' AND turn % 2 = 1) WHERE cmd <> ''),
cs AS (SELECT file, array_to_string(list(cmd ORDER BY rowid)[1:4], '|') AS commands FROM c WHERE again = 1 GROUP BY file),
g AS (SELECT file, coalesce(max(text) FILTER (real), '') AS ask, CASE WHEN count(*) FILTER (role = 'assistant' AND turn % 2 = 1) > 0 THEN 'f' || any_value(conv % 5) || '.py' ELSE '' END AS files,
  count(*) FILTER (role = 'assistant' AND turn % 2 = 1 AND conv % 3 = 0)::INT AS failures, coalesce(max_by(text, rowid) FILTER (role = 'assistant' AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')), '') AS said FROM l GROUP BY file),
o AS (SELECT g.*, coalesce(commands, '') AS commands, {_squeeze('said', 220)} AS outcome FROM g LEFT JOIN cs USING (file)),
p AS (SELECT *, array_to_string(list_filter([CASE WHEN files <> '' THEN 'files: ' || files END, CASE WHEN commands <> '' THEN 'ran: ' || replace(commands, '|', ' | ') END, CASE WHEN failures > 0 THEN failures || ' failed' END], lambda x: x IS NOT NULL), '  ·  ') AS done FROM o)
SELECT file, sha256(ask) AS ask_sha256, files, commands, failures, outcome, array_to_string(list_filter([CASE WHEN done <> '' THEN '    ' || done END, CASE WHEN outcome <> '' THEN '    did: ' || outcome END], lambda x: x IS NOT NULL), chr(10)) AS details FROM p"""

# ---- curation with a stub in the provider's place


def stub(requests: list[str]) -> list[str]:
    """Keeps rows with an id divisible by 3; of those, even ones get a gist and a question; one in seven batches fails."""
    out = []
    for request in requests:
        body = json.loads(request)
        rows = json.loads(body["messages"][1]["content"])["rows"]
        if body["messages"][0]["content"] == curate.RUBRICS["scene"]:
            made = {"scenes": [{"id": r["id"], "title": r["text"][:20], "summary": r["text"][:50], "outcome": "Done"} for r in rows]}
        elif body["messages"][0]["content"] == curate.RUBRICS["durability"]:
            made = {"verdicts": [{"id": r["id"], "keep": True, "gist": r["text"][:30] if r["id"] % 2 == 0 else "", "asks": ["what of " + str(r["id"])] if r["id"] % 2 == 0 else []} for r in rows]}
        else:
            made = {"verdicts": [{"id": r["id"], "keep": r["id"] % 3 == 0, "gist": "", "asks": []} for r in rows] + [{"id": -1, "keep": True}]}
        out.append(json.dumps({"choices": [{"message": {"content": json.dumps(made)}}]}))
    return out


def distilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict table after a run over the assistant rows, some of them judged before."""
    rows = memory_rows(spark, sf_dir)
    before = rows.where(F.col("session").isin("s3", "s4")).select(stable_key("session", "ts", "role", "text").alias("key"), F.lit("old").alias("gist")).distinct()
    made, table_ = curate.distill(rows, before, stub)
    asked = made.where(F.col("asks") != "").select(stable_key("session", "ts", "role", "text").alias("key"), "asks")
    return table_.join(asked, "key", "left").select(F.sha2("key", 256).alias("key_sha256"), "gist", text_of("asks").alias("asks"))


_DISTILLED = f"""WITH {_ROWS}, k AS (SELECT *, {_key()} AS key FROM rows_), b AS (SELECT DISTINCT key FROM k WHERE session IN ('s3', 's4')),
j AS (SELECT key, rowid, CASE WHEN rowid % 6 = 0 THEN left(left(coalesce(text, ''), 500), 30) ELSE '' END AS gist, CASE WHEN rowid % 6 = 0 AND left(coalesce(text, ''), 500) <> '' THEN 'what of ' || rowid ELSE '' END AS asks
  FROM k WHERE role IN ('assistant', 'summary') AND key NOT IN (SELECT key FROM b))
SELECT sha256(key) AS key_sha256, gist, asks FROM j UNION ALL SELECT sha256(key), 'old', '' FROM b"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of the sessions that have five rows and none yet."""
    rows = memory_rows(spark, sf_dir)
    have = spark.createDataFrame([("s1",), ("s2",)], "session string")
    return curate.build_scenes(sessions.rollup(rows), sessions.digests(rows, cap=900), have, stub).select("session", "title", "summary", "outcome", "project", "ts_start", "ts_end", "n_rows")


_SCENES = f"""WITH {_ROWS}, d AS (SELECT session, digest FROM ({_digest_of('rows_')}))
SELECT session, left(digest, 20) AS title, left(digest, 50) AS summary, 'done' AS outcome, min_by(project, rowid) AS project, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n_rows
FROM rows_ JOIN d USING (session) WHERE role IN ('user', 'assistant', 'system') AND session NOT IN ('s1', 's2') GROUP BY session, digest HAVING count(*) >= 5"""

# ---- briefs


def project_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's brief, under a budget that cuts some lines."""
    rows = memory_rows(spark, sf_dir)
    asked = rows.where(F.col("role") == "user").select("project", "ts", "rowid", briefing.dated(text_of("text"), F.col("ts")).alias("line"))
    opened = briefing.numbered(asked, F.desc("ts"), F.desc("rowid")).select("project", "nth", "line")
    return briefing.project_states(rows, opened, sessions.newest_gists(rows, base.gists(rows)), 520)


def _add(lines: str) -> str:
    return f"""list_reduce({lines}, lambda a, x: CASE WHEN a.closed = x.part THEN a WHEN strlen(a.line) + strlen(x.line) + 16 > 520 THEN {{'part': 0, 'line': a.line, 'label': '', 'closed': x.part}}
  ELSE {{'part': 0, 'line': a.line || chr(10) || x.label || ' · ' || x.line, 'label': '', 'closed': a.closed}} END)"""


_STATES = f"""WITH {_ROWS}, n AS ({base._NEWEST.replace(f'WITH {_ROWS}, ', 'WITH ')}),
u AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY ts DESC, rowid DESC) AS nth, left(ts, 10) || ' ' || coalesce(text, '') AS line FROM rows_ WHERE role = 'user' QUALIFY nth <= 3),
l AS (SELECT project, 0 AS part, nth, 'open' AS label, {_squeeze('line', 140)} AS line FROM u UNION ALL SELECT project, 1, nth, 'done', {_squeeze('line', 140)} FROM n),
h AS (SELECT project, '[state] ' || project || ' — ' || count(DISTINCT session) || ' session(s) on file, last ' || left(max(ts), 10) || ':' AS head FROM rows_ GROUP BY project),
s AS (SELECT project, head, [{{'part': -1, 'line': head, 'label': '', 'closed': -1}}] || list({{'part': part, 'line': line, 'label': label, 'closed': -1}} ORDER BY part, nth) AS xs FROM l JOIN h USING (project) GROUP BY project, head)
SELECT project, ({_add('xs')}).line AS state FROM s WHERE ({_add('xs')}).line <> head"""


def topic_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as pages: the first eight by name, and how many more there are."""
    d = table(spark, sf_dir, "documents")
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return briefing.topics(d.select(name.alias("file"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("session"), "text"))


_TOPIC = _squeeze(r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^[ \t]*[^ \t#]'))[1]", 60)
_TOPICS = f"""WITH p AS (SELECT doc_id, 'd' || doc_id || ' — ' || coalesce(nullif({_TOPIC}, ''), '(empty)') AS topic FROM documents),
s AS (SELECT string_agg(topic, ' | ' ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS menu FROM (SELECT * FROM p ORDER BY lpad(doc_id::VARCHAR, 12, '0') LIMIT 8)), c AS (SELECT count(*) AS n FROM p)
SELECT menu || CASE WHEN n > 8 THEN ' | +' || (n - 8) || ' more' ELSE '' END AS topics FROM s, c"""


def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice once for each session and category of what was said in it."""
    return hints(spoken_rows(spark, sf_dir).select(F.col("text").alias("prompt"), F.col("session").alias("session_id")))


_PADDED = "(' ' || " + _low("coalesce(text, '')") + " || ' ')"
_HINTS = f"""WITH {_ROWS}, c AS (SELECT DISTINCT 's' || (rowid // 1000) AS session_id, CASE WHEN {_has(base._folded('text'), CORRECTIONS)} THEN 'correction' {' '.join(f"WHEN {_has(_PADDED, ps)} THEN '{name}'" for name, ps in base.CATEGORIES)} END AS category FROM {_SPOKEN})
SELECT session_id, category, '[hint] this ' || CASE category {' '.join(f"WHEN '{k}' THEN {_q([v])}" for k, v in ADVICE.items())} END AS reply FROM c WHERE category IS NOT NULL"""

# ---- what a prompt is answered with: a session's scene, talk, and work that was run


def scene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for scenes: a session's first words."""
    talk = memory_rows(spark, sf_dir).where(F.col("role").isin("user", "assistant", "system"))
    held = talk.groupBy("session").agg(F.min("rowid").alias("rowid"), F.min_by(text_of("text"), "rowid").alias("text"), F.max("ts").alias("ts_end"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return held.select("rowid", F.concat(F.lit("session "), "session").alias("title"), F.substring("text", 1, 200).alias("summary"), F.lit("done").alias("outcome"), "session", "ts_end")


def work_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as tool traffic."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rowid"), "text", F.lit("tool").alias("role"), F.col("source").alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("session"), F.lit("2026-01-01T00").alias("ts"))


def recall_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines at most for every prompt, some of them given before."""
    rows, scenes_, traffic = memory_rows(spark, sf_dir), scene_rows(spark, sf_dir), work_table(spark, sf_dir)
    asked = rows.where(F.col("rowid") % 100 == 0).select(F.col("rowid").alias("qid"), F.col("text").alias("prompt"), F.col("session").alias("exclude"), "session")
    index = index_of(spark, sf_dir)
    scene = retrieve.scene_hits(search.build_index(scenes_, ("title", "summary", "outcome")).stage("scenes"), index, scenes_, asked)
    talk = retrieve.retrieve(index, rows, asked, 12)
    ran = retrieve.retrieve(search.build_index(traffic).stage("work"), traffic, asked, 2)
    seen = talk.where((F.col("rank") == 1) & (F.col("qid") % 3000 == 0)).join(asked, "qid").select("session", "key")
    return retrieve.recall_slots(scene, talk, ran, asked, seen).select("qid", "slot", "lane", "line")


def _lane(p: str, rows: str, columns: tuple[str, ...] = ("text",)) -> str:
    """Rows, tokens and frequencies of a lane whose names begin with ``p``."""
    tokens = " || ".join(f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')" for c in columns)
    return f"""{p}rows AS MATERIALIZED ({rows}), {p}toks AS (SELECT rowid, {tokens} AS ts FROM {p}rows), {p}dls AS MATERIALIZED (SELECT rowid, len(ts) AS dl FROM {p}toks), {p}totals AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}dls),
{p}tf AS MATERIALIZED (SELECT rowid, t AS term, count(*) AS tf FROM (SELECT rowid, unnest(ts) AS t FROM {p}toks) GROUP BY ALL), {p}df AS MATERIALIZED (SELECT term, count(*) AS df FROM {p}tf GROUP BY term)"""


def _best(p: str, gate: str) -> str:
    """The 40 best rows of lane ``p`` for the terms that are rare in lane ``gate``."""
    return f"""{p}rare AS MATERIALIZED (SELECT qid, list(e.term ORDER BY i) AS terms FROM (SELECT qid, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM given) e LEFT JOIN {gate}df df ON df.term = lower(e.term), {gate}totals
  WHERE n < 200 OR df <= greatest(5, floor(n * 6 / 100)) GROUP BY qid HAVING count(*) >= 2),
{p}s AS (SELECT qid, rowid, sum(({_BM25}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT qid, unnest(terms) AS term FROM {p}rare) a JOIN {p}df df ON df.term = lower(a.term) JOIN {p}tf tf ON tf.term = df.term JOIN {p}dls USING (rowid), {p}totals GROUP BY ALL),
{p}c AS MATERIALIZED (SELECT qid, rowid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS r FROM {p}s QUALIFY r <= 40)"""


def _talk(p: str, limit: int) -> str:
    low, echo = _low("head"), lambda x: _squeeze(_low(x), 400)
    return f"""{p}f AS (SELECT qid, rowid, r, x.ts, role, project, session, left(coalesce(text, ''), 400) AS head, {_key('x.')} AS key, prompt, exclude, terms FROM {p}c JOIN {p}rows x USING (rowid) JOIN {p}rare USING (qid) JOIN asked USING (qid)),
{p}hits AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank, key, left(ts, 10) || ' ' || role || CASE WHEN coalesce(project, '') = '' THEN '' ELSE '/' || project END || ': ' || {_squeeze('head', 160)} AS line FROM {p}f
  WHERE session <> exclude AND len(list_filter(terms, lambda t: contains({low}, t))) >= 2
    AND NOT (strlen({echo('prompt')}) >= 25 AND (contains({echo('head')}, {echo('prompt')}) OR contains({echo('prompt')}, {echo('head')}))) QUALIFY rank <= {limit})"""


_PROMPT_TERMS = base._TERMS.replace("coalesce(text, '')", "coalesce(prompt, '')")
_SLOTS = f"""WITH {_ROWS}, asked AS MATERIALIZED (SELECT rowid AS qid, text AS prompt, session AS exclude FROM rows_ WHERE rowid % 100 = 0),
given AS MATERIALIZED (SELECT qid, list(t ORDER BY i)[1:12] AS terms FROM (SELECT qid, t, min(i) AS i FROM (SELECT qid, unnest({_PROMPT_TERMS}) AS t, generate_subscripts({_PROMPT_TERMS}, 1) AS i FROM asked WHERE NOT {_noise('prompt')}) GROUP BY qid, t) GROUP BY qid HAVING count(*) >= 2),
{_lane('m', 'SELECT rowid, text, role, project, session, ts FROM rows_')},
{_lane('w', "SELECT doc_id AS rowid, text, 'tool' AS role, source AS project, 'd' || doc_id AS session, '2026-01-01T00' AS ts FROM documents")},
{_lane('z', "SELECT min(rowid) AS rowid, 'session ' || session AS title, left(min_by(coalesce(text, ''), rowid), 200) AS summary, 'done' AS outcome, session, max(ts) AS ts_end FROM rows_ WHERE role IN ('user', 'assistant', 'system') GROUP BY session HAVING count(*) >= 5", ('title', 'summary', 'outcome'))},
{_best('m', 'm')}, {_talk('m', 12)}, {_best('w', 'w')}, {_talk('w', 2)}, {_best('z', 'm')},
zhits AS (SELECT qid, 1 AS rank, session || '|' || ts_end || '|scene|' || left(title, 64) AS key, title || ' (' || outcome || ', ' || left(ts_end, 10) || ')' AS line FROM zc JOIN zrows USING (rowid) JOIN zrare USING (qid) JOIN asked USING (qid)
  WHERE session <> exclude AND len(list_filter(terms, lambda t: contains({_low("title || ' ' || summary")}, t))) >= 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) = 1),
seen AS (SELECT DISTINCT exclude AS session, key FROM mhits JOIN asked USING (qid) WHERE rank = 1 AND qid % 3000 = 0),
u AS (SELECT qid, rank, key, line, 0 AS lane FROM zhits UNION ALL SELECT qid, rank, key, line, 1 FROM mhits UNION ALL SELECT qid, rank, key, line, 2 FROM whits),
n AS (SELECT u.*, u.qid IN (SELECT qid FROM whits) AS reserved FROM u JOIN asked USING (qid) WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.session = asked.exclude AND seen.key = u.key)),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY lane, rank) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY qid, lane ORDER BY rank) AS nth, max((lane = 0)::INT) OVER (PARTITION BY qid) AS scenes FROM o),
q AS (SELECT * FROM p WHERE lane <> 1 OR nth <= 3 - 2 * scenes - reserved::INT)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY lane, nth)::INT AS slot, lane::INT AS lane, CASE WHEN lane = 2 THEN '(ran) ' || line ELSE line END AS line FROM q QUALIFY slot <= 3"""

# ---- coverage, calibration, graph


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each lane reaches."""
    rows = memory_rows(spark, sf_dir).withColumn("asks", F.when(F.col("rowid") % 3 == 0, F.lit("x")))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding")
    labels = table(spark, sf_dir, "labels")
    judged = labels.select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, F.lit("g")).otherwise(F.lit("")).alias("gist"))
    recalled = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("key")).distinct()
    return sessions.coverage(rows, v, judged, labels.where("toxic = 1").select("doc_id"), recalled)


_COVERAGE = """SELECT (SELECT count(*) FROM conversations) AS n_rows, (SELECT count(*) FROM conversations WHERE (conv_id * 1000 + turn) % 3 = 0) AS with_asks, (SELECT count(*) FROM embeddings) AS embedded,
(SELECT count(*) FROM labels) AS judged, (SELECT count(*) FROM labels WHERE quality = 1) AS with_gist, (SELECT count(*) FROM labels WHERE toxic = 1) AS forgotten,
(SELECT count(DISTINCT user_id) FROM events) AS recall_sessions, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS recalled"""


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines that one needle alone flags, how many stay without it."""
    return condense.calibrate(base.log_bodies(spark, sf_dir), needles=LOG_NEEDLES)


_CALIBRATION = f"""WITH d AS (SELECT doc_id, string_split({_LOGS}, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:-2] ELSE ls END AS ls FROM d),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM e),
h AS (SELECT *, list_filter([{_q(LOG_NEEDLES)}], lambda x: contains({_low('line')}, x)) AS hits, line[1:1] IN (' ', chr(9)) AS ind FROM l),
w AS (SELECT DISTINCT doc_id, hits[1] AS needle FROM h WHERE len(hits) = 1),
a AS (SELECT h.*, needle, len(list_filter(hits, lambda x: x <> needle)) > 0 AS flag, len(hits) = 1 AND hits[1] = needle AS sole FROM h JOIN w USING (doc_id)),
b AS (SELECT *, sum(CASE WHEN ind THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, needle ORDER BY i) AS island FROM a),
c AS (SELECT *, max(flag::INT) OVER (PARTITION BY doc_id, needle, island ORDER BY i) = 1 AS seed FROM b),
k AS (SELECT *, i < 5 OR i + 15 >= n OR seed OR (coalesce(lead(seed) OVER (PARTITION BY doc_id, needle ORDER BY i), false) AND line <> '') AS keep FROM c),
s AS (SELECT needle, count(*) AS lines, count(*) FILTER (keep) AS survived FROM k WHERE sole GROUP BY needle)
SELECT needle, coalesce(lines, 0) AS lines, coalesce(survived, 0) AS survived FROM (SELECT unnest([{_q(LOG_NEEDLES)}]) AS needle) LEFT JOIN s USING (needle)"""


def saved_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the larger logs before and after condensing."""
    return condense.savings(base.log_bodies(spark, sf_dir), LOG_NEEDLES)


_SAVED = f"""WITH x AS ({base._CONDENSED.replace("grew, sha256(CASE WHEN grew THEN body ELSE made END) AS text_sha256 FROM x", "strlen(body) AS before, strlen(CASE WHEN grew THEN body ELSE made END) AS after FROM x")})
SELECT count(*) AS bodies, coalesce(sum(before), 0)::BIGINT AS before, coalesce(sum(after), 0)::BIGINT AS after FROM x WHERE before >= 2048"""


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the graph of what is known: system rows as pages that link to each other, other rows with a gist."""
    rows = memory_rows(spark, sf_dir)
    note = F.col("role") == "system"
    rows = rows.withColumn("text", F.when(note, F.concat(F.lit("[[ s"), (F.col("rowid") / 1000).cast("int") + 1, F.lit(" ]] "), text_of("text"))).otherwise(F.col("text"))).withColumn("role", F.when(note, F.lit("wiki")).otherwise(F.col("role")))
    return graph.build_graph(graph.knowledge(rows, base.gists(rows), 1_000_000))[1]


_GRAPH = f"""WITH {_ROWS}, {_GISTS},
r AS (SELECT rowid, CASE WHEN role = 'system' THEN 'wiki' ELSE role END AS role, project, session, CASE WHEN role = 'system' THEN '[[ s' || (rowid // 1000 + 1) || ' ]] ' || coalesce(text, '') ELSE text END AS text, ts FROM rows_),
k AS (SELECT r.* FROM r LEFT JOIN g ON g.key = {_key('r.')} AND gist <> '' WHERE role = 'wiki' OR gist IS NOT NULL),
n AS (SELECT lower(session) AS name, min(rowid) AS rowid FROM k WHERE role = 'wiki' GROUP BY ALL)
SELECT 'center' AS source, 'p:' || project AS target, 'spine' AS kind FROM (SELECT DISTINCT project FROM k WHERE role <> 'wiki')
UNION ALL SELECT 'p:' || max_by(project, rowid), 's:' || session, 'spine' FROM k WHERE role <> 'wiki' GROUP BY session
UNION ALL SELECT CASE WHEN role = 'wiki' THEN 'center' ELSE 's:' || session END, 'm:' || rowid, 'leaf' FROM k
UNION ALL SELECT 'm:' || k.rowid, 'm:' || n.rowid, 'wikilink' FROM k JOIN n ON n.name = 's' || (k.rowid // 1000 + 1) WHERE role = 'wiki' AND n.rowid <> k.rowid"""


#: A toy vocabulary: letters, and some pieces that are frequent in the documents.
PIECES = {p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz.,", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), "the", "an", "en", "##the", "##ion", "##er", "##en", "##nd"])}


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of every document by the toy vocabulary."""
    ids = encoders.piece_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rowid"), "text"), WordPiece(PIECES))
    return ids.select(F.col("rowid").alias("doc_id"), F.size("ids").alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


QUERIES = {f.__name__: f for f in (porter_search, asks_search, turn_digests, distilled, scenes, project_states, topic_menu, hinted, recall_slots, coverage, calibration, saved_bytes, graph_links, pieces)}

SQL = {
    "porter_search": _PORTER, "asks_search": _ASKS, "turn_digests": _DIGEST, "distilled": _DISTILLED, "scenes": _SCENES, "project_states": _STATES, "topic_menu": _TOPICS,
    "hinted": _HINTS, "recall_slots": _SLOTS, "coverage": _COVERAGE, "calibration": _CALIBRATION, "saved_bytes": _SAVED, "graph_links": _GRAPH,
}
