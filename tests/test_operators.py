"""The library's own operators on small hand-made tables."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import predicates, text, tokens
from lodestone.operators import condense, curate, graph, recurrence, search, sessions, vectors
from lodestone.sources import transcripts
from lodestone.streaming import events


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).head()["x"]


@pytest.mark.parametrize(("value", "want"), [("", True), ("  ok! ", True), ("that's it", False), ("<system-reminder> x", True), ("don't stop", False), ("日本", False), ("Yes, please", False)])
def test_noise(spark, value, want):
    assert one(spark, value, predicates.is_noise) is want


@pytest.mark.parametrize(("value", "want"), [("No, that's wrong", "correction"), ("from now on use tabs", "preference"), ("we will ship it", "decision"), ("see https://x.y", "reference"), ("hello there", None)])
def test_category(spark, value, want):
    assert one(spark, value, predicates.classify_prompt) == want


def test_squeeze(spark):
    assert one(spark, " a \n b ", lambda c: text.squeeze(c, 10)) == "a b"
    assert one(spark, "ééééé", lambda c: text.squeeze(c, 5)) == "éé…"
    assert one(spark, None, lambda c: text.squeeze(c, 5)) == ""


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("sky", "sky"), ("probate", "probat"), ("controll", "control"), ("größe", "groß")])
def test_stems(word, stem):
    assert tokens.porter(tokens.fold(word)) == stem


@pytest.fixture(scope="module")
def lane(spark):
    texts = ["the build failed on linker", "linker flags and more flags", "reply.cpp parses the reply", None, "cpp reply reversed", "nothing here"]
    return spark.createDataFrame([(i, t, "user", "s", "2026-01-01", "p") for i, t in enumerate(texts)], "rowid long, text string, role string, session string, ts string, project string")


def test_match(lane):
    ix = search.build_index(lane)
    ids = lambda df: sorted(r.rowid for r in df.collect())
    assert ids(search.match(ix, ["linker"])) == [0, 1]
    assert ids(search.match(ix, ["linker", "build"])) == [0]
    assert ids(search.match(ix, ["reply.cpp"])) == [2]
    assert ids(search.match(ix, ["linker", "!!!"])) == []
    assert ids(search.match(ix, ["linker", "!!!"], "or")) == [0, 1]
    assert ids(search.match(ix, [])) == []


def test_porter_match(lane):
    assert [r.rowid for r in search.match(search.build_index(lane, tokenizer="porter"), ["parsing"]).collect()] == [2]


def test_rows_with_equal_parts_tie(spark, lane):
    """Rows that hold six equally frequent terms as often, in another order, have one score, and go by ``rowid``."""
    terms = list("abcdef")
    rows = list(itertools.permutations(range(1, 7)))
    tf = spark.createDataFrame([(t, i, 21, n) for i, row in enumerate(rows) for t, n in zip(terms, row, strict=True)], "term string, rowid long, dl int, tf long")
    index = search.Index(lane, lane, ("text",), "simple", 5000, 20.0)
    found = search.score_batch(index, spark.createDataFrame([(1, t) for t in terms], "qid long, term string"), tf, 40).collect()
    assert len({r.score for r in found}) == 1 and sorted((r["rank"], r.rowid) for r in found) == [(i, i) for i in range(40)]


def test_bm25_against_sqlite(lane):
    sqlite3 = pytest.importorskip("sqlite3")
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    for r in lane.collect():
        con.execute("INSERT INTO t(rowid, text) VALUES (?, ?)", (r.rowid + 1, r.text))
    want = {i - 1: -s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"linker\" OR \"the\"'")}
    got = {r.rowid: r.score for r in search.match(search.build_index(lane), ["linker", "the"], "or").collect()}
    assert got == pytest.approx(want)


def test_knn_and_fusion(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "rowid long, embedding array<float>")
    q = spark.createDataFrame([(0, [2.1, 0.0])], "qid int, query array<float>")
    assert [r.rowid for r in vectors.knn(v, q, 3).orderBy("rank").collect()] == [2, 3, 1]
    leg = lambda ids: spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "rowid int, rank int")
    assert {r.rowid for r in vectors.fuse(leg([1, 2]), leg([2, 3])).collect()} == {1, 2}
    assert {r.rowid for r in vectors.fuse(leg([1, 2]), leg([2, 3]), gated=False).collect()} == {1, 2, 3}


def plain_condense(body, needles=condense.NEEDLES):
    """The kept-line rule, line by line."""
    rows = body.split("\n")
    rows = rows[:-1] if rows[-1] == "" else rows
    hit = [any(n in r.lower() for n in needles) for r in rows]
    seed = list(hit)
    for i in range(1, len(rows)):
        seed[i] = seed[i] or (seed[i - 1] and rows[i][:1] in (" ", "\t") and rows[i] != "")
    n = len(rows)
    keep = [i < 5 or i + 15 >= n or seed[i] or (i + 1 < n and seed[i + 1] and rows[i] != "") for i in range(n)]
    out, gap = [], 0
    for k, r in [*zip(keep, rows, strict=True), (True, None)]:
        if k and gap:
            out.append(f"⟨… {gap} line{'s' * (gap != 1)} …⟩\n")
            gap = 0
        if k and r is not None:
            out.append(r + "\n")
        gap += not k
    cut = n - sum(keep)
    made = f"⟨lodestone: {cut} line{'s' * (cut != 1)} elided · {sum(hit)} flagged⟩\n" + "".join(out)
    return (body, 0, 0, True) if len(made.encode()) >= len(body.encode()) else (made, cut, sum(hit), False)


BODIES = [
    "\n".join(f"filler line number {i}" for i in range(400)).replace("number 200", "number 200 error: bad"),
    "start\n" * 40 + "Traceback (most recent call last):\n" + "".join(f'  File "x{i}.py"\n' for i in range(8)) + "done\n" * 60,
    "{\n" + "".join(f'  "key{i}": 1,\n' for i in range(400)) + "}\n",
    "x" * 9000, "a\n\nfatal\n" + "b\n" * 60, "fatal: 0\n" + "  candidate\n" * 40 + "tail\n" * 40, "", "one", "\n" * 50, "c\n" * 19 + "one gap\n" + "d\n" * 2,
]


def test_condense(spark):
    df = spark.createDataFrame([*enumerate(BODIES), (99, None)], "doc_id long, body string")
    got = {r.doc_id: r for r in condense.condense(df).collect()}
    for i, b in enumerate(BODIES):
        assert (got[i].text, got[i].elided, got[i].flagged, got[i].grew) == plain_condense(b)
    assert got[99].text is None and got[99].grew


def test_calibrate(spark):
    df = spark.createDataFrame([*enumerate(BODIES)], "doc_id long, body string")
    got = {r.needle: (r.lines, r.survived) for r in condense.calibrate(df).collect()}
    assert len(got) == len(condense.NEEDLES) and got["error"] == (1, 0)


def plain_groups(asks):
    import re

    groups, out = [], {}
    for rowid, t, _, ts in sorted(asks, key=lambda a: (a[3], a[0])):
        s = {x.lower() for x in re.findall("[A-Za-z0-9]{2,}", t)}
        if len(s) < 5:
            continue
        home = next((g for g in groups if len(s & g[1]) * 100 >= 60 * len(s | g[1])), None)
        if home is None:
            home = (rowid, s)
            groups.append(home)
        out[rowid] = home[0]
    return out


def test_recurrence(spark):
    import random

    r = random.Random(2)
    words = [f"w{i}" for i in range(14)]
    asks = [(i, " ".join(r.sample(words, r.randrange(3, 9))), f"s{r.randrange(5)}", f"2026-01-{r.randrange(10, 28)}") for i in range(120)]
    df = spark.createDataFrame(asks, "rowid long, text string, session string, ts string")
    assert {x.rowid: x.founder for x in recurrence.group_asks(df).collect()} == plain_groups(asks)
    assert all(x.sessions >= 2 for x in recurrence.recurring(df).collect())
    assert recurrence.group_asks(df.limit(0)).count() == 0


def test_turns_and_sources(spark, tmp_path):
    say = lambda who, content, **k: json.dumps({"type": who, "message": {"role": who, "content": content}, "timestamp": "2026-01-02T00:00:00Z", "sessionId": "abc", **k})
    rows = [
        json.dumps({"type": "summary", "summary": "A summary"}), "not json", say("user", "please fix the failing build now"), say("assistant", [{"type": "text", "text": "narration"}]),
        say("assistant", [{"type": "text", "text": "x"}, {"type": "tool_use", "name": "Bash", "input": {"command": "make"}}]),
        say("user", [{"type": "tool_result", "is_error": True, "content": "boom"}]), say("assistant", "final " * 20), say("user", "side", isSidechain=True), say("user", "thanks"),
    ]
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "t1.jsonl").write_text("\n".join(rows))
    e = transcripts.parse_entries(transcripts.read_transcripts(spark, str(tmp_path)))
    got = [(r.kind, r.text[:8], r.session) for r in e.orderBy("line_no").collect()]
    assert [g[0] for g in got] == ["Summary", "UserHuman", "AssistantText", "AssistantTool", "UserTool", "AssistantText", "UserHuman"]
    assert got[0][2] == "t1" and got[1][2] == "abc" and got[3][1] == "Bash mak" and got[4][1] == "boom"
    assert [r.final for r in sessions.turn_final(e).where("kind = 'AssistantText'").orderBy("line_no").collect()] == [False, True]
    assert [r.role for r in transcripts.talk_rows(e).orderBy("line_no").collect()] == ["summary", "user", "assistant"]


def test_notes_and_manifest(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nSee [[B]]")
    (tmp_path / "blank.md").write_text(" \n")
    assert [(r.session, r.role) for r in transcripts.read_notes(spark, str(tmp_path), "wiki").collect()] == [("a", "wiki")]
    files = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime long")
    found = transcripts.stale(files([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]), files([("a", 1, 1), ("b", 2, 1)]))
    assert sorted(r.path for r in found.collect()) == ["b", "c"]


def test_curation(spark):
    reply = lambda inner: json.dumps({"choices": [{"message": {"content": inner}}]})
    good = reply(json.dumps({"verdicts": [{"id": 1, "keep": True, "gist": "g", "asks": ["a"]}, {"keep": True}, {"id": 2}]}))
    df = spark.createDataFrame([(x,) for x in (good, reply("prose"), json.dumps({"error": {"message": "m"}}), "", reply("[]"))], "reply string")
    assert [(r.id, r.gist, r.asks) for r in curate.parse_verdicts(df).collect()] == [(1, "g", ["a"])]
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, gist string")
    new = spark.createDataFrame([("b", "9", 1), ("b", "3", 2), ("c", "4", 1)], "key string, gist string, arrived int")
    assert {(r.key, r.gist) for r in curate.upsert(old, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_forget(spark, lane):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "rowid long, embedding array<double>")
    rows, vecs, keys = curate.forget(lane, v, spark.createDataFrame([], "key string"), spark.createDataFrame([(0,)], "rowid long"))
    assert rows.count() == 5 and vecs.count() == 1 and keys.count() == 1


def test_graph(spark):
    rows = spark.createDataFrame(
        [(1, "a note [[other]] [[gone]]", "wiki", "p", "", "2026-01-01"), (2, "other", "memory", "p", "", "2026-01-01"), (3, "said", "user", "p", "s", "2026-01-02")], "rowid long, text string, role string, project string, session string, ts string"
    )
    nodes = {r.rowid: r for r in graph.message_nodes(rows, *graph.places(rows)).collect()}
    assert [nodes[i].parent for i in (1, 2, 3)] == ["center", "p:p", "s:s"] and all(abs(n.fx) < 1000 for n in nodes.values())
    names = spark.createDataFrame([("other", 2)], "name string, rowid long")
    assert [(r.source, r.target) for r in graph.wikilink_edges(rows, names).collect()] == [("m:1", "m:2")]


def test_hint_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, p in enumerate(["No, that is wrong", "you missed one", "from now on tabs"]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"prompt": p, "session_id": "s"}))
    out = events.hints(events.read_events(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("hints_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.category for r in spark.table("hints_test").collect()) == ["correction", "preference"]
