"""Ingestion, turn digests, briefs, curation, encoders, the graph's page: on small files and tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.wordpiece import WordPiece, normalize, words
from lodestone.operators import briefing, condense, curate, encoders, graph, ingest, vectors, work
from lodestone.sources import transcripts, weights
from lodestone.streaming import events

SAID = "we found that the linker flag was missing from the release build and put it back where it belongs"


def line(kind, content, **more):
    return json.dumps({"type": kind, "message": {"role": kind, "content": content}, "timestamp": more.pop("ts", "2026-03-01T10:00:00Z"), "sessionId": "sess", **more})


def use(name, **args):
    return {"type": "tool_use", "name": name, "input": args}


TURN = [
    line("user", "an older ask that is over now"),
    line("assistant", [use("Edit", file_path="/a/old.py")]),
    line("user", "please fix the failing release build"),
    line("assistant", [{"type": "text", "text": "looking"}, use("Bash", zeta="last first", command="# why\n  make all; echo", flag=True, depth=3)]),
    line("user", [{"type": "tool_result", "is_error": True, "content": [{"type": "text", "text": "boom"}, {"type": "text", "text": "bang " * 400}]}]),
    line("assistant", [use("Edit", file_path="/a/b/main.cpp"), use("Write", file_path="main.cpp"), use("Skill", skill="review"), use("Task", subagent_type="scout")]),
    line("user", [{"type": "text", "text": "<system-reminder> not a person"}]),
    line("assistant", SAID),
    "not json", "", line("assistant", "beside the point " * 9, isSidechain=True),
]


@pytest.fixture
def project(tmp_path):
    (tmp_path / "in" / "-root-work").mkdir(parents=True)
    (tmp_path / "in" / "-root-work" / "t1.jsonl").write_text("\n".join(TURN))
    return tmp_path


def test_tool_text_keeps_the_order_of_arguments_and_counts_bytes(spark, project):
    e = {r.line_no: r for r in transcripts.parse_entries(transcripts.read_transcripts(spark, str(project / "in"))).collect()}
    assert e[3].text == "Bash last first # why\n  make all; echo"
    assert e[4].kind == "UserTool" and e[4].text.startswith("boom bang") and len(e[4].text.encode()) == transcripts.TOOL_BYTES
    assert e[6].kind == "UserHuman" and e[7].session == "sess" and 8 not in e and 10 not in e


def test_last_turn(spark, project):
    d = work.digest(work.turn_steps(transcripts.messages(transcripts.read_transcripts(spark, str(project / "in"))))).head()
    assert (d.ask, d.files, d.commands, d.skills, d.failures, d.outcome) == ("please fix the failing release build", ["main.cpp"], ["make all"], ["review", "agent:scout"], 1, SAID)
    entry = work.capture(spark.createDataFrame([d]), F.lit(1784650211)).head().entry
    assert entry == f"- [2026-07-21 16:10] (note) {d.ask}\n    files: main.cpp  ·  ran: make all  ·  skills: review, agent:scout  ·  1 failed\n    did: {SAID}\n"


def test_mere_talk_has_no_details(spark):
    row = ("f", "No, that is wrong, use tabs", [], [], [], 2, "ok then")
    df = spark.createDataFrame([row, ("g", "thanks", [], [], [], 0, "")], "file string, ask string, files array<string>, commands array<string>, skills array<string>, failures int, outcome string")
    assert [r.entry for r in work.capture(df, F.lit(0)).collect()] == ["- [1970-01-01 00:00] (correction?) No, that is wrong, use tabs\n"]


def test_inbox(spark, tmp_path):
    path = "file://" + str(tmp_path / "inbox")
    for text in ("- [a] (note) one\n    did: x\n", "- [b] (note) two\n"):
        work.append_inbox(spark.createDataFrame([("p", text)], "project string, entry string"), path)
    lines = spark.read.text(path)
    assert [(r.project, r.signals) for r in work.inbox_counts(lines).collect()] == [("p", 2)]


def test_state_goes_on_with_the_next_section(spark):
    rows = spark.createDataFrame([("p", "s1", "2026-01-02T"), ("p", "s2", "2026-01-03T"), ("q", "s3", "2026")], "project string, session string, ts string")
    make = lambda xs: spark.createDataFrame(xs, "project string, nth int, line string")
    opened, done = make([("p", 1, "short"), ("p", 2, "x" * 100), ("p", 3, "never tried")]), make([("p", 1, "fits"), ("q", 1, "y" * 300)])
    got = {r.project: r.state for r in briefing.project_states(rows, opened, done, 110).collect()}
    assert got == {"p": "[state] p — 2 session(s) on file, last 2026-01-03:\nopen · short\ndone · fits"}


def test_session_starts(spark):
    pages = spark.createDataFrame([(f"{i}.md", f"n{i}", t) for i, t in enumerate(["# A\n\nfirst line", "", "# only"] + ["x"] * 7)], "file string, session string, text string")
    menu = briefing.topics(pages)
    assert menu.head().topics == "n0 — first line | n1 — (empty) | n2 — (empty) | n3 — x | n4 — x | n5 — x | n6 — x | n7 — x | +2 more"
    e = spark.createDataFrame([(1, "p", "startup"), (2, "p", "compact"), (3, "z", "resume")], "eid int, project string, source string")
    signals = spark.createDataFrame([("p", 7), ("z", 4)], "project string, signals long")
    states = spark.createDataFrame([("p", "[state] p: x")], "project string, state string")
    loops = spark.createDataFrame([(i, f"loop {i}") for i in (1, 2, 3, 4)], "nth int, line string")
    got = {r.eid: json.loads(r.reply) for r in briefing.nudges(e, signals, states, loops, menu).collect()}
    text = {i: g.get("hookSpecificOutput", {}).get("additionalContext", "") for i, g in got.items()}
    assert text[1].startswith("7 notes") and "[state] p: x" in text[1] and "loop 3" in text[1] and "loop 4" not in text[1] and "n0 — first line" in text[1] and "kB]" in text[1]
    assert "[state] p: x" in text[2] and "loop" not in text[2] and got[3] == {"continue": True}


def test_ingest_is_incremental(spark, project):
    path = "file://" + str(project / "in")
    store, n = ingest.ingest_transcripts(spark, path, ingest.Store.empty(spark))
    rows = store.rows.orderBy("rowid").collect()
    assert n == 1 and [(r.role, r.project) for r in rows] == [("user", "work"), ("user", "work"), ("assistant", "work")]
    assert store.work.count() == 2 and [r.rowid for r in rows] == [1, 2, 3]
    again, n = ingest.ingest_transcripts(spark, path, store)
    assert n == 0 and again.rows.count() == 3
    # a changed file loses its rows and vectors; a blocked key stays out; a second file waits for its run
    with (project / "in" / "-root-work" / "t1.jsonl").open("a") as f:
        f.write("\n" + line("user", "one more ask of four words", ts="2026-03-02T"))
    (project / "in" / "-root-work" / "t2.jsonl").write_text(line("user", "please fix the failing release build") + "\n" + line("user", "asked in another file"))
    key = f"sess|2026-03-01T10:00:00Z|user|{'an older ask that is over now'}"
    blocked = ingest.Store(store.rows, store.work, store.files, spark.createDataFrame([(key,)], "key string"), spark.createDataFrame([(2, [1.0])], "rowid bigint, embedding array<float>"))
    first, n = ingest.ingest_transcripts(spark, path, blocked, per_run=1)
    assert n == 1 and sorted(r.text for r in first.rows.collect()) == sorted(["please fix the failing release build", SAID, "one more ask of four words"]) and first.vectors.count() == 0
    second, n = ingest.ingest_transcripts(spark, path, first)
    assert n == 1 and sorted(r.text for r in second.rows.collect())[0] == "asked in another file" and second.rows.count() == 4
    assert second.rows.select("rowid").distinct().count() == 4
    (project / "in" / "-root-work" / "t2.jsonl").unlink()
    assert ingest.sweep(second, ingest.listing(spark, path, "*.jsonl")).rows.count() == 3


def test_ingest_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nSee [[b]]")
    (tmp_path / "b.md").write_text("text of b")
    store = ingest.ingest_notes(spark, "file://" + str(tmp_path), ingest.Store.empty(spark), "wiki")
    assert sorted((r.session, r.role) for r in store.rows.collect()) == [("a", "wiki"), ("b", "wiki")]
    (tmp_path / "b.md").write_text("a longer text of b")
    store = ingest.ingest_notes(spark, "file://" + str(tmp_path), store, "wiki")
    assert store.rows.count() == 2 and store.rows.where("session = 'b'").head().text == "a longer text of b"


def test_distill_without_replies_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "text", "", "assistant", "s", "t"), (2, "more", "", "user", "s", "t")], "rowid long, text string, asks string, role string, session string, ts string")
    none = spark.createDataFrame([], "key string, gist string")
    _, table = curate.distill(rows, none, lambda rs: ['{"error": {"message": "busy"}}'] * len(rs))
    assert table.count() == 0


def test_words():
    assert words(normalize("Größe, don't stop!")) == ["große", ",", "don", "'", "t", "stop", "!"]
    assert words(normalize("日本x Łódź ø​")) == ["日", "本", "x", "lodz", "o"]


def test_pieces():
    p = WordPiece({t: i for i, t in enumerate(["[UNK]", "un", "##aff", "##able", "a", "##b", "."])}, longest=8)
    assert p.encode("unaffable.") == [0, 6] and WordPiece(p.vocab).encode("unaffable ab ac") == [1, 2, 3, 4, 5, 0]
    assert p.median_bytes == 3
    with pytest.raises(ValueError, match="not in the vocabulary"):
        WordPiece({"a": 1})
    raw = json.dumps({"model": {"vocab": {"[X]": 0, "a": 1, "@b": 2}, "unk_token": "[X]", "continuing_subword_prefix": "@"}})
    assert WordPiece.of_json(raw).encode("ab c") == [1, 2, 0]


def test_tensor_files():
    v = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.zeros(0, np.float32)}
    raw = weights.pack_tensors(v)
    got = weights.tensors(raw)
    assert (got["a"] == v["a"]).all() and got["b"].size == 0
    with pytest.raises(ValueError, match="past the end"):
        weights.tensors(raw[:-4])
    for bad in (b"", b"\0" * 8, b"\xff" * 16, (2).to_bytes(8, "little") + b"{}", (3).to_bytes(8, "little") + b"[1]"):
        with pytest.raises(ValueError):
            weights.tensors(bad)
    head = json.dumps({"i": {"dtype": "I64", "shape": [1], "data_offsets": [0, 8]}}).encode()
    with pytest.raises(ValueError, match="no 32-bit"):
        weights.tensor(weights.tensors(len(head).to_bytes(8, "little") + head + b"\0" * 8), "i")


VOCAB = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "a", "b", "##b", "c"])}


def model(hidden=8, layers=2, heads=2):
    r = np.random.default_rng(3)
    v = {"embeddings.word_embeddings.weight": (len(VOCAB), hidden), "embeddings.position_embeddings.weight": (16, hidden), "embeddings.token_type_embeddings.weight": (2, hidden)}
    for i in range(layers):
        p = f"encoder.layer.{i}."
        for n, shape in (("attention.self.query", (hidden, hidden)), ("attention.self.key", (hidden, hidden)), ("attention.self.value", (hidden, hidden)), ("attention.output.dense", (hidden, hidden)), ("intermediate.dense", (12, hidden)), ("output.dense", (hidden, 12))):
            v |= {p + n + ".weight": shape, p + n + ".bias": shape[:1]}
        for n in ("attention.output.LayerNorm", "output.LayerNorm"):
            v |= {p + n + ".weight": (hidden,), p + n + ".bias": (hidden,)}
    v |= {"embeddings.LayerNorm.weight": (hidden,), "embeddings.LayerNorm.bias": (hidden,)}
    config = {"hidden_size": hidden, "num_hidden_layers": layers, "num_attention_heads": heads, "intermediate_size": 12, "max_position_embeddings": 16, "vocab_size": len(VOCAB)}
    return config, {k: r.normal(size=s).astype(np.float32) for k, s in v.items()}


def plain_bert(config, v, ids):
    """One number after the other."""
    import math

    h, heads = config["hidden_size"], config["num_attention_heads"]
    w = h // heads

    def norm(x, p):
        m = sum(x) / h
        var = sum((y - m) ** 2 for y in x) / h
        return [(y - m) / math.sqrt(var + 1e-12) * g + b for y, g, b in zip(x, v[p + ".weight"], v[p + ".bias"], strict=True)]

    def lin(x, p):
        return [sum(a * b for a, b in zip(row, x, strict=True)) + bias for row, bias in zip(v[p + ".weight"].tolist(), v[p + ".bias"].tolist(), strict=True)]

    x = [norm([float(a + b + c) for a, b, c in zip(v["embeddings.word_embeddings.weight"][i], v["embeddings.position_embeddings.weight"][k], v["embeddings.token_type_embeddings.weight"][0], strict=True)], "embeddings.LayerNorm") for k, i in enumerate(ids)]
    for layer in range(config["num_hidden_layers"]):
        p = f"encoder.layer.{layer}."
        q, k, val = ([lin(t, p + f"attention.self.{n}") for t in x] for n in ("query", "key", "value"))
        out = []
        for i in range(len(x)):
            ctx = []
            for a in range(heads):
                s = slice(a * w, a * w + w)
                scores = [math.exp(sum(m * n for m, n in zip(q[i][s], kk[s], strict=True)) / math.sqrt(w)) for kk in k]
                ctx += [sum(e / sum(scores) * vv[s][d] for e, vv in zip(scores, val, strict=True)) for d in range(w)]
            y = norm([a + b for a, b in zip(x[i], lin(ctx, p + "attention.output.dense"), strict=True)], p + "attention.output.LayerNorm")
            f = [0.5 * z * (1 + math.erf(z / math.sqrt(2))) for z in lin(y, p + "intermediate.dense")]
            out.append(norm([a + b for a, b in zip(y, lin(f, p + "output.dense"), strict=True)], p + "output.LayerNorm"))
        x = out
    length = math.sqrt(sum(a * a for a in x[0]))
    return [a / length for a in x[0]]


def test_transformer_against_plain_arithmetic():
    config, v = model()
    b = encoders.Bert(WordPiece(VOCAB), config, v)
    got = b.encode(["ab c", "", "c " * 50])
    for row, ids in zip(got, ([1, 3, 5, 6, 2], [1, 2], [1, *[6] * 14, 2]), strict=True):
        assert row == pytest.approx(plain_bert(config, v, ids), abs=2e-5)
    prefixed = encoders.Bert(WordPiece(VOCAB), config, {"bert." + k: x for k, x in v.items()})
    assert (prefixed.encode(["ab c"]) == got[:1]).all()
    for bad in ({"hidden_size": 7}, {"position_embedding_type": "relative"}, {"vocab_size": 9}, {"max_position_embeddings": 3}):
        with pytest.raises(ValueError):
            encoders.Bert(WordPiece(VOCAB), config | bad, v)


def test_kernels():
    x = np.array([[1.0, 2.0, 3.0], [1000.0, 1000.0, 1000.0]])
    assert encoders.softmax(x).sum(-1) == pytest.approx([1, 1]) and encoders.softmax(x)[1] == pytest.approx([1 / 3] * 3)
    assert encoders.gelu(np.array([0.0, 10.0, -10.0])) == pytest.approx([0, 10, 0], abs=1e-6)
    n = encoders.layer_norm(np.arange(8.0)[None], np.ones(8), np.zeros(8), 0.0)
    assert n.mean() == pytest.approx(0) and n.std() == pytest.approx(1)


def test_static_vectors_from_a_folder(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(len(VOCAB), 4)).astype(np.float32)
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"vocab": VOCAB, "unk_token": "[UNK]"}}))
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "model.safetensors").write_bytes(weights.pack_tensors({"embeddings": m}))
    enc = encoders.load_encoder(spark, "file://" + str(tmp_path))
    want = m[[3, 5, 6]].mean(0)
    assert enc.encode(["ab zz c", ""])[0] == pytest.approx(want / np.linalg.norm(want), abs=1e-6) and not enc.encode([""]).any()
    rows = spark.createDataFrame([(1, "ab c"), (2, "c"), (3, None)], "rowid long, text string")
    have = spark.createDataFrame([(2, [0.0] * 4)], "rowid long, embedding array<float>")
    got = {r.rowid: r.embedding for r in vectors.extend(rows, have, enc).collect()}
    assert got[1] == pytest.approx(enc.encode(["ab c"])[0], abs=1e-6) and got[2] == [0.0] * 4 and len(got) == 3
    with pytest.raises(ValueError, match="dimensions"):
        vectors.extend(rows, spark.createDataFrame([(2, [0.0])], "rowid long, embedding array<float>"), enc)
    assert {r.rowid: r.ids for r in encoders.piece_ids(rows, enc.pieces).collect()} == {1: [3, 5, 6], 2: [6], 3: []}


def test_neighbours_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    m = np.round(r.normal(size=(300, 5)), 1)
    m[50:90] = m[7]  # ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "rowid long, embedding array<float>")
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 300, 30)], "qid long, query array<float>")
    f = m.astype(np.float32).astype(np.float64)
    want = {(i, k, j) for i in range(0, 300, 30) for k, j in enumerate(np.lexsort((np.arange(300), np.sqrt(((f - f[i]) ** 2).sum(1))))[:20].tolist())}
    assert {(x.qid, x.rank, x.rowid) for x in vectors.knn(v, q, 20).collect()} == want
    monkeypatch.setattr(vectors, "QUERY_BYTES", 100)
    assert {(x.qid, x.rank, x.rowid) for x in vectors.knn(v, q, 20).collect()} == want


def test_graph_and_page(spark, tmp_path):
    rows = spark.createDataFrame([(1, "see [[B]] [[gone]]", "wiki", "p", "a", "2026-01-01"), (2, "note", "memory", "p", "B", "2026-01-01"), (3, "said </script>", "user", "p", "s", "2026-01-02")], "rowid long, text string, role string, project string, session string, ts string")
    code = spark.read.json(spark.sparkContext.parallelize([json.dumps({"nodes": [{"id": "x"}, {"id": "y", "label": "Y", "file_type": "py", "source_file": "y.py"}, {"id": "z"}], "links": [{"source": "x", "target": "y"}, {"source": "x", "target": "z"}]})]))
    nodes, links = graph.build_graph(rows, graph.code_graph(code, 2))
    kinds = sorted((r.kind, r.source, r.target) for r in links.collect())
    assert kinds == [("code", "c:x", "c:y"), ("leaf", "center", "m:1"), ("leaf", "p:p", "m:2"), ("leaf", "s:s", "m:3"), ("spine", "center", "code:repo"), ("spine", "center", "p:p"), ("spine", "p:p", "s:s"), ("tether", "code:repo", "c:x"), ("tether", "code:repo", "c:y"), ("wikilink", "m:1", "m:2")]
    data = graph.payload(nodes, links)
    assert "</" not in data and json.loads(data)["stats"]["roles"] == {"memory": 1, "user": 1, "wiki": 1} and len(json.loads(data)["nodes"]) == 9
    graph.page(spark, data, "file://" + str(tmp_path / "page"))
    assert "const DATA = {" in spark.read.text("file://" + str(tmp_path / "page")).head().value
    assert sorted(r.id for r in graph.search_nodes(nodes, links, "SAID").collect()) == ["m:3", "s:s"]
    assert {r.id: r.children for r in graph.child_counts(links).collect()}["center"] == 3


def test_spill_before_condensing(spark, tmp_path):
    body = "\n".join(f"line {i}" for i in range(900))
    e = spark.createDataFrame([("s", "t1", "Bash", body), ("s", "../x", "Bash", body), ("", "t2", "Bash", body), ("s", "t3", "Read", body), ("s", "t4", "Bash", "short")], "session string, tool_use_id string, tool string, body string")
    got = condense.condense_events(e, "file://" + str(tmp_path / "spill")).collect()
    assert [(r.session, r.tool_use_id) for r in got] == [("s", "t1")] and "session=s#t1" in got[0].reply
    assert spark.read.parquet("file://" + str(tmp_path / "spill")).head().body == body


def test_once_without_session(spark):
    df = spark.createDataFrame([("s", "k"), ("s", "k"), ("t", "k"), ("", "k"), (None, "k")], "session string, key string")
    assert events.once(df).count() == 4
