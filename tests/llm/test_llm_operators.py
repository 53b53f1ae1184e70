"""Every operator against its plain version, on a driver table and on odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import brute
from lodestone.llm import bpe_automaton, decontaminate, html_cut, lines, packing, quality, setsketch, suffixes, token_counts, wavelet
from lodestone.llm.common import new_path
from lodestone.llm.queries import table, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, text_crc32 string, token string, n_words string, size string"


def _odd():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "ζήτα", "the", "of", "<|endoftext|>", "x1"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    long, shared = prose(6000), prose(60)
    texts = [None, "", " \n\t ", "a", "one two three", long, long, long + " tail", shared + "\n" + prose(80), prose(80) + "\n" + shared, "x" * 5000, "x" * 5000, "\n" * 70]
    texts += ["same line of text here\nsame line of text here\nother", "Same  SPACES\x0b kept", "日本語のテキスト" * 40, "a b   c", "👩‍👩‍👧 emoji\r\nline", "## $$ %% <> || &&" * 20, "ab " * 300]
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


ODD = _odd()


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def corpus(request, spark):
    if request.param == "table":
        df = table(spark, SF, "documents").select("doc_id", "text")
        return df, [tuple(x) for x in df.collect()]
    docs = ODD if request.param == "odd" else []
    df = spark.createDataFrame([(*d, "c", "t", "n", "s") for d in docs], SCHEMA)
    return df, docs


def rows(df, *columns):
    return sorted(tuple(x) for x in df.select(*columns).collect())


def test_wavelet(spark, corpus):
    df, docs = corpus
    path = new_path(spark, "wavelet-test")
    wavelet.write_shards(df, vocabulary("byte_bpe_50k.json"), path, shard_tokens=20_000)
    assert rows(wavelet.read_documents(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == brute.encoded(docs)


def test_new_pieces_are_encoded_together():
    """Pieces of every kind get the library's ids, with few calls for each piece."""
    import cProfile

    import numpy as np
    import pstats

    r = random.Random(8)
    pieces = ["".join(r.choices("abcdefghij", k=9)) for _ in range(6000)]
    pieces = [(" " + p, "\n" + p, p, " " + p + "é", " " + p + "|", " <|endoftext|>" + p)[0 if i % 20 else i // 20 % 6] for i, p in enumerate(pieces)]
    cache, _ = wavelet.encoder(vocabulary("byte_bpe_50k.json"))
    seen = cProfile.Profile()
    flat, lens = seen.runcall(cache.encode, pieces)
    t = brute.tokenizer("byte_bpe_50k.json")
    assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == [t.encode(p, add_special_tokens=False).ids for p in pieces]
    assert pstats.Stats(seen).total_calls < 5 * len(pieces)


def test_lookup_in_shards(spark):
    docs = [(i, "the cat and the dog " * (i % 5)) for i in range(40)]
    path = new_path(spark, "wavelet-lookup")
    wavelet.write_shards(spark.createDataFrame(docs, "doc_id bigint, text string"), vocabulary("byte_bpe_50k.json"), path, shard_tokens=100)
    t = brute.tokenizer("byte_bpe_50k.json")
    ids = [x for _, text in docs for x in [*t.encode(text, add_special_tokens=False).ids, 0]]
    for token in (0, t.encode(" the", add_special_tokens=False).ids[0], 49999):
        found = wavelet.lookup(spark, path, token).collect()
        assert sum(r.n for r in found) == ids.count(token)
        assert all((r.first_at is None) == (r.n == 0) for r in found)


def test_wavelet_matrix():
    import numpy as np

    ids = np.random.default_rng(1).integers(0, 37, 3000)
    m = wavelet.WaveletMatrix.build(ids)
    assert (m.decode() == ids).all() and (m.access(np.arange(3000)) == ids).all()
    for t in (0, 5, 36):
        assert m.count(t) == (ids == t).sum() and m.rank(t, 1700) == (ids[:1700] == t).sum()
        assert m.select(t, 3) == np.flatnonzero(ids == t)[3]


def test_quality(corpus):
    df, docs = corpus
    got = rows(quality.quality(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted((d, *brute.base_rules(t)) for d, t in docs)
    assert quality.quality(df).where("kept and base_failed").count() == 0


def test_quality_verdict(corpus):
    df, docs = corpus
    assert rows(quality.quality(df), "doc_id", "kept") == sorted((d, brute.passes(t)) for d, t in docs)


def test_each_rule_rejects_something_of_its_own():
    import pyarrow as pa

    r = random.Random(2)
    word = lambda n=6: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prose = " ".join(word() for _ in range(80))
    texts = {
        "symbols": prose + " #" * 20, "word_length": " ".join(word(1) + str(k % 10) * 0 for k in range(90)), "line_copies": prose + "\nsame" * 30, "shouting": prose.upper(),
        "few_letters": " ".join(word(3) + str(1000 + k) for k in range(80)), "gram_copies": prose + " " + " ".join((word(2) + "z" * 60) for _ in range(40)),
    }
    chunk = quality.Chunk(pa.array([*texts.values(), prose]))
    gone = {rule.name: rule.rejects(chunk, quality.np.arange(7)).tolist() for rule in quality.RULES}
    assert all(gone[name][k] for k, name in enumerate(texts)) and not any(g[-1] for g in gone.values())


def test_cascade_order_counts_what_is_left():
    """The second rule rejects the same rows as the first, the third others: it goes second although it rejects fewer."""
    import numpy as np

    gone = np.zeros((100, 3), bool)
    gone[:50, 0] = gone[:49, 1] = gone[60:70, 2] = True
    assert quality.best_order(gone, np.array([1.0, 1.0, 1.0])) == [0, 2, 1]
    assert quality.best_order(gone, np.array([100.0, 1.0, 1.0])) == [1, 2, 0]


def test_quality_order_does_not_matter(corpus):
    df, _ = corpus
    assert rows(quality.quality(df), "doc_id", "kept") == rows(quality.quality(df, tuple(reversed(quality.RULES)), 1), "doc_id", "kept")


def test_idle_workers_keep_no_large_tables(spark):
    """A task that met very many words leaves no table of all of them in its worker."""
    import pyarrow as pa

    r = random.Random(9)
    docs = [(i, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1500))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    assert bpe_automaton.encode_decode(df, vocabulary("byte_bpe_50k.json")).agg(F.sum("n_tokens")).head()[0] > 0

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(a.states) for a, _ in bpe_automaton._compiled.values())] * b.num_rows, pa.int64())], ["id"])

    assert spark.range(0, 8, 1, 8).mapInArrow(held, "id bigint").agg(F.max("id")).head()[0] <= 50_000


def test_automaton_tables_are_small():
    """What a state, its transitions and the pairs of labels tried for it take, on words that mostly make new states."""
    import tracemalloc

    a = bpe_automaton.Automaton(vocabulary("byte_bpe_50k.json"))
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)).encode() for _ in range(4000)]
    tracemalloc.start()
    try:
        for w in words:
            a.word(w)
        taken, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(a.states) > 10_000
    assert taken < 400 * len(a.states), taken / len(a.states)


def test_suffixes(corpus):
    df, docs = corpus
    assert rows(suffixes.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.without_repeats(docs)


def test_suffixes_of_texts_that_share_an_id(spark):
    r = random.Random(6)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared, own = prose(120), prose(300)
    docs = [(1, shared + prose(80)), (2, own + shared), (2, prose(50) + own), (2, prose(50) + own), (3, own)]
    got = sorted((x.n_bytes, x.doc_id, x.n_removed) for x in suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert [(d, n) for _, d, n in got] == [(1, 0), (3, 300), (2, 0), (2, 0), (2, 120)]


def test_suffixes_are_shuffled_in_parts(spark, monkeypatch):
    """No shuffle holds all suffixes, and the parts together find what a whole would."""
    docs = [(i, "the same eight words stand before every line of it " + f"{i % 40:03d} and then something else, different {i % 7} times over") for i in range(300)]
    sizes, plain = [], suffixes._reduce

    def spy(packed, solve, kind):
        if kind == suffixes.WINDOW:
            sizes.append(packed.agg(F.sum(F.octet_length("pack"))).head()[0])
        return plain(packed, solve, kind)

    monkeypatch.setattr(suffixes, "_reduce", spy)
    got = rows(suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.without_repeats(docs)
    assert max(sizes) < 0.7 * sum(sizes)


def test_suffixes_with_one_beginning(spark):
    """Very many strings that share their first words, cut between buckets all the same."""
    docs = [(i, "the same eight words stand before every line of it " + f"{i % 40:03d} and then something else, different {i % 7} times over") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(suffixes.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.without_repeats(docs)


def test_decontaminate(spark, corpus):
    df, docs = corpus
    items = [tuple(x) for x in table(spark, SF, "benchmark").collect()] + [(900, "one two"), (901, None), (902, ""), (903, " ".join((docs[5][1] or "a b").split()[:40]) if docs else "q")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = rows(decontaminate.decontaminate(df, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "full")
    assert got == brute.leaks(docs, items)


def test_decontaminate_without_items(spark, corpus):
    df, docs = corpus
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(decontaminate.decontaminate(df, none), "doc_id", "n_hit") == sorted((d, 0) for d, _ in docs)


def test_decontaminate_gives_a_row_for_each_row(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (None, "x c d"), (2, "c d"), (2, "e f"), (3, None)]
    items = [(1, "c d"), (2, "C, d!"), (3, "d"), (None, "a b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in got) == [(0, 3, 2, 3), (1, 4, 4, 3), (1, 4, 4, 3), (2, 2, 0, 0), (2, 2, 2, 3), (3, 0, 0, 0)]


def test_decontaminate_with_a_filter_that_lets_much_through(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1024)
    df = table(spark, SF, "documents").select("doc_id", "text")
    items = [tuple(x) for x in table(spark, SF, "benchmark").collect()] + [(900, "the of")]
    got = rows(decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id bigint, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "full")
    assert got == brute.leaks([tuple(x) for x in df.collect()], items)


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from lodestone.llm.common import shared_dir

    conf = {"spark.checkpoint.dir": "hdfs:/shared/"}
    session = lambda master, held: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: held.get(k, d)), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("yarn", conf)) == "hdfs:/shared"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            shared_dir(session(master, {}))
    assert shared_dir(session("local[4]", {})).startswith("file://")


def test_near(corpus):
    df, docs = corpus
    assert rows(setsketch.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute.near(docs)


def test_token_counts(corpus):
    df, docs = corpus
    assert rows(token_counts.count_tokens(df, vocabulary("word_bpe_49k.json"), 2048), "doc_id", "n_bytes", "n_tokens", "over_limit") == brute.counted(docs)


def test_bpe(corpus):
    df, docs = corpus
    assert rows(bpe_automaton.encode_decode(df, vocabulary("byte_bpe_50k.json")), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.round_trip(docs)


def test_lines(corpus):
    df, docs = corpus
    assert rows(lines.dedup_lines(df).withColumn("text", F.coalesce("text", F.lit("\0"))), "doc_id", "n_removed", "text") == [(d, n, "\0" if t is None else t) for d, n, t in brute.fewer_lines(docs)]


def test_packing(corpus):
    df, docs = corpus
    out = packing.shard_documents(df).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d, size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    slots, load = {}, [0] * 24
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    groups, rows_of = {}, [0] * 24
    for r in out:
        text = dict(docs)[r.doc_id] or ""
        groups.setdefault(text, []).append(r.shard)
        rows_of[r.shard] += 1
    tokens = sum(len(brute.SPACE.findall(t)) for t in groups for _ in groups[t])
    for t, held in groups.items():  # whole, unless no shard has room
        share = max(len(held) * size(t) / sum(load), len(held) / len(docs), len(held) * len(brute.SPACE.findall(t)) / max(tokens, 1))
        assert len(set(held)) == 1 or 24 * share > 1
    if len(docs) > 100:
        largest = max(len(h) for h in groups.values())
        assert max(rows_of) - min(rows_of) <= max(2, largest)
        biggest = max(len(h) * size(t) for t, h in groups.items())
        assert max(load) - min(load) <= max(0.02 * sum(load) / 24, biggest - min(load))


def test_packing_takes_the_highest_dot_product():
    """Item after item against plain sums, and a packing that no move of one item improves."""
    import numpy as np

    r = np.random.default_rng(9)
    for n in (1, 7, 200):
        sizes = np.stack([r.integers(1, 900, n), r.integers(0, 150, n), r.integers(1, 3, n)], 1)
        capacity = np.tile(sizes.sum(0) / 5, (5, 1))
        got = packing.pack(sizes, capacity)
        total = sizes.sum(0)
        left = [[c / t for c, t in zip(row, total, strict=True)] for row in capacity.tolist()]
        share = [[x / t for x, t in zip(row, total, strict=True)] for row in sizes.tolist()]
        for k in sorted(range(n), key=lambda k: (-max(share[k]), -share[k][0], k)):
            dots = [sum(a * b for a, b in zip(row, share[k], strict=True)) for row in left]
            fits = [s for s in range(5) if all(a >= b - 1e-12 for a, b in zip(left[s], share[k], strict=True))] or list(range(5))
            assert got[k] in fits and dots[got[k]] >= max(dots[s] for s in fits) - 1e-12
            left[got[k]] = [a - b for a, b in zip(left[got[k]], share[k], strict=True)]
        after = packing.even(sizes, got, capacity)
        spread = lambda w, c: np.ptp(np.bincount(w, sizes[:, c], 5))
        assert spread(after, 2) <= max(2, spread(got, 2)) and (n < 200 or spread(after, 0) <= 5)


def test_packing_cuts_only_what_no_shard_holds(spark):
    rows_ = [(i, "hot text of many rows") for i in range(900)] + [(1000 + i, f"text {i} " * (1 + i % 40)) for i in range(5000)]
    out = packing.shard_documents(spark.createDataFrame(rows_, "doc_id bigint, text string")).collect()
    text = dict(rows_)
    where = {}
    for r in out:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert [t for t, s in where.items() if len(s) > 1] == ["hot text of many rows"]
    load, slots = [0] * 24, {}
    for r in out:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(load) - min(load) <= 0.002 * sum(load) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 12


@pytest.mark.parametrize("n", [0, 3])
def test_null_ids_and_repeated_rows(spark, n):
    df = spark.createDataFrame([(None, "a b c d e f")] * n + [(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "c d")], "item_id bigint, text string")
    total = n + 3
    assert quality.quality(df).count() == total
    assert suffixes.remove_repeats(df).count() == total
    assert setsketch.near_duplicates(df).count() == total
    assert token_counts.count_tokens(df, vocabulary("word_bpe_49k.json")).count() == total
    assert bpe_automaton.encode_decode(df, vocabulary("byte_bpe_50k.json")).count() == total
    assert lines.dedup_lines(df).count() == total
    assert packing.shard_documents(df).count() == total
    assert decontaminate.decontaminate(df, bench).where("contaminated").count() >= 1


def test_two_texts_of_one_id_do_not_mix(spark):
    """Line 1 of one text is a copy; line 1 of the other text of that id is not and stays."""
    docs = [(1, "first line of it all\na line that is said again"), (2, "something else entirely\na line that is said again"), (2, "more of something else\nan innocent line that occurs once")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got == [(1, docs[0][1], 0), (2, docs[2][1], 0), (2, "something else entirely", 1)]


def test_lines_counted(spark):
    line = "a fuzzy line of some sixty characters that differs by one letter."
    docs = [(1, line + "\n\nown words"), (2, line.replace("sixty", "sixtX") + "\n" + line), (2, line.replace("sixty", "sixtX") + "\n" + line), (3, None)]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_fuzzy) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), width=5).collect())
    assert got == [(1, 3, 0, 0), (2, 2, 2, 1), (2, 2, 2, 1), (3, 0, 0, 0)]


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><article><h1>A story of rivers</h1>"
    "<p>The river &amp; its banks have\n  been described by many people over the years, and each saw another thing.</p>"
    "<p>Others went up to the source, where the water is cold, and wrote long letters about it to their friends.</p></article>"
    "<footer>&copy; 2020 example</footer></body></html>"
)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p><b>open"), (5, "u", "<!-- only"), (6, "u", "<div>" * 3000)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html_cut.extract(pages).collect()}
    assert got[1].text == (
        "A story of rivers\nThe river & its banks have been described by many people over the years, and each saw another thing.\n"
        "Others went up to the source, where the water is cold, and wrote long letters about it to their friends."
    )
    assert got[2].text == got[3].text == got[5].text == got[6].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
