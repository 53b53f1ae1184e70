"""The pipeline against the plain versions, stage by stage, and the text operators' SQL against DuckDB."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
import brute
import corpus_pipeline
from lodestone.llm import lines
from lodestone.plans import more, registry

SF = "/root/testdata/sf0.001"


def _fixture():
    """Documents of which every stage drops some, and benchmark items."""
    r = random.Random(17)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = ["\n".join(prose(40) for _ in range(4)) for _ in range(8)]
    docs += [None, "", "too short", "again and " * 60, "#### " * 40 + prose(60)]
    docs += [docs[0], docs[1].replace(docs[1][70], "#", 1), docs[2] + "\n" + prose(30)]  # lines that stand elsewhere
    one = prose(200).split()
    docs += [" ".join(one), " ".join(one[:100]) + "\n" + " ".join(one[100:])]  # near copies whose lines differ
    item = prose(30)
    docs += [prose(60) + " " + item + "\n" + prose(50)]
    docs += [prose(600) + " " + " ".join(item.split()[5:18]) + " " + prose(300)]  # a whole window, a small share of a long text
    return [(3 * i + 1, t) for i, t in enumerate(docs)], [(1, item), (2, prose(20))]


def test_run_against_plain_versions(spark, tmp_path):
    docs, items = _fixture()
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = [(d, t) for d, t in docs if brute.passes(t)]
    fewer = [(d, t) for d, n, t in brute.fewer_lines(good, lines.SHORT_WIDTH) if n == 0 or brute.SPACE.search(t)]
    stays = {d for d, _, _, kept in brute.near(fewer) if kept}
    single = [(d, t) for d, t in fewer if d in stays]
    leaked = {x[0] for x in brute.leaks(single, items) if x[-1] or x[-2]}
    clean = [(d, t) for d, t in single if d not in leaked]
    assert len(docs) > len(good) > len(fewer) > len(single) > len(clean) > 0
    assert docs[-1][0] in leaked and not next(x for x in brute.leaks(single, items) if x[0] == docs[-1][0])[-2]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(x) for x in got) == brute.round_trip(clean)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(registry.SQL) - set(more.SQL)))
def test_operator_same_as_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(x) for x in got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_odd_rows_pass_through(spark, tmp_path):
    """Nulls, repeated rows, columns with names that the stages use themselves."""
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(n))
    one = prose(90)
    rows = [(1, one, "a", "b", 1), (1, one, "a", "b", 1), (None, prose(80), None, None, None), (2, None, "x", "y", 2), (3, "", "x", "y", 3), (4, prose(70), "r", "s", 4), (4, prose(75), "r", "s", 4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, __row string, key string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[:20]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "__row", "key", "n_words"], name
    assert sorted((x.doc_id or 0, x.text) for x in docs.collect()) == sorted([(0, rows[2][1]), (1, one), (1, one), (4, rows[6][1])])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
