"""Statistics and recurrence over whole tables, counted once more in plain Python."""

import re
from collections import Counter

import duckdb

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


def test_frequencies_of_all_terms_of_all_rows(spark):
    want = Counter()
    for (t,) in duckdb.sql(f"SELECT text FROM read_parquet('{SF}/conversations.parquet')").fetchall():
        want.update(set(re.findall(r"[^\W_]+", (t or "").lower())))
    got = {r.term: r.df for r in registry.QUERIES["term_document_frequency"](spark, SF).collect()}
    assert got == want


def _token_sets():
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') ORDER BY doc_id").fetchall()
    sets = {d: frozenset(re.findall("[a-z0-9]{2,}", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in rows}
    return {d: s for d, s in sets.items() if len(s) >= 5}


def _alike(a, b):
    return 100 * len(a & b) >= 60 * len(a | b)


def test_similar_documents(spark):
    first = {}
    for d, s in _token_sets().items():
        first.setdefault(s, d)
    want = Counter(first[a] for a in first for b in first if a != b and _alike(a, b))
    got = {r.id: r.n_links for r in registry.QUERIES["similar_documents"](spark, SF).collect()}
    assert want and got == want


def test_recurring_documents(spark):
    groups, want = [], {}
    for d, s in _token_sets().items():
        home = next((g for g in groups if _alike(s, g[1])), None)
        if home is None:
            groups.append(home := (d, s))
        want[d] = home[0]
    got = {r.rowid: r.founder for r in registry.QUERIES["recurring_documents"](spark, SF).collect()}
    assert got == want and len(groups) < len(want)
