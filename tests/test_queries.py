"""Every core query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from palimpsest.plans import history, hybrid, ledger, memory, night, recall, texts

FOLDER = "/root/testdata/sf0.001"
MODULES = [history, texts, memory, recall, ledger, hybrid, night]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.sql(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return connection


def plain(value):
    return repr(round(float(value), 5) + 0.0) if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(tuple(plain(v) for v in row) for row in duck.sql(f"select {listed} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_facade(spark):
    from palimpsest.api import Memory

    memory_of = Memory(spark, FOLDER)
    assert memory_of.recall("battery of the greenhouse", 5).count() == 5
    assert memory_of.facts("works").count() <= memory_of.facts("works", status=None).count()
    assert memory_of.scope("last month", 1758369600.0) == (1754006400.0, 1756684800.0) and memory_of.scope("nothing", 0.0) is None
    vector = memory_of.table("vectors").where("kind = 'window' and vec is not null and size(vec) = 64").orderBy("rid").first().vec
    asked = memory_of.ask("when was the locker checked last month?", vector, 1771970454.0, 5).collect()
    assert 0 < len(asked) <= 5 and len({r.id for r in asked}) == len(asked)
    assert memory_of.about("in May 2025", 1771970454.0).count() >= memory_of.said_in("in May 2025", 1771970454.0).count() > 0
    assert 0 < memory_of.between("2025-05-01", "2025-06-01", 0.0).count() < memory_of.between("", "", 0.0).count()
    assert set(memory_of.report()) == {"counts", "speakers", "nights", "review", "runs", "provenance"}


def test_windows_of_documents(spark):
    """Windows and sentences hold all letters of their texts in order, and keep to their bounds."""
    import re

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got: dict = {}
    for r in QUERIES["document_windows"](spark, FOLDER).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append(r)
    letters = lambda s: re.sub(r"[^\w]", "", s)
    for doc_id, text in docs.items():
        rows = got.get(doc_id, [])
        assert [r.position for r in rows] == list(range(len(rows)))
        whole = all("```" not in r.text for r in rows)
        assert all(len(r.text) <= 480 for r in rows) or not whole
        if whole:
            assert letters("".join(r.text for r in rows)) == letters(text)
    texts = {r.id: r.text for r in spark.read.parquet(f"{FOLDER}/windows.parquet").where("text is not null").collect()}
    found: dict = {}
    for r in QUERIES["window_sentences"](spark, FOLDER).orderBy("id", "position").collect():
        found.setdefault(r.id, []).append(r.sentence)
    assert all(letters("".join(found.get(i, []))) == letters(t) for i, t in texts.items())


def test_spans_of_windows(spark):
    """The query's spans are those of each text on its own."""
    from palimpsest.operators.spans import extract_spans
    from palimpsest.plans.base import clean_windows

    rows = clean_windows(spark, FOLDER).where("text is not null").collect()
    want = sorted((r.id, *x[:4]) for r in rows for x in extract_spans(r.text, r.said))
    found = QUERIES["window_spans"](spark, FOLDER).collect()
    assert sorted((r.id, r.start, r.end, r.type, r.value) for r in found) == want and len(want) > 50
    assert sum(r.spans for r in QUERIES["span_counts"](spark, FOLDER).collect()) == len(want)
