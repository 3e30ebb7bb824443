"""The pipeline against its stages, and its SQL twins against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadpulse.llm import decontaminate, quality
from roadpulse.llm.queries import all_queries
from roadpulse.llm.shared import stored, table
from roadpulse.llm.sql import all_sql
from tests.llm import brute


def test_stages_keep_columns_and_decide(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), "stage")
        seen.append((name, before, docs))
    assert all(after.columns == columns for _, _, after in seen[:-1])
    (_, given, judged), (_, _, single), (_, _, cut), (_, _, clean), (_, _, coded) = seen
    kept = quality.apply_policy(quality.ledger(given.select("doc_id", "text")), "v2").where("kept")
    assert {r.doc_id for r in judged.collect()} == {r.doc_id for r in kept.collect()}
    prints = [(r.doc_id, brute.simhash(r.text)) for r in judged.collect()]
    assert {r.doc_id for r in single.collect()} == set(brute.groups(prints).values())
    left = {r[0]: r[4] for r in brute.repeats([(r.doc_id, r.text) for r in single.collect()])}
    whole = {r.doc_id: r.text for r in cut.collect()}
    assert set(whole) == set(left)
    assert all(brute.sha(whole[d]) == left[d] for d in whole if len(whole[d]) == len(whole[d].encode()))
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    bad = {r[0] for r in brute.decontamination(list(whole.items()), items) if r[5]}
    assert {r.doc_id for r in clean.collect()} == set(whole) - bad
    assert coded.count() == clean.count() and coded.where("n_tokens <> size(token_ids)").count() == 0
    run = corpus_pipeline.run(spark, sf)
    assert run.columns == coded.columns
    assert run.exceptAll(coded).count() == 0 and run.count() == coded.count()


def test_stages_on_edge_and_empty_tables(spark, sf):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "one two three four five six seven eight nine ten eleven"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("lang", "source", "n_words", "_row", "_text", "fp")}
    )
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert stage(spark, docs, sf).count() <= len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 1


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_sql_twin(spark, sf, name):
    found = all_queries()[name](spark, sf)
    with duckdb.connect() as db:
        for t in ("documents", "pages"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = db.sql(all_sql()[name])
        columns = sorted(found.columns)
        assert sorted(want.columns) == columns
        rows = want.select(", ".join(columns)).fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=key) == sorted(rows, key=key)


def test_a_text_just_at_the_contamination_bound(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(n, item + " x" * (n - 13)) for n in (260, 261)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [261]
