"""Toxicity, the pipeline and the registered queries."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import queries as registered
from barloom.llm import toxicity


def test_toxicity_held_out(spark):
    """On sf0.1, which has enough labelled rows to learn from: about 3,000. sf0.01 has about 300; see the README."""
    large = "/root/testdata/sf0.1"
    out = registered.queries()["op2_toxicity"](spark, large)
    labels = spark.read.parquet(f"{large}/labels.parquet").select("doc_id", "toxic")
    rows = out.where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum(x > y for x in bad for y in good) >= 0.95 * len(bad) * len(good)


def test_counterfactual_penalty():
    import numpy as np

    neutral = ["women sing in the hall", "men sing in the hall"] * 20
    nasty = ["women are awful scum", "awful scum and more scum"] * 20
    texts, y = neutral + nasty, np.array([0] * 40 + [1] * 40)
    loose, tight = toxicity.fit(texts, y, pairing=0.0), toxicity.fit(texts, y, pairing=50.0)
    gap = lambda m: abs(np.diff(toxicity.scores_of(_texts(["women talk", "men talk"]), *m)))[0]
    assert gap(tight) <= gap(loose) + 1e-9
    assert toxicity.swapped("Women and men") == "men and women" and toxicity.swapped("nothing") is None


def _texts(x):
    import pyarrow as pa

    return pa.array(x)


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(6, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for model in (toxicity.train(edge, labels), toxicity.train(empty, labels), toxicity.train(edge, labels.limit(0))):
        out = toxicity.score_toxicity(edge, model, out="_score")
        assert out.count() == edge.count() and out.where((F.col("_score") < 0) | (F.col("_score") > 1) | F.col("_score").isNull()).isEmpty()
        assert toxicity.score_toxicity(empty, model).isEmpty()


def test_toxicity_repeated_id(spark):
    """A clean id with far more rows than the sample has ids leaves the toxic rows in it."""
    nasty = [(i, "awful scum and more scum") for i in range(10)]
    clean = [(i, "people sing in the hall") for i in range(10, 20)]
    docs = spark.createDataFrame(nasty + clean + [(10, f"people sing in the hall {i}") for i in range(200)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_rows=20)
    bad, good = toxicity.scores_of(_texts(["awful scum", "people sing"]), *model)
    assert bad > 0.5 > good


@pytest.mark.parametrize("name", list(registered.oracle_sql()))
def test_oracles(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = con.execute(registered.oracle_sql()[name]).df()
    got = registered.queries()[name](spark, small).toPandas()[list(want.columns)]
    key = list(want.columns)
    a, b = (d.sort_values(key).reset_index(drop=True).astype(str) for d in (got, want))
    assert a.equals(b)


def test_pipeline(spark, small):
    from barloom.llm import pipeline as corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small)
        assert after.columns == docs.columns, name
        assert not after.isEmpty()
        before = spark.createDataFrame(after.toArrow())
    packed = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert packed.where("length > 1024").isEmpty() and packed.select("sequence_id").distinct().count() > 1


def test_pipeline_keeps_one_of_each_group(spark, small):
    from barloom.llm import pipeline as corpus_pipeline
    from barloom.llm.ngram_join import near_duplicates

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    component = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    got = [component[r.doc_id] for r in kept.collect()]
    assert sorted(got) == sorted(set(component.values()))


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_stages_on_hostile_tables(request, spark, small, name):
    """Every stage on nulls, empty and long texts, repeated rows and clashing names, and on an empty table."""
    from barloom.llm import pipeline

    table = request.getfixturevalue(name)
    clash = ["_score", "_key", "_other", "_again", "score", "key", "other", "again", "digest", "spans", "pii_spans", "pii_digest", "component_id", "source_size_"]
    docs = table.withColumns({c: F.lit("x") for c in clash if c not in table.columns})
    for stage, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, small)
        assert out.columns == docs.columns, stage
        rows = out.collect()
        assert all(r[c] == "x" for r in rows for c in clash if c not in table.columns), stage
        if name == "edge" and stage in ("pii", "near_duplicates"):
            ids = {r.doc_id for r in rows}
            assert {1, 2, 3, 9, None} <= ids and (stage == "pii" or 7 not in ids)
    packed = pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.isEmpty() == (name == "empty")
