"""Ranked search against a plain scorer and its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def model(docs, items, top):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (k, _), c, size in zip(docs, counts, sizes, strict=True):
            score = 0
            for t in set(terms(text)) & set(c):
                m = 100 - 50 + (50 * size * n) // length
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, k is not None, k or 0))
        out += [(item, i + 1, k if some else None, -s) for i, (s, some, k) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "one two und mail"), (2, None), (3, ""), (None, "the Quick brown FOX"), (4, "a a A"), (5, "w1x1 w2x2 w3x3 lazy"), (5, "w1x1 w2x2 w3x3 lazy"), (6, "zzz-nowhere"), (7, "über 中文 example org 10 card end")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS k", "2 AS terms", "3 AS item", "4 AS score")


@pytest.mark.parametrize("name", ["edge", "empty"])
@pytest.mark.parametrize("top", [2, 50])
def test_hostile(request, items, name, top):
    table = request.getfixturevalue(name)
    assert got(lexical.search(table, items, top)) == model([(r.doc_id, r.text) for r in table.collect()], ITEMS, top)


def test_no_items(spark, edge):
    for rows in ([], [(1, None)]):
        out = lexical.search(edge, spark.createDataFrame(rows, "item_id long, text string"))
        assert out.count() == 0 and set(out.columns) == {"item_id", "rank", "doc_id", "score"}


def topics(n, copies=True, seed=5):
    """Documents of eight topics with words of their own and common ones; with ``copies`` a third are equal."""
    rng = random.Random(seed)
    own = [[f"t{k}w{i}" for i in range(40)] for k in range(8)]
    made = [" ".join(rng.choices(own[k % 8], k=rng.randrange(5, 30)) + rng.choices(["the", "of", "and", "in"], k=8)) for k in range(n)]
    return [(i, made[i] if i % 3 or not copies else made[3]) for i in range(n)]


def test_rounds_and_stops(spark, monkeypatch):
    """Small shards, several rounds and batches of items: same rows, though most shards are never visited."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", 16)
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "BATCH_TERMS", 25)
    calls, visit = [], lexical.visit

    def watched(index, batch, low, high, least, top):
        bounds = np.array([r.bounds for r in index.select("bounds").collect()])
        calls.append((((bounds >= low) & (bounds < high)).sum(), bounds.size, len(batch.vocabulary)))
        return visit(index, batch, low, high, least, top)

    monkeypatch.setattr(lexical, "visit", watched)
    rows = topics(1200)
    queries = [(k, " ".join(f"t{k % 8}w{i}" for i in range(k, k + 9)) + " the") for k in range(10)]
    got_ = got(lexical.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 5))
    assert got_ == model(rows, queries, 5)
    assert len(calls) > 4 and sum(c[0] for c in calls) < 0.4 * sum({c[1:]: c[1] for c in calls}.values())


def test_bisection_gathers_topics(spark):
    """Documents of one topic land next to each other, though the sample lists the topics by turns."""
    rows = topics(800, copies=False)
    number = {f"t{k}w{i}": k * 40 + i for k in range(8) for i in range(40)}
    found = [(d, number[t]) for d, (_, text) in enumerate(rows) for t in set(text.split()) if t in number]
    of, term = np.array(found).T
    order = np.lexsort((term, of))
    model_ = lexical.fit_bisection(len(rows), of[order], term[order], 8 * 40, depth=3)
    leaf, _ = model_.route(len(rows), of[order], term[order])
    own = np.arange(len(rows)) % 8
    pure = sum(Counter(own[leaf == x]).most_common(1)[0][1] for x in set(leaf))
    assert pure > 0.9 * len(own)


def test_index_holds_every_row(spark, more_docs, middle):
    items = spark.read.parquet(f"{middle}/benchmark.parquet")
    batch = next(lexical.item_batches(items, "text", "item_id"))
    batch.weight = np.ones(len(batch.term), np.int64)
    rows = lexical.count_terms(more_docs, batch.vocabulary, lexical.sample_bisection(more_docs, batch.vocabulary, "text", "doc_id"), "text", "doc_id")
    index = lexical.build_index(rows, batch, 1000, 100_000)
    assert sorted(r.k for r in index.select(F.explode("keys").alias("k")).collect()) == sorted(r.doc_id for r in more_docs.collect())


def test_sql(spark, middle):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{middle}/{name}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.OP11_SQL})").fetchall()
    assert got(lexical.op11_lexical_search(spark, middle)) == sorted(want, key=str)
