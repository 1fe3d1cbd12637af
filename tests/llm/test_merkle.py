"""Merkle manifest against a plain recursion and against its SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root and, per leaf, its steps (left hex, right hex)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p - p % 3
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        at = [p // 3 for p in at]
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def model(rows):
    groups = defaultdict(list)
    for r in rows:
        alt = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
            alt[4] = r[4].replace("\n", "")
        groups[r[1]].append((r[0], leaf_of(r), leaf_of(alt)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = [tree([x[1] for x in groups[g]]) for g in order]
    if not subs:
        return []
    root, tops = tree([s[0] for s in subs])
    out = []
    for g, (sub, paths), top in zip(order, subs, tops, strict=True):
        for (k, leaf, alt), path in zip(groups[g], paths, strict=True):
            at = alt
            for left, right in path + top:
                at = h(left + at + right)
            out.append((k, leaf, sub, root, h("".join(a + b for a, b in path + top)), at, at == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def run(table, spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    table.write.parquet(path)
    return got(merkle.op12_merkle_manifest(spark, str(tmp_path)))


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_tables(request, spark, tmp_path, name):
    table = request.getfixturevalue(name)
    rows = [tuple(r) for r in table.select(*FIELDS).collect()]
    assert run(table, spark, tmp_path) == model(rows)


@pytest.mark.parametrize("one_task", [0, 2000])
def test_every_size(spark, tmp_path, monkeypatch, one_task):
    """Groups of 1 to 30 rows, one of a third of all rows, equal rows, line ends."""
    monkeypatch.setattr(merkle, "ONE_TASK", one_task)
    rows = [(1000 * n + i, f"s{n:02}" if n else None, "en", i, f"a\nb {i}\n") for n in range(13) for i in range(n or 40)]
    rows += [(7, "same", None, None, "x\n")] * 30
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert run(table, spark, tmp_path) == model(rows)


def test_sql(spark, middle):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{middle}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.OP12_SQL})").fetchall()
    assert got(merkle.op12_merkle_manifest(spark, middle)) == sorted(want, key=str)


def test_store_and_order(spark, edge):
    """The root doesn't depend on the order of rows, any change moves it, and the store holds every level."""
    a, b = merkle.build_manifest(edge, FIELDS), merkle.build_manifest(edge.orderBy(F.rand(3)), FIELDS)
    assert a.root == b.root
    assert a.root != merkle.build_manifest(edge.where("doc_id <> 4"), FIELDS).root
    stored = spark.read.parquet(f"{a.folder}/rows")
    assert stored.groupBy("level").count().count() == len(a.levels) and a.leaves.count() == edge.count()
    assert a.proofs().where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_other_arity(spark, docs):
    made = merkle.build_manifest(docs, FIELDS, group="lang", arity=2)
    proofs = made.proofs()
    assert proofs.where(merkle.fold(F.col("leaf"), F.col("path")) == made.root).count() == docs.count()
    assert proofs.where(F.exists("path", lambda p: F.length(p["left"]) + F.length(p["right"]) > 32)).count() == 0
