"""Ranked lexical search over a clustered index, exact to the last tie.

Documents are put in an order in which neighbours share terms: a recursive graph bisection is fitted on a bounded sample
and every document goes down its tree. Runs of that order are the shards of the index. A shard holds its postings with
each term's largest contribution, so that for every query item a bound of the shard is known. Items visit shards by
falling bound and stop where no bound reaches the score of their last result; places in the order are mapped back to
the documents' keys, which decide ties. All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved
from barloom.llm._words import Words, slices, text_bytes

#: Documents that the bisection is fitted on, expected and twice that at most; the terms it looks at, most frequent first.
SAMPLE_DOCS, MODEL_TERMS = 4096, 16_384
#: Depth of the bisection, and the documents below which a node isn't split.
DEPTH, LEAST = 8, 12
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 512, 1 << 19
#: Items are searched together as long as they have about so many distinct terms, summed over items.
BATCH_TERMS = 1 << 18
#: Shards that an item visits at first, and how much further each round goes.
FIRST, FURTHER = 8, 4

#: Bytes of a term, A-Z lower-cased; every other byte is a space.
FOLDED = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    FOLDED[_lo:_hi] = np.arange(_lo, _hi)
FOLDED[0x41:0x5B] += 32


def term_counts(texts: pa.Array, vocabulary: np.ndarray | None = None):
    """For some texts at a time: their number of terms, and (text, term, occurrences) of each text's distinct terms.

    A term is its 64-bit hash, or its number in the sorted ``vocabulary``; terms that this lacks are only counted.
    """
    for lo, hi in slices(texts):
        raw, offsets = text_bytes(texts.slice(lo, hi - lo))
        words = Words(FOLDED[raw], offsets)
        term, of = words.hashes(), words.text_of()
        n = np.diff(words.first)
        if vocabulary is not None:
            at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1) if len(vocabulary) else np.zeros(len(term), np.int64)
            known = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
            term, of = at[known], of[known]
        order = np.lexsort((term, of))
        term, of = term[order], of[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        yield n, of[first], term[first], np.diff(np.append(first, len(term)))


def lists(of: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of the values of texts 0 to n - 1; ``of`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


@dataclass
class Bisection:
    """Per node and model term the cost of going left less that of going right; node i has the children 2i + 1 and 2i + 2."""

    model_term: np.ndarray
    weight: np.ndarray
    middle: np.ndarray

    def route(self, n: int, of: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each of n documents, and how far right of the middle it is at the last node."""
        at = self.model_term[term] if len(term) else np.zeros(0, np.int64)
        of, at = of[at >= 0], at[at >= 0]
        node, score = np.zeros(n, np.int64), np.zeros(n)
        for _ in range((len(self.middle) + 1).bit_length() - 1):
            score = np.bincount(of, self.weight[node[of], at], n) - self.middle[node]
            node = 2 * node + 1 + (score > 0)
        return node - len(self.middle), score


def _cost(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Bits of the gaps between a term's documents where a of na are left and b of nb are right."""
    return a * np.log2(na / (a + 1)) + b * np.log2(nb / (b + 1))


def fit_bisection(n: int, of: np.ndarray, term: np.ndarray, terms: int, depth: int = DEPTH, rounds: int = 12) -> Bisection:
    """Halve documents again and again so that each half's terms lie close together, swapping pairs that gain most."""
    count = np.bincount(term, minlength=terms)
    kept = np.flatnonzero(count > 1)
    kept = kept[np.argsort(-count[kept], kind="stable")][:MODEL_TERMS]
    model_term = np.full(max(terms, 1), -1, np.int64)
    model_term[kept] = np.arange(len(kept))
    of, term = of[model_term[term] >= 0], model_term[term][model_term[term] >= 0]
    first, m = np.searchsorted(of, np.arange(n + 1)), len(kept)
    model = Bisection(model_term, np.zeros((2**depth - 1, m), np.float32), np.zeros(2**depth - 1, np.float32))
    nodes = [(0, np.arange(n))]
    while nodes:
        node, docs = nodes.pop()
        if node >= len(model.middle) or len(docs) < LEAST:
            continue
        own = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        t, d = term[own], np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
        right = np.arange(len(docs)) >= len(docs) // 2
        nl, nr = int((~right).sum()), int(right.sum())
        for _ in range(rounds):
            a, b = np.bincount(t[~right[d]], minlength=m), np.bincount(t[right[d]], minlength=m)
            now = _cost(a, b, nl, nr)
            to_right, to_left = now - _cost(np.maximum(a - 1, 0), b + 1, nl, nr), now - _cost(a + 1, np.maximum(b - 1, 0), nl, nr)
            gain = np.bincount(d, np.where(right[d], to_left[t], to_right[t]), len(docs))
            left_docs, right_docs = np.flatnonzero(~right), np.flatnonzero(right)
            left_docs, right_docs = left_docs[np.argsort(-gain[left_docs], kind="stable")], right_docs[np.argsort(-gain[right_docs], kind="stable")]
            pairs = min(nl, nr)
            swaps = int((gain[left_docs[:pairs]] + gain[right_docs[:pairs]] > 0).sum())
            if not swaps:
                break
            right[left_docs[:swaps]], right[right_docs[:swaps]] = True, False
        a, b = np.bincount(t[~right[d]], minlength=m), np.bincount(t[right[d]], minlength=m)
        model.weight[node] = _cost(a + 1, b, nl, nr) - _cost(a, b + 1, nl, nr)
        score = np.bincount(d, model.weight[node][t], len(docs))
        model.middle[node] = np.median(score)
        goes = score - model.middle[node] > 0
        nodes += [(2 * node + 1, docs[~goes]), (2 * node + 2, docs[goes])]
    return model


@dataclass
class Items:
    """A batch of query items: item i has the terms term[first[i]:first[i + 1]], numbers in the sorted vocabulary."""

    ids: list
    first: np.ndarray
    term: np.ndarray
    vocabulary: np.ndarray
    weight: np.ndarray | None = None

    def bounds(self, best: np.ndarray) -> np.ndarray:
        """Per item the sum over its terms of weight times ``best`` (by term)."""
        sums = np.zeros(len(self.term) + 1, np.int64)
        np.cumsum(self.weight * best[self.term], out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def item_batches(items: DataFrame, text: str, key: str):
    """Batches of items with their distinct terms; together they hold every row of ``items``."""

    def run(batches):
        for batch in batches:
            done = 0
            for n, of, term, _ in term_counts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), lists(of, len(n), term.view(np.int64), pa.int64())], names=["k", "terms"])
                done += len(n)

    kind = items.schema[key].dataType.simpleString()
    read = items.select(items[key].alias("k"), items[text].alias("t")).mapInArrow(run, f"k {kind}, terms array<long>")
    rows = saved(read.withColumn("part", F.abs(F.xxhash64(F.monotonically_increasing_id()))), "lexical-items")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // BATCH_TERMS)
    for part in range(parts):
        table = rows.where(F.col("part") % parts == part).select("k", "terms").toArrow()
        if table.num_rows:
            terms = table.column("terms").combine_chunks()
            flat = terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            vocabulary, number = np.unique(flat, return_inverse=True)
            first = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
            yield Items(table.column("k").to_pylist(), first, number, vocabulary)


def count_terms(docs: DataFrame, vocabulary: np.ndarray, model: Bisection | None, text: str, key: str) -> DataFrame:
    """Per document: key (k), its number of terms, those of the vocabulary with occurrences, and its place in the bisection."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))  # BATCH_TERMS and MODEL_TERMS bound it

    def run(batches):
        vocabulary, model = shared.value
        for batch in batches:
            done = 0
            for n, of, term, tf in term_counts(batch.column(1), vocabulary):
                leaf, score = model.route(len(n), of, term) if model else (np.zeros(len(n), np.int64), np.zeros(len(n)))
                columns = [batch.column(0).slice(done, len(n)), pa.array(n, pa.int64()), lists(of, len(n), term, pa.int32()), lists(of, len(n), tf, pa.int32()), pa.array(leaf, pa.int32()), pa.array(score, pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "terms", "tf", "leaf", "score"])
                done += len(n)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, n long, terms array<int>, tf array<int>, leaf int, score float")


def sample_bisection(docs: DataFrame, vocabulary: np.ndarray, text: str, key: str) -> Bisection:
    """The bisection of about SAMPLE_DOCS documents chosen by a hash of their row."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    picked = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE_DOCS)
    table = count_terms(picked, vocabulary, None, text, key).select("terms").toArrow()
    terms = table.column("terms").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    of = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
    return fit_bisection(len(terms), of, terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(vocabulary))


def build_index(rows: DataFrame, items: Items, documents: int, length: int) -> DataFrame:
    """Shards of ``rows`` (from ``count_terms``) as a written table, one row each, bounds of all items included.

    terms ascend; the postings of term i are places[starts[i]:starts[i + 1]] with their saturated counts in sat, and
    best[i] is the largest of these. A place is a document's number in the shard, keys maps it back.
    """
    kind, shared = rows.schema["k"].dataType.simpleString(), rows.sparkSession.sparkContext.broadcast(items)
    schema = f"shard long, bounds array<long>, keys array<{kind}>, terms array<int>, starts array<int>, places array<int>, sat array<int>, best array<int>"
    tasks = -(-rows.count() // (16 * SHARD_DOCS)) or 1
    order = ["leaf", "score", "k", "_from"]
    ranged = rows.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def shard(number, keys, n, of, term, tf):
        items = shared.value
        m = 50 + 50 * n * documents // max(length, 1)
        sat = 1_000_000_000 * tf // (1000 * tf + 20 * m[of])
        by = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[by], return_index=True)
        best = np.maximum.reduceat(sat[by], starts) if len(terms) else np.zeros(0, np.int64)
        whole = np.zeros(len(items.vocabulary), np.int64)
        whole[terms] = best
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = [pa.array([number], pa.int64()), one(items.bounds(whole), pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
        columns += [one(x, pa.int32()) for x in (terms, np.append(starts, len(by)), of[by], sat[by], best)]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "bounds", "keys", "terms", "starts", "places", "sat", "best"])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            size = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tf"))
            first, lo = np.concatenate([[0], np.cumsum(size)]), 0
            while lo < len(n):
                hi = min(lo + SHARD_DOCS, max(lo + 1, int(np.searchsorted(first, first[lo] + SHARD_POSTINGS, "right")) - 1), len(n))
                of = np.repeat(np.arange(hi - lo), size[lo:hi])
                yield shard(number, batch.column("k").slice(lo, hi - lo), n[lo:hi], of, term[first[lo] : first[hi]], tf[first[lo] : first[hi]])
                number, lo = number + 1, hi

    return saved(ranged.select("k", "n", "terms", "tf").mapInArrow(run, schema), "lexical-index")


def visit(index: DataFrame, items: Items, low: np.ndarray, high: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """(item, k, score): per item and shard with low <= bound < high its best ``top`` documents that score ``least`` or more."""
    kind = index.schema["keys"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast((items, low, high, least))

    def score(batch, row, wanted, items, least):
        col = lambda c: batch.column(c)[row].values
        number = lambda c: col(c).to_numpy(zero_copy_only=False)
        terms, starts, places, sat = number("terms"), number("starts").astype(np.int64), number("places"), number("sat").astype(np.int64)
        keys = col("keys")
        key_rank = np.empty(len(keys), np.int64)
        key_rank[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
        for i in wanted:
            term, weight = items.term[items.first[i] : items.first[i + 1]], items.weight[items.first[i] : items.first[i + 1]]
            at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            here = terms[at] == term
            at, weight = at[here], weight[here]
            size = starts[at + 1] - starts[at]
            posting = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            gain = np.repeat(weight, size) * sat[posting]
            if gain.sum() < 1 << 53:
                total = np.bincount(places[posting], gain, len(keys)).astype(np.int64)
            else:
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, places[posting], gain)
            found = np.flatnonzero(total >= least[i])
            if len(found) > top:
                found = found[np.lexsort((key_rank[found], -total[found]))[:top]]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i), pa.int32()), keys.take(pa.array(found)), pa.array(total[found], pa.int64())], names=["item", "k", "score"])

    def run(batches):
        items, low, high, least = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                bound = batch.column("bounds")[row].values.to_numpy(zero_copy_only=False)
                wanted = np.flatnonzero((bound >= low) & (bound < high))
                if len(wanted):
                    out = list(score(batch, row, wanted, items, least))
                    if out:
                        yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return index.mapInArrow(run, f"item int, k {kind}, score long")


def best_of(index: DataFrame, items: Items, top: int) -> DataFrame:
    """(item, rank, k, score) over all shards: rounds over shards by falling bound until no bound reaches an item's last result."""
    spark, n = index.sparkSession, len(items.ids)
    shards = index.count()
    reach = FIRST
    ranks = []
    while reach < shards:
        ranks.append(reach)
        reach *= FURTHER
    cuts = []
    if ranks:  # bounds that about so many shards reach; only the order of visits depends on them
        share = [1 - r / shards for r in ranks]
        rows = index.select(F.posexplode("bounds").alias("item", "bound")).groupBy("item").agg(F.percentile_approx("bound", share, 10_000).alias("cut")).collect()
        found = np.zeros((len(ranks), n), np.int64)
        for r in rows:
            found[:, r["item"]] = r["cut"]
        cuts = [*found]
    least, high, best = np.ones(n, np.int64), np.full(n, np.iinfo(np.int64).max), None
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("k")))
    for cut in [*cuts, np.ones(n, np.int64)]:
        low = np.minimum(np.maximum(cut, least), high)
        if (low < high).any():
            more = visit(index, items, low, high, least, top)
            old, best = best, saved((best.drop("rank").unionByName(more) if best is not None else more).withColumn("rank", place).where(F.col("rank") <= top), "lexical-best")
            for r in best.where(F.col("rank") == top).select("item", "score").collect():  # one row an item at most
                least[r["item"]] = r["score"]
            if old is not None:
                drop(old)
        high = low
    return best if best is not None else spark.createDataFrame([], f"item int, k {index.schema['keys'].dataType.elementType.simpleString()}, score long, rank int")


def search(docs: DataFrame, items: DataFrame, top: int = 50, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The ``top`` best documents for every row of ``items``: item key, rank (from 1), document key, score above 0.

    A null or empty text has no terms: as a document it is found by no item and counts in no average, as an item it finds
    nothing. Equal scores go by ascending key, null first; documents that are equal in that too take adjacent ranks, and
    repeated items have results each. Every row is indexed. Items whose terms are too many for one batch are searched
    batch after batch, each over all documents. Terms are told apart by 64-bit hashes.
    """
    spark, out = docs.sparkSession, None
    for batch in item_batches(items, item_text, item_key):
        rows = saved(count_terms(docs, batch.vocabulary, sample_bisection(docs, batch.vocabulary, text, key), text, key), "lexical-rows")
        documents, length = rows.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(batch.vocabulary), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the batch's terms
            frequency[r["term"]] = r["count"]
        batch.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)[batch.term]
        index = build_index(rows, batch, documents, length)
        names = spark.createDataFrame(pa.table({"number": pa.array(range(len(batch.ids)), pa.int32()), "id": pa.array(batch.ids, _arrow(items.schema[item_key].dataType))}))
        found = best_of(index, batch, top).join(names, F.col("item") == F.col("number")).select(F.col("id").alias(item_key), "rank", F.col("k").alias(key), "score")
        drop(rows)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = [f"`{item_key}` {items.schema[item_key].dataType.simpleString()}", f"`{key}` {docs.schema[key].dataType.simpleString()}"]
        out = spark.createDataFrame([], f"{kinds[0]}, rank int, {kinds[1]}, score long")
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
c AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, docs),
q AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark))),
s AS (
  SELECT item, item_id, d.row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.row = p.row, c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
