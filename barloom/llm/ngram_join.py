"""Near-duplicate components by an exact Jaccard join of word shingles.

Rare shingles come first in one global order: by the count of the shingle's hash bucket over all documents, then by
hash. Two sets with Jaccard similarity t share a shingle among their first |x| - ceil(t |x|) + 1; of the smaller set even
the first |x| - ceil(2t/(1+t) |x|) + 1 suffice. Those prefixes are joined on the shingle, and length, positional and
suffix filters thin out what is verified once per pair.

Equal sets are one node from the start. A prefix shingle that many nodes share is first joined with one hub node only;
nodes that turn out connected need no further pair, and only pairs between different components are enumerated, keyed by
shingle and size band, so that sizes too far apart never meet. A group of copies costs pairs in proportion to its size,
and no link between components is lost. Components go on from those of the round before: only new links between them
are followed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved
from barloom.llm._words import shingle_sets
from barloom.llm.components import components

BUCKET_BITS = 18
SEGMENT = 4096
SUFFIX_BINS = 64
#: Ids up to which a join side is sent to every task (16 MB of longs); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Cross-component pairs per posting above which another hub round comes before they are enumerated.
PAIRS_PER_POSTING = 32
#: Digests of sets that a task remembers, to leave out postings of copies it has met.
REMEMBERED = 100_000
#: Bytes of shingle hashes in one Arrow batch.
BATCH_BYTES = 4 << 20


def bucket_counts(docs: DataFrame, n: int, text: str) -> np.ndarray:
    """In how many documents the shingles of each hash bucket are: 2 ** BUCKET_BITS counts, whatever the input."""
    shift = np.uint64(64 - BUCKET_BITS)

    def count(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            held, size = [], 0
            for s in shingle_sets(batch.column(0), n):
                held.append((s >> shift).astype(np.int32))
                size += len(s)
                if size > 1 << 18:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
        parts = counts.reshape(-1, SEGMENT)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["segment", "counts"])

    schema = "segment int, counts binary"
    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, schema).repartition("segment").mapInArrow(add, schema).collect()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows:
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.counts, np.int64)
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def prefix_table(docs: DataFrame, counts: np.ndarray, n: int, percent: int, text: str, key: str) -> DataFrame:
    """Per document: key, size, digest (d1, d2; null for an empty set), prefix (rare first) and bins, counts by hash range.

    A set that the same task has met shortly before has no prefix: its postings are there already.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFF).astype(np.uint16))
    names = ["k", "size", "d1", "d2", "prefix", "bins"]

    def run(batches):
        frequency, seen = shared.value, set()
        shift, bins = np.uint64(64 - BUCKET_BITS), np.uint64(64 - 6)
        for batch in batches:
            size, first, second, prefix, hist = [], [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                size.append(len(s))
                d = digest(s) if len(s) else (None, None)
                first.append(d[0]), second.append(d[1])
                if not len(s) or d in seen:
                    prefix.append(None), hist.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                order = np.argsort((frequency[(s >> shift).astype(np.int32)].astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)), kind="stable")
                keep = len(s) - (percent * len(s) + 99) // 100 + 1
                prefix.append(s[order[:keep]].view(np.int64))
                hist.append(np.bincount((s >> bins).astype(np.int32), minlength=SUFFIX_BINS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(hist, pa.list_(pa.int32()))], names=names)

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, size long, d1 long, d2 long, prefix array<long>, bins array<int>")


def needed(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of sizes a and b with Jaccard similarity of ``percent`` %."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def core(a: Column, percent: int) -> Column:
    """Length of the prefix that suffices against sets at least as large."""
    return a - needed(a, a, percent) + 1


def length_filter(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def position_filter(a: Column, pos_a: Column, b: Column, pos_b: Column, percent: int) -> Column:
    """What can still follow the first shared shingle, itself included, must suffice; true for that one if the pair qualifies."""
    return F.least(a - pos_a, b - pos_b) >= needed(a, b, percent)


def few(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table of a few ids a row, if it has ``BROADCAST_IDS`` rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


class Verifier:
    """Exact similarity of candidate pairs; full sets are made again from the text, for candidates only."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, percent: int, text: str, key: str):
        self.docs, self.nodes, self.n, self.percent, self.text, self.key = docs, nodes, n, percent, text, key

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link.

        Before sets are made again, two bounds on what a pair can share: of two prefixes the one that ends first in the
        global order tells which shingles are shared up to there, so at most the rest of its set can follow; and shared
        shingles can't exceed the sum of the smaller counts over hash ranges.
        """
        ids = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "pair-ids")
        known = saved(self.nodes.join(few(ids), "node", "left_semi"), "pair-nodes")
        own = lambda side: known.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "prefix", "bins")])
        least = needed(F.col("size_a"), F.col("size_b"), self.percent)
        in_prefix = F.size(F.array_intersect("prefix_a", "prefix_b")) + F.greatest(F.col("size_a") - F.size("prefix_a"), F.col("size_b") - F.size("prefix_b"))
        in_bins = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        likely = own("a").join(few(pairs), "a").join(own("b"), "b").where((in_prefix >= least) & (in_bins >= least))
        pairs = saved(likely.select("a", "b"), "pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = saved(known.select("node", "k", "d1", "d2").join(few(wanted), "node", "left_semi"), "pair-wanted")
        n = self.n

        def sets(batches):
            seen: set = set()

            def batch_of(rows):
                one, two, full = zip(*rows, strict=True) if rows else ((), (), ())
                return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(full, pa.list_(pa.int64()))], names=["d1", "d2", "s"])

            for batch in batches:
                rows, size = [], 0
                for s in shingle_sets(batch.column(0), n):
                    d = digest(s) if len(s) else None
                    if d is None or d in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    rows.append((*d, s.view(np.int64)))
                    size += s.nbytes
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

        ids = few(wanted.select(F.col("k").alias("id")).distinct())
        texts = self.docs.join(ids, self.docs[self.key].eqNullSafe(F.col("id")), "left_semi").select(self.docs[self.text].alias("t"))
        full = texts.mapInArrow(sets, "d1 long, d2 long, s array<long>").join(few(wanted.select("node", "d1", "d2")), ["d1", "d2"])
        full = saved(full.select("node", "s"), "pair-sets")
        if full.count() > wanted.count():  # repeated keys
            once = saved(full.dropDuplicates(["node"]), "pair-sets")
            drop(full)
            full = once
        both = full.select(F.col("node").alias("a"), F.col("s").alias("s_a")).join(few(pairs), "a").join(full.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
        shared = F.size(F.array_intersect("s_a", "s_b"))
        out = saved(both.where(100 * shared >= self.percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b"), "links")
        for t in (pairs, ids, known, wanted, full):
            drop(t)
        return out


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after new links: components already found count as one node each."""
    if comp is None:
        return components(links)
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    new = components(joined.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    moved = comp.join(new.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    old = moved.select("node", F.coalesce("top", "component").alias("component"))
    out = saved(old.unionByName(new.join(comp.select("node"), "node", "left_anti")), "node-components")
    drop(new)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, n_shingles and component_id, the smallest key of its component.

    Words are lower-cased in A-Z; a text with fewer than ``n`` words has one shingle, its word sequence; a text without
    words (null too) has none and is a component of its own. Repeated rows and equal sets are in one component. Null
    keys take part in linking but name no component while another key can. Extra columns are not read. An empty table
    gives no rows. Shingles are compared by 64-bit and sets of them by 128-bit hashes.
    """
    docs = docs.select(key, text)
    # row numbers are written with the rows, so that they don't depend on how files are split later
    table = saved(prefix_table(docs, bucket_counts(docs, n, text), n, percent, text, key).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    # a task's first row of a set has its prefix, so the smallest row of all has
    node_of = saved(table.where("d1 is not null").groupBy("d1", "d2").agg(F.min("row").alias("node")), "set-nodes")
    spare = saved(table.where("prefix is not null").select("row", "d1", "d2").join(node_of, ["d1", "d2"]).where("row <> node").select("row"), "spare-rows")
    nodes = table.where("prefix is not null").join(few(spare), "row", "left_anti").withColumnRenamed("row", "node")
    # size and position travel in one long; a node has a shingle once, so a count above 1 is another node
    postings = nodes.select("node", F.shiftleft("size", 32).alias("packed"), F.posexplode("prefix").alias("pos", "shingle"))
    postings = postings.select("shingle", "node", (F.col("packed") + F.col("pos")).alias("packed"))
    shared = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    postings = saved(postings.join(shared, "shingle"), "postings")
    size, pos = F.shiftright("packed", 32), F.col("packed").bitwiseAND(F.lit(2**32 - 1))
    hub_size, hub_pos = F.shiftright("hub_packed", 32), F.col("hub_packed").bitwiseAND(F.lit(2**32 - 1))

    def hubs_of(rows: DataFrame, order: Column, *more: str) -> DataFrame:
        """Per shingle the first node by ``order``, a long."""
        return rows.groupBy("shingle").agg(F.min_by("node", order).alias("hub"), *[F.min_by(c, order).alias(f"hub_{c}") for c in ("packed", *more)])

    # the text that others were made from has few shingles of its own, so the shared ones come first in its prefix
    earliest = F.shiftleft(pos, 40) + F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))
    verifier = Verifier(docs, nodes, n, percent, text, key)

    def met(rows: DataFrame) -> DataFrame:
        """Distinct pairs of a posting's node and its hub that pass the filters."""
        close = length_filter(size, hub_size, percent) & position_filter(size, pos, hub_size, hub_pos, percent)
        return rows.where("hub <> node").where(close).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    tried = saved(met(postings.join(hubs_of(postings, earliest), "shingle")), "tried")
    used = [tried]
    links = verifier.links(tried)
    comp = merged(None, links)
    drop(links)
    band = lambda x: F.floor(F.log(x.cast("double")) / math.log(100 / percent)).cast("int")
    # a shingle of two nodes has no pair left
    live, before, round_ = postings.where("n > 2"), None, 0
    while True:
        live_ = live.select("shingle", "node", "packed").join(few(comp), "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = live_.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("shingle")
        mine = saved(live_.join(mixed, "shingle", "left_semi"), "mixed")
        drop(live)
        live = mine
        short = (pos < core(size, percent)).cast("long")
        per = mine.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(short).alias("m"))
        per = per.groupBy("shingle").agg((F.sum("n") * F.sum("m") - F.sum(F.col("n") * F.col("m"))).alias("pairs"), F.sum("n").alias("rows"))
        pairs, rows = per.agg(F.sum("pairs"), F.sum("rows")).first()
        if not rows:
            break
        # enumerate once that is cheap, or once hub rounds leave more than nine tenths of the pairs
        last = pairs <= PAIRS_PER_POSTING * rows + 1000 or (before is not None and 10 * pairs > 9 * before)
        before = pairs
        if last:
            x = mine.where(pos < core(size, percent)).select("shingle", F.explode(F.sequence(band(size), band(size * (100 / percent) + 1e-6))).alias("band"), size.alias("x_size"), pos.alias("x_pos"), *[F.col(c).alias(f"x_{c}") for c in ("node", "component")])
            y = mine.select("shingle", band(size).alias("band"), size.alias("y_size"), pos.alias("y_pos"), *[F.col(c).alias(f"y_{c}") for c in ("node", "component")])
            found = x.join(y, ["shingle", "band"]).where("x_component <> y_component AND (x_size < y_size OR (x_size = y_size AND x_node < y_node))")
            found = found.where(length_filter(F.col("x_size"), F.col("y_size"), percent) & position_filter(F.col("x_size"), F.col("x_pos"), F.col("y_size"), F.col("y_pos"), percent))
            found = found.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
        else:
            round_ += 1
            hubs = hubs_of(mine, F.xxhash64(F.lit(round_), "component", "node"), "component")
            found = met(mine.join(hubs, "shingle").where("component <> hub_component"))
        found = saved(found.join(tried, ["a", "b"], "left_anti"), "tried")
        links = verifier.links(found)
        gained = not links.isEmpty()
        if gained:
            new = merged(comp, links)
            drop(comp)
            comp = new
        drop(links)
        if last:
            drop(found)
            break
        tried = tried.unionByName(found)
        used.append(found)
    for t in [*used, live, postings, spare]:
        drop(t)
    named = table.select("k", "size", "d1", "d2").join(node_of, ["d1", "d2"], "left").join(few(comp), "node", "left").withColumn("c", F.coalesce("component", "node"))
    groups = named.where("node is not null").groupBy("c").agg(F.min("k").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = saved(groups.select(F.col("c").alias("cc"), "component_id", F.lit(True).alias("grouped")), "least-keys")
    out = named.join(few(least), F.col("c") == F.col("cc"), "left")
    return out.select(F.col("k").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
