"""Balanced shards of indivisible groups by best-fit-decreasing bin packing.

Groups are rows of equal text. Sorted by size they enter the bin with the tightest remaining capacity, the largest first;
the capacity is the smallest with which the bins suffice. So that the plan is bounded however large the input is, groups
below a fixed fraction of the whole are planned in batches: groups of one size class (sizes within 1/64 of each other)
form as many batches as their bytes need to stay below that fraction, and a batch takes its place in the order by its
groups' size. Larger groups are planned one by one. The rows themselves are only counted, joined and numbered in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved

#: A group above 1/PARTS of all bytes is an item of its own; a batch of smaller groups has about that many bytes at most.
PARTS = 8192
#: Size classes to a doubling of the size.
CLASSES = 64


@dataclass(slots=True)
class Node:
    """Node of an AA tree over (remaining capacity, bin)."""

    key: tuple[int, int]
    level: int = 1
    left: Node | None = None
    right: Node | None = None


def _skew(t: Node) -> Node:
    if t.left and t.left.level == t.level:
        up = t.left
        t.left, up.right = up.right, t
        return up
    return t


def _split(t: Node) -> Node:
    if t.right and t.right.right and t.right.right.level == t.level:
        up = t.right
        t.right, up.left = up.left, t
        up.level += 1
        return up
    return t


def _insert(t: Node | None, key: tuple[int, int]) -> Node:
    if t is None:
        return Node(key)
    if key < t.key:
        t.left = _insert(t.left, key)
    else:
        t.right = _insert(t.right, key)
    return _split(_skew(t))


def _delete(t: Node | None, key: tuple[int, int]) -> Node | None:
    if t is None:
        return None
    if key < t.key:
        t.left = _delete(t.left, key)
    elif key > t.key:
        t.right = _delete(t.right, key)
    elif t.left is None:
        return t.right
    elif t.right is None:
        return t.left
    else:
        after = t.right
        while after.left:
            after = after.left
        t.key = after.key
        t.right = _delete(t.right, after.key)
    least = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
    if least < t.level:
        t.level = least
        if t.right and t.right.level > least:
            t.right.level = least
    t = _skew(t)
    if t.right:
        t.right = _skew(t.right)
        if t.right.right:
            t.right.right = _skew(t.right.right)
    t = _split(t)
    if t.right:
        t.right = _split(t.right)
    return t


class Capacities:
    """Bins by remaining capacity in a balanced search tree: tightest fit, insertion and removal in log time."""

    def __init__(self):
        self.root: Node | None = None

    def add(self, room: int, bin_: int) -> None:
        self.root = _insert(self.root, (room, bin_))

    def tightest(self, size: int) -> int | None:
        """The bin with the least remaining capacity of at least ``size``, lowest number on ties; its room shrinks by it."""
        t, found = self.root, None
        while t:
            if t.key >= (size, -1):
                found, t = t.key, t.left
            else:
                t = t.right
        if found is None:
            return None
        self.root = _delete(self.root, found)
        self.add(found[0] - size, found[1])
        return found[1]


def best_fit_decreasing(sizes: list[int], capacity: int, order: list[int] | None = None) -> list[int]:
    """Bin of each size; a new bin of ``capacity`` opens only when the item fits nowhere. A larger item gets its own bin.

    Items come by decreasing size, or in the ``order`` of their numbers.
    """
    tree, bins, out = Capacities(), 0, [0] * len(sizes)
    for i in order if order is not None else sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bin_ = tree.tightest(sizes[i])
        if bin_ is None:
            bin_, bins = bins, bins + 1
            tree.add(max(0, capacity - sizes[i]), bin_)
        out[i] = bin_
    return out


def near_equal_bins(sizes: list[int], bins: int, order: list[int] | None = None) -> list[int]:
    """Best-fit-decreasing at the smallest capacity that needs no more than ``bins`` bins, found by bisection."""
    low, high = -(-sum(sizes) // bins), sum(sizes) + 1
    best = [0] * len(sizes)
    while low < high:
        mid = (low + high) // 2
        found = best_fit_decreasing(sizes, mid, order)
        if max(found, default=0) < bins:
            best, high = found, mid
        else:
            low = mid + 1
    return best


def text_size(text: Column, overhead: int = 16) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def shard_groups(docs: DataFrame, shards: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Shard and slot of every row; rows of equal text (null counts as empty) share a shard, shard sizes are near equal.

    Returns the ``keep`` columns, size (UTF-8 bytes + 16), text_crc32, shard (0 to shards - 1) and slot (gapless from 0
    in each shard). A group above a shard's fair part fills a shard alone. Rows that are equal in everything get
    different slots. An empty table gives no rows.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_size(F.col(text)).alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"), F.md5(value.cast("binary")).alias("g"))
    # the partition a row was written from is part of the row, so that numbering doesn't depend on how files are split later
    rows = saved(rows.withColumn("part", F.spark_partition_id()), "shard-rows")
    groups = saved(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = F.col("bytes") * PARTS > total
    large = groups.where(alone).select("g", F.lit(None).cast("int").alias("class"), F.lit(None).cast("int").alias("batch"), "bytes", F.col("bytes").alias("unit"))
    kind = F.floor(F.log2("bytes") * CLASSES).cast("int")
    small = groups.where(~alone).withColumn("class", kind)
    classes = small.groupBy("class").agg(F.ceil(F.sum("bytes") * PARTS / F.lit(max(total, 1))).cast("int").alias("batches"))  # some thousand rows
    batch = F.pmod(F.xxhash64("g"), F.col("batches")).cast("int")
    batched = small.join(F.broadcast(classes), "class").withColumn("batch", batch)
    batches = batched.groupBy("class", "batch").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("unit"))
    items = large.unionByName(batches.select(F.lit(None).cast("string").alias("g"), "class", "batch", "bytes", "unit")).collect()  # about PARTS rows and the classes
    items.sort(key=lambda r: (-r.unit, -r.bytes, r.g or "", r["class"] or 0, r.batch or 0))
    bins = near_equal_bins([r.bytes for r in items], shards, list(range(len(items))))
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r.g, r["class"], r.batch, b) for r, b in zip(items, bins, strict=True)], "lg string, lc int, lb int, shard int")
    by_group = F.broadcast(plan.where("lg is not null").select(F.col("lg").alias("g"), "shard"))
    by_batch = F.broadcast(plan.where("lg is null").select(F.col("lc").alias("class"), F.col("lb").alias("batch"), "shard"))
    shard_of = groups.where(alone).select("g").join(by_group, "g").select("g", "shard").unionByName(batched.join(by_batch, ["class", "batch"]).select("g", "shard"))
    placed = saved(rows.join(saved(shard_of, "shard-of"), "g"), "shard-placed")
    drop(groups)
    # slots: rows are numbered within (part, shard), and parts follow one another
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("shard").alias("os"), F.col("part").alias("op"), offset.alias("offset"))
    at = F.row_number().over(Window.partitionBy("part", "shard").orderBy("g", *[f"k{i}" for i in range(len(keep))])) - 1
    out = placed.withColumn("at", at).join(offsets, (F.col("shard") == F.col("os")) & (F.col("part") == F.col("op")))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "text_crc32", "shard", (F.col("at") + F.col("offset")).cast("long").alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
