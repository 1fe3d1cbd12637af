"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups, and a proof for every row.

The node store lies in Parquet. Rows are range-sorted into runs and numbered without gathering a group in a task, so a
leaf's coordinate is (tree, place). Each level is a table of its own, made from the level below it: node i has the
children arity*i, arity*i + 1 and so on of its tree. Proofs come from the top: a node's path is its siblings followed by
its parent's path, so each level is merged with the one above it by coordinate and no row climbs the tree alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved, shared_dir

#: A level of at most so many nodes is built in one task; larger ones are grouped by coordinate.
ONE_TASK = 2000


def framed(*values: Column) -> Column:
    """sha256 (lowercase hex) of the values one after another: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, path: Column) -> Column:
    """Root (hex) that a leaf (hex) and its path lead to."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(hex_of(step["left"]), at, hex_of(step["right"])), 256))


def proof_digest(path: Column) -> Column:
    """sha256 (hex) of all siblings' hex digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: hex_of(F.concat(step["left"], step["right"]))), ""), 256)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` in the order of ``keys`` (nulls first) as a written table with their place as column ``at``.

    A key that many rows share is split over partitions, as the place a row was read from is the last key.
    """
    ranged = rows.withColumn("_from", F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() for k in [*keys, "_from"]]
    runs = saved(ranged.repartitionByRange(*order).sortWithinPartitions(*order).drop("_from").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    before, steps = 0, []
    for p, n in sorted(map(tuple, runs.groupBy(part.alias("p")).count().collect())):  # one row a partition
        steps.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(steps, "_part int, _before long")
    place = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    out = runs.join(starts, part == F.col("_part")).select(*rows.columns, place.alias("at"))
    out._barloom_path = runs._barloom_path
    return out


def height_of(n: Column, arity: int) -> Column:
    """Levels above the leaves of a tree with ``n`` leaves: 0 for a lone leaf."""
    powers = [1]
    while powers[-1] * arity < 2**63:
        powers.append(powers[-1] * arity)
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < n))


def climb(leaves: DataFrame, sizes: list[int], arity: int, folder: str) -> list[DataFrame]:
    """The levels above ``leaves`` (tree, height, place, digest): level k is made from level k - 1 and written to its own folder.

    ``sizes`` has the number of nodes of each level, that of the leaves first. A tree of height h has no nodes above level h.
    """
    spark, out, now = leaves.sparkSession, [], leaves
    for level in range(1, len(sizes)):
        below = now.where(F.col("height") >= level).select("tree", "height", "place", "digest")
        if sizes[level - 1] <= ONE_TASK:
            below = below.coalesce(1)
        runs = below.groupBy("tree", "height", F.expr(f"place div {arity}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"].alias("children"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("children", hex_of), ""), 256))
        nodes = runs.select("tree", "height", F.col("up").alias("place"), "children", digest.alias("digest"))
        nodes.write.parquet(f"{folder}/level={level}")
        now = spark.read.schema(nodes.schema).parquet(f"{folder}/level={level}")
        out.append(now)
    return out


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with path and subroot; ``tops`` (tree, height, path, subroot) has what lies above each tree.

    A path is an array of (left, right): the digests left and right of the node in its run, from the leaf upwards.
    """
    nothing = F.lit("").cast("binary")
    join = lambda digests: F.aggregate(digests, nothing, lambda a, d: F.concat(a, d))
    above = None
    for level in range(len(levels), -1, -1):
        nodes = levels[level - 1] if level else leaves
        parents = tops.where(F.col("height") == level).select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<binary>").alias("run"), "path", "subroot")
        if above is not None:
            parents = parents.unionByName(above.select(F.col("tree").alias("t"), F.col("place").alias("up"), F.col("children").alias("run"), "path", "subroot"))
        at = (F.col("place") % arity).cast("int")
        step = F.struct(join(F.slice("run", F.lit(1), at)).alias("left"), join(F.slice("run", at + 2, F.lit(arity))).alias("right"))
        joined = nodes.join(parents, (F.col("tree") == F.col("t")) & (F.expr(f"place div {arity}") == F.col("up")))
        joined = joined.select(*nodes.columns, F.when(F.col("run").isNull(), F.col("path")).otherwise(F.concat(F.array(step), "path")).alias("path"), "subroot")
        if level:
            before, above = above, saved(joined.select("tree", "place", "children", "path", "subroot"), "merkle-paths")
            if before is not None:
                drop(before)
    return joined


@dataclass
class Manifest:
    """The written node store of one dataset and its root (lowercase hex)."""

    folder: str
    arity: int
    keys: dict[str, str]
    root: str
    leaves: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    groups: DataFrame | None = None
    group_levels: list[DataFrame] = field(default_factory=list)
    group_count: int = 0

    def proofs(self) -> DataFrame:
        """Per row: its key and carried columns, leaf, subroot, root (hex) and path (binary digests left and right of it, leaf first)."""
        empty = F.array().cast("array<struct<left:binary,right:binary>>")
        over = self.groups.select(F.lit(0).cast("long").alias("tree"), F.lit(len(self.group_levels)).alias("height"), F.col("tree").alias("place"), "digest", F.col("height").alias("h"))
        top = self.groups.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(len(self.group_levels)).alias("height"), empty.alias("path"), F.lit(None).cast("binary").alias("subroot"))
        tops = descend(over, self.group_levels, top, self.arity).select(F.col("place").alias("tree"), F.col("h").alias("height"), "path", F.col("digest").alias("subroot"))
        out = descend(self.leaves, self.levels, saved(tops, "merkle-tops"), self.arity)
        names = [F.col(inside).alias(name) for name, inside in self.keys.items()]
        return out.select(*names, hex_of(F.col("digest")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), F.lit(self.root).alias("root"), "path")


def build_manifest(docs: DataFrame, fields: tuple[str, ...], group: str = "source", order: str = "doc_id", arity: int = 3, carry: dict[str, Column] | None = None) -> Manifest:
    """Leaves, levels and root of ``docs``; the rows' keys (``order``) and the ``carry`` columns stay with the leaves.

    A leaf is ``framed`` over ``fields``. Within a group leaves ascend by ``order``, null first, equal keys by leaf, so
    that the root doesn't depend on the order of rows or files; repeated rows are leaves of their own. Groups ascend by
    value, the null group first. Every ``arity`` consecutive nodes (the last ones: fewer, even one) have one parent, as
    long as a tree has several nodes; a lone leaf is its tree's root. An empty table has no groups, and sha256 of
    nothing as root. The names in ``carry`` must differ from ``order``, leaf, subroot, root and path.
    """
    carry = carry or {}
    inside = {order: "k", **{c: f"c{i}" for i, c in enumerate(carry)}}
    rows = docs.select(docs[group].alias("g"), docs[order].alias("k"), F.unhex(framed(*[docs[c] for c in fields])).alias("digest"), *[c.alias(inside[n]) for n, c in carry.items()])
    runs = numbered(rows, ["g", "k", "digest"], "merkle-runs")
    folder = f"{shared_dir(docs.sparkSession)}/manifest-{uuid.uuid4().hex}"
    found = saved(runs.groupBy("g").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")).withColumn("height", height_of(F.col("n"), arity)), "merkle-groups")
    high, count = found.agg(F.max("height"), F.count(F.lit(1))).first()
    high = high or 0
    # nodes of each level, over the trees that reach it
    sizes = [int(x or 0) for x in found.agg(*[F.sum(F.when(F.col("height") >= level, F.ceil(F.col("n") / float(arity**level)))) for level in range(high + 1)]).first()]
    trees = numbered(found, ["start"], "merkle-trees").select(F.col("g").alias("tg"), "start", "height", F.col("at").alias("tree"))
    placed = runs.join(trees, F.col("g").eqNullSafe(F.col("tg"))).select("tree", "height", (F.col("at") - F.col("start")).alias("place"), "digest", *inside.values())
    placed.write.parquet(f"{folder}/leaves")
    leaves = docs.sparkSession.read.schema(placed.schema).parquet(f"{folder}/leaves")
    drop(runs)
    levels = climb(leaves, sizes, arity, f"{folder}/rows")
    tops = [nodes.where(f"height = {level}").select("tree", "height", "digest") for level, nodes in enumerate([leaves, *levels])]
    groups = tops[0]
    for t in tops[1:]:
        groups = groups.unionByName(t)
    groups = saved(groups, "merkle-subroots")
    over, sizes = groups.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest"), [count]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    above = climb(over.withColumn("height", F.lit(len(sizes) - 1)), sizes, arity, f"{folder}/groups")
    root = (above[-1] if above else over).select(hex_of(F.col("digest"))).first() if count else None
    return Manifest(folder, arity, inside, root[0] if root else _EMPTY, leaves, levels, groups, above, count)


_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = build_manifest(docs, fields, carry={"tampered": F.unhex(framed(*[F.col(c) for c in fields[:4]], tampered))})
    folded = fold(hex_of(F.col("tampered")), F.col("path"))
    out = manifest.proofs().select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FRAME = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FRAME.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT)"""
OP12_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, sha256({_HEAD} || {_FRAME.format('text')}) AS leaf,
    sha256({_HEAD} || {_FRAME.format("(CASE WHEN coalesce(" + _CRC32 + " % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END)")}) AS tampered
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY no_src DESC, encode(src)) - 1 AS tree,
    row_number() OVER (PARTITION BY no_src, src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY no_src, src) AS n
  FROM base),
up AS (
  SELECT tree, 0 AS level, n, place, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, CAST(ceil(n / 3) AS BIGINT), place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY tree, level, n, place // 3),
subs AS (SELECT tree, level AS height, digest AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, (SELECT count(*) FROM subs) AS n, tree AS place, subroot AS digest FROM subs
  UNION ALL
  SELECT level + 1, CAST(ceil(n / 3) AS BIGINT), place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, n, place // 3),
nodes AS (
  SELECT tree, level, place, digest FROM up WHERE n > 1
  UNION ALL SELECT -1, level, place, digest FROM top WHERE n > 1),
runs AS (SELECT tree, level, place // 3 AS up, list(digest ORDER BY place) AS run FROM nodes GROUP BY ALL),
walk AS (
  SELECT row_number() OVER () AS row, doc_id, leaf, tree AS own, tree, 0 AS level, place, tampered AS folded, '' AS proof, height, false AS over FROM placed JOIN subs USING (tree)
  UNION ALL
  SELECT row, doc_id, leaf, own, CASE WHEN level = height THEN -1 ELSE w.tree END, CASE WHEN level = height THEN 0 ELSE level + 1 END,
    CASE WHEN level = height THEN w.tree ELSE place // 3 END,
    CASE WHEN level = height THEN folded ELSE sha256(array_to_string(run[:(place % 3)], '') || folded || array_to_string(run[(place % 3) + 2:], '')) END,
    CASE WHEN level = height THEN proof ELSE proof || array_to_string(run[:(place % 3)], '') || array_to_string(run[(place % 3) + 2:], '') END,
    CASE WHEN level = height THEN (SELECT max(level) FROM top) ELSE height END, over OR level = height
  FROM (SELECT v.*, run FROM walk v LEFT JOIN runs r ON r.tree = v.tree AND r.level = v.level AND r.up = v.place // 3) w
  WHERE NOT (over AND level = height))
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM walk JOIN subs s ON s.tree = own, (SELECT digest FROM top WHERE n = 1) WHERE over AND level = walk.height
"""
