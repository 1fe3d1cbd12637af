"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order.

Which strings can be equal is found first, without comparing texts: in every window of ``length`` bytes the smallest
hash of its ``GRAM``-byte grams is the window's anchor. Equal windows have equal anchors at the same place, so only
stretches of windows behind an anchor that occurs twice can repeat, and all their copies have the same anchor hash.

Stretches are dealt by anchor. In each task a suffix array over the windows of its distinct stretches is built by
prefix doubling; previous and next smaller positions in suffix order give each window's longest earlier match, and a
match of ``length`` bytes marks the later window and, unless first copies are kept, the earlier one it was matched with.

Anchors with very many distinct stretches are not gathered in a task. Their windows become rows of two 64-bit hashes,
those that occur in two places are found by a partially aggregated minimum and maximum, and joined back.

What is shuffled follows the input at any size: stretches whose anchor occurs once, and texts without a wanted stretch or
a span, are left out before a shuffle by filters of bounded size, and joins on texts have one form for small and large tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved
from barloom.llm._words import BYTE_VALUES, mix, powers

GRAM = 48
#: Windows handled at once; a longer text is taken in overlapping parts.
PART = 1 << 20


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): runs of window starts with one anchor, in order; together they are all windows of the text."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    windows = len(raw) - length + 1
    span = length - GRAM + 1  # grams in a window
    for lo in range(0, max(windows, 0), PART):
        n = min(PART, windows - lo)
        part = raw[lo : lo + n + length - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        grams = len(part) - GRAM + 1
        h = mix((sums[GRAM:] - sums[:-GRAM]) * down[:grams])
        # smallest of each ``span`` neighbours: running minima of blocks from both sides; the place breaks ties, leftmost first
        key = (h & ~np.uint64(0x1FFFFF)) | np.arange(grams, dtype=np.uint64)
        blocks = -(-grams // span) * span
        padded = np.full(blocks, np.uint64(2**64 - 1))
        padded[:grams] = key
        padded = padded.reshape(-1, span)
        fore = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], fore[span - 1 : span - 1 + n])
        at = (least & np.uint64(0x1FFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [n]]) - 1
        out.append((h[at[first]], first + lo, last + lo))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ranks(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places of the windows of ``length`` bytes inside the stretches [begin, end) of ``raw``, and ranks by prefix doubling.

    The ranks are per doubling step (size, rank of the ``size`` bytes at each place), ``length`` last: equal strings have
    equal ranks and ranks are in byte order. ``length`` is at least 8.
    """

    def places(size: int) -> np.ndarray:
        n = np.maximum(end - begin - size + 1, 0)
        skip = np.cumsum(n) - n
        return np.arange(n.sum()) - np.repeat(skip, n) + np.repeat(begin, n)

    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = places(8)
    value = np.ascontiguousarray(eight[at]).view(">u8").ravel().astype(np.uint64)
    size, steps = 8, []
    while True:
        rank = np.zeros(len(raw), np.int32)
        rank[at] = np.unique(value, return_inverse=True)[1]
        steps.append((size, rank))
        if size == length:
            return at, steps
        more = min(size, length - size)  # the last step overlaps
        size += more
        at = places(size)
        value = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + more].astype(np.uint64)


def smaller_neighbours(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before and after it with a smaller value: -1 and len(place) where there is none.

    Every entry begins at its neighbour and takes that one's pointer until it meets a smaller value; what lies between
    is larger at any time, and pointers double their reach.
    """
    n = len(place)
    out = []
    for step, none in ((-1, -1), (1, n)):
        to = np.arange(n) + step
        open_ = np.arange(n)
        while len(open_):
            inside = (to[open_] >= 0) & (to[open_] < n)
            open_ = open_[inside]
            open_ = open_[place[to[open_]] > place[open_]]
            to[open_] = to[to[open_]]
        out.append(np.where((to >= 0) & (to < n), to, none))
    return out[0], out[1]


def common_prefix(raw: np.ndarray, steps: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the windows at places a and b share from their beginning, the windows' length at most."""
    length, whole = steps[-1]
    equal = whole[a] == whole[b]
    shared = np.zeros(len(a), np.int64)
    for size, rank in reversed(steps[:-1]):
        fits = shared + size <= length
        x, y = np.where(fits, a + shared, a), np.where(fits, b + shared, b)
        shared += np.where(fits & (rank[x] == rank[y]), size, 0)
    same = np.ones(len(a), bool)
    for _ in range(7):
        same &= shared < length
        x, y = np.where(same, a + shared, a), np.where(same, b + shared, b)
        same &= raw[x] == raw[y]
        shared += same
    return np.where(equal, length, shared)


def longest_previous(raw: np.ndarray, place: np.ndarray, steps: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Longest-previous-factor array: for each window the length of its longest match at an earlier place, and that place or -1.

    Windows in suffix order (by rank, ties by place) have their longest earlier match at the previous or the next smaller
    place in that order. Lengths end at the window's own.
    """
    order = np.lexsort((place, steps[-1][1][place]))
    at = place[order]
    factor, source = np.zeros(len(place), np.int64), np.full(len(place), -1)
    for near in smaller_neighbours(at):
        there = np.flatnonzero((near >= 0) & (near < len(at)))
        shared = common_prefix(raw, steps, at[there], at[near[there]])
        better = shared > factor[order[there]]
        factor[order[there[better]]] = shared[better]
        source[order[there[better]]] = at[near[there[better]]]
    return factor, source


def marked_windows(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, keep_first: bool = False) -> np.ndarray:
    """Places of windows whose previous factor is the whole window; unless the first is kept, also of those they were matched with."""
    place, steps = ranks(raw, begin, end, length)
    factor, source = longest_previous(raw, place, steps)
    hit = factor == length
    return place[hit] if keep_first else np.union1d(place[hit], source[hit])


#: Distinct stretches behind one anchor above which its windows are aggregated by their hashes and not gathered in a task.
HOT_STRETCHES = 20_000
#: Ids of texts up to which they are sent to every task; more are sent as a filter of bounded size.
BROADCAST_IDS = 1_000_000
#: A filter has 16 bits for each key, up to so many (32 MB); each of its segments is made on its own.
FILTER_BITS = 1 << 28
SEGMENTS = 256
#: Texts that a task remembers, to leave out copies it has met.
REMEMBERED = 100_000
CHUNK = 2 << 20


def _text_table(docs: DataFrame, text: str, key: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("k"), value.alias("t"), F.xxhash64(value).alias("node"))


def key_filter(keys: DataFrame):
    """A function from an array of longs to whether each may be among the longs of ``keys``, its only column.

    A long of ``keys`` always passes, another one rarely; what passes is still to be joined. Keys are dealt to segments
    by their hash, so that no task and no row holds more than a segment; together they are ``FILTER_BITS`` at most.
    """
    bits = 1 << min(16 * keys.count() // SEGMENTS, FILTER_BITS // SEGMENTS - 1).bit_length()
    mask = np.uint64(bits - 1)

    def spots(x: np.ndarray):
        x = mix(x.view(np.uint64))
        return (x >> np.uint64(56)).astype(np.int64), (x & mask).astype(np.int64), ((x >> np.uint64(28)) & mask).astype(np.int64)

    def deal(batches):
        for batch in batches:
            cols = [pa.array(c, pa.int32()) for c in spots(batch.column(0).to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays(cols, names=["segment", "first", "second"])

    def build(table: pa.Table) -> pa.Table:
        flags = np.zeros(bits, bool)
        for c in ("first", "second"):
            flags[table.column(c).to_numpy()] = True
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    flags = np.zeros((SEGMENTS, -(-bits // 8)), np.uint8)
    for row in keys.mapInArrow(deal, "segment int, first int, second int").groupBy("segment").applyInArrow(build, "segment int, bits binary").collect():
        flags[row.segment] = np.frombuffer(row.bits, np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(flags)

    def may_be(x: np.ndarray) -> np.ndarray:
        segment, *places = spots(x)
        return np.logical_and(*[(sent.value[segment, at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in places])

    return may_be


def anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """k, node, n_bytes, sha256 of the text, and its stretches (h, sh, l): anchor, content hash, first window.

    A stretch ends where the next one, or the text, does. Equal texts have one node; a node that the task has met before
    has no stretches.
    """
    kind = texts.schema["k"].dataType.simpleString()
    stretch = pa.list_(pa.struct([("h", pa.int64()), ("sh", pa.int64()), ("l", pa.int32())]))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sizes, shas, parts, counts, none = [], [], [], [0], []
            for value, node in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = value.as_py().encode()
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
                none.append(_met(seen, node))
                if not none[-1]:
                    raw = np.frombuffer(data, np.uint8)
                    h, first, last = anchors(raw, length)
                    parts.append((h, _stretch_hashes(raw, first, last + length), first))
                    counts.append(len(h))
                else:
                    counts.append(0)
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
            inner = pa.StructArray.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32))], names=["h", "sh", "l"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), inner).cast(stretch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), lists], names=["k", "node", "n_bytes", "sha", "stretches"])

    return texts.mapInArrow(run, f"k {kind}, node long, n_bytes long, sha string, stretches array<struct<h:long,sh:long,l:int>>")


def _stretch_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _places(lists: DataFrame, length: int, may_be) -> DataFrame:
    """h, sh, node, l, r, o: the stretches of ``lists`` (node, n_bytes, o, stretches) whose anchor passes the filter."""

    def run(batches):
        for batch in batches:
            flat, counts = batch.column(3).flatten(), batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            h, sh, first = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            last = np.append(first[1:], 0) - 1
            some = counts > 0
            last[np.cumsum(counts)[some] - 1] = batch.column(1).to_numpy(zero_copy_only=False)[some] - length
            at = np.flatnonzero(may_be(h))
            own = np.repeat(np.arange(len(counts)), counts)[at]
            cols = [pa.array(h[at]), pa.array(sh[at]), batch.column(0).take(pa.array(own)), pa.array(first[at], pa.int32()), pa.array(last[at].astype(np.int32)), batch.column(2).take(pa.array(own))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "sh", "node", "l", "r", "o"])

    return lists.mapInArrow(run, "h long, sh long, node long, l int, r int, o long")


def _of_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(t, node) of the texts that have one of ``nodes`` (node: distinct), and few others."""
    texts = texts.select("t", "node")
    if nodes.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(nodes), "node", "left_semi")
    may_be = key_filter(nodes)

    @F.pandas_udf("boolean")
    def wanted(node: pd.Series) -> pd.Series:
        return pd.Series(may_be(node.to_numpy()).astype(bool))

    return texts.where(wanted("node"))


def _met(seen: set, node: int) -> bool:
    """Whether the task has met the text shortly before."""
    if node in seen:
        return True
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(node)
    return False


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Wanted stretches: (h, sh, at, stretch) with their bytes, or for hot anchors (h, sh, at, w1, w2), two hashes of each window."""
    lists = wanted.groupBy("node").agg(F.collect_list(F.struct("h", "sh", "l", "r", "hot", "o")).alias("w"))  # one document's own

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for value, node, w in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if _met(seen, node):
                    continue
                data = value.as_py().encode()
                for x in w.as_py():
                    if x["hot"]:
                        start = np.arange(x["l"], x["r"] + 1)
                        raw = np.frombuffer(data, np.uint8)[x["l"] : x["r"] + length]
                        keys = _stretch_hashes(raw, start - x["l"], start - x["l"] + length).view(np.int64).tolist()
                        for a, k in enumerate(keys):
                            second = hashlib.blake2b(raw[a : a + length].tobytes(), digest_size=8).digest()
                            rows.append((x["h"], x["sh"], a, None, k, int.from_bytes(second, "little", signed=True), x["o"], x["l"]))
                    else:
                        rows.append((x["h"], x["sh"], 0, data[x["l"] : x["r"] + length], None, None, x["o"], x["l"]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["h", "sh", "at", "stretch", "w1", "w2", "o", "l"])

    joined = _of_nodes(texts, wanted.select("node").distinct()).join(lists, "node").select("t", "node", "w")
    return joined.mapInArrow(run, "h long, sh long, at int, stretch binary, w1 long, w2 long, o long, l int")


def _mark_hot(windows: DataFrame, keep_first: bool) -> DataFrame:
    """(h, sh, a, b): each window of a hot anchor's stretches that equals another (earlier) one; no task gathers a window's members."""
    p = F.struct("o", (F.col("l") + F.col("at")).alias("place")) if keep_first else F.xxhash64("h", "sh", "at")
    windows = windows.withColumn("p", p)
    shared = saved(windows.groupBy("w1", "w2").agg(F.min("p").alias("p0"), F.max("p").alias("p1")).where("p0 <> p1").select("w1", "w2", "p0"), "hot-windows")
    met = windows.join(shared, ["w1", "w2"])
    return (met.where("p <> p0") if keep_first else met).select("h", "sh", F.col("at").alias("a"), F.col("at").alias("b"))


def _mark(stretches: DataFrame, length: int, keep_first: bool = False) -> DataFrame:
    """(h, sh, a, b): runs of windows, counted from the stretch's first, that equal another (earlier) stretch's window."""

    def flush(rows):
        found, distinct = [], {}
        for r in rows:  # the same stretch may come from several tasks
            distinct[r[0], r[1]] = r
        rows = sorted(distinct.values(), key=lambda r: (r[4], r[5]))
        sizes = np.array([len(r[3]) for r in rows], np.int64)
        end = np.cumsum(sizes)
        begin = end - sizes
        at = marked_windows(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), begin, end, length, keep_first)
        if len(at):
            own = np.searchsorted(begin, at, "right") - 1
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(own) > 0)]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            for f, t in zip(first.tolist(), last.tolist(), strict=True):
                r, base = rows[own[f]], begin[own[f]]
                found.append((r[0], r[1], int(at[f] - base) + r[2], int(at[t] - base) + r[2]))
        cols = list(zip(*found, strict=True)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["h", "sh", "a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > CHUNK and r[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield flush(held)

    return stretches.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, sh long, a int, b int")


def _merged(spans: DataFrame) -> DataFrame:
    """node, s: a text's spans (begin << 32 | end) as maximal runs, in order."""

    def run(batches):
        for batch in batches:
            runs = []
            for s in batch.column(1):
                s = np.sort(s.values.to_numpy(zero_copy_only=False))
                begin, reach = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF)
                first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
                runs.append((begin[first] << 32) | reach[np.append(first[1:], len(s)) - 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.int64()))], names=["node", "s"])

    return spans.mapInArrow(run, "node long, s array<long>")


def _kept(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """node, n_removed, n_spans, kept_sha256 (and kept bytes): each text without its merged spans."""
    names = ["node", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for value, node, s in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if _met(seen, node):
                    continue
                data, parts, done, gone = value.as_py().encode(), [], 0, 0
                for x in s:
                    begin, end = x >> 32, x & 0xFFFFFFFF
                    parts.append(data[done:begin])
                    gone += end - begin
                    done = end
                parts.append(data[done:])
                kept = b"".join(parts)
                rows.append((node, gone, len(s), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    joined = _of_nodes(texts, spans.select("node")).join(spans, "node").select("t", "node", "s")
    return joined.mapInArrow(run, "node long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id", with_text: bool = False, keep_first: bool = False) -> DataFrame:
    """Per row of ``docs``: what remains when every byte covered by a repeated ``length``-byte string is removed.

    A string is repeated if it also starts anywhere else, in the same document or another; with ``keep_first`` only if it
    starts earlier, in the order in which the rows are read, so that one copy of everything stays. Returns the key, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 and, on request, kept (bytes; null where nothing was
    removed). Null and empty texts have 0 bytes and keep nothing; texts below ``length`` bytes are kept; repeated rows
    of at least ``length`` bytes are copies of each other and are removed (with ``keep_first`` all but one). Extra columns
    are not read; an empty table gives no rows. Texts are told apart by 64-bit hashes and their lengths.
    """
    if length < max(GRAM, 8):
        raise ValueError(f"length below {GRAM}")
    texts = _text_table(docs, text, key)
    table = saved(anchor_table(texts, length).withColumn("row", F.monotonically_increasing_id()), "anchors")
    heads = saved(table.drop("stretches"), "heads")
    copies = heads.groupBy("node", "n_bytes").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("first_row"))
    copied = copies.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("node", "first_row", F.lit(True).alias("copied"))
    # without keep_first no row's place in the order is carried along
    lists = table.select("node", "n_bytes", (F.col("row") if keep_first else F.lit(0).cast("long")).alias("o"), "stretches")
    if keep_first:  # tasks that met the same text have its stretches twice: the first row's stay
        lists = lists.join(heads.groupBy("node").agg(F.min("row").alias("o")), ["node", "o"], "left_semi").select(lists.columns)
    anchored = lists.select("node", F.inline("stretches")).select("h", F.xxhash64("node", "l").alias("p"))
    # written before it is joined: two plain exchanges, whose hot keys Spark can split
    twice = saved(anchored.groupBy("h").agg(F.min("p").alias("p0"), F.max("p").alias("p1")).where("p0 <> p1").select("h"), "repeated-anchors")
    places = _places(lists, length, key_filter(twice))
    repeated = saved((places if keep_first else places.drop("o")).join(twice, "h"), "repeated")
    for done in (table, twice):
        drop(done)
    # equal texts have one place here, as they have one node
    which = F.struct("o", "l", "node", "r") if keep_first else F.struct("node", "l", "r", F.lit(0).cast("long").alias("o"))
    kinds = repeated.groupBy("h", "sh").agg(F.min(which).alias("w"), F.max(which).alias("z"))
    kinds = saved(kinds.select("h", "sh", "w.node", "w.l", "w.r", "w.o", (F.col("w") != F.col("z")).alias("whole")), "stretch-kinds")
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > HOT_STRETCHES).alias("hot"))
    wanted = saved(kinds.join(mixed, "h"), "wanted")
    cut = saved(_cut(texts, wanted, length), "stretches")
    marks = _mark(cut.where("w1 IS NULL").select("h", "sh", "at", "stretch", "o", "l"), length, keep_first)
    marks = marks.unionByName(_mark_hot(cut.where("w1 IS NOT NULL").select("h", "sh", "at", "w1", "w2", "o", "l"), keep_first))
    asked = kinds if keep_first else kinds.where("not whole")
    part = asked.select("h", "sh").join(marks, ["h", "sh"]).groupBy("h", "sh").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    all_of = F.array(F.struct(F.lit(0).alias("a"), (F.col("r") - F.col("l")).alias("b")))
    if keep_first:  # of stretches that occur twice as a whole, the first keeps what has no earlier copy elsewhere
        first = kinds.select("h", "sh", F.struct("node", "l").alias("first")).join(part, ["h", "sh"], "left")
        marked = saved(first, "marked-stretches")
        spans = repeated.join(marked, ["h", "sh"])
        own = F.struct("node", "l") == F.col("first")
        runs = F.when(~own, all_of).otherwise(F.coalesce("runs", F.array().cast("array<struct<a:int,b:int>>")))
    else:
        full = kinds.where("whole").select("h", "sh", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"))
        marked = saved(full.unionByName(part), "marked-stretches")
        spans = repeated.select("h", "sh", "node", "l", "r").join(marked, ["h", "sh"])
        runs = F.coalesce("runs", all_of)
    spans = spans.select("node", F.transform(runs, lambda x: F.shiftleft((F.col("l") + x.a).cast("long"), 32).bitwiseOR((F.col("l") + x.b + length).cast("long"))).alias("s"))
    spans = spans.groupBy("node").agg(F.flatten(F.collect_list("s")).alias("s")).where(F.size("s") > 0)  # one document's own
    spans = saved(_merged(spans if keep_first else spans.join(copied, "node", "left_anti")), "spans")
    for done in (repeated, kinds, wanted, cut, marked):
        drop(done)
    kept = _kept(texts, spans, with_text)
    kept = kept.dropDuplicates(["node"])
    out = heads.select("k", "row", "node", "n_bytes", "sha").join(copied, "node", "left").join(kept, "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    gone = F.col("copied").isNotNull() & (F.col("row") != F.col("first_row") if keep_first else F.lit(True))
    columns = [
        F.col("k").alias(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
