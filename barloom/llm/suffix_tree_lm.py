"""Language-model scores by a probabilistic suffix tree over words.

Nodes of the tree are contexts of preceding words, one pass for each length for as long as longer ones are frequent. As in
the classic construction a context must have at least the share ``P_MIN`` of all tokens, so there are at most 1/P_MIN of
each length however large the corpus is; it is kept if its next-symbol distribution diverges from its parent's by more
than the counts explain. Next symbols are
smoothed into the parent's distribution, down to the root, which knows every training token. A text is scored from the
longest suffix state of each token.

Above the words the tree has a level of phrases, which grows with the corpus. A phrase ends where a hash of its last two
words says so, after about ``PHRASE`` words, or with the text; so equal passages have equal phrases, and no phrase begins
another. Its context is the whole phrase before it in the text. (context, phrase) pairs are counted over all training
documents; those seen ``LEAST`` times are explicit symbols, a context that diverges from the words' distribution is a
state, and what its explicit symbols leave falls back to the product of the words' probabilities. These tables are
written and joined, never broadcast but for keys above the share ``HOT`` of all tokens, at most 1/HOT of them.

All counts are over all training documents. Words above ``HEAD`` of the tokens (at most 1/HEAD of them) are sent to every
task; the others, each too rare to be skewed, are joined by word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved
from barloom.llm._words import Words, mix, slices, text_bytes

HEAD = 1e-6
P_MIN = 1e-4
#: Pseudo-count of the parent's distribution in a context.
STRENGTH = 5.0
#: Words of the longest context that is looked for.
MOST_WORDS = 8
END = np.uint64(0x1D8E4E27C47D124F)
SEVERAL = 3_000_000
#: Words of a phrase on average.
PHRASE = 8
#: Times that a phrase is seen after its context to be a symbol of its own there.
LEAST = 2
HOT = 1e-5
#: Words of 64 bits, 2 ** this many, in the filter that keeps phrases without a state from being shuffled.
FILTER_BITS = 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place in the text) of every token, each text closed by END."""
    words = Words(*text_bytes(texts))
    n = len(words.first) - 1
    doc = words.text_of()
    total = len(doc) + n
    h = np.empty(total, np.uint64)
    of = np.empty(total, np.int64)
    at = np.arange(len(doc)) + doc
    end = words.first[1:] + np.arange(n)
    h[at], h[end] = words.hashes(), END
    of[at], of[end] = doc, np.arange(n)
    begin = words.first[:-1] + np.arange(n)
    return h, of, np.arange(total) - begin[of]


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, counts, len(kinds)).astype(np.int64)


def _counted(all_keys, name: str):
    """Rows (key, n): sums over the arrays of keys of a task, given out whenever many distinct keys are held."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for keys in all_keys:
        held.append(_sum_by(keys, np.ones(len(keys))))
        if sum(len(k) for k, _ in held) > SEVERAL:
            held = [_sum_by(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
            if len(held[0][0]) > SEVERAL // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=[name, "n"])
                held = []
    if held:
        k, c = _sum_by(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=[name, "n"])


def parts_of(batches):
    """The first column of Arrow batches, some texts at a time."""
    for batch in batches:
        for lo, hi in slices(batch.column(0)):
            yield batch.column(0).slice(lo, hi - lo)


def letters_table(train: DataFrame, tree: Tree) -> tuple[DataFrame, type]:
    """Written table of the letters of every text, so that the passes over longer and longer contexts don't read words again."""
    shared, kind = train.sparkSession.sparkContext.broadcast(tree), np.dtype("<i2" if tree.letters < 2**15 else "<i4")

    def run(batches):
        for texts in parts_of(batches):
            h, _, place = sequence(texts)
            raw, first = shared.value.letters_of(h).astype(kind).tobytes(), np.flatnonzero(place == 0) * kind.itemsize
            cut = [*first.tolist(), len(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([raw[i:j] for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], names=["letters"])

    return saved(train.mapInArrow(run, "letters binary"), "lm-letters"), kind


def letter_parts(batches, kind):
    """(letter, place in the text) of all tokens of some texts at a time."""
    for batch in batches:
        texts = batch.column(0)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize)])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 17), "right")) - 1)
            letter = np.frombuffer(b"".join(texts.slice(lo, hi - lo).to_pylist()), kind).astype(np.int64)
            yield letter, np.arange(len(letter)) - np.repeat(ends[lo:hi] - ends[lo], np.diff(ends[lo : hi + 1]))
            lo = hi


def count_words(train: DataFrame) -> DataFrame:
    """(w, c): how often each token, END included, occurs in column t of ``train``."""

    def run(batches):
        yield from _counted((sequence(t)[0].view(np.int64) for t in parts_of(batches)), "w")

    return saved(train.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "unigrams")


@dataclass
class Tree:
    """Model arrays, bounded by HEAD and P_MIN: see the module's text.

    ``head`` sorted hashes of the head words, ``count`` theirs, ``letter`` the number of a frequent word or -1; ``levels``
    per context length the sorted keys of frequent contexts and their states or -1: a key is the number of the context
    without its last word, times letters, plus that word's letter; ``entry`` sorted keys state * letters + next letter, ``entry_n`` their counts; per state its parent (-1: root), the
    sum of its explicit counts and the weight of the parent's distribution.
    """

    total: int
    kinds: int
    head: np.ndarray
    count: np.ndarray
    letter: np.ndarray
    letters: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    entry: np.ndarray
    entry_n: np.ndarray
    parent: np.ndarray
    explicit: np.ndarray
    weight: np.ndarray

    def root(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.total + 0.1 * (self.kinds + 1))

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in ``head``, or -1."""
        if not len(self.head):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, at, -1)

    def letters_of(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return np.where(at >= 0, self.letter[at] if len(self.letter) else -1, -1)

    def contexts(self, letter: np.ndarray, place: np.ndarray):
        """For 1, 2, ... words the tokens with which a frequent context of so many ends, and its number there.

        Only tokens after one that ended a context of one word less are looked at again.
        """
        at = np.flatnonzero(letter >= 0)
        now = letter[at]
        yield at, now
        for keys, _ in self.levels[1:]:
            at, now = self.followed(at, now, letter, place)
            key = now * self.letters + letter[at]
            where = np.searchsorted(keys, key)
            known = np.append(keys, -1)[where] == key
            at, now = at[known], where[known]
            yield at, now

    @staticmethod
    def followed(at: np.ndarray, now: np.ndarray, letter: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens after ``at``, where they are frequent and of the same text, and the ``now`` before them."""
        inside = at + 1 < len(letter)
        at, now = at[inside] + 1, now[inside]
        ok = (letter[at] >= 0) & (place[at] >= 1)
        return at[ok], now[ok]

    def states(self, letter: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Longest kept context before each token; -1 is the root."""
        out = np.full(len(letter), -1)
        for (at, now), (_, state) in zip(self.contexts(letter, place), self.levels, strict=True):
            found = state[now]
            kept = (found >= 0) & (at + 1 < len(letter))
            after, found = at[kept] + 1, found[kept]
            same = place[after] >= 1
            out[after[same]] = found[same]
        return out

    def numbers(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state * self.letters + letter
        if not len(self.entry):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        return np.where((letter >= 0) & (self.entry[at] == key), self.entry_n[at], 0)

    def probability(self, state: np.ndarray, letter: np.ndarray, root: np.ndarray) -> np.ndarray:
        """P(next | state), from the root upwards; ``root`` is the token's probability there."""
        chain = [state]
        while (chain[-1] >= 0).any():
            chain.append(np.where(chain[-1] >= 0, self.parent[chain[-1]], -1))
        p = root.copy()
        for s in reversed(chain):
            on = s >= 0
            if on.any():
                k = s[on]
                p[on] = (self.numbers(k, letter[on]) + self.weight[k] * p[on]) / (self.explicit[k] + self.weight[k])
        return p


def _empty(total: int, kinds: int, head: np.ndarray, count: np.ndarray, least: float) -> Tree:
    frequent = (count >= least) & (count > 0)
    letter = np.full(len(head), -1)
    letter[frequent] = np.arange(int(frequent.sum()))
    none = np.zeros(0, np.int64)
    m = int(frequent.sum())
    return Tree(total, kinds, head, count, letter, max(m, 1), [(np.arange(m), np.full(m, -1))], none, none, none, none, none)


def _contexts(counts: dict[int, tuple[np.ndarray, np.ndarray]], size: dict[int, float], parent_p, parent_of, threshold: float):
    """Contexts whose next-symbol counts diverge: 2 n KL against the parent exceeds what chance and coding cost explain."""
    for c, (letter, n) in counts.items():
        total = max(size[c], n.sum())
        p = parent_p(parent_of(c), letter)
        rest_n, rest_p = total - n.sum(), max(1 - p.sum(), 1e-12)
        gain = 2 * ((n * np.log(np.maximum(n, 1e-12) / (total * p))).sum() + (rest_n * math.log(rest_n / (total * rest_p)) if rest_n > 0 else 0.0))
        if gain > len(n) + 3 * math.sqrt(2 * len(n)) + threshold:
            yield c, letter, n, rest_n


def fit(train: DataFrame, words: DataFrame, p_min: float = P_MIN, head: float = HEAD) -> Tree:
    """The tree of column t of ``train``; ``words`` are its token counts."""
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.where(F.col("c") >= head * total).toPandas()  # at most 1 / head rows
    hashes = top.w.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    tree = _empty(int(total), int(kinds), hashes[order], top.c.to_numpy(np.int64)[order], p_min * total)
    m, context = tree.letters, train.sparkSession.sparkContext
    end_letter = int(tree.letters_of(np.array([END], np.uint64))[0])
    letter_count = np.zeros(m)
    letter_count[tree.letter[tree.letter >= 0]] = tree.count[tree.letter >= 0]

    written, kind = letters_table(train, tree)

    def count(keys_of) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            yield from _counted((keys_of(letter, place) for letter, place in letter_parts(batches, kind)), "k")

        got = written.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # frequent words only
        at = np.argsort(got.k.to_numpy(np.int64))
        return got.k.to_numpy(np.int64)[at], got.n.to_numpy(np.int64)[at]

    threshold = math.log(max(total, 2))
    entries, entry_n, parent, explicit, weight = [], [], [], [], []

    def add(letter, n, rest, up):
        s = len(parent)
        entries.append(s * m + letter)
        entry_n.append(n)
        parent.append(up)
        explicit.append(float(n.sum()))
        weight.append(float(rest) + STRENGTH)
        return s

    def grouped(key, n):
        if not len(key):
            return {}
        at = np.flatnonzero(np.diff(key // m, prepend=-1))
        return {int(key[a] // m): (key[a:b] % m, n[a:b].astype(float)) for a, b in zip(at, [*at[1:], len(key)], strict=True)}

    root_p = tree.root(letter_count)
    size = {int(c): letter_count[c] for c in range(len(tree.levels[0][0]))}
    words_of = np.arange(len(tree.levels[0][0]))[:, None]  # letters of each context
    for depth in range(1, MOST_WORDS + 1):
        shared = context.broadcast(tree)

        def next_keys(letter, place, depth=depth, shared=shared):
            at, now = next(islice(shared.value.contexts(letter, place), depth - 1, None))
            at, now = Tree.followed(at, now, letter, place)
            return now * m + letter[at]

        key, n = count(next_keys)
        found = {c: v for c, v in grouped(key, n).items() if words_of[c, -1] != end_letter}
        # the longest kept context of fewer words: that of the last depth - 1 letters
        above = np.full(len(words_of), -1)
        if depth > 1 and len(words_of):
            at = np.tile(np.arange(depth - 1), len(words_of)).reshape(len(words_of), depth - 1)
            flat = tree.states(np.append(words_of[:, 1:], np.full((len(words_of), 1), end_letter), 1).ravel(), np.append(at, np.full((len(words_of), 1), depth - 1), 1).ravel())
            above = flat.reshape(len(words_of), depth)[:, -1]

        def up_p(c, letter, above=above):
            return root_p[letter] if above[c] < 0 else tree.probability(np.full(len(letter), above[c]), letter, root_p[letter])

        state = np.full(len(tree.levels[-1][0]), -1)
        for c, letter, counts, rest in list(_contexts(found, size, up_p, lambda c: c, threshold)):
            state[c] = add(letter, counts, rest, int(above[c]))
        tree.levels[-1] = (tree.levels[-1][0], state)
        tree.entry = np.concatenate(entries) if entries else np.zeros(0, np.int64)
        tree.entry_n = np.concatenate(entry_n) if entry_n else np.zeros(0, np.int64)
        tree.parent, tree.explicit, tree.weight = np.array(parent, np.int64), np.array(explicit), np.array(weight)
        often = (n >= max(p_min * total, 1)) & (key % m != end_letter) & np.isin(key // m, list(found))
        if not often.any():
            break
        words_of = np.append(words_of[key[often] // m], (key[often] % m)[:, None], 1)
        size = dict(enumerate(n[often].tolist()))
        tree.levels.append((key[often], np.full(int(often.sum()), -1)))
    drop(written)
    return tree


def phrases(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of every phrase of the tokens ``h`` of texts ``of``; each text's last token ends one."""
    ends = np.ones(len(h), bool)
    ends[:-1] = of[1:] != of[:-1]
    inside = of[1:] == of[:-1]
    ends[1:] |= inside & ((mix(h[1:] + h[:-1] * STEP) >> np.uint64(32)) % np.uint64(PHRASE) == 0)
    first = np.flatnonzero(np.append(True, ends[:-1]))
    size = np.diff(np.append(first, len(h)))
    at = (np.arange(len(h)) - np.repeat(first, size)).astype(np.uint64)
    return first, mix(np.add.reduceat(mix(h + at * STEP), first) + size.astype(np.uint64))


def _scores(texts: pa.Array, tree: Tree) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known head tokens, base and score without the tail's root part; per tail word: text, hash, count.

    Last all phrases (text, hash), and of those that have one before them the text, the log10 probability by words without
    the tail's part, and the tail words in it: offsets, places among the text's tail words.
    """
    n = len(texts)
    h, of, place = sequence(texts)
    at = tree.places(h)
    in_head = at >= 0
    root = np.where(in_head, tree.root(tree.count[at]) if len(tree.count) else 1.0, 1.0)
    logs = np.log10(root)
    letter = np.where(in_head, tree.letter[at] if len(tree.letter) else -1, -1)
    state = tree.states(letter, place)
    on = state >= 0
    score = logs.copy()
    if on.any():
        score[on] = np.log10(tree.probability(state[on], letter[on], root[on]))
    tail = np.flatnonzero(~in_head)
    order = tail[np.lexsort((h[tail], of[tail]))]
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(new) - 1 - np.searchsorted(of[order[first]], of[order])
    begin, x = phrases(h, of)
    follows = np.flatnonzero(np.append(False, of[begin[1:]] == of[begin[:-1]]))
    number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    mine = tail[np.isin(number[tail], follows)]
    ends = np.concatenate([[0], np.cumsum(np.bincount(number[mine], minlength=len(begin))[follows])])
    after = of[begin], x, of[begin[follows]], np.add.reduceat(score, begin)[follows], ends, kind[mine]
    return np.bincount(of, minlength=n), np.bincount(of, in_head, n).astype(np.int64), np.bincount(of, logs, n), np.bincount(of, score, n), of[order[first]], h[order[first]], times, after


def phrase_states(seen: DataFrame, total: int, log_tail: float) -> tuple[DataFrame, DataFrame]:
    """(s, size, weight): contexts whose next phrases diverge from the words' distribution; (s, x, n): symbols seen LEAST times.

    ``seen`` has the (s, x) of every phrase, its log10 probability q by words and the number of its tail words.

    In the test a tail word counts as probable as a head word at least is (``log_tail``), which it is less than.
    """
    # pairs seen LEAST times, without what only they need; the rest is counted among the contexts that have one
    pairs = saved(seen.groupBy("s", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("s").distinct(), "lm-contexts")
    near = perhaps_in(seen, pairs)
    by_words = F.col("q") + F.col("tail") * log_tail
    counted = saved(near.groupBy("s", "x").agg(F.count(F.lit(1)).alias("n"), F.max(by_words).alias("q")), "lm-symbols")
    symbols = counted.where(F.col("n") >= LEAST)
    sizes = counted.groupBy("s").agg(F.sum("n").alias("size")).where(F.col("size") >= LEAST)
    ln_q = F.col("q") * math.log(10)
    per = symbols.groupBy("s").agg(F.sum("n").alias("explicit"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * (F.log("n") - ln_q)).alias("part"), F.sum(F.exp(ln_q)).alias("mass"))
    rest = F.col("size") - F.col("explicit")
    other = F.when(rest > 0, rest * F.log(rest / (F.col("size") * F.greatest(1 - F.col("mass"), F.lit(1e-12))))).otherwise(0.0)
    gain = 2 * (F.col("part") - F.col("explicit") * F.log("size") + other)
    diverges = gain > F.col("kinds") + 3 * F.sqrt(2 * F.col("kinds")) + math.log(max(total, 2))
    states = per.join(sizes, "s").where(diverges).select("s", "size", (rest + STRENGTH).alias("weight"))
    return saved(states, "lm-states"), symbols.select("s", "x", "n")


def perhaps_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose hash s may be among those of ``keys``: all that are, and others the more often the more keys there are."""
    word = lambda s: F.shiftrightunsigned(s, 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(s & 63 AS int))")
    bits = keys.groupBy(word("s").alias("word")).agg(F.bit_or(bit).alias("bits"))  # at most 2 ** FILTER_BITS rows
    return rows.join(F.broadcast(bits), word("s") == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def phrase_gains(scored: DataFrame, words: DataFrame, tree: Tree, head: float) -> DataFrame:
    """(row, gain): by how much phrase states change the log10 probability of each text that meets one."""
    norm = tree.total + 0.1 * (tree.kinds + 1)
    bar = HOT * tree.total
    # a phrase's context is the one before it; its tail words are kept as places among the text's
    many = F.greatest(F.size("phrases") - 1, F.lit(0))
    words_at = F.transform("rare", lambda at: F.transform(at, lambda i: F.get(F.col("tail"), i)["w"]))
    following = F.arrays_zip(F.slice("phrases", F.lit(1), many).alias("s"), F.slice("phrases", F.lit(2), many).alias("x"), F.col("q"), words_at.alias("tail"))
    short = F.arrays_zip(F.slice("phrases", F.lit(1), many).alias("s"), F.slice("phrases", F.lit(2), many).alias("x"), F.col("q"), F.transform("rare", F.size).alias("tail"))
    states, symbols = phrase_states(scored.where("learn").select(F.inline(short)), tree.total, math.log10((head * tree.total + 0.1) / norm))
    places = scored.select("row", F.posexplode(following).alias("i", "p")).select("row", "i", "p.*")
    places = perhaps_in(places, states)
    hot = F.broadcast(states.where(F.col("size") >= bar))
    cool = places.join(hot.select("s"), "s", "left_anti").join(states.where(F.col("size") < bar), "s")
    met = saved(places.join(hot, "s").unionByName(cool), "lm-met")
    often = met.join(F.broadcast(symbols.where(F.col("n") >= bar)), ["s", "x"], "left")
    seldom = often.where("n is null").drop("n").join(symbols.where(F.col("n") < bar), ["s", "x"], "left")
    found = often.where("n is not null").unionByName(seldom).select("row", "i", "q", "size", "weight", F.coalesce("n", F.lit(0)).alias("n"))
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(norm))
    rare = met.select("row", "i", F.explode("tail").alias("w")).join(words, "w", "left").groupBy("row", "i").agg(F.sum(log).alias("rare"))
    q = F.col("q") + F.coalesce("rare", F.lit(0.0))
    gain = F.log10((F.col("n") + F.col("weight") * F.pow(F.lit(10.0), q)) / (F.col("size") + STRENGTH))
    # a long phrase's probability is 0 as a double; without a count of its own only the logarithm is needed
    gain = F.when(F.col("n") > 0, gain - q).otherwise(F.log10(F.col("weight") / (F.col("size") + STRENGTH)))
    return found.join(rare, ["row", "i"], "left").groupBy("row").agg(F.sum(gain).alias("gain"))


def score_documents(docs: DataFrame, is_training, text: str = "text", key: str = "doc_id", p_min: float = P_MIN, head: float = HEAD) -> DataFrame:
    """Base and model log10 probability of every whole text, learnt from the rows where ``is_training`` holds.

    Returns the key, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score. A null or
    empty text is its end token alone. Repeated rows get a row each; without training rows every token is unknown.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(is_training, F.lit(False)).alias("learn"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    train = rows.where("learn").select("t")
    words = count_words(train)
    tree = fit(train, words, p_min, head)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    kind = docs.schema[key].dataType.simpleString()
    word = pa.list_(pa.struct([("w", pa.int64()), ("m", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                tokens, known, base, score, of, h, times, after = _scores(part.column(2), shared.value)
                counts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=hi - lo))])
                inner = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], names=["w", "m"])
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), inner).cast(word)
                text_of, x, after_of, q, ends, rare = after
                lists_of = lambda of, values, n=hi - lo: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.int32()))
                columns = [part.column(0), part.column(1), pa.array(number + np.arange(hi - lo)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), lists, lists_of(text_of, pa.array(x.view(np.int64))), lists_of(after_of, pa.array(q)), lists_of(after_of, rare)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "learn", "row", "n_tokens", "known", "base", "score", "tail", "phrases", "q", "rare"])
                number += hi - lo

    scored = saved(rows.mapInArrow(run, f"k {kind}, learn boolean, row long, n_tokens long, known long, base double, score double, tail array<struct<w:long,m:long>>, phrases array<long>, q array<double>, rare array<array<int>>"), "lm-scores")
    tail = scored.select("row", F.inline("tail")).join(words, "w", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(tree.total + 0.1 * (tree.kinds + 1)))
    rest = tail.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * log).alias("rest"))
    gains = phrase_gains(scored, words, tree, head)
    out = scored.drop("tail", "phrases", "q", "rare").join(rest, "row", "left").join(gains, "row", "left")
    plus = F.coalesce("rest", F.lit(0.0))
    return out.select(
        F.col("k").alias(key),
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + plus).alias("base_score"),
        (F.col("score") + plus + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def op4_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score_documents(docs, number % 10 != 0)
