"""Weak supervision of document quality: rules vote or abstain, expectation-maximisation estimates how far to trust each.

Rules see counts of a document's words, symbols, lines and repetitions. Documents with the same votes are alike to the
model, so Spark counts vote patterns over all documents (at most 3 to the number of rules, whatever the input) and the
estimation runs on those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._tables import saved
from barloom.llm._words import Words, mix, slices, text_bytes, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_shouts", "n_symbol_words"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere."""
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    twin = np.zeros(len(k), bool)
    twin[1:] |= same
    twin[:-1] |= same
    out = np.zeros(len(k), bool)
    out[order] = twin
    return out


def count_texts(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    parts = []
    for lo, hi in slices(texts):
        raw, off = text_bytes(texts.slice(lo, hi - lo))
        w = Words(raw, off, lower=False)
        n, hashes, doc = np.diff(w.first), w.hashes(), w.text_of()
        h, at = windows(hashes, w.first, 5)
        salt = lambda d: mix(d.astype(np.uint64) + np.uint64(1))
        again = at[_repeats(h ^ salt(doc[at]))] if len(at) else at
        cover = np.bincount(again, minlength=len(hashes) + 1) - np.bincount(again + 5, minlength=len(hashes) + 1)
        repeated = np.cumsum(cover)[: len(hashes)] > 0
        ends = np.union1d(np.flatnonzero(raw == 10), off[1:] - 1) + 1 if len(raw) else np.zeros(0, np.int64)
        ends = ends[ends > 0]
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        stop = np.where(raw[ends - 1] == 10, ends - 1, ends)
        words_in = np.concatenate([[0], np.cumsum(w.word)])
        full = words_in[stop] > words_in[begins]
        begins, stop = begins[full], stop[full]
        line_doc = np.searchsorted(off, begins, "right") - 1
        keys = w.span_hash(begins, stop) ^ salt(line_doc)
        lines = np.bincount(line_doc, minlength=len(n))
        kinds = np.unique(keys, return_index=True)[1]
        word_kinds = np.unique(hashes ^ salt(doc), return_index=True)[1]
        marks = SYMBOLS[raw]
        marks_to = np.concatenate([[0], np.cumsum(marks)])
        upper = (raw >= 65) & (raw <= 90)
        letters = upper | (raw >= 97) & (raw <= 122) | (raw >= 0xC0)
        parts.append([n, _per_text(w.word & ((raw & 0xC0) != 0x80), off), _per_text(marks, off), lines - np.bincount(line_doc[kinds], minlength=len(n)), _per_text(repeated, w.first), lines, np.bincount(doc[word_kinds], minlength=len(n)), _per_text(upper, off), _per_text(letters, off), _per_text(raw == 33, off), _per_text(marks_to[w.end] > marks_to[w.start], w.first)])
    return [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(len(COUNTS))]


def quality_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """COUNTS of every whole text; null and empty texts count 0 throughout."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in count_texts(batch.column(1))]], names=["k", *COUNTS])

    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumnRenamed("k", key)


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1), good (1) or abstains (0); ``trust`` is the accuracy that estimation starts from."""

    name: str
    bad: Column
    good: Column
    trust: float = 0.9


def rules() -> list[Rule]:
    n, c = F.col("n_words"), F.col
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    length, capitals, shouts, kinds = share(c("word_chars"), n), share(c("n_upper"), c("n_letters")), share(c("n_shouts"), n), share(c("n_distinct"), n)
    symbols, repeats, lines = share(c("n_symbols"), n), share(c("n_repeat_words"), n), share(c("n_dup_lines"), c("n_lines"))
    return [
        Rule("symbols", symbols > 0.2, symbols < 0.02, 0.95),
        Rule("symbol_words", share(c("n_symbol_words"), n) > 0.15, share(c("n_symbol_words"), n) < 0.02, 0.95),
        Rule("symbol_share", share(c("n_symbols"), c("word_chars")) > 0.04, share(c("n_symbols"), c("word_chars")) < 0.005, 0.9),
        Rule("capitals", (capitals > 0.6) & (c("n_letters") >= 20), capitals < 0.3, 0.95),
        Rule("shouting", shouts > 0.3, shouts < 0.02, 0.95),
        Rule("repetition", repeats > 0.5, repeats < 0.05, 0.95),
        Rule("same_lines", (lines > 0.5) & (c("n_lines") >= 4), lines < 0.05),
        Rule("few_kinds", (kinds < 0.15) & (n >= 10) & (n < 2000), (kinds > 0.3) & (n >= 10)),
        Rule("word_length", (length > 12) | (length < 2.2), (length >= 3) & (length <= 9), 0.8),
        Rule("shortness", n < 10, n >= 40, 0.8),
    ]


def votes(rule_list: list[Rule]) -> Column:
    return F.array(*[F.when(F.coalesce(r.bad, F.lit(False)), -1).when(F.coalesce(r.good, F.lit(False)), 1).otherwise(0) for r in rule_list])


#: Documents that the starting accuracies of the rules are worth.
PRIOR_DOCUMENTS = 30.0


def estimate(patterns: np.ndarray, counts: np.ndarray, trust: np.ndarray, prior_good: float = 0.85, rounds: int = 200, weight: float = PRIOR_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and P(vote | class) as [class, rule, vote + 1].

    Two latent classes, votes independent given the class; a rule that abstains on a document says nothing about it.
    Starting accuracies count as ``weight`` documents, half of them in each class, however many real ones there are: they
    say which class is which, and the estimates come from the documents.
    """
    total, m = counts.sum(), patterns.shape[1]
    seen = np.stack([(counts[:, None] * (patterns == v)).sum(0) for v in (-1, 0, 1)], 1) / max(total, 1)
    silent = np.clip(seen[:, 1], 0.01, 0.98)
    spoken = 1 - silent
    start = np.empty((2, m, 3))
    # a bad document trips a few rules only, so most rules call it good: what tells is how rarely a good one is called bad
    wrong = np.minimum(1 - trust, np.maximum(seen[:, 0], 1e-4)) * 0.05
    start[1] = np.stack([wrong, silent, np.maximum(spoken - wrong, 1e-3)], 1)
    caught = np.full(m, 0.25)
    start[0] = np.stack([caught, silent * (1 - caught), np.maximum(spoken * (1 - caught), 1e-3)], 1)
    start /= start.sum(2, keepdims=True)
    like, good = start.copy(), prior_good
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    post = np.zeros(len(counts))
    for _ in range(rounds):
        logs = [np.log(p) + (hot * np.log(like[k]))[:, :, [0, 2]].sum((1, 2)) for k, p in ((0, 1 - good), (1, good))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        moved, post = np.abs(new - post).max(initial=0), new
        for k, p in ((0, 1 - post), (1, post)):
            got = (hot * (counts * p)[:, None, None]).sum(0) + start[k] * weight / 2
            like[k] = got / got.sum(1, keepdims=True)
        good = float(np.clip((counts * post).sum() / max(total, 1), 0.02, 0.98))
        if moved < 1e-9:
            break
    return post, like


def score_quality(counts: DataFrame, rule_list: list[Rule] | None = None) -> DataFrame:
    """``counts`` with votes and quality, the posterior probability of being good. An empty table gives no rows."""
    rule_list = rule_list or rules()
    voted = counts.withColumn("votes", votes(rule_list))
    table = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    table.sort(key=lambda r: r.votes)
    patterns = np.array([r.votes for r in table]).reshape(-1, len(rule_list))
    post, _ = estimate(patterns, np.array([float(r.n) for r in table]), np.array([r.trust for r in rule_list]))
    found = counts.sparkSession.createDataFrame([(list(r.votes), float(p)) for r, p in zip(table, post, strict=True)], "v array<int>, quality double")
    return voted.join(F.broadcast(found), voted.votes == found.v).drop("v")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    counts = saved(quality_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = score_quality(counts)
    return out.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")
