"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their beginnings, so that punctuation behind a word matters less. Logistic regression is
fitted on a bounded sample of labelled rows. For every labelled sentence with identity terms, a copy with the terms
swapped for others of their kind is made, and the squared difference of the two raw scores is a penalty: the words that
name a group can't carry the score, so that neutral mentions stay low. Scoring covers all words of every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm._words import Words, mix, slices, text_bytes

#: Most labelled rows that the classifier is fitted on, chosen by a hash of the id.
SAMPLE_ROWS = 8_000
#: Bytes of the word beginnings that are features too.
PREFIXES = (4, 5, 6, 7)
#: Features kept, by chi-square on the sample.
FEATURES = 4096

# Identity terms by kind; a term is swapped for the next one of its list.
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["girl", "boy"],
    ["female", "male"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["transgender", "cisgender"],
    ["black", "white", "asian", "latino", "arab"],
    ["africans", "europeans", "asians", "americans"],
    ["immigrants", "citizens", "refugees", "natives"],
    ["old", "young"],
    ["deaf", "hearing"],
    ["blind", "sighted"],
]
SWAP = {term: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS for i, term in enumerate(terms)}
_TERM = re.compile(r"\b(" + "|".join(sorted(SWAP, key=lambda t: (-len(t), t))) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str | None:
    """The text with every identity term exchanged, or None where it has none."""
    out, n = _TERM.subn(lambda m: SWAP[m[0].lower()], text)
    return out if n else None


def feature_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each feature occurrence."""
    doc, size = words.text_of(), words.end - words.start
    hashes, docs = [words.hashes()], [doc]
    for n in PREFIXES:
        long = size >= n
        begin = words.start[long]
        hashes.append(mix(words.span_hash(begin, begin + n) + np.uint64(n)))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text and the text's number, in the order of texts; made a few megabytes at a time."""
    hashes, docs = [], []
    for lo, hi in slices(texts):
        h, doc = feature_hashes(Words(*text_bytes(texts.slice(lo, hi - lo))))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        hashes.append(h[new])
        docs.append((doc[new] + lo).astype(np.int32))
    return (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def fit(texts: list[str], labels: np.ndarray, features: int = FEATURES, ridge: float = 1e-3, pairing: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the intercept. Without rows of both labels all weights are 0."""
    labels = labels.astype(float)
    rate = (labels.sum() + 1) / (len(labels) + 20)
    bias = float(np.log(rate / (1 - rate)))
    if len(labels) == 0 or labels.min() == labels.max():
        return np.zeros(0, np.uint64), np.zeros(0), bias
    other = [(i, s) for i, s in enumerate(map(swapped, texts)) if s is not None]
    h, doc = distinct_features(pa.array([*texts, *[s for _, s in other]], pa.large_string()))
    vocabulary, often = np.unique(h, return_counts=True)
    vocabulary = vocabulary[often >= 3]
    at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
    doc, at = doc[known], at[known]
    own = doc < len(texts)
    seen = np.bincount(at[own], minlength=len(vocabulary)).astype(float)
    hits = np.bincount(at[own], labels[doc[own]], len(vocabulary))
    n, positive = float(len(labels)), labels.sum()
    expected = seen * positive / n
    chi = np.where(seen >= 3, (hits - expected) ** 2 / np.maximum(expected * (1 - seen / n), 1e-9), -1)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:features])
    chosen = chosen[chi[chosen] > 0]
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[at] >= 0
    doc, at = doc[keep], place[at[keep]]
    first = np.searchsorted(doc, len(texts))
    rows, cols = doc[:first], at[:first]
    # differences between a sentence and its swapped copy; what they share cancels
    twin_of = np.array([i for i, _ in other], np.int64)
    k, m = len(twin_of), len(chosen)
    key = lambda r, c: r * max(m, 1) + c
    in_twin = key(doc[first:] - len(texts), at[first:])
    of_row = np.searchsorted(twin_of, rows)
    has = (of_row < k) & (twin_of[np.minimum(of_row, max(k - 1, 0))] == rows) if k else np.zeros(len(rows), bool)
    in_own = key(of_row[has], cols[has])
    plus, minus = np.setdiff1d(in_own, in_twin), np.setdiff1d(in_twin, in_own)
    d_row, d_col, d_sign = np.concatenate([plus, minus]) // max(m, 1), np.concatenate([plus, minus]) % max(m, 1), np.concatenate([np.ones(len(plus)), -np.ones(len(minus))])
    w, m1, m2 = np.zeros(m), np.zeros(m), np.zeros(m)
    bias_step = 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        grad = np.bincount(cols, error[rows], m) + ridge * w
        if len(d_row):
            apart = np.bincount(d_row, w[d_col] * d_sign, k) * (2 * pairing / k)
            grad += np.bincount(d_col, apart[d_row] * d_sign, m)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        rate = 0.05 * (1 - t / (rounds + 1))
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        bias_step = 0.9 * bias_step + error.sum()
        bias -= rate * np.clip(bias_step, -1, 1)
    useful = np.abs(w) > 1e-3
    return vocabulary[chosen][useful], w[useful], float(bias)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Classifier from the labelled rows of ``docs``; rows without label, id or text are not used.

    The sample's ids are chosen from the labels alone and sent to the scan of ``docs`` (``sample_rows`` ids at most), so
    no text is shuffled but the sample's own. Of an id's rows the text with the smallest hash is taken, whatever the label:
    each task keeps one row per id, then the ids are reduced by key, so that one task reads ``sample_rows`` rows at most
    however often an id occurs.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    sample = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").select("k", "t", F.xxhash64("t").alias("h"), "y")

    def least(batches):
        kept: dict = {}
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[0] not in kept or (r[2], r[1]) < (kept[r[0]][2], kept[r[0]][1]):
                    kept[r[0]] = r
        cols = list(zip(*kept.values(), strict=True)) if kept else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    kinds = [f.type for f in to_arrow_schema(sample.schema)]
    names = sample.columns
    sample = sample.mapInArrow(least, sample.schema).groupBy("k").agg(F.min(F.struct("h", "t", "y")).alias("s")).select("s.t", "s.y")

    def run(batches):
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (y[i], texts[i]))  # the same sum order whatever the order of arrival
        hashes, weights, bias = fit([texts[i] for i in order], np.array([y[i] for i in order]))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes.view(np.int64), 0)), pa.array(np.append(weights, bias)), pa.array([*[False] * len(weights), True])], names=["h", "w", "bias"])

    found = sample.repartition(1).mapInArrow(run, "h long, w double, bias boolean").toPandas()
    bias = float(found.w[found.bias].sum()) if found.bias.any() else -2.0
    rows = found[~found.bias]
    return rows.h.to_numpy(np.int64).view(np.uint64), rows.w.to_numpy(float), bias


def scores_of(texts: pa.Array, hashes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for lo, hi in slices(texts):
        raw, off = text_bytes(texts.slice(lo, hi - lo))
        z = np.full(hi - lo, bias)
        if len(hashes):
            h, doc = feature_hashes(Words(raw, off))
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            pairs = np.unique(doc[hit].astype(np.int64) * len(hashes) + at[hit])
            z += np.bincount(pairs // len(hashes), weights[pairs % len(hashes)], hi - lo)
        out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
    return np.concatenate(out) if out else np.zeros(0)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; null and empty texts get the score of a text without known words."""
    hashes, weights, bias = model
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores_of(batch.column(at), hashes, weights, bias))], names=[*[f"c{i}" for i in range(len(names))], "s"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return renamed.mapInArrow(run, f"{schema}, s double").toDF(*names, out)


def held_out(key: str = "doc_id"):
    """Rows that labels are never learnt from; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out()))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
