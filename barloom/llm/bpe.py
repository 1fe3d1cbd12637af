"""BPE encoding and decoding with byte-level vocabularies, by forced boundaries.

A pair of neighbouring bytes that no token of the vocabulary holds can never end up inside one token, so a text may be
cut between them and the parts encoded apart. Such cuts are taken at two places. In the whole text they are taken before
white space, where the pre-tokenizer always begins a new pre-token whatever stands around it; in each pre-token they are
taken everywhere. What lies between two cuts is encoded alone, fragments of texts are remembered, and the ids are
concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that may end a white-space character, alone or as the end of a longer one.
MAYBE_SPACE = SPACE.copy()
MAYBE_SPACE[0x1C:0x20] = True
MAYBE_SPACE[0x80:] = True


#: One white-space byte at most, a word of Latin letters with or without a space, ASCII punctuation without apostrophes:
#: the pre-tokenizer's own parts of such a fragment, in every version of its character classes.
LATIN = rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC9][\x80-\xBF])+"
SIMPLE = re.compile(rb"([\t-\r]?)( ?" + LATIN + rb")([!-&(-/:-@\[-`{-~]*)")
NEVER = 1 << 40


class Vocabulary:
    """Tokens of a vocabulary file in the format of the tokenizers library, and the decoder.

    The file must hold a byte-level BPE model without normaliser, dropout and affixes, and added tokens that match
    literally; another one raises ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec["normalizer"] or (spec["decoder"] or {}).get("type") != "ByteLevel" or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary {odd}")
        self.added_tokens = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in self.added_tokens):
            raise ValueError(f"{path} has added tokens that don't match literally")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.model_tokens = {i: bytes(self.byte_of[c] for c in token) for token, i in model["vocab"].items()}
        self.tokens = self.model_tokens | {t["id"]: t["content"].encode() for t in self.added_tokens}

    def decode(self, ids: bytes) -> str:
        """Text of ids, special ones included; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        token = self.tokens.get
        return b"".join([token(i, b"") for i in array("I", ids)]).decode("utf-8", "replace")


class ForcedBoundaryBPE(Vocabulary):
    """Encoder of one vocabulary file. Memory is bounded: beyond ``most`` remembered fragments it starts again."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import pre_tokenizers

        super().__init__(path)
        self.use_regex = self.spec["pre_tokenizer"].get("use_regex", True)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=self.use_regex).pre_tokenize_str
        vocab = self.spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in self.spec["model"]["merges"]]
        #: place in the order of merges by left id and right id, and the id that a merge makes
        self.rank = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in reversed([*enumerate(merges)])}
        self.made = [vocab[a + b] for a, b in merges]
        self.id_of = [vocab.get(c) for c, _ in sorted(self.byte_of.items(), key=lambda x: x[1])]
        if None in self.id_of:
            raise ValueError(f"{path} lacks a token for some byte")
        #: forced[a, b]: no token holds byte b right after byte a
        self.forced = np.ones((256, 256), bool)
        for token in self.model_tokens.values():
            for a, b in zip(token, token[1:], strict=False):
                self.forced[a, b] = False
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in self.added_tokens}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.most, self.known = most, {}
        del self.spec

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str], slice_bytes: int = 1 << 20):
        """Ids of each text; texts are handled some at a time, about ``slice_bytes`` together."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= slice_bytes:
                out += self._slice(some)
                some, size = [], 0
        return out + self._slice(some)

    def _slice(self, texts: list[str]) -> list[bytes]:
        runs, own = [], []  # texts between added tokens; per text its runs and the ids of its added tokens
        for text in texts:
            if self.find_added and self.find_added.search(text):
                own.append([])
                for s in self.find_added.split(text):
                    own[-1].append(self.added.get(s) or len(runs))
                    if s not in self.added:
                        runs.append(s.encode())
            else:
                own.append([len(runs)])
                runs.append(text.encode())
        cuts = self.cuts(runs)
        fragments = [[run[i:j] for i, j in zip(c, c[1:], strict=False)] for run, c in zip(runs, cuts, strict=True)]
        if len(self.known) > self.most:
            self.known.clear()
        self._learn({f for some in fragments for f in some}.difference(self.known))
        ids = [b"".join(map(self.known.__getitem__, some)) for some in fragments]
        return [b"".join([ids[x] if isinstance(x, int) else x for x in parts]) for parts in own]

    def cuts(self, runs: list[bytes]) -> list[list[int]]:
        """Certain cuts of each run, its two ends included: forced pairs of a character that is surely no white space and a white-space byte."""
        a, ends = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([0, *map(len, runs)])
        at = np.flatnonzero(SPACE[a[1:]] & self.forced[a[:-1], a[1:]]) + 1
        last, before, third = a[at - 1], a[np.maximum(at - 2, 0)], a[np.maximum(at - 3, 0)]
        # all white space beyond ASCII begins with the bytes C2, E1, E2 or E3
        at = at[~MAYBE_SPACE[last] | ((last >= 0x80) & (((before >= 0xC3) & (before < 0xE0)) | ((third >= 0xE4) & (before >= 0x80) & (before < 0xC0))))]
        low, high = np.searchsorted(at, ends[:-1], "right"), np.searchsorted(at, ends[1:], "left")
        return [[0, *(at[i:j] - e).tolist(), n] for i, j, e, n in zip(low, high, ends, map(len, runs), strict=False)]

    def _learn(self, new: set[bytes]) -> None:
        """Ids of new fragments: their pre-tokens, each cut at every forced pair, the parts merged apart."""
        new, pieces, count = [*new], [], []
        for raw in new:
            before = len(pieces)
            simple = SIMPLE.fullmatch(raw)
            if not self.use_regex:
                pieces.append(raw)
            elif simple:
                pieces += filter(None, simple.groups())
            else:
                pieces += [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.split(raw.decode())]
            count.append(len(pieces) - before)
        a, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])
        cut = self.forced[a[:-1], a[1:]] if len(a) else np.zeros(0, bool)
        cut = np.union1d(np.flatnonzero(cut) + 1, ends)
        parts = np.searchsorted(cut, ends[np.cumsum([0, *count])]).tolist()
        joined, cut = b"".join(pieces), cut.tolist()
        memo: dict[bytes, bytes] = {}
        for raw, i, j in zip(new, parts, parts[1:], strict=False):
            out = []
            for p, q in zip(cut[i:j], cut[i + 1 : j + 1], strict=True):
                part = joined[p:q]
                ids = memo.get(part)
                if ids is None:
                    ids = memo[part] = array("I", self.merge(part)).tobytes()
                out.append(ids)
            self.known[raw] = b"".join(out)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of bytes without a forced pair: the pair of lowest rank is joined first, the leftmost on ties."""
        ids, rank, made = [self.id_of[b] for b in raw], self.rank.get, self.made
        if len(ids) > 100:
            return self._merge_long(ids)
        ranks = [rank(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for runs of any length."""
        n, rank = len(ids), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rank[k], i, k) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (k := a << 32 | b) in rank]
        heapq.heapify(heap)
        while heap:
            low, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j], k = self.made[low], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (p := ids[i] << 32 | ids[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := ids[h] << 32 | ids[i]) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [i for i in ids if i >= 0]


_WORKER: dict[tuple, Vocabulary] = {}


def in_worker(kind: type, path: str):
    """One encoder or decoder for all tasks that a Python worker runs."""
    if (kind, path) not in _WORKER:
        _WORKER[kind, path] = kind(path)
    return _WORKER[kind, path]


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key of every row, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit) and ``ids_sha256``.

    Equal to what the tokenizers library gives without special tokens added, truncation and padding; the string of an
    added token in a text is that token. A null or empty text has no ids. Repeated rows and rows without a key give
    one row each; other columns are not read. ``tokenizer`` is a path that every executor can open.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bpe = in_worker(ForcedBoundaryBPE, tokenizer)
        for batch in batches:
            ids = bpe.encode_all([text or "" for text in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n_tokens", "ids", "ids_sha256"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids binary, ids_sha256 string").withColumnRenamed("k", key)


def decode_ids(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as column ``out``, special tokens kept; null ids are an empty text.

    ``out`` must not be a column yet. Ids that the vocabulary lacks give nothing, broken UTF-8 gives U+FFFD.
    """
    if out.lower() in map(str.lower, encoded.columns):
        raise ValueError(f"there is a column {out} already")
    at = encoded.columns.index(ids)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields], f"`{out}` string"])

    def run(batches):
        decode = in_worker(Vocabulary, tokenizer).decode
        for batch in batches:
            texts = pa.array([decode(value.as_py() or b"") for value in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return decode_ids(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
