"""Best-fit packing of token sequences by the sum-of-squares rule.

Full pieces are sequences of their own. Every other piece goes where the sum over all gap sizes of (open sequences with
that gap)**2 becomes smallest: into an open sequence or into a new one. The state is one count per gap, whatever the
number of pieces. Pieces are dealt evenly to packing tasks by position, not by a key, so no task depends on the data's
skew, and each task's pieces come longest first.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._tables import saved

#: Pieces that one packing task handles; the number of tasks grows with the input.
TASK_PIECES = 400_000


class PieceIds(dict):
    """Ids of pre-tokens, as little-endian 32-bit bytes. A pre-token's ids don't depend on its neighbours.

    The text is split at once where every character is of Latin script or basic punctuation, for which the
    vocabulary's own split pattern has the same classes in every Unicode version; other texts, and those with a special
    token's string, go to the tokenizer whole. A new pre-token is merged by the tokenizer's own merge ranks; where its
    ids don't follow the merge order, so that they are no ranks, the tokenizer itself encodes it. The memory is bounded:
    beyond ``most`` pre-tokens it starts again. A file with another pre-tokenizer, a normaliser, special tokens that
    don't begin with ``<|``, or other rules of merging has every text encoded whole by the tokenizer.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        known = [chr(i) for i in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]]
        pick = lambda kind: "".join(re.escape(c) for c in known if unicodedata.category(c)[0] == kind)
        letters, numbers = pick("L"), pick("N")
        splits = self._splits(path)
        self.other = re.compile(f"[^{''.join(re.escape(c) for c in known)}]|<\\|" if splits else "")
        self.split = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^\t\n\r {letters}{numbers}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+").findall
        self.encode_piece = (splits and self._by_ranks(path)) or (lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids)

    @staticmethod
    def _splits(path: str) -> bool:
        """Whether the file splits texts as this class does."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        return plain and byte_level and not file.get("normalizer") and all(t["content"].startswith("<|") for t in file.get("added_tokens") or ())

    @staticmethod
    def _by_ranks(path: str):
        """Encoder of one pre-token, if ids are merge ranks."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[piece] = array("I", self.encode_piece(piece)).tobytes()
        return out

    def ids(self, text: str) -> bytes:
        if self.other.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, self.split(text)))


def worker_ids(path: str) -> PieceIds:
    """One memory of pre-tokens for all tasks that a Python worker runs."""
    if path not in _WORKER:
        _WORKER[path] = PieceIds(path)
    return _WORKER[path]


_WORKER: dict[str, PieceIds] = {}


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text followed by ``end_id``.

    Returns the key, piece, start, length, ids_crc32 and, on request, ids. A null or empty text is the end id alone.
    Only longer documents are cut: all pieces but the first are full, so that at most one piece of a document has to
    find a place.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = f"k {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        cache = worker_ids(tokenizer)
        for batch in batches:
            source, rows = [], []
            for i, value in enumerate(batch.column(1)):
                ids = cache.ids(value.as_py() or "") + end
                n = len(ids) // 4
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for j, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    source.append(i)
                    rows.append((j, a, b - a, zlib.crc32(part), *[np.frombuffer(part, "<i4")] * with_ids))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (4 + with_ids)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


class SumOfSquares:
    """Open sequences by their gap, and the rule that picks one."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.open, self.made = capacity, np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece; a new sequence opens only where the piece fits in no open one.

        Using a gap g makes the sum grow by 2 (N[g - length] - N[g] + 1); a full sequence is no longer counted.
        """
        top, n = self.capacity, self.count
        grow = 2 * (n[: top - length] - n[length:top]) + 2
        gap = top
        if len(grow):
            grow[0] = 1 - 2 * n[length]
            grow[n[length:top] == 0] = sys.maxsize
            at = int(grow.argmin())
            if grow[at] < sys.maxsize:
                gap = at + length
        if gap == top:
            number, self.made = self.made, self.made + 1
        else:
            number = self.open[gap].pop()
            n[gap] -= 1
        left = gap - length
        if left:
            self.open[left].append(number)
            n[left] += 1
        return number, top - gap


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset: pieces of one sequence lie without gaps from 0 and never pass ``capacity``.

    Sequence numbers are unique over all tasks. Pieces of length 0 don't occur; a longer piece than ``capacity`` is an
    error. ``pieces`` should be a written table, so that a lost task finds the same rows again.
    """
    tasks = max(1, -(-pieces.count() // TASK_PIECES))
    columns = pieces.columns
    out_schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields], "sequence_id long, offset long"])

    def run(batches):
        from pyspark import TaskContext

        base, state = TaskContext.get().partitionId() << 40, SumOfSquares(capacity)
        for batch in batches:
            placed = [state.place(n) for n in batch.column(columns.index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*columns, "sequence_id", "offset"])

    dealt = pieces.repartition(tasks)
    return dealt.sortWithinPartitions(F.desc("length"), *[c for c in columns if c != "length" and c != "ids"]).mapInArrow(run, out_schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; see the two steps."""
    return pack_pieces(saved(tokenize_pieces(docs, tokenizer, capacity, end_id, text, key, with_ids), "pieces"), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
