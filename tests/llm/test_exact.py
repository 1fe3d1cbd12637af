"""Operators with one right answer, against plain versions of it."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import defaultdict

import pytest

from barloom.llm import media_gif, mixing, ngram_join, packing, pii, quality, sharding, suffix_dedup, suffix_tree_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture(params=["edge", "docs", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def shingles(text, n=5):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def join_model(rows):
    sets = [shingles(t) for _, t in rows]
    at, parent = defaultdict(list), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in at[x]:
                shared[j] += 1
            at[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        names[find(i)].append(k)
    least = {c: min((k for k in ks if k is not None), default=None) for c, ks in names.items()}
    return by_row((k, len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows))


def test_ngram_join(table):
    got = by_row((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table).collect())
    assert got == join_model(pairs(table))


def test_ngram_join_more(more_docs):
    got = by_row((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(more_docs).collect())
    assert got == join_model(pairs(more_docs))


def repeats_model(rows, length=200):
    seen = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for i, b in enumerate(texts):
        for j in range(len(b) - length + 1):
            seen[hashlib.blake2b(b[j : j + length], digest_size=12).digest()].append((i, j))
    gone = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i][j : j + length] = b"\1" * length
    out = []
    for (k, _), b, g in zip(rows, texts, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out.append((k, len(b), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return by_row(out)


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_suffix_dedup(request, name):
    table = request.getfixturevalue(name)
    out = suffix_dedup.remove_repeats(table)
    got = by_row((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == repeats_model(pairs(table))


def first_model(rows, length=200):
    """What stays if a string that starts earlier anywhere goes."""
    seen, out = set(), []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if b[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(b[j : j + length])
        out.append((k, sum(gone), hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return by_row(out)


@pytest.mark.parametrize("hot", [10, 20_000])
def test_suffix_dedup_keeps_first(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", hot)
    own = lambda i: hashlib.sha256(str(i).encode()).hexdigest() * 4
    passage = " ".join(f"clause{i}" for i in range(60))
    rows = [(0, own(0)), (1, passage + own(1)), (2, own(2) + passage), (3, passage + own(1)), (4, None), (5, "x" * 700), (6, own(6) + own(0) + own(6) + own(0)), (7, passage[50:400] + own(7))]
    rows += [(20 + i, own(30 + i) + passage + own(-i - 40)) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = by_row((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(table, keep_first=True).collect())
    assert got == first_model(rows)


def test_suffix_dedup_shared_passage(spark, monkeypatch):
    """A passage that many documents share, each with its own surroundings, is not gathered in one task."""
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", 10)
    mark, largest = suffix_dedup._mark, []

    def watched(stretches, length, keep_first):
        largest.append(max((r["count"] for r in stretches.groupBy(stretches.columns[0]).count().collect()), default=0))
        return mark(stretches, length, keep_first)

    monkeypatch.setattr(suffix_dedup, "_mark", watched)
    passage = " ".join(f"clause{i}" for i in range(35))
    own = lambda i: hashlib.sha256(str(i).encode()).hexdigest() * 4
    rows = [(i, own(i) + passage + own(-i - 1)) for i in range(60)] + [(60, own(60)), (61, own(61)[:100] + passage[:210]), (62, own(62) + own(62))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_dedup.remove_repeats(table)
    got = by_row((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    assert got == repeats_model(rows)
    assert largest and max(largest) <= 10


def test_suffix_dedup_shuffles_what_repeats(spark, monkeypatch):
    """Stretches and texts that repeat nothing are left out before a shuffle, also where too many texts have spans to send their ids."""
    for name, value in (("BROADCAST_IDS", 0), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    own = lambda i: "".join(hashlib.sha256(f"{i}:{j}".encode()).hexdigest() for j in range(300))
    passage = " ".join(f"clause{i}" for i in range(60))
    rows = [(i, own(i)) for i in range(60)] + [(60, passage + own(60)), (61, own(61)[:100] + passage), (62, own(62)[:70] + own(0)[900:1500]), (63, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()

    def written():
        time.sleep(0.3)
        spark.range(1).count()  # figures are kept up to date by events
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before, conf = written(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(conf, -1)
    try:
        out = suffix_dedup.remove_repeats(table)
        got = by_row((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    finally:
        spark.conf.unset(conf)
    moved = written() - before
    assert got == repeats_model(rows)
    assert 0 < moved < 0.8 * sum(len(t or "") for _, t in rows)


@pytest.mark.parametrize("most", [1 << 12, 1 << 28])
def test_suffix_dedup_filter(spark, monkeypatch, most):
    """No key is lost, however full the filter is; with 16 bits for each, few others pass."""
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", most)
    keys = np.random.default_rng(5).integers(-(2**63), 2**63, 4000, dtype=np.int64)
    may_be = suffix_dedup.key_filter(spark.createDataFrame([(int(x),) for x in keys[:2000]], "h long"))
    assert may_be(keys[:2000]).all()
    if most == 1 << 28:
        assert may_be(keys[2000:]).mean() < 0.05
    assert not suffix_dedup.key_filter(spark.createDataFrame([], "h long"))(keys).any()


def test_longest_previous():
    import numpy as np

    rng = np.random.default_rng(3)
    for text in (b"abcdefghij" * 5, bytes(rng.integers(97, 99, 300, dtype=np.uint8)), b"x" * 60, bytes(rng.integers(97, 123, 200, dtype=np.uint8)) * 2):
        raw, n = np.frombuffer(text, np.uint8), 20
        place, steps = suffix_dedup.ranks(raw, np.array([0]), np.array([len(raw)]), n)
        factor, source = suffix_dedup.longest_previous(raw, place, steps)
        shared = lambda p, q, text=text, n=n: next((i for i in range(n) if text[p + i] != text[q + i]), n)
        for p, f, s in zip(place.tolist(), factor.tolist(), source.tolist(), strict=True):
            assert f == max((shared(p, q) for q in range(p)), default=0)
            assert (s == -1) == (f == 0) and (s == -1 or (s < p and shared(p, s) == f))


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_model(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base(table):
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.base]) for r in pii.find_personal_data(table).collect())
    assert got == sorted((str(k), base_model(t)) for k, t in pairs(table))


def test_pii_spans_hold_base(docs):
    for r in pii.find_personal_data(docs).collect():
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert {(s.kind, s.start, s.end) for s in r.base} <= set(spans) and len(set(spans)) == len(spans)


def test_pii_unseen_identifiers(spark):
    """Unseen numbers and addresses of several words, and those right behind another number, are found by their context."""
    seeds = [(i, f"tel +44 20 7946 {1000 + i} and mail bob{i}@example.org") for i in range(30)]
    label = "tel" + "x" * 60
    seeds += [(100 + i, f"{label} +44 20 7946 {2000 + i}") for i in range(30)]
    unseen = {200: ["020 7946 0958"], 201: ["(555) 123-4567"], 202: ["555-123-4567", "555-987-6543"], 204: ["555-123-9999"]}
    rows = [*seeds, *((k, "tel " + " ".join(v)) for k, v in unseen.items() if k != 204), (203, "mail jo at example dot org"), (204, f"{label} 555-123-9999"), (205, "room 020 7946 0958 is empty and mail at noon dot")]
    unseen[203] = ["jo at example dot org"]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in sorted(r.spans, key=lambda s: s.start)] for r in pii.find_personal_data(table).collect()}
    assert {k: got[k] for k in unseen} == unseen and got[205] == []


def test_pii_bootstrap(spark):
    """Found numbers become seeds: their other words are patterns that lead to numbers no first seed's words lead to."""
    rows = [(i, f"tel +44 20 7946 {1000 + i} please") for i in range(30)]
    rows += [(100 + i, f"tel 555-123-{2000 + i} please") for i in range(6)]
    rows += [(200 + i, f"fon 555-123-{2000 + i} now") for i in range(6)]  # the same numbers behind another word
    rows += [(300, "fon 555-777-8888 now"), (301, "shelf 555-777-9999 is full"), (302, "fon"), (303, None), (304, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(table).collect()}
    assert all(got[100 + i] == [("phone", 4, 16)] and got[200 + i] == [("phone", 4, 16)] for i in range(6))
    assert got[300] == [("phone", 4, 16)] and got[301] == got[302] == got[303] == got[304] == []


def test_pii_long_chain(spark):
    """Each word leads to numbers that also stand behind the next word: seven rounds are needed and taken."""
    around = lambda step, value: [f"{w}{'klmnopqr'[step]} {value} {w}{'klmnopqr'[step]}" for w in ("west", "east")]
    texts = [t for i in range(30) for t in around(0, f"+44 20 7946 {1000 + i}")]
    texts += [t for step in range(7) for i in range(6) for side in (0, 1) for t in around(step + side, f"555-{200 + step}-{2000 + i}")]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(table).where("size(spans) = 1").count()
    assert found == len(rows)
    spans = pii.matches(table, "text", ("doc_id",))[1]
    spans = spans.withColumn("ok", pii.valid(spans.kind, spans.value))
    assert pii.discover(spans, rounds=5).count() < len(rows) - 60


def test_redaction(edge):
    out = pii.redact(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[10].startswith("mail [EMAIL] or [PHONE], ip [IP] and 300.1.1.1")
    assert texts[11].startswith("card [CARD] bad 4111 1111 1111 1112 a@[EMAIL] x@y")
    assert texts[2] is None and texts[1] == ""


def quality_model(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base(table):
    got = by_row((r.doc_id, *(r[c] for c in quality.COUNTS[:5])) for r in quality.quality_counts(table).collect())
    assert got == by_row((k, *quality_model(t)) for k, t in pairs(table))


def test_quality_posterior(docs, empty):
    from pyspark.sql import functions as F

    out = quality.score_quality(quality.quality_counts(docs))
    assert out.count() == docs.count() and out.where((F.col("quality") < 0) | (F.col("quality") > 1)).isEmpty()
    assert quality.score_quality(quality.quality_counts(empty)).isEmpty()


def test_gif(table):
    rows = media_gif.store_texts(table, with_media=True).collect()
    got = by_row((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    want = []
    for k, t in pairs(table):
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((k, len(b), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == by_row(want)
    for r in rows:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()


def test_gif_frames_rules(spark):
    """Disposal 2 clears, disposal 3 restores, the transparent index leaves the canvas."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(samples, disposal, clear=None, box=(0, 0, 2, 1)):
        flags = disposal << 2 | (clear is not None)
        head = b"\x21\xf9\x04" + bytes([flags, 10, 0, clear or 0, 0]) + b"\x2c" + b"".join(x.to_bytes(2, "little") for x in box) + b"\0\x08"
        return head + media_gif._sub_blocks(media_gif.lzw_encode(bytes(samples)))

    gif = b"GIF89a\x02\0\x01\0\xf1\0\0" + palette + frame([1, 1], 0) + frame([2, 2], 3) + frame([3, 0], 2, 0) + frame([2, 0], 0, 0) + b"\x3b"
    df = spark.createDataFrame([(1, bytearray(gif)), (2, None), (3, bytearray(b"junk"))], "doc_id long, gif binary")
    rows = sorted(media_gif.gif_frames(df).collect(), key=lambda r: (r.doc_id, r.frame))
    red, green, blue, none = b"\xff\0\0", b"\0\xff\0", b"\0\0\xff", b"\0\0\0"
    assert [bytes(r.rgb) for r in rows[:4]] == [red + red, green + green, blue + red, green + none]
    assert [r.start_cs for r in rows[:4]] == [0, 10, 20, 30] and [r.opaque for r in rows[:4]] == [2, 2, 2, 1]
    assert sum(rows[0].histogram) == 2 and [(r.doc_id, r.frame) for r in rows[4:]] == [(2, -1), (3, -1)]


def test_gif_frames_broken(spark):
    """Cut and corrupt data: frames before the break, then one row with the reason."""
    import random

    rng = random.Random(4)
    samples = bytes(rng.randrange(256) for _ in range(64 * 40))
    whole = media_gif.encode_gif(samples, rows=16)  # frames of 16, 16 and 8 rows
    first = whole.index(b"\x21\xf9", 800 + len(whole) // 4)  # the second frame's control block
    torn = bytearray(whole)
    body = whole.index(b"\x2c", first) + 11
    torn[body + 20 : body + 24] = b"\xff\xff\xff\xff"
    data = [(1, bytearray(whole)), (2, bytearray(whole[: first + 300])), (3, bytearray(whole[:-1])), (4, torn), (5, bytearray(whole[:20])), (6, bytearray(whole[: first + 3])), (7, bytearray(whole[: first // 2 + 390]))]  # 7: in the first frame
    rows = media_gif.gif_frames(spark.createDataFrame(data, "doc_id long, gif binary")).collect()
    frames = {k: [r.frame for r in rows if r.doc_id == k] for k, _ in data}
    assert frames == {1: [0, 1, 2], 2: [0, -1], 3: [0, 1, 2, -1], 4: [0, -1], 5: [-1], 6: [0, -1], 7: [-1]}
    assert all((r.error is None) == (r.frame >= 0) for r in rows)


def test_lm_base(table):
    from pyspark.sql import functions as F

    import math
    from collections import Counter

    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    got = suffix_tree_lm.score_documents(table, number % 10 != 0).collect()
    rows = pairs(table)
    learn = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 != 0
    tokens = lambda t: [*WORD.findall(lower(t or "")), None]
    c = Counter(w for k, t in rows if learn(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = by_row((k, not learn(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 2)) for k, t in rows)
    have = by_row((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 2)) for r in got)
    assert [r[:5] for r in have] == [r[:5] for r in want]
    for a, b in zip(have, want, strict=True):
        assert abs(a[5] - b[5]) <= 0.02 + 1e-6 * abs(b[5])


def test_lm_is_better_than_base(more_docs):
    from pyspark.sql import functions as F

    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = suffix_tree_lm.score_documents(more_docs, number % 10 != 0).where("held_out")
    a, b = out.agg(F.sum("score"), F.sum("base_score")).first()
    assert a > b


def test_packing_hostile(edge, tmp_path):
    """Every row of the hostile table, and files with other pre-tokenizers, against the tokenizer."""
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    path = Path(packing.tokenizer_path())
    other = tmp_path / "prefix.json"
    file = json.loads(path.read_text(encoding="utf-8"))
    file["pre_tokenizer"]["add_prefix_space"] = True
    other.write_text(json.dumps(file), encoding="utf-8")
    rows = [(i, r.text) for i, r in enumerate(edge.collect())]
    table = edge.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for file in (path, other, path.with_name("word_bpe_49k.json")):
        tok, got = Tokenizer.from_file(str(file)), defaultdict(list)
        for r in sorted(packing.tokenize_pieces(table, str(file), with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
            got[r.doc_id] += r.ids
        for i, text in rows:
            assert got[i] == [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing(table):
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(table, packing.tokenizer_path(), with_ids=True).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 1024 and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.piece].append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    texts = pairs(table)
    if len({k for k, _ in texts}) == len(texts):
        for k, t in texts:
            want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            got, piece = [], 0
            while (k, piece) in by_doc:
                (r,) = by_doc[k, piece]
                assert r.start == len(got)
                got += r.ids
                piece += 1
            assert json.dumps(got) == json.dumps(want)
    total = sum(r.length for r in rows)
    assert len(bins) <= max(1.1 * -(-total // 1024), -(-total // 1024) + 2)


def test_sharding(table):
    rows = sharding.shard_groups(table, 40, keep=("doc_id", "text")).collect()
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        data = (r.text or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
        slots[r.shard].append(r.slot)
        groups[r.text or ""].add(r.shard)
    assert len(rows) == table.count() and all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 40 for s in slots)


def test_best_fit_decreasing():
    assert sharding.best_fit_decreasing([5, 4, 3, 3, 2, 2, 1], 10) == [0, 0, 1, 1, 1, 1, 0]


def test_capacities():
    """The tree gives the tightest bin, whatever the order in which bins come and go."""
    import random

    rng, tree, plain = random.Random(5), sharding.Capacities(), []
    for i in range(400):
        room = rng.randrange(100)
        tree.add(room, i)
        plain.append((room, i))
        size = rng.randrange(60)
        fits = sorted(x for x in plain if x[0] >= size)
        assert tree.tightest(size) == (fits[0][1] if fits else None)
        if fits:
            plain.remove(fits[0])
            plain.append((fits[0][0] - size, fits[0][1]))


def test_shard_balance(more_docs):
    """Shards differ by less than a hundredth, and no group is divided."""
    rows = sharding.shard_groups(more_docs, 40, keep=("doc_id", "text")).collect()
    total, where = defaultdict(int), defaultdict(set)
    for r in rows:
        total[r.shard] += r.size
        where[r.text or ""].add(r.shard)
    assert len(total) == 40 and max(total.values()) <= 1.01 * min(total.values()) and all(len(w) == 1 for w in where.values())


def test_quality_estimates(more_docs, middle, spark):
    """Accuracies of simulated rules are recovered, and verdicts agree with the labels of texts that pass the base rules."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    caught = np.array([0.6, 0.5, 0.3, 0.4])
    votes = np.where(good[:, None], np.where(rng.random((40_000, 4)) < 0.02, -1, 1), np.where(rng.random((40_000, 4)) < caught, -1, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, like = quality.estimate(patterns, counts.astype(float), np.full(4, 0.9))
    assert np.abs(like[0][:, 0] - caught).max() < 0.05 and np.abs(like[1][:, 0] - 0.02).max() < 0.02
    assert abs((counts * post).sum() / counts.sum() - 0.8) < 0.03
    out = quality.score_quality(quality.quality_counts(more_docs)).where((F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words")))
    labels = spark.read.parquet(f"{middle}/labels.parquet").select("doc_id", F.col("quality").alias("y")).where("y is not null")
    rows = out.join(labels, "doc_id").select("quality", "y").collect()
    assert sum((r.quality >= 0.5) == (r.y == 1) for r in rows) >= 0.98 * len(rows) > 0


def test_mixing(table):
    rows = mixing.mix_sources(table, keep=("doc_id", "text", "source")).collect()
    assert len(rows) == table.count()
    taken, target = defaultdict(int), {}
    largest = defaultdict(int)
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] + 1


def test_mixing_copies(spark):
    """600 copies of one row beside another source: as many copies are taken as the budget allows."""
    rows = [(7, "a", " ".join(["w"] * 10))] * 600 + [(i, "b", " ".join(["v"] * 10)) for i in range(600)] + [(1, None, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    want = {"a": 4000, "b": 8000, None: 0}
    got = defaultdict(int)
    for r in mixing.mix_sources(table, keep=("source",)).collect():
        assert r.taken in {"a": (0, 10), "b": (10, 20), None: (0,)}[r.source]
        got[r.source] += r.taken
    assert got == want
    mixed = {r.source: r["count"] for r in mixing.mixed_documents(table).groupBy("source").count().collect()}
    assert mixed == {"a": 400, "b": 800, None: 3}


def test_mixed_documents(edge):
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns
    want = sum(r.taken // r.size for r in mixing.mix_sources(edge).collect() if r.size)
    assert sum(1 for r in out.collect() if WORD.search(r.text or "")) == want


def test_lm_tree(spark):
    """Probabilities of a state sum to 1 with the root's share of unknown words, and contexts are as long as they tell something."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    plain = [" ".join(rng.choice("abcdef") for _ in range(40)) for _ in range(200)]
    # after "x y z" comes "q", after "w y z" comes "r": only three words tell
    told = ["x y z q " * 10 + "w y z r " * 10 for _ in range(60)]
    train = spark.createDataFrame([(t,) for t in plain + told], "t string")
    tree = suffix_tree_lm.fit(train, suffix_tree_lm.count_words(train))
    assert len(tree.levels) >= 3 and max((tree.levels[2][1] >= 0).sum(), 0) > 0
    letters = np.arange(tree.letters)
    c = np.zeros(tree.letters)
    c[tree.letter[tree.letter >= 0]] = tree.count[tree.letter >= 0]
    rest = 1 - tree.root(c).sum()
    for s in range(len(tree.parent)):
        p = tree.probability(np.full(tree.letters, s), letters, tree.root(c))
        unknown, up = rest, s
        chain = []
        while up >= 0:
            chain.append(up)
            up = tree.parent[up]
        for k in reversed(chain):
            unknown *= tree.weight[k] / (tree.explicit[k] + tree.weight[k])
        assert (p > 0).all() and abs(p.sum() + unknown - 1) < 1e-9
    h, _, place = suffix_tree_lm.sequence(pa.array(["x y z q", "w y z q"]))
    letter = tree.letters_of(h)
    state = tree.states(letter, place)
    p = tree.probability(state, letter, tree.root(c[letter]))
    assert p[3] > 0.8 and p[8] < 0.1


@pytest.mark.parametrize("head", [1e-6, 0.004])
def test_lm_phrases(spark, head):
    """Scores with phrase states against a plain model over words; without frequent words the tree's part is the base."""
    import math
    import random
    from collections import Counter

    import pyarrow as pa
    from pyspark.sql import functions as F

    pick = random.Random(5)
    fresh = lambda n: [f"w{pick.randrange(400)}" for _ in range(n)]
    shared = [fresh(90) for _ in range(4)]
    rows = [(i, " ".join(fresh(30) + shared[i % 4] * (i % 3 > 0) + fresh(20))) for i in range(60)]
    rows += [(100 + i, " ".join(shared[0])) for i in range(12)] + [(200, ""), (201, None), (202, "a " * 300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_tree_lm.score_documents(table, F.col("doc_id") % 5 != 0, p_min=2.0, head=head).collect()}

    def split(t):
        h, of, _ = suffix_tree_lm.sequence(pa.array([t]))
        first = [*suffix_tree_lm.phrases(h, of)[0], len(h)]
        words = [*WORD.findall(lower(t or "")), None]
        return [tuple(words[a:b]) for a, b in zip(first, first[1:], strict=False)]

    texts = {k: split(t) for k, t in rows}
    learn = {k: k % 5 != 0 for k, _ in rows}
    c = Counter(w for k, parts in texts.items() if learn[k] for x in parts for w in x)
    total = sum(c.values())
    p = lambda w: (c[w] + 0.1) / (total + 0.1 * (len(c) + 1))
    least = (head * total + 0.1) / (total + 0.1 * (len(c) + 1))
    log_q = lambda x: sum(math.log10(p(w)) for w in x)
    bound = lambda x: sum(math.log(p(w) if c[w] >= head * total else least) for w in x)
    seen = Counter((s, x) for k, parts in texts.items() if learn[k] for s, x in zip(parts, parts[1:], strict=False))
    size = Counter()
    for (s, _), n in seen.items():
        size[s] += n
    states = {}
    for s, m in size.items():
        symbols = {x: n for (y, x), n in seen.items() if y == s and n >= 2}
        if symbols:
            rest = m - sum(symbols.values())
            gain = 2 * sum(n * (math.log(n / m) - bound(x)) for x, n in symbols.items())
            gain += 2 * rest * math.log(rest / (m * max(1 - sum(math.exp(bound(x)) for x in symbols), 1e-12))) if rest else 0
            if gain > len(symbols) + 3 * math.sqrt(2 * len(symbols)) + math.log(total):
                states[s] = symbols, rest + 5.0, m + 5.0
    assert len(states) > 20
    better = 0
    for k, parts in texts.items():
        want = sum(log_q(x) for x in parts)
        assert abs(got[k].base_score - want) < 1e-6 * (1 + abs(want))
        for s, x in zip(parts, parts[1:], strict=False):
            if s in states:
                symbols, weight, whole = states[s]
                want += math.log10((symbols.get(x, 0) + weight * 10 ** log_q(x)) / whole) - log_q(x)
        assert abs(got[k].score - want) < 1e-6 * (1 + abs(want))
        better += got[k].held_out and got[k].score > got[k].base_score + 10
    assert better >= 5
