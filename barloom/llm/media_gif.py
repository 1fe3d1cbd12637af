"""GIF media columns: decoding of LZW code streams, palettes, disposal, transparency and interlace, and timed frames.

Decoding has no loop per code. Between two clear codes the bit place of the i-th code follows from i alone, a table
entry made at code k is the output that starts where code k starts, and so every output sample points to an earlier
one; following all pointers at once, doubling the distance each time, gives the samples in a few array operations.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 64
ROWS = 512
GRAY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def _layout(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the i-th code after a clear code, and bits before it."""
    entries = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    width = np.full(n, min_size + 1)
    for bits in range(min_size + 1, 12):
        width += entries >= (1 << bits)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=before[1:])
    return width, before


_LAYOUTS = {8: _layout(8, 4200)}
_BITS = np.arange(12)


def lzw_encode(samples: bytes) -> bytes:
    """Code stream of 8-bit samples; a clear code whenever the table is full."""
    blocks: list[list[int]] = []
    if samples:
        table: dict[int, int] = {}
        get, codes, free, prefix = table.get, [], 258, samples[0]
        put = codes.append
        for b in samples[1:]:
            key = prefix << 8 | b
            code = get(key)
            if code is None:
                put(prefix)
                table[key] = free
                free += 1
                prefix = b
                if free == 4096:
                    put(256)
                    blocks.append(codes)
                    table, codes, free = {}, [], 258
                    get, put = table.get, codes.append
            else:
                prefix = code
        put(prefix)
    else:
        codes = []
    codes.append(257)
    blocks.append(codes)
    width, _ = _LAYOUTS[8]
    values = np.array([256, *[c for block in blocks for c in block]])
    widths = np.concatenate([[9], *[width[: len(block)] for block in blocks]])
    bits = ((values[:, None] >> _BITS) & 1).astype(np.uint8)
    return np.packbits(bits[_BITS < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_size: int, most: int) -> np.ndarray:
    """Samples of a code stream, at most ``most``. Raises ValueError for a stream that ends or breaks before."""
    if not 1 <= min_size <= 11:
        raise ValueError(f"LZW code size {min_size}")
    clear = 1 << min_size
    raw = np.zeros(len(stream) + 4, np.uint32)
    raw[: len(stream)] = np.frombuffer(stream, np.uint8)
    total, at, done, parts, step = len(stream) * 8, 0, 0, [], 4200
    while done < most:
        width, before = _LAYOUTS.setdefault(min_size, None) or _LAYOUTS.__setitem__(min_size, _layout(min_size, 4200)) or _LAYOUTS[min_size]
        if len(width) < step:
            width, before = _layout(min_size, step)
        n = int(np.searchsorted(before, total - at, "right")) - 1
        n = min(n, step)
        if n <= 0:
            break
        place = at + before[:n]
        byte = place >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7).astype(np.uint32)) & ((1 << width[:n]) - 1).astype(np.uint32)
        codes = codes.astype(np.int64)
        special = (codes == clear) | (codes == clear + 1)
        stop = int(special.argmax()) if special.any() else n
        if stop == n and n == step:  # a table that stays full without a clear code
            step *= 2
            continue
        used = codes[:stop]
        if stop:
            out = _expand(used, clear)
            parts.append(out[: most - done])
            done += len(parts[-1])
            if len(out) == 0:
                break
        if stop == n or codes[stop] == clear + 1:
            break
        at += int(before[stop + 1])
        step = 4200
    got = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if len(got) < most:
        raise ValueError(f"LZW stream has {len(got)} of {most} samples")
    return got


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes."""
    n = len(codes)
    index = np.arange(n)
    made = codes - (clear + 2)  # the code at which the entry began
    literal = made < 0
    bad = made >= np.maximum(index, 1)
    if bad.any():
        cut = int(bad.argmax())
        codes, made, literal, index, n = codes[:cut], made[:cut], literal[:cut], index[:cut], cut
        if not n:
            return np.zeros(0, np.uint8)
    parent = np.where(literal, index, made)
    steps = (~literal).astype(np.int64)
    while True:
        further = parent[parent]
        if np.array_equal(further, parent):
            break
        steps = steps + steps[parent]
        parent = further
    length = steps + 1
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(length, out=begin[1:])
    back = np.where(literal, 0, begin[:-1] - begin[np.where(literal, 0, made)])
    source = (np.arange(begin[-1]) - np.repeat(back, length)).astype(np.int32)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    value = np.zeros(begin[-1], np.uint8)
    value[begin[:-1][literal]] = codes[literal]
    return value[source]


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, rows: int = ROWS, delay_cs: int = 4) -> bytes:
    """Animated grayscale GIF of ``samples``, 64 to a row; each frame covers its rows and is left in place."""
    height = max(1, -(-len(samples) // WIDTH))
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(rows, height).to_bytes(2, "little"), b"\xf7\0\0", GRAY.tobytes()]
    for at in range(0, len(samples), rows * WIDTH):
        part = samples[at : at + rows * WIDTH]
        out += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\0\x08", _sub_blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """A frame after composition: ``rgb`` is the whole canvas, ``box`` the frame's own left, top, width, height."""

    number: int
    start_cs: int
    delay_cs: int
    box: tuple[int, int, int, int]
    rgb: np.ndarray
    alpha: np.ndarray


def decode_gif(data: bytes):
    """Frames of a GIF in order, composed on the canvas.

    Disposal 2 clears the frame's box before the next frame, disposal 3 restores what was there before it; samples of
    the transparent index leave the canvas as it is. Raises ValueError for data that is no GIF, and after the frames before
    the break for data that ends or breaks before its trailer.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    word = lambda i: data[i] | data[i + 1] << 8
    width, height, flags, at = word(6), word(8), data[10], 13
    common = GRAY
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        common, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
    rgb, alpha = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), np.uint8)
    delay, disposal, clear_index, number, now = 0, 0, -1, 0, 0

    def blocks(i: int) -> tuple[bytes, int]:
        parts = []
        while i < len(data) and data[i]:
            parts.append(data[i + 1 : i + 1 + data[i]])
            i += 1 + data[i]
        return b"".join(parts), i + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else -1
            at = after
        elif kind == 0x2C and at + 10 < len(data):
            left, top, w, h, local = word(at + 1), word(at + 3), word(at + 5), word(at + 7), data[at + 9]
            at += 10
            palette = common
            if local & 0x80:
                size = 3 << ((local & 7) + 1)
                palette, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
            stream, after = blocks(at + 1)
            index = lzw_decode(stream, data[at], w * h).reshape(h, w)
            at = after
            if local & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                rows = np.empty_like(index)
                rows[order] = index
                index = rows
            kept = (rgb.copy(), alpha.copy()) if disposal == 3 else None
            x, y = min(left + w, width), min(top + h, height)
            part = index[: max(0, y - top), : max(0, x - left)]
            if len(palette) < 256:
                part = np.minimum(part, len(palette) - 1)
            colours = palette[part]
            if clear_index >= 0:
                seen = part != clear_index
                rgb[top:y, left:x][seen] = colours[seen]
                alpha[top:y, left:x][seen] = 255
            else:
                rgb[top:y, left:x] = colours
                alpha[top:y, left:x] = 255
            yield Frame(number, now, delay, (left, top, w, h), rgb, alpha)
            if disposal == 2:
                rgb[top:y, left:x] = 0
                alpha[top:y, left:x] = 0
            elif disposal == 3:
                rgb, alpha = kept
            number, now = number + 1, now + delay
            delay, disposal, clear_index = 0, 0, -1
        elif kind == 0x3B:
            return
        else:
            break
    raise ValueError("broken before its trailer")


def colour_histogram(rgb: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    """Counts of 64 colour cells, two bits for each of red, green and blue; transparent samples don't count."""
    top = rgb >> 6
    cell = top[..., 0] << 4 | top[..., 1] << 2 | top[..., 2]
    return np.bincount(cell.ravel() if alpha is None or alpha.all() else cell[alpha > 0], minlength=64)


def gif_frames(df: DataFrame, gif: str = "gif", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Timed frames of the GIFs in a binary column: one row per frame.

    Returns the ``keep`` columns, frame, start_cs, delay_cs, width, height, rgb (the canvas after this frame), opaque
    (samples with a colour) and histogram (64 cells). Null, empty or broken data give one row with frame -1 and the
    reason in ``error``; frames before the break are kept.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`k{i}` {kinds[c]}" for i, c in enumerate(keep)], "frame int, start_cs long, delay_cs int, width int, height int, rgb binary, opaque long, histogram array<long>, error string"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(k).slice(i, 1) for k in range(len(keep))]
                data = batch.column(len(keep))[i].as_py()
                try:
                    found = [] if data else [(-1, None, None, None, None, None, None, None, "empty")]
                    frames = decode_gif(data) if data else ()
                    for f in frames:
                        yield _frame_row(row, (f.number, f.start_cs, f.delay_cs, f.rgb.shape[1], f.rgb.shape[0], f.rgb.tobytes(), int((f.alpha > 0).sum()), colour_histogram(f.rgb, f.alpha).tolist(), None))
                except (ValueError, IndexError) as e:
                    found = [(-1, None, None, None, None, None, None, None, str(e)[:200] or "broken")]
                for x in found:
                    yield _frame_row(row, x)

    out = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[gif].alias("gif")).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


_FRAME_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.string()]
_FRAME_NAMES = ["frame", "start_cs", "delay_cs", "width", "height", "rgb", "opaque", "histogram", "error"]


def _frame_row(keys: list[pa.Array], values: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys, *[pa.array([v], t) for v, t in zip(values, _FRAME_TYPES, strict=True)]], names=[*[f"k{i}" for i in range(len(keys))], *_FRAME_NAMES])


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zeros up to the next positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def read_payload(gif: bytes) -> tuple[bytes, str]:
    """Samples of all frames of a GIF that ``encode_gif`` made, and its feature text: frames, time and gray histogram."""
    parts, gray, frames, size, end = [], np.zeros(16, np.int64), 0, (0, 0), 0
    for f in decode_gif(gif):
        left, top, w, h = f.box
        red = f.rgb[top : top + h, left : left + w, 0].reshape(-1)
        gray += np.bincount(red >> 4, minlength=16)
        parts.append(red.tobytes())
        frames, size, end = frames + 1, f.rgb.shape, f.start_cs + f.delay_cs
    return b"".join(parts), f"{size[1]}x{size[0]};frames={frames};cs={end};gray={','.join(map(str, gray))}"


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", with_media: bool = False) -> DataFrame:
    """Every text as a GIF of its UTF-8 bytes, read back from the stored bytes.

    Returns the key, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of what was read back, media_bytes,
    media_sha256, feature and, on request, media. A null text is stored like an empty one: 64 zero bytes. Long texts
    become many frames, coded and decoded one at a time.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * with_media]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media]
    schema = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                data = (value.as_py() or "").encode()
                gif = encode_gif(payload_of(data))
                back, feature = read_payload(gif)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, *[gif] * with_media))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def op3_gif_media(spark, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
