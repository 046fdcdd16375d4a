"""Media columns: byte payloads as GIF images, decoded from their LZW code streams.

``encode`` stores samples as the frames of a GIF89a with a grey palette; ``decode`` reads any GIF87a or GIF89a: global
and local palettes, interlacing, transparency, disposal and delays. ``store`` writes a table of media; ``read`` decodes
it into payload digests, timed frames and colour histograms. A medium that is damaged, or ends early, raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import storage

#: Samples in a row, and rows in a frame at most.
WIDTH, ROWS = 64, 1024
#: Delay of a stored frame in hundredths of a second.
DELAY = 10
#: Bins of a histogram, for each of red, green and blue.
BINS = 16

_CLEAR, _END = 256, 257
_BASE = [bytes([i]) for i in range(256)]


def _schedule(bits: int, n: int) -> np.ndarray:
    """Widths of the first n codes after a clear code, for samples of ``bits`` bits."""
    free = np.maximum(np.arange(n) - 1, 0) + (1 << bits) + 2
    return np.minimum(np.maximum(np.floor(np.log2(free)).astype(np.int64) + 1, bits + 1), 12)


_WIDTHS = {b: _schedule(b, 8192) for b in range(2, 9)}
_STARTS = {b: np.concatenate([[0], np.cumsum(w)]) for b, w in _WIDTHS.items()}


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = [_CLEAR]
    add = codes.append
    marks = [0]
    table: dict[int, int] = {}
    get = table.get
    free = 258
    it = iter(data)
    prefix = next(it)
    for b in it:
        key = prefix << 8 | b
        c = get(key)
        if c is None:
            add(prefix)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                marks.append(len(codes))
                add(_CLEAR)
                table.clear()
                free = 258
            prefix = b
        else:
            prefix = c
    add(prefix)
    add(_END)
    code = np.array(codes, np.int64)
    # a clear code ends its stretch, so it has the width of the position it stands at
    width = np.empty(len(code), np.int64)
    w = _WIDTHS[8]
    width[0] = 9
    ends = [*marks[1:], len(code) - 1]
    for p, q in zip(marks, ends):
        width[p + 1 : q + 1] = w[: q - p]
    at = np.cumsum(width) - width
    v, byte = code << (at & 7), at >> 3
    n = int(at[-1] + width[-1] + 7) >> 3
    out = sum(np.bincount(byte + i, (v >> 8 * i) & 255, n + 3) for i in range(3))
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """``most`` samples of a code stream. One that breaks off before, or has a code that no entry stands for, raises
    ValueError."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    size, pos, out, made = 8 * len(data), 0, [], 0
    base = _BASE[:clear] + [b"", b""]
    table, prev, fresh = base[:], b"", True
    while made < most and pos < size:
        if fresh:
            start, width = _STARTS[bits], _WIDTHS[bits]
            n = int(np.searchsorted(start, size - pos, "right")) - 1
            at, width = pos + start[:n], width[:n]
        else:  # the table stays full until a clear code comes
            n = min(8192, (size - pos) // 12)
            at, width = pos + 12 * np.arange(n), np.full(n, 12)
        if n <= 0:
            break
        byte = at >> 3
        code = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((code == clear) | (code == end))
        last = int(stop[0]) if len(stop) else n
        if fresh:
            table, prev = base[:], b""
        add, put = table.append, out.append
        room = 4096 - len(table)
        for c in code[:last].tolist():
            if c < len(table):
                e = table[c]
                if prev and room > 0:
                    add(prev + e[:1])
                    room -= 1
            else:
                if not prev or c > len(table):
                    raise ValueError("a code that stands for nothing")
                e = prev + prev[:1]
                if room > 0:
                    add(e)
                    room -= 1
            put(e)
            prev = e
        if last < n:
            pos = int(at[last] + width[last])
            if int(code[last]) == end:
                break
            fresh = True
        else:
            pos = int(at[-1] + width[-1])
            if n < 8192:
                break
            fresh = False
        made += sum(map(len, out[len(out) - last :]))
    data = b"".join(out)
    if len(data) < most:
        raise ValueError("a code stream that ends early")
    return data[:most]


def _blocks(data: bytes) -> bytes:
    out = [bytes([len(x)]) + x for i in range(0, len(data), 255) if (x := data[i : i + 255])]
    return b"".join(out) + b"\0"


_GREY = bytes(x for i in range(256) for x in (i, i, i))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A GIF of the payload (a positive multiple of WIDTH bytes), whose comment holds ``n_bytes``."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY, b"\x21\xfe", _blocks(b"bytes=%d" % n_bytes)]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """A frame as shown: ``canvas`` (height, width, 3) after it is drawn, its own rectangle, and its time."""

    canvas: np.ndarray
    drawn: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    start_ms: int
    disposal: int
    transparent: int | None

    @property
    def samples(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data):
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        if at + 1 + n > len(data):
            break
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1
    raise ValueError("a block that ends early")


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise ValueError("a palette that ends early")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode(data: bytes) -> tuple[list[Frame], list[bytes]]:
    """(frames, comments). Raises ValueError if it is no GIF, or not a whole one: its trailer, a block, palette or code is
    missing, or an index has no colour."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    w, h, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    palette = None
    if flags & 0x80:
        palette, at = _palette(data, at, flags)
    ground = palette[back] if palette is not None and back < len(palette) else np.zeros(3, np.uint8)
    canvas = np.empty((h, w, 3), np.uint8)
    canvas[:] = ground
    frames, comments, control, clock = [], [], (0, 0, None), 0
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = ((body[0] >> 2) & 7, 10 * int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None)
            elif label == 0xFE:
                comments.append(body)
        elif kind == 0x2C:
            if at + 11 > len(data):
                raise ValueError("a frame that ends early")
            x, y, fw, fh, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if flags & 0x80:
                colours, at = _palette(data, at, flags)
            if at >= len(data) or not 2 <= data[at] <= 8:
                raise ValueError("a frame without a code size")
            bits = data[at]
            body, at = _read_blocks(data, at + 1)
            index = np.frombuffer(lzw_decode(body, bits, fw * fh), np.uint8).reshape(fh, fw)
            drawn = np.ones((fh, fw), bool)
            if flags & 0x40:
                order = np.concatenate([np.arange(0, fh, 8), np.arange(4, fh, 8), np.arange(2, fh, 4), np.arange(1, fh, 2)])
                rows = np.empty_like(index)
                rows[order] = index
                index = rows
            disposal, delay, clear = control
            if clear is not None:
                drawn = drawn & (index != clear)
            kept = canvas.copy() if disposal == 3 else None
            if colours is None:
                colours = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
            shown = canvas.copy() if frames or disposal == 3 else canvas
            area = shown[y : y + fh, x : x + fw]
            cut = drawn[: area.shape[0], : area.shape[1]]
            if len(colours) < 256 and (drawn & (index >= len(colours))).any():
                raise ValueError("an index without a colour")
            ink = colours[np.minimum(index, len(colours) - 1)][: area.shape[0], : area.shape[1]]
            area[cut] = ink[cut]
            frames.append(Frame(shown, cut, x, y, fw, fh, delay, clock, disposal, clear))
            clock += delay
            if disposal == 2:
                canvas = shown.copy()
                canvas[y : y + fh, x : x + fw] = ground
            else:
                canvas = kept if disposal == 3 else shown
            control = (0, 0, None)
        elif kind == 0x3B:
            return frames, comments
        else:
            raise ValueError("a block of no known kind")
    raise ValueError("no trailer")


def histogram(samples: np.ndarray) -> list[int]:
    """BINS counts of red, then of green, then of blue."""
    flat = samples.reshape(-1, 3) // (256 // BINS)
    return [int(n) for c in range(3) for n in np.bincount(flat[:, c], minlength=BINS)]


def _store(batches):
    import pyarrow as pa

    for big in batches:
        for i in range(0, big.num_rows, 500):
            b = big.slice(i, 500)
            media = []
            for t in b.column("text").to_pylist():
                raw = (t or "").encode()
                media.append(encode(raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


FRAME = "struct<start_ms:long,delay_ms:long,left:int,top:int,width:int,height:int,disposal:int,histogram:array<int>>"
_HISTOGRAMS = ("red", "green", "blue")
READ = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<{FRAME}>, " + ", ".join(f"{c} array<long>" for c in _HISTOGRAMS)


def _read(batches):
    import pyarrow as pa

    frame = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), *((c, pa.int32()) for c in ("left", "top", "width", "height", "disposal")), ("histogram", pa.list_(pa.int32()))])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(frame), *[pa.list_(pa.int64())] * 3]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", *_HISTOGRAMS]
    for big in batches:
        for i in range(0, big.num_rows, 500):
            b = big.slice(i, 500)
            rows = []
            for doc, media in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                frames, comments = decode(media)
                payload = b"".join(f.samples[:, :, 0].tobytes() for f in frames)
                all_ = np.zeros(3 * BINS, np.int64)
                shown = []
                for f in frames:
                    hist = histogram(f.samples)
                    all_ += hist
                    shown.append({"start_ms": f.start_ms, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "histogram": hist})
                n = int(comments[0].partition(b"=")[2])
                colour = dict(zip(_HISTOGRAMS, all_.reshape(3, BINS).tolist()))
                feature = f"frames={len(frames)};ms={sum(f.delay_ms for f in frames)};" + ";".join(f"{c}={','.join(map(str, n))}" for c, n in colour.items())
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, shown, *colour.values()))
            yield pa.RecordBatch.from_arrays([pa.array([r[q] for r in rows], k) for q, k in enumerate(kinds)], names=names)


def store(docs: DataFrame) -> DataFrame:
    """Writes a media table (doc_id, media) of all rows of ``docs`` (doc_id, text): the text's UTF-8 bytes, padded with
    zeros to a positive multiple of 64, as grey samples. Null counts as empty; long texts are stored whole, in as many
    frames as they need; ids may repeat or be null; other columns are ignored; an empty table gives an empty one."""
    return storage.persist(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, media binary"), "media")


def read(media: DataFrame) -> DataFrame:
    """Decodes a media table (doc_id, media): sizes and digests of payload and medium, a feature string, the timed frames
    with their colour histograms, and the histograms of all frames by colour. Repeated rows are read each time, a null
    doc_id stays null; a medium that is null, or not a whole GIF of ``store``, raises; other columns are ignored; an
    empty table gives an empty result."""
    return media.select("doc_id", "media").mapInArrow(_read, READ)
