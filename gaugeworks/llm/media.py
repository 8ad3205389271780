"""Media columns: payloads stored losslessly as baseline JPEG, read back by a numpy Huffman decoder.

A payload byte is one quantised DCT coefficient (the format's unit): 64 bytes fill an 8x8 block in zigzag order and a
row of 9 blocks takes 576 bytes. Each block is a restart interval, so every block can be decoded on its own and all
blocks of many images advance in lock-step in numpy. Byte b is the coefficient 256 + b, always of size class 9.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm.common import raw_texts, slices

UNIT = 576  # bytes of a row of 9 blocks
_MASK = (1 << np.arange(16)) - 1
_HALF = (1 << np.arange(16)) >> 1
MAX_ROWS = 8191  # JPEG heights end at 65,535 lines; longer payloads take several images


def pad(raw: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, codes: dict[int, list[int]]) -> bytes:
    """A DHT body: how many codes of each length, then their symbols."""
    counts = bytes(len(codes.get(n, ())) for n in range(1, 17))
    return bytes([kind]) + counts + bytes(s for n in range(1, 17) for s in codes.get(n, ()))


_CODES = _segment(0xC4, _table(0x00, {1: [9]})) + _segment(0xC4, _table(0x10, {1: [9]}))


def encode(payload: bytes) -> bytes:
    """One baseline JPEG (or several, one after another) holding the payload; its length must be a multiple of 576."""
    out = []
    for at in range(0, len(payload), UNIT * MAX_ROWS):
        part = np.frombuffer(payload[at : at + UNIT * MAX_ROWS], np.uint8)
        rows = len(part) // UNIT
        quads = part.reshape(-1, 4).astype(np.uint64)  # each: the code 0, the sign bit 1, eight bits of the byte
        quads = quads[:, 0] << 30 | quads[:, 1] << 20 | quads[:, 2] << 10 | quads[:, 3] | np.uint64(0x4010040100)
        scan = quads.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1, 80)
        full = scan == 0xFF
        n = len(scan)
        size = 80 + full.sum(1) + 2
        ends = np.cumsum(size)
        data = np.zeros(int(ends[-1]), np.uint8)
        place = (np.arange(80) + np.cumsum(full, 1) - full) + (ends - size)[:, None]
        data[place] = scan  # a zero stays after each 255
        data[ends - 2] = 0xFF
        data[ends - 1] = 0xD0 + np.arange(n) % 8
        head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
        head += _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (72).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        head += _CODES
        head += _segment(0xDD, (1).to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        out.append(head + data[:-2].tobytes() + b"\xff\xd9")
    return b"".join(out)


@lru_cache(64)
def _lookup(body: bytes) -> np.ndarray:
    """For each 16-bit window: symbol * 32 + code length; 0 where no code fits."""
    lut, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            lut[code << (16 - n) : (code + 1) << (16 - n)] = body[at] * 32 + n
            code, at = code + 1, at + 1
        code <<= 1
    return lut


class _Image:
    """Markers of one JPEG; ``end`` is the offset behind it."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.huff, self.restart = {}, {}, 0
        at += 2
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    values = np.frombuffer(body[1 : 129 if wide else 65], ">u2" if wide else np.uint8).astype(np.int64)
                    self.quant[body[0] & 15], body = values, body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    self.huff[body[0]], body = _lookup(body[1:n]), body[n:]
            elif marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
            at += 2 + size
        at += 2 + size
        raw = np.frombuffer(data, np.uint8)[at:]
        marks = np.flatnonzero(raw[:-1] == 0xFF)
        kinds = raw[marks + 1]
        marks, kinds = marks[(kinds != 0)], kinds[kinds != 0]
        last = int(np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))[0])
        self.end = at + int(marks[last]) + 2
        self.starts = np.concatenate([[0], marks[:last] + 2])
        self.stops = np.concatenate([marks[:last], [marks[last]]])
        self.raw = raw[: int(marks[last]) + 2]
        wide, high = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcus = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        single = len(self.parts) == 1
        if single:
            self.mcus = -(-self.width // 8), -(-self.height // 8)
        self.order = [k for k, p in enumerate(self.parts) for _ in range(1 if single else p[1] * p[2])]


def _decode_images(images: list[_Image]) -> list[np.ndarray]:
    """Quantised coefficients in zigzag order, ``(blocks, 64)`` in scan order, of images that share their tables.

    Each restart interval has its own bit position; all of them take one symbol a step.
    """
    order, first = images[0].order, images[0]
    bufs, starts, counts, offset = [], [], [], 0
    for im in images:
        gone = np.flatnonzero((im.raw[1:] == 0) & (im.raw[:-1] == 0xFF)) + 1  # stuffed zeros
        bufs.append(np.delete(im.raw, gone))
        starts.append(offset + im.starts - np.searchsorted(gone, im.starts))
        total = im.mcus[0] * im.mcus[1]
        each = im.restart or total
        n = np.full(len(im.starts), each)
        n[-1] = total - each * (len(im.starts) - 1)
        counts.append(n * len(order))
        offset += len(bufs[-1])
    buf = np.concatenate([*bufs, np.zeros(8, np.uint8)]).astype(np.int64)
    window = buf[:-4] << 32 | buf[1:-3] << 24 | buf[2:-2] << 16 | buf[3:-1] << 8 | buf[4:]
    p, blocks = np.concatenate(starts).astype(np.int64) * 8, np.concatenate(counts).astype(np.int64)
    at, last = (np.cumsum(blocks) - blocks) * 64, np.cumsum(blocks) * 64  # of the current block and behind the interval
    luts = np.stack([t for part in first.parts for dc, ac in [first.tables[part[0]]] for t in (first.huff[dc], first.huff[0x10 | ac])])
    comp_of, turn = np.array(order, np.int64), np.zeros(len(p), np.int64)
    out = np.zeros(int(blocks.sum()) * 64, np.int32)
    k, pred = np.zeros(len(p), np.int64), np.zeros((len(p), len(first.parts)), np.int64)
    while len(p):
        comp = comp_of[turn]
        w = window[p >> 3] << (p & 7)
        hit = luts[2 * comp + (k > 0), w >> 24 & 0xFFFF]
        if not hit.all():
            raise ValueError("a code that no table has")
        length, size, run = hit & 31, hit >> 5 & 15, hit >> 9
        value = w >> (40 - length - size) & _MASK[size]
        value -= _MASK[size] * (value < _HALF[size])
        p += length + size
        is_dc = k == 0
        if is_dc.any():
            run = np.where(is_dc, 0, run)
            rows = np.flatnonzero(is_dc)
            pred[rows, comp[rows]] += value[rows]
            value[rows] = pred[rows, comp[rows]]
        spot = np.minimum(k + run, 63)
        if size.all():
            out[at + spot] = value
            k = spot + 1
        else:
            put = (size > 0) | is_dc
            out[(at + spot)[put]] = value[put]
            k = np.where(~is_dc & (size == 0) & (run < 15), 64, spot + 1)  # end of block, or 16 zeros
        over = k >= 64
        if over.any():
            k[over] = 0
            at[over] += 64
            turn[over] = (turn[over] + 1) % len(order)
            if (at >= last).any():
                live = at < last
                p, at, last, k, turn, pred = p[live], at[live], last[live], k[live], turn[live], pred[live]
    out = out.reshape(-1, 64)
    cuts = np.cumsum([len(im.order) * im.mcus[0] * im.mcus[1] for im in images])[:-1]
    return np.split(out, cuts)


def _thumbnail(im: _Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient alone."""
    wide, high = (1, 1) if len(im.parts) == 1 else im.parts[0][1:3]
    per = wide * high
    dc = coefficients.reshape(-1, len(im.order), 64)[:, :per, 0] * im.quant[im.parts[0][3]][0]
    light = np.clip(np.rint(dc / 8) + 128, 0, 255).astype(np.uint8)
    light = light.reshape(im.mcus[1], im.mcus[0], high, wide).transpose(0, 2, 1, 3).reshape(im.mcus[1] * high, im.mcus[0] * wide)
    return light[: -(-im.height // 8), : -(-im.width // 8)]


def decode_many(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """For each stored value its images: (width, height, coefficients, DC thumbnail). A value that isn't a whole baseline JPEG raises."""
    images, owner = [], []
    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            images.append(_Image(data, at))
            owner.append(i)
            at = images[-1].end
    groups: dict = {}
    for j, im in enumerate(images):
        key = (tuple(im.order), tuple(im.parts), tuple(im.tables.items()), tuple((k, id(v)) for k, v in im.huff.items()))
        groups.setdefault(key, []).append(j)
    out: list[list] = [[] for _ in media]
    done: dict[int, tuple] = {}
    for members in groups.values():
        for j, c in zip(members, _decode_images([images[j] for j in members]), strict=True):
            done[j] = (images[j].width, images[j].height, c, _thumbnail(images[j], c))
    for j, i in enumerate(owner):
        out[i].append(done[j])
    return out


def payload_of(images: list[tuple]) -> bytes:
    """The bytes that ``encode`` stored."""
    return b"".join((c - 256).astype(np.uint8).tobytes() for _, _, c, _ in images)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: means of an 8x8 grid over the thumbnail against their mean. Small thumbnails repeat rows and columns."""
    r, c = (np.arange(9) * thumb.shape[0]) // 8, (np.arange(9) * thumb.shape[1]) // 8
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    r1, c1 = np.maximum(r[1:], r[:-1] + 1), np.maximum(c[1:], c[:-1] + 1)
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r[:-1], c1)] - total[np.ix_(r1, c[:-1])] + total[np.ix_(r[:-1], c[:-1])]
    means = sums / np.outer(r1 - r[:-1], c1 - c[:-1])
    return np.packbits((means >= means.mean()).reshape(-1)).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, media``: each text as UTF-8, padded and stored as JPEG. Null and empty texts store 576 bytes 255; equal rows stay equal rows, an empty table gives none, and other columns aren't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col, 1 << 20):  # a long text is held alone
                raws = raw_texts(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raws), pa.int64()), pa.array([encode(pad(x)) for x in raws], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_features(stored: DataFrame, id_col: str = "doc_id", block_bytes: int = 1 << 20) -> DataFrame:
    """Read media back: payload facts, dimensions and thumbnail hash. Many short images decode together, up to ``block_bytes``.

    ``feature`` is ``WxH:average hash:sha256 prefix of the thumbnail``, images joined by ``+``.
    """
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def flush(ids: list, sizes: list, media: list[bytes]) -> pa.RecordBatch:
        rows = []
        for data, images in zip(media, decode_many(media), strict=True):
            payload = payload_of(images)
            feature = "+".join(f"{w}x{h}:{average_hash(t)}:{hashlib.sha256(t.tobytes()).hexdigest()[:16]}" for w, h, _, t in images)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, media, held = [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                ids.append(b.column(0).slice(i, 1))
                sizes.append(b.column(1)[i].as_py())
                media.append(b.column(2)[i].as_py())
                held += len(media[-1])
                if held >= block_bytes:
                    yield flush(ids, sizes, media)
                    ids, sizes, media, held = [], [], [], 0
        if media:
            yield flush(ids, sizes, media)

    kind = dict(stored.dtypes)[id_col]
    return stored.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
