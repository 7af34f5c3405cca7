"""Baseline JPEG: marker parsing, Huffman decoding and DC-only luminance thumbnails, in numpy.

Scans are cut at restart markers and all intervals of a batch are decoded side by side, one
Huffman symbol of each at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_bytes, doc_runs, lean, text_only

#: Blocks of a row of the images made here; a row is a restart interval.
ROW = 192
#: Rows of one image at most: 65,535 pixels of 8 a block. A longer payload takes several images.
ROWS = 65535 // 8
# The usual luminance DC code, as counts of codes by length and their symbols.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: The images made here are flat within each block: the only AC symbol is the end of the block, in one bit.
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + length of the code there; 0 where there is none."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return table


def _code_of_difference() -> tuple[np.ndarray, np.ndarray]:
    """Bits and number of bits of each DC difference -255..255, with the end of the block."""
    dc = {s: (c, n) for s, c, n in codes(DC_COUNTS, DC_SYMBOLS)}
    bits, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d > 0 else d + (1 << size) - 1
        bits[d + 255], length[d + 255] = ((code << size) | extra) << 1, n + size + 1
    return bits, length


_BITS, _LENGTH = _code_of_difference()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    quant = bytes([0]) + bytes([8] * 64)
    frame = struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])
    tables = bytes([0x00]) + DC_COUNTS + DC_SYMBOLS + bytes([0x10]) + AC_COUNTS + AC_SYMBOLS
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_samples(samples: np.ndarray, rows_of: list[int]) -> list[bytes]:
    """Gray images whose DC-only thumbnails are the samples: rows_of[i] rows of ROW samples each.

    With a quantiser of 8, the DC term of a flat block of value v is exactly v - 128.
    """
    m = samples.reshape(-1, ROW).astype(np.int64) - 128
    d = np.diff(m, axis=1, prepend=0) + 255
    length = _LENGTH[d]
    ends = np.cumsum(length, axis=1)
    total = ends[:, -1]
    at = ends - length
    size = (total + 7) // 8
    wide = 15 * ROW // 8 + 3
    value = _BITS[d] << (24 - length - (at & 7))
    place = (at >> 3) + (np.arange(len(m)) * wide)[:, None]
    packed = np.zeros(len(m) * wide + 2)
    for k in range(3):
        packed[k:] += np.bincount(place.ravel(), ((value >> (16 - 8 * k)) & 255).ravel(), len(m) * wide + 2)[: len(packed) - k]
    packed = packed[: len(m) * wide].astype(np.uint8).reshape(len(m), wide)
    pad = (-total) & 7
    packed[np.arange(len(m)), size - 1] |= ((1 << pad) - 1).astype(np.uint8)
    flat = packed[np.arange(wide)[None, :] < size[:, None]]
    stuffed = flat == 255
    row = np.repeat(np.arange(len(m)), size)
    where = np.arange(len(flat)) + np.cumsum(stuffed) - stuffed + 2 * row
    out = np.zeros(len(flat) + int(stuffed.sum()) + 2 * len(m), np.uint8)
    out[where] = flat
    row_ends = np.cumsum(size + np.add.reduceat(stuffed, np.cumsum(size) - size).astype(np.int64) + 2) - 2
    first = np.cumsum(rows_of) - rows_of
    number = np.arange(len(m)) - np.repeat(first, rows_of)
    out[row_ends], out[row_ends + 1] = 0xFF, 0xD0 + number % 8
    raw, images, a = out.tobytes(), [], 0
    for n, last in zip(rows_of, (np.cumsum(rows_of) - 1).tolist(), strict=True):
        b = int(row_ends[last])
        images.append(_head(n) + raw[a:b] + b"\xff\xd9")
        a = b + 2
    return images


@dataclass
class Image:
    """What the markers of a baseline image say, and where its scan lies."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)  # class * 16 + id
    restart: int = 0
    scan: list[tuple[int, int]] = field(default_factory=list)  # component, tables
    start: int = 0
    stop: int = 0  # of the scan
    end: int = 0  # where EOI is

    def blocks(self) -> list[tuple[int, int, int, int, int]]:
        """(component, its DC table, AC table, x, y) of each block of an MCU."""
        by = {c[0]: c for c in self.components}
        alone = len(self.scan) == 1
        return [(c, t >> 4, t & 15, x, y) for c, t in self.scan for y in range(1 if alone else by[c][2]) for x in range(1 if alone else by[c][1])]

    def size_in_blocks(self) -> tuple[int, int]:
        """Blocks of the first component side by side and one below the other."""
        h, v = (max(c[i] for c in self.components) for i in (1, 2))
        _, own_h, own_v, _ = self.components[0]
        return -(-(-(-self.width * own_h // h)) // 8), -(-(-(-self.height * own_v // v)) // 8)

    def mcus(self) -> tuple[int, int]:
        if len(self.scan) == 1:
            return self.size_in_blocks()
        h, v = (max(c[i] for c in self.components) for i in (1, 2))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def _check(image: Image) -> None:
    """A header is not trusted: what it says has to be sound, and a block takes two bits of the scan at least."""
    sound = image.width and image.height and image.components and all(1 <= c[1] <= 4 and 1 <= c[2] <= 4 for c in image.components)
    if not sound or not {c for c, _ in image.scan} <= {c[0] for c in image.components}:
        raise ValueError("the frame is not sound")
    if image.components[0][3] not in image.quant:
        raise ValueError("a quantiser is missing")
    w, h = image.mcus()
    if w * h * len(image.blocks()) > 4 * (image.stop - image.start):
        raise ValueError("the scan is too short for the frame")


def parse(data: bytes, at: int = 0) -> Image:
    """Markers of one image, from SOI to EOI, and where the scan of its first component lies; ValueError for what isn't baseline or is cut off."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG image here")
    image, tables, restart, i = Image(), {}, 0, at + 2
    while True:
        if i + 2 > len(data) or data[i] != 0xFF:
            raise ValueError("the image is cut off or has no marker where one is due")
        marker = data[i + 1]
        if marker == 0xD9:
            if not image.scan:
                raise ValueError("the image has no scan of its first component")
            image.end = i
            _check(image)
            return image
        if marker in (0x01, 0xFF):
            i += 1 + (marker == 0x01)
            continue
        if i + 4 > len(data):
            raise ValueError("the image is cut off")
        (n,) = struct.unpack_from(">H", data, i + 2)
        body = data[i + 4 : i + 2 + n]
        i += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant.setdefault(body[0] & 15, struct.unpack_from(">H", body, 1)[0] if wide else body[1])
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline images are read")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            stop = _end_of_scan(data, i)
            if not image.scan and image.components and image.components[0][0] in {c for c, _ in scan}:
                image.scan, image.start, image.stop, image.tables, image.restart = scan, i, stop, dict(tables), restart
            i = stop


def _end_of_scan(data: bytes, i: int) -> int:
    while True:
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            raise ValueError("the scan has no end")
        if data[i + 1] != 0 and not 0xD0 <= data[i + 1] <= 0xD7:
            return i
        i += 2


#: MCUs of all lanes that are decoded side by side.
LANES = 1 << 24


def thumbnails(files: list[bytes], strict: bool = True) -> list[list[tuple[Image, np.ndarray]]]:
    """The images of each file, one after another, each with the DC-only thumbnail of its first component; what follows the last image is no part of it.

    Images of equal tables and sampling are decoded side by side, whichever files they are of. An
    unreadable file raises ValueError, or without strict has no images.
    """
    found: list[list[tuple[Image, np.ndarray | None]]] = [[] for _ in files]
    groups: dict[tuple, list[tuple[int, int, bytes]]] = {}
    for f, data in enumerate(files):
        own, at = [], 0
        try:
            while not own or data[at : at + 2] == b"\xff\xd8":
                own.append(parse(data, at))
                at = own[-1].end + 2
        except (ValueError, IndexError, struct.error) as e:
            if strict:
                raise ValueError(str(e)) from e
            continue
        found[f] = [(image, None) for image in own]
        for k, image in enumerate(own):
            key = (tuple(image.blocks()), tuple(sorted(image.tables.items())), image.restart)
            groups.setdefault(key, []).append((f, k, data[image.start : image.stop]))
    for (blocks, tables, _), members in groups.items():
        count = [int(np.prod(found[f][k][0].mcus())) for f, k, _ in members]
        order = sorted(range(len(members)), key=lambda i: count[i])
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * count[order[j]] <= LANES:
                j += 1
            some = [members[x] for x in order[i:j]]
            for part in [some] if strict else _parts(some):
                own = [found[f][k][0] for f, k, _ in part]
                try:
                    got = _decode([m[2] for m in part], own, blocks, dict(tables))
                except (ValueError, IndexError):
                    if strict:
                        raise
                    got = _one_by_one(part, own, blocks, dict(tables))
                for (f, k, _), image, pixels in zip(part, own, got, strict=True):
                    found[f][k] = (image, pixels)
            i = j
    return [x if all(p is not None for _, p in x) else [] for x in found]


def _parts(members: list) -> list[list]:
    """At most 256 images that fail or pass together."""
    return [members[i : i + 256] for i in range(0, len(members), 256)]


def _one_by_one(members: list, images: list[Image], blocks: tuple, tables: dict) -> list[np.ndarray | None]:
    out = []
    for (_, _, scan), image in zip(members, images, strict=True):
        try:
            out += _decode([scan], [image], blocks, tables)
        except (ValueError, IndexError):
            out.append(None)
    return out


def _decode(scans: list[bytes], images: list[Image], blocks: tuple, tables: dict) -> list[np.ndarray]:
    raw = np.frombuffer(b"\xff\xd7".join(scans) + bytes(2), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    cut = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(raw), bool)
    drop[ff[after == 0] + 1] = True
    drop[cut] = drop[cut + 1] = True
    kept = np.cumsum(~drop)
    starts = np.concatenate([[0], kept[cut + 1]])
    clean = np.concatenate([raw[~drop], np.zeros(8, np.uint8)]).astype(np.uint32)
    ahead = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    counts = []
    for image in images:
        w, h = image.mcus()
        each = image.restart or w * h
        full, rest = divmod(w * h, each)
        counts += [each] * full + [rest] * bool(rest)
    counts = np.array(counts)
    if len(counts) != len(starts):
        raise ValueError("restart markers are missing")
    order = np.argsort(-counts, kind="stable")
    bit = (starts[order] * 8).astype(np.int64)
    by_length = -counts[order]
    first = blocks[0][0]
    per_mcu = sum(b[0] == first for b in blocks)
    most = int(counts.max())
    dc = np.zeros((most * per_mcu, len(counts)), np.int16)
    looks = {k: lookup(*v) for k, v in tables.items()}
    for c in {b[0] for b in blocks}:
        own = [b for b in blocks if b[0] == c]
        if any(b[1] not in looks or 16 + b[2] not in looks for b in own):
            raise ValueError("a Huffman table is missing")
    pred = {b[0]: np.zeros(len(counts), np.int32) for b in blocks}
    for mcu in range(most):
        n = int(np.searchsorted(by_length, -mcu, "left"))  # lanes with more than mcu MCUs
        place = 0
        for c, t_dc, t_ac, _, _ in blocks:
            pos = bit[:n]
            sym = looks[t_dc][(ahead[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF]
            pos = pos + (sym & 31)
            size = sym >> 5
            extra = ((ahead[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int32) >> (16 - size)
            pred[c][:n] += np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            bit[:n] = pos + size
            if c == first:
                dc[mcu * per_mcu + place, :n] = pred[c][:n]
                place += 1
            lanes, k = None, 1  # lanes: those still inside the block
            while True:
                pos = bit[:n] if lanes is None else bit[lanes]
                sym = looks[16 + t_ac][(ahead[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF]
                if not sym.all():
                    raise ValueError("a scan has a code that no table has")
                rs = sym >> 5
                new = pos + (sym & 31) + (rs & 15)
                if lanes is None:
                    bit[:n] = new
                    lanes = np.arange(n) if rs.any() else lanes
                else:
                    bit[lanes] = new
                if lanes is None:
                    break
                k = k + np.where(rs == 0, 64, (rs >> 4) + 1)
                going = k < 64
                lanes, k = lanes[going], k[going]
                if not len(lanes):
                    break
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    lanes = dc.T[back]
    out, lane = [], 0
    for image in images:
        w, h = image.mcus()
        each = image.restart or w * h
        n = -(-(w * h) // each)
        seq = lanes[lane : lane + n].reshape(-1)[: w * h * per_mcu] if (w * h) % each == 0 or n == 1 else np.concatenate([lanes[lane + k][: min(each, w * h - k * each) * per_mcu] for k in range(n)])
        lane += n
        _, ch, cv, q = next(c for c in image.components if c[0] == first)
        if len(image.scan) == 1:
            ch = cv = 1
        grid = seq.reshape(h, w, cv, ch).transpose(0, 2, 1, 3).reshape(h * cv, w * ch)
        wide, high = image.size_in_blocks()
        grid = grid[:high, :wide]
        pixels = (grid.astype(np.int32) * image.quant[q] + 4 + 1024) >> 3
        out.append(np.clip(pixels, 0, 255).astype(np.uint8))
    return out


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each cell of 8 by 8 is brighter than their mean."""
    y, x = (np.arange(9) * n // 8 for n in pixels.shape)
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    y1, x1 = np.maximum(y[1:], y[:-1] + 1), np.maximum(x[1:], x[:-1] + 1)
    y0, x0 = y[:-1], x[:-1]
    cells = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    cells = cells / np.outer(y1 - y0, x1 - x0)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def joint_hash(images: list) -> str:
    """The average hash of one image; of several, that of the first and a digest of all of theirs, so that each image counts."""
    each = [average_hash(p) for _, p in images]
    return each[0] if len(each) == 1 else f"{each[0]}{hashlib.sha256(''.join(each).encode()).hexdigest()[:16]}"


def media_columns(files: DataFrame, key: str, data: str) -> DataFrame:
    """(key, width, height, n_images, thumb_hash, thumb_sha256) of binary files; a null, empty or unreadable one has nulls (n_images 0), and spoils no other. Keys may repeat or be null."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            read = thumbnails([x or b"" for x in batch.column(1).to_pylist()], strict=False)
            for k, got in zip(batch.column(0).to_pylist(), read, strict=True):
                rows.append((k, got[0][0].width, got[0][0].height, len(got), joint_hash(got), hashlib.sha256(b"".join(p.tobytes() for _, p in got)).hexdigest()) if got else (k, None, None, 0, None, None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], ["key", "width", "height", "n_images", "thumb_hash", "thumb_sha256"])

    return files.select(key, data).mapInArrow(lean(run), f"key {kind}, width int, height int, n_images int, thumb_hash string, thumb_sha256 string").withColumnRenamed("key", key)


def store_as_images(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media binary): the text's bytes, padded with spaces to rows of 192, as gray images. Null and empty texts are one row of spaces."""

    def run(batches):
        for batch in batches:
            for keys, n, size, images in _stored(batch):
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return text_only(docs).mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary")


def _stored(batch):
    raw, offsets = column_bytes(batch.column(1))
    for i, j in doc_runs(offsets):
        n = np.diff(offsets[i : j + 1])
        rows = np.maximum(1, -(-n // ROW))
        to = (np.cumsum(rows) - rows) * ROW
        payload = np.full(int(rows.sum()) * ROW, 32, np.uint8)
        src = raw[offsets[i] : offsets[j]]
        payload[np.repeat(to - (offsets[i:j] - offsets[i]), n) + np.arange(len(src))] = src
        each = [[ROWS] * (r // ROWS) + [r % ROWS] * bool(r % ROWS) for r in rows.tolist()]
        images = encode_samples(payload, [x for e in each for x in e])
        k, media = 0, []
        for e in each:
            media.append(b"".join(images[k : k + len(e)]))
            k += len(e)
        yield batch.column(0).slice(i, j - i), n, rows * ROW, media


def stored_features(docs: DataFrame) -> DataFrame:
    """Stores each text as images, reads the stored bytes back and describes both; one pass, so that images need not travel."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for keys, n, size, media in _stored(batch):
                cols = [[] for _ in range(5)]
                for x, got in zip(media, thumbnails(media), strict=True):
                    payload = b"".join(p.tobytes() for _, p in got)
                    image = got[0][0]
                    for c, v in zip(cols, (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), f"{image.width}x{image.height}x{len(got)}:{joint_hash(got)}"), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(size, pa.int64()), *(pa.array(c) for c in cols)], names)

    return text_only(docs).mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text stored as baseline JPEG and read back."""
    return stored_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
