"""Media columns: motion-JPEG in AVI files, read frame by frame, and cut into shots.

Reading parses the RIFF index, decodes intra (JPEG) frames and compares the brightness histograms of
neighbouring frames; a cut is where their difference stands out from the differences around it.

Writing stores bytes losslessly. Samples of a JPEG would lose bits, so the unit is the quantised DCT
coefficient: 64 bytes are the 64 coefficients of a block in zigzag order, byte b as b - 128 below 128
and b - 127 from there on, so that no coefficient is zero. 576 bytes are the nine blocks of a 24 x 24
frame. Each file carries Huffman tables in which the length of a size's code and the size add up
to a constant (10 bits for a DC difference, 9 for an AC coefficient), valid baseline JPEG that can
also be decoded by table look-up for all coefficients at once.

Frames of other writers are decoded symbol by symbol: baseline JPEG of one scan, of one component (brightness)
or several of any sampling (brightness first, as in YCbCr), with restart markers, and with the standard
Huffman tables where a frame brings none, as motion-JPEG allows. Brightness alone makes histograms. Frames
may lie in `rec ` lists and have an index or none. What is not of this form (progressive frames, other codecs) is
an error.

Defined results: null and empty texts are one frame of padding; equal bytes give equal files and
features; ids may be null and rows may repeat, as each row has its own result; frames that follow one another
without a change make one shot; a file without frames has no shots; an empty table gives an empty result;
other columns are ignored. A file is written and read within its row, STEP frames at a time, so a worker
holds one file, which is some 1.4 times its text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_slices, whole_text

SIDE = 24
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = 64 * BLOCKS
FPS = 25
PAD = 255
#: Frames that are worked on at a time.
STEP = 2048
#: Shot detection: bins, frames to each side, deviations above the mean, and the least difference.
BINS, AROUND, DEVIATIONS, LEAST = 16, 6, 2.0, 0.25


def zigzag() -> np.ndarray:
    """For each place in zigzag order, the index of the coefficient in its block, row by row."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in order])


def idct_matrix() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    m = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


ZIGZAG, IDCT = zigzag(), idct_matrix().astype(np.float32)


# --- JPEG -----------------------------------------------------------------------------------------

#: (code lengths of 1..16 bits: number of codes, symbols by code) of the two tables.
DC_TABLE = ([1] * 10 + [0] * 6, list(range(9, -1, -1)))
AC_TABLE = ([1] * 8 + [0] * 8, list(range(8, 0, -1)))


# The standard Huffman tables of ITU-T T.81, Annex K, by kind (0 DC, 1 AC) and number: how
# many codes there are of 1 to 16 bits, and the symbols by code, in hexadecimal. AC symbols that are not listed follow
# in ascending order, as they do in the standard's tables.
STANDARD = {
    (0, 0): ("00010501010101010100000000000000", "000102030405060708090a0b"),
    (0, 1): ("00030101010101010101010000000000", "000102030405060708090a0b"),
    (1, 0): ("0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    (1, 1): ("00020102040403040705040400010277", "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}


def standard_table(kind: int, number: int) -> tuple[list[int], list[int]]:
    counts, symbols = (list(bytes.fromhex(x)) for x in STANDARD[kind, number])
    if kind:
        every = {0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))}
        symbols += sorted(every.difference(symbols))
    return counts, symbols


def canonical(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def constant_lookup(table: dict[tuple[int, int], int]) -> tuple[int, np.ndarray] | None:
    """(bits, value by those bits), if every symbol is a plain size and code and value bits together
    are as many for all; values without a code are marked by 32767."""
    totals = {length + symbol for (length, _), symbol in table.items()}
    if len(totals) != 1 or any(s > 15 for s in table.values()):
        return None
    (bits,) = totals
    values = np.full(1 << bits, 32767, np.int16)
    for (length, code), size in table.items():
        extra = np.arange(1 << size)
        low = extra < (1 << size) >> 1
        values[(code << size) + extra] = np.where(low, extra - (1 << size) + 1, extra) if size else 0
    return bits, values


def _bit_rows(counts: list[int], symbols: list[int]) -> tuple[int, dict[int, np.ndarray]]:
    """The bits of every value that a table can code."""
    bits, values = constant_lookup(canonical(counts, symbols))
    rows = (np.arange(len(values))[:, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8)
    return bits, {int(v): rows[i] for i, v in enumerate(values) if v != 32767}


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def frame_header() -> bytes:
    tables = b"".join(segment(0xC4, bytes([kind << 4, *counts, *symbols])) for kind, (counts, symbols) in ((0, DC_TABLE), (1, AC_TABLE)))
    return b"\xff\xd8" + segment(0xDB, bytes([0] + [1] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])) + tables + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


@lru_cache(maxsize=1)
def _writer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficient by byte, bits of DC differences (from -256), bits of AC coefficients by byte."""
    value = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int16)
    _, dc = _bit_rows(*DC_TABLE)
    _, ac = _bit_rows(*AC_TABLE)
    return value, np.stack([dc[d] for d in range(-256, 257)]), np.stack([ac[int(v)] for v in value])


def write_frames(payload: bytes) -> Iterator[bytes]:
    """The JPEG frames of a payload of whole frames."""
    value, dc_bits, ac_bits = _writer()
    head = frame_header()
    for start in range(0, len(payload), STEP * FRAME_BYTES):
        data = np.frombuffer(payload, np.uint8, min(STEP * FRAME_BYTES, len(payload) - start), start).reshape(-1, BLOCKS, 64)
        n = len(data)
        change = np.diff(value[data[:, :, 0]], axis=1, prepend=np.int16(0))
        bits = np.concatenate([dc_bits[change + 256], ac_bits[data[:, :, 1:]].reshape(n, BLOCKS, -1)], axis=2).reshape(n, -1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)), constant_values=1)
        for row in np.packbits(bits, axis=1):
            yield head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


@dataclass(frozen=True)
class Header:
    """A frame's first component, in full, and of the others what is needed to read past them."""

    width: int
    height: int
    quant: tuple[int, ...]
    dc: tuple
    ac: tuple
    sampling: tuple[int, int] = (1, 1)
    #: (sampling, dc, ac) of the other components.
    others: tuple = ()
    #: MCUs between restart markers; 0: none.
    interval: int = 0

    @property
    def units(self) -> tuple[int, int]:
        """MCUs across and down."""
        wide, high = (max(c[0][k] for c in ((self.sampling,), *self.others)) for k in (0, 1)) if self.others else (1, 1)
        return -(-self.width // (8 * wide)), -(-self.height // (8 * high))

    @property
    def blocks(self) -> tuple[int, int]:
        """Blocks of the first component across and down."""
        h, v = self.sampling if self.others else (1, 1)
        return self.units[0] * h, self.units[1] * v

    @property
    def plane(self) -> tuple[int, int]:
        """Samples of the first component across and down, without those that only fill blocks."""
        if not self.others:
            return self.width, self.height
        most = [max(c[0][k] for c in ((self.sampling,), *self.others)) for k in (0, 1)]
        return -(-self.width * self.sampling[0] // most[0]), -(-self.height * self.sampling[1] // most[1])


@lru_cache(maxsize=64)
def parse_header(head: bytes) -> Header:
    """What stands before the entropy-coded data of a baseline frame."""
    tables = {kind << 4 | n: canonical(*standard_table(kind, n)) for kind, n in STANDARD}
    quants, size, components, scan, interval = {}, None, [], [], 0
    at = 2
    while at < len(head):
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = struct.unpack_from(">64" + "BH"[wide], body, 1)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = canonical(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit frames are supported")
            size, components = (width, height), [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(count)]
        elif marker == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            scan = [tuple(body[1 + 2 * k : 3 + 2 * k]) for k in range(body[0])]
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline JPEG is supported")
        at += 2 + n
    if size is None or not components or [c[0] for c in components] != [c[0] for c in scan]:
        raise ValueError("only frames whose components are in one scan are supported")
    parts = [((c[1] >> 4, c[1] & 15), tuple(tables[x >> 4].items()), tuple(tables[16 | x & 15].items())) for c, (_, x) in zip(components, scan, strict=True)]
    return Header(*size, quants[components[0][2]], parts[0][1], parts[0][2], parts[0][0], tuple(parts[1:]), interval)


@lru_cache(maxsize=64)
def _lookups(header: Header) -> tuple | None:
    if header.others or header.interval:
        return None
    dc, ac = constant_lookup(dict(header.dc)), constant_lookup(dict(header.ac))
    return (dc, ac) if dc and ac and all(dict(header.ac).values()) else None


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def split_frame(frame: bytes) -> tuple[bytes, list[bytes]]:
    """A frame's header, and its entropy-coded data without stuffing, parted at restart markers."""
    at = 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("not a JPEG frame")
        step = 2 + struct.unpack_from(">H", frame, at + 2)[0]
        if at + step > len(frame):
            raise ValueError("the frame's header ends early")
        if frame[at + 1] == 0xDA:
            head, data = frame[: at + step], frame[at + step :]
            break
        at += step
    end = data.rfind(b"\xff\xd9")
    return head, [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[: end if end >= 0 else None])]


@lru_cache(maxsize=64)
def _peeks(table: tuple) -> list[int]:
    """By the next 16 bits: a code's length and its symbol, as one number; 0 where there is no code."""
    out = [0] * (1 << 16)
    for (length, code), symbol in table:
        low = code << 16 - length
        out[low : low + (1 << 16 - length)] = [length << 8 | symbol] * (1 << 16 - length)
    return out


class _Blocks:
    """Reads the blocks of a stretch of entropy-coded data, symbol by symbol."""

    def __init__(self, data: bytes) -> None:
        # three bytes of ones more than there are, so that the next 16 bits can always be looked at
        self.data, self.at, self.bits, self.held, self.end = data + b"\xff\xff\xff", 0, 0, 0, 8 * len(data)

    def _number(self, size: int) -> int:
        while self.held < size:
            self.bits, self.held, self.at = self.bits << 8 | self.data[self.at], self.held + 8, self.at + 1
        self.held -= size
        v = self.bits >> self.held
        self.bits &= (1 << self.held) - 1
        return v if v >> size - 1 else v - (1 << size) + 1

    def _symbol(self, peeks: list[int]) -> int:
        if 8 * self.at - self.held > self.end:
            raise ValueError("the frame's data end early")
        while self.held < 16:
            self.bits, self.held, self.at = self.bits << 8 | self.data[self.at], self.held + 8, self.at + 1
        found = peeks[self.bits >> self.held - 16]
        if not found:
            raise ValueError("no such code")
        self.held -= found >> 8
        self.bits &= (1 << self.held) - 1
        return found & 255

    def read(self, dc: list[int], ac: list[int], last: int, row: np.ndarray) -> int:
        """Fills a block's coefficients; returns its DC."""
        size = self._symbol(dc)
        row[0] = last = last + (self._number(size) if size else 0)
        k = 1
        while k < 64:
            s = self._symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                if k > 63:
                    raise ValueError("a run leaves its block")
                row[k] = self._number(s & 15)
            k += 1
        if 8 * self.at - self.held > self.end:
            raise ValueError("the frame's data end early")
        return last


def decode_scalar(header: Header, data: bytes | list[bytes]) -> np.ndarray:
    """The first component's coefficients (blocks, 64) in zigzag order, blocks row by row."""
    stretches = [data] if isinstance(data, bytes) else data
    across, down = header.units
    wide, high = header.blocks
    parts = [(header.sampling if header.others else (1, 1), _peeks(header.dc), _peeks(header.ac))]
    parts += [(sampling, _peeks(dc), _peeks(ac)) for sampling, dc, ac in header.others]
    out, skipped = np.zeros((high, wide, 64), np.int16), np.zeros(64, np.int64)
    each = header.interval or across * down
    if len(stretches) < -(-across * down // each):
        raise ValueError("the frame's data end early")
    for start, stretch in zip(range(0, across * down, each), stretches, strict=False):
        source, last = _Blocks(stretch), [0] * len(parts)
        for unit in range(start, min(start + each, across * down)):
            y, x = divmod(unit, across)
            for c, ((h, v), dc, ac) in enumerate(parts):
                for k in range(h * v):
                    row = out[y * v + k // h, x * h + k % h] if c == 0 else skipped
                    last[c] = source.read(dc, ac, last[c], row)
    return out.reshape(-1, 64)


def read_frames(frames: list[bytes]) -> Iterator[tuple[Header, np.ndarray]]:
    """(header, coefficients (frames, blocks, 64) in zigzag order) of runs of frames alike."""
    start = 0
    parts = [split_frame(f) for f in frames]
    size = [[len(x) for x in data] for _, data in parts]
    while start < len(parts):
        end = start
        while end < len(parts) and end - start < STEP and parts[end][0] == parts[start][0] and size[end] == size[start]:
            end += 1
        header = parse_header(parts[start][0])
        if (found := _lookups(header)) is None:
            yield header, np.stack([decode_scalar(header, d) for _, d in parts[start:end]])
        else:
            (dc_n, dc), (ac_n, ac) = found
            n, blocks = end - start, header.blocks[0] * header.blocks[1]
            width = dc_n + 63 * ac_n
            bits = np.unpackbits(np.frombuffer(b"".join(d[0] for _, d in parts[start:end]), np.uint8).reshape(n, -1), axis=1)[:, : blocks * width].reshape(n, blocks, width)
            coefficients = np.empty((n, blocks, 64), np.int16)
            coefficients[:, :, 0] = np.cumsum(dc[_numbers(bits[:, :, :dc_n])], axis=1)
            coefficients[:, :, 1:] = ac[_numbers(bits[:, :, dc_n:].reshape(n, blocks, 63, ac_n))]
            yield header, coefficients
        start = end


def _numbers(bits: np.ndarray) -> np.ndarray:
    """The numbers that the bits of the last axis (9 to 16) stand for."""
    packed = np.packbits(bits, axis=-1)
    return packed[..., 0].astype(np.int32) << bits.shape[-1] - 8 | packed[..., 1] >> 16 - bits.shape[-1]


def payload_of(coefficients: np.ndarray) -> bytes:
    c = coefficients.reshape(-1)
    if not c.all() or c.min() < -128 or c.max() > 128:
        raise ValueError("the coefficients are no stored bytes")
    return (c + np.where(c < 0, 128, 127)).astype(np.uint8).tobytes()


def pixels(header: Header, coefficients: np.ndarray) -> np.ndarray:
    """Brightness of frames as (frames, blocks, 64) samples of 0..255."""
    block = np.zeros(coefficients.shape, np.float32)
    block[..., ZIGZAG] = coefficients * np.array(header.quant, np.float32)
    out = IDCT.T @ block.reshape(-1, 8, 8) @ IDCT
    return np.clip(np.rint(out) + 128, 0, 255).astype(np.uint8).reshape(coefficients.shape)


def pictures(header: Header, coefficients: np.ndarray) -> np.ndarray:
    """Brightness of frames as (frames, rows, columns), without what only fills blocks."""
    (wide, high), (columns, rows) = header.blocks, header.plane
    samples = pixels(header, coefficients).reshape(-1, high, wide, 8, 8)
    return samples.transpose(0, 1, 3, 2, 4).reshape(-1, 8 * high, 8 * wide)[:, :rows, :columns]


# --- AVI ------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], fps: int = FPS, side: int = SIDE) -> bytes:
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the video frames, as the file's index lists them (or, without an index, in
    the order they are stored)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, None
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            k = data.find(b"avih", at, at + 8 + n)
            if k >= 0 and (us := struct.unpack_from("<I", data, k + 8)[0]):
                fps = 1_000_000 / us
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, n)
        elif name == b"idx1":
            index = (at + 8, n)
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("the file has no frames")
    if index:
        entries = [(o, n) for name, _, o, n in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]) if name[2:] in (b"dc", b"db")]
        # offsets count from "movi", or from the file's start
        base = 0 if entries and data[entries[0][0] + 2 : entries[0][0] + 4] in (b"dc", b"db") and entries[0][0] >= movi[0] else movi[0]
        return fps, [data[base + o + 8 : base + o + 8 + n] for o, n in entries]
    out, at = [], movi[0] + 4
    while at + 8 <= movi[0] + movi[1]:
        if data[at : at + 4] == b"LIST" and data[at + 8 : at + 12] == b"rec ":
            at += 12  # its chunks follow
            continue
        n = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            out.append(data[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    return fps, out


# --- features -------------------------------------------------------------------------------------


def histograms(samples: np.ndarray) -> np.ndarray:
    """Brightness histograms (frames, BINS), as shares of the samples."""
    n, each = len(samples), samples[0].size
    level = (samples.reshape(n, -1) // (256 // BINS)).astype(np.int64)
    return np.bincount((level + BINS * np.arange(n)[:, None]).ravel(), minlength=n * BINS).reshape(n, BINS) / each


def cuts(h: np.ndarray) -> list[int]:
    """The frames that start a new shot, but the first. The difference from the frame before has to
    reach LEAST and exceed the mean of the differences around it by DEVIATIONS of theirs."""
    if len(h) < 2:
        return []
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    i = np.arange(len(d))
    low, high = np.maximum(0, i - AROUND), np.minimum(len(d), i + AROUND + 1)
    n = np.maximum(1, high - low - 1)
    mean = (sums[high] - sums[low] - d) / n
    spread = np.sqrt(np.maximum(0, (squares[high] - squares[low] - d * d) / n - mean * mean))
    return (np.flatnonzero((d >= LEAST) & (d > mean + DEVIATIONS * spread + 1e-9)) + 1).tolist()


@dataclass
class Decoded:
    payload: bytes
    fps: float
    n_frames: int
    cuts: list[int]
    brightness: float

    @property
    def clips(self) -> list[tuple[int, int]]:
        edges = [0, *self.cuts, self.n_frames] if self.n_frames else []
        return list(zip(edges, edges[1:], strict=False))

    @property
    def feature(self) -> str:
        return f"frames={self.n_frames};brightness={self.brightness:.3f};clips=" + ",".join(f"{a}-{b}" for a, b in self.clips)


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (FRAME_BYTES - len(data) if not data else -len(data) % FRAME_BYTES)


def store(data: bytes) -> bytes:
    """The AVI file that holds the bytes, padded to whole frames."""
    return write_avi(list(write_frames(padded(data))))


def load(media: bytes) -> Decoded:
    """Decodes a file that store() wrote: its bytes, and its shots."""
    return _decoded(media, payload_of)


def shots(media: bytes) -> Decoded:
    """The shots of any file whose frames can be read; no bytes are taken from its coefficients."""
    return _decoded(media, lambda coefficients: b"")


def _decoded(media: bytes, bytes_of: Callable[[np.ndarray], bytes]) -> Decoded:
    fps, frames = read_avi(media)
    payload, shares, total, seen = [], [], 0, 0
    for header, coefficients in read_frames(frames):
        payload.append(bytes_of(coefficients))
        samples = pictures(header, coefficients)
        total += int(samples.sum(dtype=np.int64))
        seen += samples.size
        shares.append(histograms(samples))
    found = cuts(np.concatenate(shares)) if shares else []
    return Decoded(b"".join(payload), fps, len(frames), found, total / max(1, seen))


# --- columns --------------------------------------------------------------------------------------


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, n_bytes, media): the AVI file of each text."""

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [x.encode() for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(x) for x in texts], pa.binary())], [id_col, "n_bytes", "media"])

    return map_slices(docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text")), "text", make, f"`{id_col}` {_id_type(docs, id_col)}, n_bytes long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per shot of each file: <id_col>, clip, first_frame, end_frame, start_s, end_s."""

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc, data in zip(part.column("id").to_pylist(), part.column("media").to_pylist(), strict=True):
            seen = shots(data)
            out += [(doc, k, a, b, a / seen.fps, b / seen.fps) for k, (a, b) in enumerate(seen.clips)]
        kinds = [part.schema.field("id").type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [id_col, "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return map_slices(media.select(column(id_col).alias("id"), "media"), "media", make, f"`{id_col}` {_id_type(media, id_col)}, clip int, first_frame int, end_frame int, start_s double, end_s double")


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads media columns back: <id_col>, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in part.column("media").to_pylist():
            seen = load(data)
            rows.append((len(seen.payload), sha256(seen.payload).hexdigest(), zlib.crc32(seen.payload[-32:]), len(data), sha256(data).hexdigest(), seen.feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kinds = ["long", "long", "string", "long", "long", "string", "string"]
    return map_slices(media.select(column(id_col).alias("id"), "n_bytes", "media"), "media", make, f"`{id_col}` {_id_type(media, id_col)}, " + ", ".join(f"{a} {b}" for a, b in zip(names[1:], kinds, strict=True)))
