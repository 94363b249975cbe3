"""Media columns: baseline JPEG files that hold bytes as quantised coefficients.

Each 64 bytes of payload are one 8x8 block: byte minus 128 is the coefficient at that zigzag position, so
entropy coding loses nothing. Every block is a restart interval of its own, which lets numpy decode all
blocks of many files in step: one Huffman symbol of each block at a time. The DC coefficients alone give
a luminance thumbnail with one pixel a block.

read_media() reads ordinary baseline files too: any sampling, any restart interval or none, DC prediction, one scan
for all components or one each. There the restart intervals of a batch of files are decoded in step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .shared import documents

BLOCK = 64
MOST_BLOCKS = 1 << 13  # blocks worked on at once
WIDTH = 64  # blocks in a row of the image, unless its height would pass what a frame header can hold


def _code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Symbol to code length: short for the magnitudes that letters have, equal for all runs of zeros."""
    short = {5: 2, 4: 3, 7: 3, 6: 4, 3: 4, 8: 5, 2: 6, 1: 6}
    ac = dict(short) | {0x00: 6, 0xF0: 8} | {run << 4 | size: 9 for run in range(1, 16) for size in range(1, 9)}
    return short | {0: 6}, ac


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT body (counts of each length, symbols) and each symbol's (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, before, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s] = code, before
        code += 1
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts + bytes(order), codes


def _lookup(body: bytes) -> np.ndarray:
    """16 bits ahead to length << 8 | symbol; -1 where no code starts so."""
    table, code, at = np.full(1 << 16, -1, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            table[code << 16 - length : code + 1 << 16 - length] = length << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


DC_BODY, _DC = _canonical(_code_lengths()[0])
AC_BODY, _AC = _canonical(_code_lengths()[1])


def _code_table(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


DC_CODE, DC_LEN = _code_table(_DC)
AC_CODE, AC_LEN = _code_table(_AC)
SIZE = np.array([int(abs(v)).bit_length() for v in range(-256, 257)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(n_blocks: int) -> bytes:
    wide = min(n_blocks, max(WIDTH, -(-n_blocks // 8191)))
    high = -(-n_blocks // wide)
    return (
        b"\xff\xd8"
        + _segment(0xE9, b"PAYLOAD\0" + struct.pack(">Q", n_blocks))
        + _segment(0xDB, b"\0" + bytes([8]) + bytes([1]) * 63)
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + DC_BODY)
        + _segment(0xC4, b"\x10" + AC_BODY)
        + _segment(0xDD, b"\0\1")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _scan(coefs: np.ndarray, restart: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded blocks with the marker of each restart number after them (none where it is -1), and each block's length."""
    n = len(coefs)
    sizes = SIZE[coefs + 256]
    bits = np.where(coefs < 0, coefs + (1 << sizes) - 1, coefs)
    codes, lengths = np.zeros((n, 66), np.int64), np.zeros((n, 66), np.int64)
    full = coefs != 0
    full[:, 0] = True
    symbols = sizes.copy()
    if not full.all():
        at = np.where(full, np.arange(64), -1)
        before = np.maximum.accumulate(at, axis=1)
        run = np.arange(64)[1:] - before[:, :-1] - 1
        symbols[:, 1:] |= (run & 15) << 4
        b, j = np.nonzero(full[:, 1:] & (run >= 16))
        for q in range(3):  # a run of 16 zeros has its own code, put at the place of its last zero
            here = run[b, j] >= 16 * (q + 1)
            bb, jj = b[here], j[here] + 1 - run[b, j][here] + 16 * q + 15
            codes[bb, jj], lengths[bb, jj] = AC_CODE[0xF0], AC_LEN[0xF0]
        ends = before[:, -1] < 63
        codes[ends, 64], lengths[ends, 64] = AC_CODE[0], AC_LEN[0]
    dc = symbols[:, 0]
    codes[:, 0], lengths[:, 0] = DC_CODE[dc] << sizes[:, 0] | bits[:, 0], DC_LEN[dc] + sizes[:, 0]
    ac = AC_CODE[symbols[:, 1:]] << sizes[:, 1:] | bits[:, 1:]
    codes[:, 1:64] = np.where(full[:, 1:], ac, codes[:, 1:64])
    lengths[:, 1:64] = np.where(full[:, 1:], AC_LEN[symbols[:, 1:]] + sizes[:, 1:], lengths[:, 1:64])
    total = lengths.sum(1)
    lengths[:, 65] = -total % 8
    codes[:, 65] = (1 << lengths[:, 65]) - 1
    n_bytes = (total + 7) // 8
    starts = np.concatenate([[0], np.cumsum(n_bytes)])
    ends = np.cumsum(lengths.ravel())
    lengths, codes = lengths.ravel(), codes.ravel()
    at = ends - lengths
    word, value = at >> 5, codes << (64 - (at & 31) - lengths).clip(0, 63)
    value = value.view(np.uint64)
    n_words = int(ends[-1] + 31) // 32 + 2
    words = np.bincount(word, (value >> np.uint64(32)).astype(float), n_words) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n_words)
    raw = np.frombuffer(words.astype(np.int64).astype(">u4").tobytes(), np.uint8)[: starts[-1]]
    stuffed = raw == 255
    of = np.repeat(np.arange(n), n_bytes)
    marked = restart >= 0
    before = np.concatenate([[0], np.cumsum(stuffed)])
    marks = np.concatenate([[0], np.cumsum(2 * marked)])
    place = np.arange(len(raw)) + before[:-1] + marks[of]
    out = np.zeros(len(raw) + before[-1] + marks[-1], np.uint8)
    out[place] = raw
    done = starts[1:] + before[starts[1:]] + marks[:-1]
    out[done[marked]], out[done[marked] + 1] = 255, 0xD0 + restart[marked]
    return out.tobytes(), np.diff(np.concatenate([[0], done + 2 * marked]))


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file of each payload, whose length is a positive multiple of 64."""
    counts = [len(p) // BLOCK for p in payloads]
    padded = [-(-n // (w := min(n, max(WIDTH, -(-n // 8191))))) * w for n in counts]
    out: list[list[bytes]] = [[header(n)] for n in counts]
    todo = [(i, lo, min(lo + MOST_BLOCKS, padded[i])) for i in range(len(payloads)) for lo in range(0, padded[i], MOST_BLOCKS)]
    while todo:
        now, size = [], 0
        while todo and (not now or size + todo[0][2] - todo[0][1] <= MOST_BLOCKS):
            now.append(todo.pop(0))
            size += now[-1][2] - now[-1][1]
        coefs, restart = np.zeros((size, 64), np.int64), np.empty(size, np.int64)
        at = 0
        for i, lo, hi in now:
            own = np.frombuffer(payloads[i][lo * BLOCK : hi * BLOCK], np.uint8).reshape(-1, 64)
            coefs[at : at + len(own)] = own.astype(np.int64) - 128
            restart[at : at + hi - lo] = np.arange(lo, hi) % 8
            if hi == padded[i]:
                restart[at + hi - lo - 1] = -1
            at += hi - lo
        data, sizes = _scan(coefs, restart)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        for i, lo, hi in now:
            out[i].append(data[ends[at] : ends[at + hi - lo]])
            at += hi - lo
    return [b"".join(x) + b"\xff\xd9" for x in out]


def parse(file: bytes) -> dict:
    """Markers of a baseline file: size, tables, restart interval, and where the scan lies."""
    at, out = 2, {"dht": {}, "dqt": {}, "interval": 0, "n_blocks": None}
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker, length = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xE9 and body[:8] == b"PAYLOAD\0":
            out["n_blocks"] = int.from_bytes(body[8:16], "big")
        elif marker == 0xDB:
            while body:
                out["dqt"][body[0] & 15], body = body[1:65], body[65:]
        elif marker == 0xC0:
            out["high"], out["wide"], components = struct.unpack(">HHB", body[1:6])
            if body[0] != 8 or components != 1:
                raise ValueError("only 8-bit luminance is read")
            out["quant"] = body[8]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["dht"][body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            out["interval"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            out["scan"], out["tables"] = at, (body[2] >> 4, 16 | body[2] & 15)
            return out
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline file")


def _intervals(file: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers, and where each restart interval starts among them."""
    d = np.frombuffer(file, np.uint8, len(file) - start - 2, start)
    ff = np.flatnonzero(d[:-1] == 255)
    keep = np.ones(len(d), bool)
    after = d[ff + 1]
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    kept = np.cumsum(keep)
    return d[keep], np.concatenate([[0], kept[marks]])


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _coefficients(data: np.ndarray, starts: np.ndarray, dc_body: bytes, ac_body: bytes) -> np.ndarray:
    """One block of coefficients from each start, all decoded in step."""
    for body in (dc_body, ac_body):
        if body not in _LOOKUPS:
            _LOOKUPS[body] = _lookup(body)
    dc, ac = _LOOKUPS[dc_body], _LOOKUPS[ac_body]
    d = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    ahead = d[:-4] << 32 | d[1:-3] << 24 | d[2:-2] << 16 | d[3:-1] << 8 | d[4:]  # 40 bits from each byte
    out = np.zeros((len(starts), 64), np.int64)
    lane, at, k = np.arange(len(starts)), starts * 8, np.zeros(len(starts), np.int64)
    table = dc
    while len(lane):
        window = ahead[at >> 3] << (at & 7) & 0xFFFFFFFFFF
        found = table[window >> 24]
        if (found < 0).any():
            raise ValueError("bad Huffman code")
        length, symbol = found >> 8, found & 255
        size = symbol & 15
        k = k + (symbol >> 4) if table is ac else k
        value = window >> (40 - length - size) & (1 << size) - 1
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
        live = size > 0
        if live.all():
            out[lane, k] = value
        else:
            out[lane[live], k[live]] = value[live]
        at = at + length + size
        k = k + 1
        go = k < 64
        if table is ac:
            go &= symbol != 0
        if not go.all():
            lane, at, k = lane[go], at[go], k[go]
        table = ac
    return out


def decode_files(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """What parse() found in each file, and its coefficients in blocks of 64."""
    heads = [parse(f) for f in files]
    out: list[list[np.ndarray]] = [[] for _ in files]
    now: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        by_tables: dict = {}
        for x in now:
            h = heads[x[0]]
            by_tables.setdefault((h["dht"][h["tables"][0]], h["dht"][h["tables"][1]]), []).append(x)
        for tables, group in by_tables.items():
            offsets = np.cumsum([0, *(len(d) for _, d, _ in group)])
            blocks = _coefficients(np.concatenate([d for _, d, _ in group]), np.concatenate([s + o for (_, _, s), o in zip(group, offsets, strict=False)]), *tables)
            at = 0
            for i, _, s in group:
                out[i].append(blocks[at : at + len(s)])
                at += len(s)
        now.clear()

    size = 0
    for i, (f, h) in enumerate(zip(files, heads, strict=True)):
        if h["interval"] != 1:
            raise ValueError("only files with one block a restart interval are read")
        data, starts = _intervals(f, h["scan"])
        for lo in range(0, len(starts), MOST_BLOCKS):
            s = starts[lo : lo + MOST_BLOCKS]
            end = starts[lo + MOST_BLOCKS] if lo + MOST_BLOCKS < len(starts) else len(data)
            if size + len(s) > MOST_BLOCKS:
                flush()
                size = 0
            now.append((i, data[s[0] : end], s - s[0]))
            size += len(s)
    flush()
    return [(h, np.concatenate(b)) for h, b in zip(heads, out, strict=True)]


def thumbnail(head: dict, coefs: np.ndarray) -> np.ndarray:
    """Luminance of each block from its DC coefficient alone."""
    step = head["dqt"][head["quant"]][0]
    return np.clip(coefs[:, 0] * step // 8 + 128, 0, 255).astype(np.uint8).reshape(head["high"] // 8, head["wide"] // 8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits, from the means of 8x8 areas of the thumbnail: which exceed their own mean."""
    sums = np.pad(pixels.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    edges = []
    for n in pixels.shape:
        lo = np.arange(8) * n // 8
        edges.append((lo, np.maximum((np.arange(8) + 1) * n // 8, lo + 1)))
    (top, low), (left, right) = edges
    area = sums[np.ix_(low, right)] - sums[np.ix_(top, right)] - sums[np.ix_(low, left)] + sums[np.ix_(top, left)]
    means = area / ((low - top)[:, None] * (right - left)[None])
    return np.packbits(means > means.mean()).tobytes().hex()


def luminance_scan(file: bytes) -> dict:
    """Frame, tables and entropy-coded bytes of the scan that holds the first component of a baseline file."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, dht, dqt, interval, frame = 2, {}, {}, 0, None
    while True:
        while at + 1 < len(file) and file[at] == 255 and file[at + 1] == 255:  # fill bytes
            at += 1
        if at + 4 > len(file) or file[at] != 255:
            raise ValueError("no scan of luminance")
        marker, length = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                dqt[body[0] & 15] = int.from_bytes(body[1 : 2 + (1 if wide else 0)], "big")
                body = body[1 + size :]
        elif marker in (0xC0, 0xC1):
            high, across, n = struct.unpack(">HHB", body[1:6])
            if body[0] != 8 or not high or not across:
                raise ValueError("only 8-bit frames of known size are read")
            frame = {"high": high, "wide": across, "parts": {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}, "first": body[6]}
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                dht[body[0]], body = bytes(body[1:n]), body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            d = np.frombuffer(file, np.uint8, len(file) - at, at)
            ff = np.flatnonzero(d[:-1] == 255)
            ends = ff[(d[ff + 1] != 0) & ((d[ff + 1] < 0xD0) | (d[ff + 1] > 0xD7)) & (d[ff + 1] != 255)]
            stop = at + int(ends[0]) if len(ends) else len(file)
            ids = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            if frame is None:
                raise ValueError("a scan before its frame")
            if frame["first"] in [c for c, _ in ids]:
                return frame | {"scan": [(frame["parts"][c][:2], dht[t >> 4], dht[16 | t & 15]) for c, t in ids], "luminance": [c for c, _ in ids].index(frame["first"]), "step": dqt[frame["parts"][frame["first"]][2]], "interval": interval, "data": file[at:stop]}
            at = stop
        elif marker == 0xD9 or 0xC2 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("not a baseline file")


class Lanes:
    """The restart intervals of some files, each a lane that is decoded on its own, all in step."""

    def __init__(self, scans: list[dict]):
        tables: dict[bytes, int] = {}
        rows, chunks, self.sizes, base, out = [], [], [], 0, 0
        for f, s in enumerate(scans):
            one = len(s["scan"]) == 1
            (h, v), most_h, most_v = s["scan"][s["luminance"]][0], max(x[0] for x in s["parts"].values()), max(x[1] for x in s["parts"].values())
            if one:  # a scan of one component has its blocks in rows, without padding to whole units
                h = v = 1
                own_h, own_v = s["parts"][s["first"]][:2]
                across, down = -(-s["wide"] * own_h // (8 * most_h)), -(-s["high"] * own_v // (8 * most_v))
                pattern = [0]
            else:
                across, down = -(-s["wide"] // (8 * most_h)), -(-s["high"] // (8 * most_v))
                pattern = [c for c, (hv, _, _) in enumerate(s["scan"]) for _ in range(hv[0] * hv[1])]
            self.sizes.append((across, down, h, v))
            data, starts = _intervals(s["data"] + b"\xff\xd9", 0)
            each, total = s["interval"] or across * down, across * down
            own = [[tables.setdefault(t, len(tables)) for t in x[1:]] for x in s["scan"]]
            own += [[0, 0]] * (4 - len(own))
            n = -(-total // each)
            ends = [*starts[1:], len(data)]
            for i in range(n):
                here = i < len(starts)
                rows.append((f, base + int(starts[i]) if here else base, base + int(ends[i]) if here else base, min(each, total - i * each), out + i * each * h * v, len(pattern), pattern + [0] * (10 - len(pattern)), own, s["luminance"], pattern.index(s["luminance"])))
            chunks.append(data)
            base += len(data)
            out += total * h * v
        self.n_out = out
        data = np.concatenate([*chunks, np.full(8, 255, np.uint8)]).astype(np.int64)
        self.ahead = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
        self.luts = np.stack([_lookup(t) for t in tables])
        cols = list(zip(*rows, strict=True))
        self.file, start, self.end, self.units, self.out, self.length = (np.array(c) for c in cols[:6])
        self.at, self.pattern, self.tables, self.luminance, self.first = start * 8, np.array(cols[6]), np.array(cols[7]), np.array(cols[8]), np.array(cols[9])

    def decode(self) -> tuple[np.ndarray, set[int]]:
        """Luminance DC coefficients of all files in scan order, and the files that are damaged."""
        n = len(self.file)
        dc, bad = np.zeros(self.n_out, np.int64), np.zeros(n, bool)
        at, block, done, k, before = self.at.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 4), np.int64)
        lum = (self.pattern == self.luminance[:, None]) & (np.arange(10) < self.length[:, None])
        per_unit = lum.sum(1)
        lane = np.arange(n)
        while len(lane):
            a, kk, c = at[lane], k[lane], self.pattern[lane, block[lane]]
            over = (a >> 3) > self.end[lane]
            a = np.minimum(a, 8 * (len(self.ahead) - 1))
            window = self.ahead[a >> 3] << (a & 7) & 0xFFFFFFFFFF
            found = self.luts[self.tables[lane, c, (kk > 0).astype(np.int64)], window >> 24]
            length, symbol = found >> 8, found & 255
            size = symbol & 15
            wrong = (found < 0) | over
            value = window >> np.maximum(40 - length - size, 0) & (1 << size) - 1
            value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
            is_dc = kk == 0
            d = np.flatnonzero(is_dc & ~wrong)
            before[lane[d], c[d]] += value[d]
            y = d[c[d] == self.luminance[lane[d]]]
            ly = lane[y]
            dc[self.out[ly] + done[ly] * per_unit[ly] + block[ly] - self.first[ly]] = before[ly, c[y]]
            nxt = np.where(is_dc, 1, np.where(symbol == 0, 64, np.where(symbol == 0xF0, kk + 16, kk + (symbol >> 4) + 1)))
            wrong |= nxt > 64
            at[lane], k[lane] = a + length + size, nxt
            bad[lane[wrong]] = True
            e = lane[(nxt >= 64) & ~wrong]
            k[e] = 0
            block[e] += 1
            e = e[block[e] == self.length[e]]
            block[e] = 0
            done[e] += 1
            lane = lane[~wrong & (done[lane] < self.units[lane])]
        return dc, set(self.file[bad].tolist())


def read_thumbnails(files: list[bytes | None]) -> list[tuple[int, int, str] | None]:
    """Width, height and thumbnail hash of each file, None for what is no whole baseline JPEG file."""
    scans, which = [], []
    for i, f in enumerate(files):
        try:
            scans.append(luminance_scan(f or b""))
            which.append(i)
        except (ValueError, KeyError, IndexError, struct.error):
            continue
    out: list = [None] * len(files)
    if not scans:
        return out
    lanes = Lanes(scans)
    dc, damaged = lanes.decode()
    at = 0
    for j, (i, s, (across, down, h, v)) in enumerate(zip(which, scans, lanes.sizes, strict=True)):
        own = dc[at : at + across * down * h * v]
        at += len(own)
        if j in damaged:
            continue
        grid = own.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        pixels = np.clip(grid * s["step"] // 8 + 128, 0, 255).astype(np.uint8)
        most_h, most_v = (max(x[k] for x in s["parts"].values()) for k in (0, 1))
        own_h, own_v = s["parts"][s["first"]][:2]
        pixels = pixels[: -(-s["high"] * own_v // (8 * most_v)), : -(-s["wide"] * own_h // (8 * most_h))]
        out[i] = s["wide"], s["high"], thumbnail_hash(pixels)
    return out


def read_media(rows: DataFrame, column: str = "media", batch_bytes: int = 1 << 20) -> DataFrame:
    """``rows`` with media_width, media_height and media_hash of the JPEG files in a binary column.

    Null where the file is null, not a baseline JPEG or damaged. Repeated rows each give a row, columns of other names pass
    unchanged, an empty table gives an empty result; a batch is decoded about ``batch_bytes`` at a time.
    """
    made = [("media_width", pa.int32()), ("media_height", pa.int32()), ("media_hash", pa.string())]
    kept = rows.drop(*[n for n, _ in made])

    def run(batches):
        for batch in batches:
            files = batch.column(batch.schema.get_field_index(column)).to_pylist()
            found, now, size = [], [], 0
            for f in files:
                now.append(f)
                size += len(f or b"")
                if size >= batch_bytes:
                    found += read_thumbnails(now)
                    now, size = [], 0
            found += read_thumbnails(now)
            cols = [pa.array([x and x[i] for x in found], t) for i, (_, t) in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *[n for n, _ in made]])

    schema = StructType([*kept.schema.fields, StructField("media_width", IntegerType()), StructField("media_height", IntegerType()), StructField("media_hash", StringType())])
    return kept.mapInArrow(run, schema)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def store_and_read(docs: DataFrame, batch_bytes: int = 1 << 19) -> DataFrame:
    """Each text as a JPEG file, read back, with its digests, size and thumbnail hash.

    A null text counts as empty and is stored as one block of zero bytes. Equal texts give equal values,
    repeated rows each a row; other columns are not read; an empty table gives an empty result.
    """

    def rows(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        files = encode_files([t + bytes(-len(t) % BLOCK or (0 if t else BLOCK)) for t in texts])
        cols: list[list] = [[] for _ in range(9)]
        for t, f, (head, coefs) in zip(texts, files, decode_files(files), strict=True):
            payload = (coefs[: head["n_blocks"]] + 128).astype(np.uint8).tobytes()
            feature = f"{head['wide']}x{head['high']}:{thumbnail_hash(thumbnail(head, coefs))}"
            for col, v in zip(cols, (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature, head["wide"], head["high"]), strict=True):
                col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append((t or "").encode())
                size += len(texts[-1]) + BLOCK
                if size >= batch_bytes:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def media(docs: DataFrame) -> DataFrame:
    """doc_id and the JPEG file of each text, as a binary media column."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            files = encode_files([t + bytes(-len(t) % BLOCK or (0 if t else BLOCK)) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def op8_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(documents(spark, sf_dir))
