"""Media columns: payloads stored as baseline JPEG, read back by a parser of markers and Huffman-coded scans.

Method.  A payload of whole 192-byte units becomes the quantised coefficients of a 4:4:4 image: 64 bytes are one 8x8
block in zigzag order, three blocks (Y, Cb, Cr) one unit.  The entropy coding of baseline JPEG is lossless, so the
coefficients, and with them the payload, come back exactly.  Byte b is stored as the coefficient b - CENTRE, wrapped to
-128 to 127: runs of zeros, ends of blocks and code lengths vary as in any file.  The Huffman tables come from a rule
(`own_tables`) and travel in the file, as do restart markers after every RESTART units.

Decoding is by table look-ups in numpy.  Restart intervals are independent, so the intervals of all files of a group of
rows advance together, one symbol each a step: a 16-bit window gives code length, run and size, and the bits behind it
the amplitude.  The same decoder reads other baseline files: any tables, sampling factors, restart intervals and number
of scans; a file without restart markers is one interval, and slower.

The luminance thumbnail needs the DC coefficients alone: a pixel for each block.  Features: dimensions, a 64-bit
difference hash of the thumbnail and a digest of it.  A null text is the empty text, which is one unit of spaces; a null
file gives nulls.  Nothing is ranked, so ties have no part.  Repeated rows give equal values; other columns are carried along, but those with the names of results
are left out.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import map_arrow, read_table, text_groups

UNIT, PAD, CENTRE = 192, b" ", ord("e")
#: Units in a row of the image: a JPEG's sides have at most 65,535 pixels.
ROW_UNITS = 4096
#: Units between restart markers.
RESTART = 1
DC_STEP = 8
#: Shares of the bits of a coefficient in texts, which code lengths follow.
SIZE_WEIGHTS = {1: 0.04, 2: 0.11, 3: 0.15, 4: 0.33, 5: 0.08, 6: 0.05, 7: 0.25, 8: 0.01}
END_OF_BLOCK, ZERO_RUN = 0x00, 0xF0
#: Units that are encoded, and bytes of files that are decoded, at once (a larger file is a group by itself).
ENCODE_UNITS, GROUP_BYTES = 512, 1 << 20
#: In look-ups: a flag, and steps that no place in a block can take.
ESCAPE, BLOCK_DONE = 1 << 15, 128
NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Code lengths of Shannon's rule, 16 at most; the code of ones alone stays free."""
    total = sum(weights.values()) * (1 + 2.0**-14)
    return {s: min(16, int(np.ceil(-np.log2(w / total)))) for s, w in weights.items()}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), in the order of a DHT segment: by length, then as given."""
    code = last = 0
    out = {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def table_body(lengths: dict[int, int]) -> bytes:
    """A table as DHT has it: how many codes of each length, then the symbols."""
    ordered = sorted(lengths.items(), key=lambda x: x[1])
    return bytes(sum(n == k for _, n in ordered) for k in range(1, 17)) + bytes(s for s, _ in ordered)


@lru_cache(maxsize=1)
def own_tables() -> tuple[bytes, bytes]:
    """DC and AC as DHT has them; an AC symbol's weight is that of its size, less for longer runs of zeros before it."""
    ac = {r << 4 | s: w * 2.0 ** -min(3 * r, 6 + r / 4) for r in range(16) for s, w in SIZE_WEIGHTS.items()}
    return table_body(code_lengths({0: 0.02, 9: 0.01} | SIZE_WEIGHTS)), table_body(code_lengths(ac | {END_OF_BLOCK: 0.01, ZERO_RUN: 0.002}))


def codes(table: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) of a table as DHT has it."""
    symbols = iter(table[16:])
    return canonical({next(symbols): n + 1 for n, k in enumerate(table[:16]) for _ in range(k)})


@lru_cache(maxsize=1)
def own_fields() -> np.ndarray:
    """Fields (code and amplitude) and their bits, by run << 9 | value + 256, with DC differences as if of run 16; then
    those of END_OF_BLOCK and ZERO_RUN."""
    dc, ac = map(codes, own_tables())
    out = np.zeros((17 * 512 + 2, 2), np.int64)
    for run in range(17):
        for value in range(-255, 256):
            size = abs(value).bit_length()
            code, n = (dc if run == 16 else ac).get(size if run == 16 else run << 4 | size, (0, 0))
            out[run << 9 | value + 256] = code << size | (value if value >= 0 else value + (1 << size) - 1), n + size
    out[-2:] = ac[END_OF_BLOCK], ac[ZERO_RUN]
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def entropy_code(units: np.ndarray, files: np.ndarray) -> list[bytes]:
    """Scans of files whose units (rows of UNIT coefficients) follow one another; files: units of each."""
    field, bits = own_fields().T
    first_unit = np.cumsum(files) - files
    opens = (np.arange(len(units)) - np.repeat(first_unit, files)) % RESTART == 0
    value = units.reshape(-1).astype(np.int64)
    dc = value[::64].reshape(-1, 3)
    steps = dc.copy()
    steps[1:][~opens[1:]] -= dc[:-1][~opens[1:]]
    keep = value != 0
    keep[::64] = True
    at = np.flatnonzero(keep)
    run = np.diff(at, prepend=0) - 1
    first = np.flatnonzero(at & 63 == 0)  # of each block
    run[first] = 16
    value[::64] = steps.reshape(-1)
    zeros = run >> 4
    zeros[first] = 0
    place = (np.where(zeros > 0, run & 15, run) << 9) + value[at] + 256
    # Behind a block's last field, the end of the block if it has further zeros; behind an interval, ones up to a byte.
    last = np.append(first[1:], len(at)) - 1
    ends = last[at[last] & 63 != 63]
    closes = last[2::3][np.append(opens[1:], True)]
    fields = zeros + 1
    fields[ends] += 1
    fields[closes] += 1
    stop = np.cumsum(fields)
    start = stop - fields
    values, lengths = np.full(int(stop[-1]), field[-1]), np.full(int(stop[-1]), bits[-1])
    values[start + zeros], lengths[start + zeros] = field[place], bits[place]
    tail = (start + zeros)[ends] + 1
    values[tail], lengths[tail] = field[-2], bits[-2]
    fill = stop[closes] - 1
    lengths[fill] = 0
    begin = np.concatenate([[0], fill[:-1] + 1])
    sizes = np.add.reduceat(lengths, begin)
    spare = -sizes % 8
    values[fill], lengths[fill] = (1 << spare) - 1, spare
    return with_markers(pack_bits(values, lengths), (sizes + spare) // 8, np.add.reduceat(opens.astype(np.int64), first_unit))


def pack_bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fields of under 32 bits, one behind the other, as bytes.  No two fields share a bit, so sums stand for unions."""
    stop = np.cumsum(lengths)
    offset = stop - lengths
    word = offset >> 5
    shifted = values.astype(np.uint64) << np.minimum(64 - (offset & 31) - lengths, 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))  # every word has a field that begins in it
    both = np.add.reduceat(shifted, first)
    out = np.zeros(len(first) + 1, np.uint64)
    out[:-1] = both >> np.uint64(32)
    out[1:] += both & np.uint64(0xFFFFFFFF)
    return np.frombuffer(out.astype(">u4").tobytes(), np.uint8)[: int(stop[-1]) // 8]


def with_markers(data: np.ndarray, sizes: np.ndarray, intervals: np.ndarray) -> list[bytes]:
    """Scans with stuffed bytes, and restart markers between the intervals of a file.  sizes: bytes of each interval;
    intervals: of each file."""
    ends = np.cumsum(sizes)
    number = np.arange(len(sizes)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    inner = np.ones(len(sizes), bool)
    inner[np.cumsum(intervals) - 1] = False
    stuffed = np.flatnonzero(data == 255) + 1
    marks = np.repeat(ends[inner], 2)
    codes = np.stack([np.full(int(inner.sum()), 255), 0xD0 + number[inner] % 8], axis=1).reshape(-1)
    # At one place a stuffed byte comes first: it belongs to the interval that ends there.
    whole = np.insert(data, np.concatenate([stuffed, marks]), np.concatenate([np.zeros(len(stuffed)), codes]).astype(np.uint8)).tobytes()
    more = np.bincount(np.searchsorted(ends, stuffed - 1, side="right"), minlength=len(sizes)) + 2 * inner
    file_bytes = np.add.reduceat(sizes + more, np.cumsum(intervals) - intervals)
    cuts = [0, *np.cumsum(file_bytes).tolist()]
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_jpegs(payloads: list[bytes], n_bytes: list[int]) -> list[bytes]:
    """Baseline JPEGs that hold the payloads; n_bytes (lengths without padding) go into comments."""
    dc_body, ac_body = own_tables()
    units = [len(p) // UNIT for p in payloads]
    shape = [(min(u, ROW_UNITS), -(-u // ROW_UNITS)) for u in units]
    scans, begin, held = [], 0, 0
    for i, (w, h) in enumerate(shape):
        held += w * h
        if held >= ENCODE_UNITS or i + 1 == len(shape):
            whole = b"".join(p + PAD * ((w * h - u) * UNIT) for p, u, (w, h) in zip(payloads[begin : i + 1], units[begin:], shape[begin:]))
            coefficients = (np.frombuffer(whole, np.uint8) - np.uint8(CENTRE)).view(np.int8).reshape(-1, UNIT)
            scans += entropy_code(coefficients, np.array([w * h for w, h in shape[begin : i + 1]]))
            begin, held = i + 1, 0
    out = []
    for scan, n, u, (w, h) in zip(scans, n_bytes, units, shape, strict=True):
        frame = struct.pack(">BHHB", 8, 8 * h, 8 * w, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
        head = [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            segment(0xFE, f"payload {n} of {u * UNIT}".encode()),
            segment(0xDB, bytes([0, DC_STEP, *[1] * 63])),
            segment(0xC0, frame),
            segment(0xC4, b"\x00" + dc_body + b"\x10" + ac_body),
            segment(0xDD, struct.pack(">H", RESTART)),
            segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
        ]
        out.append(b"".join([*head, scan, b"\xff\xd9"]))
    return out


def parse_markers(data: bytes) -> dict:
    """Frame, quantisation tables, comments, and each scan with its tables and entropy-coded bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out: dict = {"quant": {}, "comments": [], "scans": []}
    huffman: dict[int, bytes] = {}
    at, restart = 2, 0
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out["comments"].append(body)
        elif marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            out |= {"width": width, "height": height, "components": {c[0]: (c[1] >> 4, c[1] & 15, c[2]) for c in parts}}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            of = [(body[1 + 2 * k], huffman[body[2 + 2 * k] >> 4], huffman[0x10 | body[2 + 2 * k] & 15]) for k in range(body[0])]
            end = m.start() if (m := NEXT_MARKER.search(data, at)) else len(data)
            out["scans"].append({"components": of, "restart": restart, "entropy": data[at:end]})
            at = end
    return out


@lru_cache(maxsize=64)
def look_up(table: bytes, ac: bool) -> np.ndarray:
    """By 16-bit window: bits of code and amplitude; << 6 how far the place in the block goes on; << 16 the value.

    With ESCAPE the amplitude reaches beyond the window: the value is then the size.  0: no code fits."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, n) in codes(table).items():
        size, run = symbol & 15, symbol >> 4
        goes = 1 if not ac else run + 1 if size or run == 15 else BLOCK_DONE
        here = np.arange(code << (16 - n), (code + 1) << (16 - n))
        if n + size > 16:
            out[here] = n + size | goes << 6 | ESCAPE | size << 16
        else:
            amplitude = (here >> (16 - n - size)) & ((1 << size) - 1)
            value = np.where(amplitude >> max(size - 1, 0) > 0, amplitude, amplitude - (1 << size) + 1) if size else 0
            out[here] = n + size | goes << 6 | value << 16
    return out


def layout(image: dict, scan: dict) -> tuple[list[tuple[int, int, int]], int, int]:
    """(component, h, v) of a scan, and how many units it has across and down.  A scan of one component has units of a
    block, and only those that the image needs."""
    of = image["components"]
    h_most, v_most = max(c[0] for c in of.values()), max(c[1] for c in of.values())
    ids = [c for c, _, _ in scan["components"]]
    if len(ids) == 1:
        h, v, _ = of[ids[0]]
        return [(ids[0], 1, 1)], -(-(-(-image["width"] * h // h_most)) // 8), -(-(-(-image["height"] * v // v_most)) // 8)
    return [(c, *of[c][:2]) for c in ids], -(-image["width"] // (8 * h_most)), -(-image["height"] // (8 * v_most))


def intervals_of(entropy: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of scans without stuffing and markers, the first byte of each restart interval, and its scan."""
    raw = np.frombuffer(b"".join(entropy), np.uint8)
    first = np.cumsum([0, *map(len, entropy[:-1])])
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    marks = ff[(after & 0xF8) == 0xD0]
    scan = np.searchsorted(first, marks, side="right") - 1
    number = np.arange(len(marks)) - np.searchsorted(scan, scan)
    if (raw[marks + 1] != 0xD0 + number % 8).any():
        raise ValueError("a restart marker out of order")
    keep = np.ones(len(raw) + 1, bool)
    for gone in (ff[after == 0] + 1, marks, marks + 1):
        keep[gone] = False
    place = np.cumsum(keep) - keep
    starts = np.concatenate([first, marks + 2])
    order = np.argsort(starts, kind="stable")
    return raw[keep[:-1]], place[starts[order]], np.concatenate([np.arange(len(entropy)), scan])[order]


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte, the 40 bits from there on, at the top of a 64-bit number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data) + 4
    return sum(padded[k : k + n] << np.uint64(56 - 8 * k) for k in range(5))


def decode_blocks(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Coefficients of all blocks in zigzag order, DC as differences; intervals advance together, a symbol a step.

    starts: first byte of each interval; blocks: how many it has; tables: the DC and the AC table of each block of a unit,
    look-ups of 2 ** 16 entries one behind the other."""
    out = np.zeros(int(blocks.sum()) * 64, np.int16)
    ahead, slots = windows(data), len(tables) >> 17
    stop = np.cumsum(blocks) * 64
    start = stop - blocks * 64
    at = start - 1  # of each interval, the place before its block's first
    position, k, slot = starts * 8, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    table = slot.copy()
    limit = np.append(starts[1:], len(data)) * 8
    while len(position):
        bits = ahead.take(position >> 3, mode="clip") << (position & 7).view(np.uint64)
        found = tables.take(table + (bits >> np.uint64(48)).view(np.int64))
        length, value = found & 63, found >> 16
        long = np.flatnonzero(found & ESCAPE)
        if len(long):
            size = value[long]
            amplitude = ((bits[long] << (length[long] - size).view(np.uint64)) >> (64 - size).view(np.uint64)).view(np.int64)
            value[long] = np.where(amplitude >> (size - 1) > 0, amplitude, amplitude - (1 << size) + 1)
        position += length
        k += (found >> 6) & 255
        out[at + np.minimum(k, 64)] = value
        table |= 1 << 16
        full = np.flatnonzero(k > 63)
        if not length.all():
            raise ValueError("a code that no table has")
        if not len(full):
            continue
        if ((k[full] > 64) & (k[full] < BLOCK_DONE)).any():
            raise ValueError("a block of more than 64 coefficients")
        k[full] = 0
        at[full] += 64
        slot[full] = (slot[full] + 1) % slots
        table[full] = slot[full] << 17
        done = at[full] + 1 == stop[full]
        if done.any():
            if (position[full[done]] > limit[full[done]]).any():
                raise ValueError("the scan is too short")
            going = np.ones(len(k), bool)
            going[full[done]] = False
            position, k, at, slot, table, stop, limit = (x[going] for x in (position, k, at, slot, table, stop, limit))
    return out.reshape(-1, 64)


def decode_scans(images: list[dict]) -> list[dict[int, np.ndarray]]:
    """Quantised coefficients in zigzag order: for each image, by component, an array (block rows, block columns, 64)."""
    groups: dict[tuple, list] = {}
    out: list[dict[int, np.ndarray]] = [{} for _ in images]
    for i, image in enumerate(images):
        for scan in image["scans"]:
            parts, across, down = layout(image, scan)
            key = tuple((h * v, d, a) for (_, h, v), (_, d, a) in zip(parts, scan["components"], strict=True))
            groups.setdefault(key, []).append((i, scan, parts, across, down))
    for key, members in groups.items():
        data, starts, scan_of = intervals_of([m[1]["entropy"] for m in members])
        units = np.array([m[3] * m[4] for m in members])
        each = np.array([m[1]["restart"] or m[3] * m[4] for m in members])
        if (np.bincount(scan_of, minlength=len(members)) != -(-units // each)).any():
            raise ValueError("restart markers don't fit the image")
        number = np.arange(len(starts)) - np.searchsorted(scan_of, scan_of)
        own = np.minimum(each[scan_of], units[scan_of] - number * each[scan_of])
        owner = np.repeat(np.arange(len(key)), [n for n, _, _ in key])  # component of each block of a unit
        tables = np.concatenate([look_up(t, ac) for c in owner for ac, t in enumerate(key[c][1:])])
        blocks = decode_blocks(data, starts, own * len(owner), tables).reshape(-1, len(owner), 64)
        first = np.cumsum(own) - own
        for c in range(len(key)):
            mine = np.flatnonzero(owner == c)
            steps = blocks[:, mine, 0].reshape(-1).astype(np.int64)
            sums = np.cumsum(steps)
            before = (sums - steps)[first * len(mine)]  # of each interval, where prediction starts again
            blocks[:, mine, 0] = (sums - np.repeat(before, own * len(mine))).reshape(-1, len(mine))
        at = 0
        for (i, _, parts, across, down), n in zip(members, units.tolist(), strict=True):
            for c, (name, h, v) in enumerate(parts):
                grid = blocks[at : at + n, owner == c].reshape(down, across, v, h, 64)
                out[i][name] = grid.transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64)
            at += n
    return out


def thumbnail(image: dict, components: dict[int, np.ndarray]) -> np.ndarray:
    """A pixel for each luminance block, from its DC coefficient alone."""
    name = next(iter(image["components"]))
    step = image["quant"][image["components"][name][2]][0]
    return np.clip(components[name][:, :, 0].astype(np.int32) * step // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: of an 8 x 9 grid of samples, whether each is darker than its right neighbour."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(9) * pixels.shape[1] // 9
    grid = pixels[np.ix_(rows, columns)].astype(np.int16)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def read_jpegs(files: list[bytes]) -> list[tuple[bytes, int, str]]:
    """Payload, its length without padding, and the feature string of each file, all from the stored bytes."""
    images = [parse_markers(f) for f in files]
    out = []
    for image, components in zip(images, decode_scans(images), strict=True):
        note = next(c for c in image["comments"] if c.startswith(b"payload ")).split()
        blocks = np.stack([components[c] for c in image["components"]], axis=2).reshape(-1, 64)
        payload = (blocks + CENTRE).astype(np.uint8).tobytes()[: int(note[3])]
        small = thumbnail(image, components)
        out.append((payload, int(note[1]), f"{image['width']}x{image['height']}:{difference_hash(small)}:{hashlib.sha256(small.tobytes()).hexdigest()[:16]}"))
    return out


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with its texts as a column of JPEG files in place of the text column."""
    keep = [c for c in df.columns if c not in (text, media)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_groups(batch, text):
                raw = [(t or "").encode() for t in texts]
                files = encode_jpegs([r + PAD * (-len(r) % UNIT or (0 if r else UNIT)) for r in raw], list(map(len, raw)))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(files, pa.binary())], names=[*keep, media])

    return map_arrow(df, [*keep, text], run, schema)


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """df, media included, with what its files hold: payload, n_bytes, feature."""
    new = {"payload": T.BinaryType(), "n_bytes": T.LongType(), "feature": T.StringType()}
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(k, t) for k, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, files in text_groups(batch, media, GROUP_BYTES):
                read_back = iter(read_jpegs([x for x in files if x is not None]))
                found = [(None, None, None) if x is None else next(read_back) for x in files]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                    names=[*keep, *new],
                )

    return map_arrow(df, keep, run, schema)


def op6_media(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(store(docs)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
