"""Packing documents into sequences of at most WINDOW tokens, by non-negative least squares over length combinations.

A document of n tokens (its ids and the end id) gives n // WINDOW full windows, each a sequence, and a rest of under
WINDOW tokens.  Rests are counted by length over all documents.  Combinations of two or three lengths that fill a
window are enumerated; repeat counts come from non-negative least squares against the histogram, are rounded down and
then raised as far as whole documents allow.  The k-th rest of a length takes the k-th place that the plan has for it.
Rests that the plan leaves over are packed greedily, one behind the other, cut where a window is full.  The last
window's worth of them is cut into powers of two, which need no padding.

Ranks within a length come from per-task counters and a running sum over tasks, so a length that a third of all
documents share is no bottleneck.  The plan has at most a few ten thousand rows, whatever the corpus.

A null text is the empty text: one token, the end id.  Repeated rows are packed as often as they occur; rests that tie in
length take their places by the order of tasks.  Other columns are carried along, but those with the names of results are
left out.  An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import SHORT_WORD, RankBpe, Recent
from quillon.llm.common import carried, map_arrow, materialise, read_table, text_groups

WINDOW = 2048
END_ID = 1
#: Lengths that may stand in the middle of three; the commonest ones.
MIDDLES = 12
CACHE_CHUNKS = 320_000
#: Characters that are encoded at once.
TOKENISE_CHARS = 8_000_000
#: UTF-8 of characters up to U+00FF that lower case and normalisation keep within them, without white space.
LATIN = re.compile(rb"(?:[\x21-\x7e]|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf])+")
#: Of Latin-1 characters: 1 letters, 2 other numbers, 3 all else, 0 the newline between chunks.
LATIN_KIND = np.array([0 if c == 10 else 1 if chr(c).isalpha() else 2 if chr(c).isnumeric() else 3 for c in range(256)], np.uint8)
FULL, PART_BITS = 1 << 62, 40


def is_latin(text: str) -> bool:
    """Whether lower case is a matter of single characters, and no special token can come of it."""
    try:
        return (text.isascii() or bool(text.encode("latin-1"))) and "<|" not in text
    except UnicodeEncodeError:
        return False


class ChunkEncoder:
    """Ids of a tokenizer that lowers case and drops white space: a text is the chunks between ASCII white space.

    A short chunk of Latin-1 characters, which normalisation leaves alone, is split and merged here; the tokenizers
    library encodes long and other ones, those with an apostrophe, and those that may hold a special token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.bpe = RankBpe(path, self.dtype.str)
        self.chunks = Recent(CACHE_CHUNKS)

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        new, young = self.chunks.missing(chunks), self.chunks.young
        plain = [c for c in new if len(c) <= SHORT_WORD and (c.isascii() or LATIN.fullmatch(c)) and b"'" not in c and b"<|" not in c]
        if plain:
            self.merge_chunks(plain)
        other = [c for c in new if c not in young] if len(plain) < len(new) else []
        for at in range(0, len(other), 4096):
            found = self.tokenizer.encode_batch_fast([c.decode() for c in other[at : at + 4096]], add_special_tokens=False)
            young.update((c, np.array(e.ids, self.dtype).tobytes()) for c, e in zip(other[at : at + 4096], found, strict=True))
        return young

    def merge_chunks(self, chunks: list[bytes]) -> None:
        """Chunks of Latin-1 letters, digits and marks: split by character class and merged, all in numpy."""
        lowered = b"\n".join(chunks).decode().lower() + "\n"
        kind = LATIN_KIND[np.frombuffer(lowered.encode("latin-1"), np.uint8)]
        # A word ends where the kind of character changes, and every digit is a word.
        last = np.append(kind[1:] != kind[:-1], True) | (kind == 2)
        raw = np.frombuffer(lowered.encode(), np.uint8)
        closes = np.append((raw[1:] & 0xC0) != 0x80, True)  # the last byte of a character
        ends = np.zeros(len(raw), bool)
        ends[np.flatnonzero(closes)] = last
        stops = np.flatnonzero(raw == 10)
        starts = np.concatenate([[0], stops[:-1] + 1])
        lengths = stops - starts
        order = np.argsort(lengths, kind="stable")
        ids = np.where(ends, self.bpe.of_last[raw], self.bpe.of_byte[raw])
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            columns = np.arange(int(lengths[rows[-1]]))
            places = np.minimum(starts[rows, None] + columns, len(ids) - 1)
            parts = np.where(columns < lengths[rows, None], ids[places], np.int32(-1))
            self.chunks.young.update(zip([chunks[i] for i in rows.tolist()], self.bpe.merge_parts(parts), strict=True))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of self.dtype."""
        each = [(t.lower() if is_latin(t) else t).encode().split() for t in texts]
        known = self.learn(set().union(*each))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in each]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """docs: row (a struct of what is carried along) and text.

    row, ids (bytes of unsigned integers, two or four bytes each, little-endian), n, rest = n % WINDOW, part, and this
    row's rank in its part: local_rank among rests of that length, local_full of its first full window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, full = TaskContext.get().partitionId(), np.zeros(WINDOW, np.int64), 0
        for batch in batches:
            for rows, texts in text_groups(batch, limit=TOKENISE_CHARS):
                out: list[tuple] = []
                tool = encoder(path)
                end, width = np.array(END_ID, tool.dtype).tobytes(), tool.dtype.itemsize
                for ids in tool.encode_texts([t or "" for t in texts]):
                    ids += end
                    n = len(ids) // width
                    rest = n % WINDOW
                    out.append((ids, n, rest, part, int(ranks[rest]), full))
                    ranks[rest] += 1
                    full += n // WINDOW
                kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*carried(rows, "row"), *columns], names=["row", "ids", "n", "rest", "part", "local_rank", "local_full"])

    return map_arrow(docs, ["row", "text"], run, f"row {docs.schema['row'].dataType.simpleString()}, ids binary, n bigint, rest int, part int, local_rank bigint, local_full bigint")


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Rows of three lengths that add up to WINDOW (0: none), longest first; only lengths that occur."""
    have = histogram > 0
    lengths = np.flatnonzero(have)
    pairs = [(WINDOW - a, a, 0) for a in lengths.tolist() if a <= WINDOW // 2 and have[WINDOW - a]]
    common = lengths[np.argsort(-histogram[lengths], kind="stable")][:MIDDLES]
    triples = set()
    for b in common.tolist():
        left = WINDOW - b - lengths
        ok = (left > 0) & have[np.clip(left, 0, WINDOW - 1)]
        triples.update(tuple(sorted((a, b, WINDOW - a - b), reverse=True)) for a in lengths[ok].tolist())
    triples.update((max(a, WINDOW - 2 * a), a, min(a, WINDOW - 2 * a)) for a in lengths.tolist() if WINDOW - 2 * a > 0 and have[WINDOW - 2 * a])
    return np.array(pairs + sorted(tuple(sorted(t, reverse=True)) for t in triples), np.int64).reshape(-1, 3)


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A counting each combination's lengths: accelerated projected gradient."""
    target = histogram.astype(float).copy()
    target[0] = 0
    weight = (combos > 0).astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), (weight * x[:, None]).ravel(), WINDOW)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * weight).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(y - step * back(forward(y) - target), 0)
        t_nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = nxt, nxt + (t - 1) / t_nxt * (nxt - x), t_nxt
    return x


@dataclass
class Plan:
    """Places by length: those of length l are [first[l], first[l + 1]) of the arrays, in order of the ranks they take."""

    first: np.ndarray
    start: np.ndarray  # first rank
    sequence: np.ndarray  # sequence of that rank; each further rank takes the next
    offset: np.ndarray
    planned: np.ndarray  # by length: ranks that the plan takes
    left_start: np.ndarray  # by length: tokens of left-over rests before its first
    sequences: int
    left: int  # tokens of all left-over rests

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of each piece of the rank-th rest of a length."""
        if rank < self.planned[length]:
            a, b = int(self.first[length]), int(self.first[length + 1])
            k = a + int(np.searchsorted(self.start[a:b], rank, side="right")) - 1
            return [(int(self.sequence[k]) + rank - int(self.start[k]), int(self.offset[k]), length)]
        at = int(self.left_start[length]) + (rank - int(self.planned[length])) * length
        out = []
        while length:
            sequence, begin, size = self.window(at)
            take = min(length, begin + size - at)
            out.append((sequence, at - begin, take))
            at, length = at + take, length - take
        return out

    def window(self, at: int) -> tuple[int, int, int]:
        """Sequence, first token and size of the window that holds a left-over token."""
        whole = self.left // WINDOW
        if at < whole * WINDOW:
            return self.sequences + at // WINDOW, at // WINDOW * WINDOW, WINDOW
        begin, rest, k = whole * WINDOW, self.left % WINDOW, 0
        while True:
            size = 1 << (rest.bit_length() - 1)
            if at < begin + size:
                return self.sequences + whole + k, begin, size
            begin, rest, k = begin + size, rest - size, k + 1


def make_plan(histogram: np.ndarray) -> Plan:
    """histogram: documents by the length of their rest, WINDOW entries."""
    free = histogram.astype(np.int64).copy()
    free[0] = 0
    combos = combinations(free)
    x = least_squares(combos, free) if len(combos) else np.zeros(0)
    places: list[tuple[int, int, int, int]] = []
    used = np.zeros(WINDOW, np.int64)
    sequences = 0
    for wanted in (np.floor(x + 1e-6).astype(np.int64), np.full(len(combos), 1 << 60)):
        for c in np.argsort(-x, kind="stable").tolist():
            parts = [p for p in combos[c].tolist() if p]
            n = min(int(wanted[c]), *(int(free[p]) // parts.count(p) for p in parts))
            if n <= 0:
                continue
            offset = 0
            for p in parts:
                places.append((p, int(used[p]), sequences, offset))
                used[p] += n
                free[p] -= n
                offset += p
            sequences += n
    places.sort()
    table = np.array(places, np.int64).reshape(-1, 4)
    tokens = free * np.arange(WINDOW)
    return Plan(
        np.searchsorted(table[:, 0], np.arange(WINDOW + 1)), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy(), used, np.concatenate([[0], np.cumsum(tokens)[:-1]]), sequences, int(tokens.sum())
    )


def pack(docs: DataFrame, path: str, carry: list[str], with_ids: bool = True) -> DataFrame:
    """A row for each piece: carry, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A carried column that has the name of one of these is left out."""
    carry = [c for c in carry if c not in (*PIECE, "ids")]
    table = materialise(tokenise(docs.select(F.struct(*carry).alias("row"), "text"), path), "pack-ids")
    counts = table.groupBy("part", "rest").agg(F.count("*").alias("k"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "rest", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ranks_before"))
    histogram = np.zeros(WINDOW, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("k").alias("k")).collect():
        histogram[r["rest"]] = r["k"]
    shared = docs.sparkSession.sparkContext.broadcast(make_plan(histogram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            get = lambda b, c: b.column(b.schema.get_field_index(c))
            for at in range(0, max(batch.num_rows, 1), 128):
                rows = batch.slice(at, 128)
                origin, out = [], []
                columns = [get(rows, c).to_pylist() for c in ("ids", "n", "rest", "part", "local_rank", "local_full", "ranks_before")]
                for i, (ids, n, rest, part, rank, full, ahead) in enumerate(zip(*columns, strict=True)):
                    pieces = [(FULL | part << PART_BITS | full + k, 0, WINDOW) for k in range(n // WINDOW)]
                    if rest:
                        pieces += plan.place(rest, ahead + rank)
                    start, ids = 0, np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                    for sequence, offset, size in pieces:
                        raw = ids[4 * start : 4 * (start + size)]
                        out.append((start, size, zlib.crc32(raw), n, sequence, offset, raw))
                        origin.append(i)
                        start += size
                if out:
                    back = pa.array(origin, pa.int32())
                    start, size, crc, n, sequence, offset, raw = zip(*out, strict=True)
                    numbers = [pa.array(c, pa.int64()) for c in (start, size, crc, n, sequence, offset)]
                    more = [pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays([get(rows, "row").take(back), *numbers, *more], names=["row", *PIECE, *["ids"] * with_ids])

    fields = f"row {table.schema['row'].dataType.simpleString()}, " + ", ".join(f"`{c}` bigint" for c in PIECE) + ", ids array<int>" * with_ids
    columns = ["row", "ids", "n", "rest", "part", "local_rank", "local_full", "ranks_before"]
    return map_arrow(table.join(offsets, ["part", "rest"]), columns, run, fields).select("row.*", *PIECE, *["ids"] * with_ids)


PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op9_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, path or default_path(), ["doc_id"], with_ids=False)
