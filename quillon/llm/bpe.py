"""Byte-level BPE encoding and decoding.

Method: a contiguous rank array.  A short word is an array of part ids and an array with the merge rank of each pair
of neighbours; the smallest rank is found by a scan, its boundary is deleted, and the two ranks beside it are looked up
again, until no pair can merge.  numpy does this for many distinct words at once, a row for each word.  The cost of the
scan grows with the square of the word's length, so words over SHORT_WORD bytes go through a heap and a linked list.

A null text is the empty text: no ids, empty decoded text; an empty table gives no rows.  Rows keep their multiplicity;
pairs that tie in rank merge from the left.  Other columns are carried along unchanged, but those with the names of results
(`ids` and the others) are left out.  Special tokens in a text are matched before splitting, as the tokenizer's file says.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import read_table, text_groups

SHORT_WORD = 48
#: Distinct words, and distinct parts between spaces, of which a worker remembers the ids; twice as many at most.
CACHE_WORDS, CACHE_CHUNKS = 120_000, 200_000
#: Characters that are encoded at once: the more, the fewer distinct parts to look up.
TOKENISE_CHARS = 3_000_000
NO_RANK = np.int32(2**31 - 1)
#: Binary logarithm of the slots of the merge table.
SLOT_BITS = 18
# The split pattern of the tokenizer's byte-level pre-tokenizer; white space as Unicode defines it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Recent:
    """A cache of two generations: when the young one is full it becomes the old one, and what is used moves back."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Keys that aren't known; all others are in `young` until the next call."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for k in keys.difference(young):
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                young[k] = v
        return out


class RankBpe:
    """A BPE vocabulary over bytes; ids of a word or chunk are held as bytes of a numpy type."""

    def __init__(self, path: str, dtype: str = "<i4"):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.of_byte = np.array([vocab[c] for c in alphabet], np.int32)
        self.of_last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in (token.removesuffix(suffix) if suffix else token))
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.shift = size.bit_length()
        keys = np.array([(vocab[a] << self.shift) | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.fill_slots(keys)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.split, self.dtype = regex.compile(SPLIT), dtype
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.uneven = regex.compile(rf" (?=[{SPACES}]|\Z)")
        self.words, self.chunks = Recent(CACHE_WORDS), Recent(CACHE_CHUNKS)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def fill_slots(self, keys: np.ndarray) -> None:
        """An open-addressed table of the merges, which numpy probes for many pairs at once."""
        size = 1 << SLOT_BITS
        self.slot_key, self.slot_rank = np.full(size + len(keys), -1, np.int64), np.full(size + len(keys), NO_RANK, np.int32)
        at, rest = self.place(keys), np.arange(len(keys))
        while len(rest):
            free = self.slot_key[at] < 0
            _, first = np.unique(at, return_index=True)
            won = first[free[first]]
            self.slot_key[at[won]], self.slot_rank[at[won]] = keys[rest[won]], rest[won]
            lost = np.ones(len(rest), bool)
            lost[won] = False
            at, rest = at[lost] + 1, rest[lost]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; NO_RANK if there's none or an id is -1 (past the word's end)."""
        key = (left.astype(np.int64) << self.shift) | right
        at = self.place(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], NO_RANK)
        more = np.flatnonzero((found != key) & (found >= 0))
        key, at = key.ravel()[more], at.ravel()[more]
        flat = out.reshape(-1)
        while len(more):
            at += 1
            found = self.slot_key[at]
            hit = found == key
            flat[more[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (found >= 0)
            more, key, at = more[on], key[on], at[on]
        return out

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Short words; one row of the rank array for each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        inside = np.arange(int(lengths.max())) < lengths[:, None]
        raw = np.zeros(inside.shape, np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        parts = np.where(inside, self.of_byte[raw], np.int32(-1))
        ends = (np.arange(len(words)), lengths - 1)
        parts[ends] = self.of_last[raw[ends]]
        return self.merge_parts(parts)

    def merge_parts(self, parts: np.ndarray) -> list[bytes]:
        """Rows of part ids, -1 behind a row's end.  A row may hold several words where ids of word ends differ from
        others, for no merge then reaches over a word's end."""
        ranks = np.full(parts.shape, NO_RANK, np.int32)
        ranks[:, :-1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        out: list = [None] * len(parts)
        index = np.arange(len(parts))
        while len(index):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(index))
            best = ranks[rows, at]
            done = best == NO_RANK
            if done.any():
                kept = parts[done]
                flat = kept.astype(self.dtype)
                stops, step = (flat.itemsize * (kept >= 0).sum(axis=1)).tolist(), flat.itemsize * kept.shape[1]
                flat = flat.tobytes()
                for k, (i, n) in enumerate(zip(index[done].tolist(), stops, strict=True)):
                    out[i] = flat[k * step : k * step + n]
                live = ~done
                index, parts, ranks, at, best = index[live], parts[live], ranks[live], at[live], best[live]
                if not len(index):
                    break
                rows = np.arange(len(index))
            parts[rows, at] = self.made[best]
            columns = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            ranks[:, -1] = NO_RANK
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, parts.shape[1] - 1)
            has_before, has_after = at > 0, at + 1 < parts.shape[1]
            here = parts[rows, at]
            ranks[rows[has_before], before[has_before]] = self.pair_ranks(parts[rows, before], here)[has_before]
            ranks[rows[has_after], at[has_after]] = self.pair_ranks(here, parts[rows, after])[has_after]
        return out

    def merge_long(self, word: bytes) -> bytes:
        """A word of any length in n log n steps: candidate merges in a heap, parts in a linked list."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.of_last[word[-1]])
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        find = lambda i, j: self.rank_of.get((ids[i] << self.shift) | ids[j])
        heap = [(r, i) for i in range(n - 1) if (r := find(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j < 0 or find(i, j) != rank:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (r := find(i, nxt[i])) is not None:
                    heapq.heappush(heap, (r, i))
            if prv[i] >= 0 and (r := find(prv[i], i)) is not None:
                heapq.heappush(heap, (r, prv[i]))
        return np.array([x for x in ids if x >= 0], self.dtype).tobytes()

    def of_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all these words, in a dictionary that may hold others as well."""
        raw = [(w.encode(), w) for w in self.words.missing(words)]
        young = self.words.young
        for b, w in raw:
            if len(b) > SHORT_WORD:
                young[w] = self.merge_long(b)
        short = sorted((x for x in raw if len(x[0]) <= SHORT_WORD), key=lambda x: len(x[0]))
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            young.update(zip([w for _, w in part], self.merge_rows([b for b, _ in part]), strict=True))
        return young

    def of_pieces(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        known = self.of_words(set().union(*lists))
        return [b"".join(map(known.__getitem__, x)) for x in lists]

    def of_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of all these chunks, each with a space before it, in a dictionary that may hold others as well."""
        new = self.chunks.missing(chunks)
        if new:
            self.chunks.young.update(zip(new, self.of_pieces([self.split.findall(" " + c) for c in new]), strict=True))
        return self.chunks.young

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has.

        Where every space stands before a character that isn't white space, splitting at spaces separates no word, and
        each part can be encoded by itself; other texts, and texts with special tokens, are split as a whole."""
        chunks, heads, others = [], {}, {}
        for k, text in enumerate(texts):
            if self.uneven.search(text) or self.special and self.special.search(text):
                others[k] = self.special.split(text) if self.special else [text]
                chunks.append(())
            else:
                head, *rest = text.split(" ")
                heads[k] = self.split.findall(head)
                chunks.append(rest)
        known = self.of_chunks(set().union(*chunks))
        first = dict(zip(heads, self.of_pieces(list(heads.values())), strict=True))
        each = []
        for k, rest in enumerate(chunks):
            if k in first:
                each.append(first[k] + b"".join(map(known.__getitem__, rest)))
            else:
                parts = self.of_pieces([[] if x in self.added else self.split.findall(x) for x in others[k]])
                each.append(b"".join(np.array([self.added[x]], "<i4").tobytes() if x in self.added else ids for x, ids in zip(others[k], parts, strict=True)))
        return np.frombuffer(b"".join(each), "<i4"), np.fromiter(map(len, each), np.int64, len(each)) // 4

    def decode_ids(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> RankBpe:
    """One for each worker process and file."""
    return RankBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>) of its texts; the text itself isn't returned."""
    keep = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for rows, texts in text_groups(batch, text, TOKENISE_CHARS):
                flat, lengths = bpe.encode_texts([t or "" for t in texts])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), column], names=[*keep, ids])

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its ids stand for; null ids give null, no ids give the empty text."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                rows = batch.slice(at, 256)
                lists = rows.column(rows.schema.get_field_index(ids))
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([len(x) if x.is_valid else 0 for x in lists]).tolist()
                texts = [bpe.decode_ids(flat[a:b]) if x.is_valid else None for x, a, b in zip(lists, [0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, text])

    return df.select(*keep).mapInArrow(run, schema)


def op5_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or default_path()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
