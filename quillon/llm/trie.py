"""Conversation prefix trie: every distinct sequence of first turns of the rebuilt conversations, with what sharing it saves.

Method: a Cartesian tree over the longest-common-prefix (LCP) array of the sorted conversations.
1. Turns become digests and word counts; texts are shuffled no further.  Conversations are rebuilt, one row each.
2. Rows are dealt by range on (sequence, conv_id) into blocks of about the square root of their number; equal sequences
   in a block become one run (a hot sequence is spread over blocks and costs each one run).
3. All nearest smaller values of the LCP array, in parallel: a stack pass in each block finds the neighbours of most
   entries.  What is left of a block are its prefix and suffix minima, a few per depth; their neighbours are looked up in
   the nearest block whose minimum is smaller (block minima), by a join with that block's own minima.
4. Entries of equal LCP between the same neighbours are one node; a node covers the depths above the larger neighbour,
   which are expanded at the end.  Counts and sums over a node's interval are differences of prefix sums within blocks,
   totals of whole blocks between, and minima alike.
5. SHA-256 of member ids: a run's ids are joined and hashed where they are sorted; only sequences that span several runs
   are hashed again, as a stream of the runs' bytes in order.

Results.  Rows without conv_id are left out.  Turns go by turn number, null first; equal numbers by the digest of role and
text, so repeated rows are repeated turns.  Null role or text is empty.  A negative conv_id has the remainder of its
magnitude, as SQL's % has.  Rebuilt conversations without turns are members of the root alone.  An empty table gives no
rows.  A conversation is one row of 32 bytes a turn and its word counts (not its texts); very long texts count like any
other.  Other columns are not read, whatever their names.

The driver holds one row of integers for each block (BLOCK_ROWS rows or SPREAD times the root of the row number, whichever
is more).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import BROADCAST_ROWS, map_arrow, materialise, read_table

#: Conversations that share a base, and the most turns taken from it plus one.
FAMILY, HEADS = 20, 4
#: Characters of a turn's digest (hexadecimal).
DIGEST = 32
#: Least rows of a block; SPREAD * sqrt(rows) beyond that.
BLOCK_ROWS, SPREAD = 5_000, 4
#: Ids that one run holds at most.
CHUNK = 100_000
NOTHING = hashlib.sha256(b"").hexdigest()
LAST = 2**31 - 1

_RUNS = "block int, idx int, last boolean, key string, words array<long>, n long, first long, hash string, ids binary"
_SUMS = ("n", "leaves", "a", "g")
_PIECES = pa.schema([
    ("kind", pa.string()), ("block", pa.int32()), ("pos", pa.int32()), ("side", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()),
    ("conv_id", pa.int64()), ("n", pa.int64()), ("leaves", pa.int64()), ("a", pa.int64()), ("g", pa.int64()), ("children", pa.int64()),
    ("turns", pa.int32()), ("words", pa.list_(pa.int64())), ("ends", pa.string()),
    ("parent", pa.int64()), ("ref_block", pa.int32()), ("ref_side", pa.string()), ("ref_hi", pa.int32()),
])
_PIECES_SQL = """kind string, block int, pos int, side string, lo int, hi int, conv_id long, n long, leaves long, a long, g long,
    children long, turns int, words array<long>, ends string, parent long, ref_block int, ref_side string, ref_hi int"""


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key (digests of the rebuilt turns, end to end), words (of each turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turn = F.struct("turn", F.substring(digest, 1, DIGEST).alias("d"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    own = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("_t"))
        .withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .repartition("_base")
        .groupBy("_base", "conv_id")
        .agg(F.transform(F.sort_array(F.collect_list("_t")), lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("own"))
    )
    # a family is at most FAMILY rows, and its base comes as its first turns alone
    base = F.max(F.when(F.col("conv_id") == F.col("_base"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("_base"))
    joined = own.withColumn("head", F.coalesce(base, F.slice("own", 1, 0))).withColumn("h", heads)
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return joined.select("conv_id", turns.alias("_t")).select("conv_id", F.array_join("_t.d", "").alias("key"), F.col("_t.w").alias("words"))


def runs(rows: DataFrame, block_rows: int | None, chunk: int) -> DataFrame:
    """Rows in order of (key, conv_id), cut into blocks; equal keys of a block are one run, of `chunk` ids at most."""
    total = rows.count()
    blocks = max(1, math.ceil(total / (block_rows or max(BLOCK_ROWS, SPREAD * math.isqrt(total)))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, idx, now = TaskContext.get().partitionId(), 0, None
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal idx
            key, words, ids = now
            joined = ",".join(map(str, ids)).encode()
            out.append((block, idx, last, key, words, len(ids), ids[0], hashlib.sha256(joined).hexdigest(), joined))
            idx += 1

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RUN_TYPES)], names=_RUN_NAMES)
            out.clear()
            return made

        for batch in batches:
            for key, conv, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now and (now[0] != key or len(now[2]) >= chunk):
                    close(False)
                    now = None
                if now:
                    now[2].append(conv)
                else:
                    now = (key, words.as_py(), [conv])
            if out:
                yield flush()
        if now:
            close(True)
            yield flush()

    placed = rows.select("key", "conv_id", "words").repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return materialise(map_arrow(placed, ["key", "conv_id", "words"], gather, _RUNS), "trie-runs")


_RUN_TYPES = [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_RUN_NAMES = ["block", "idx", "last", "key", "words", "n", "first", "hash", "ids"]


def common(a: str, b: str) -> int:
    """Turns that two keys begin with alike."""
    if a == b:
        return len(a) // DIGEST
    for at in range(0, min(len(a), len(b)), DIGEST):
        if a[at : at + DIGEST] != b[at : at + DIGEST]:
            return at // DIGEST
    return min(len(a), len(b)) // DIGEST


def _sums(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


class Pieces:
    """Rows of _PIECES, column by column."""

    def __init__(self) -> None:
        self.columns = {name: [] for name in _PIECES.names}
        self.rows = 0

    def add(self, **values) -> int:
        for name, column in self.columns.items():
            column.append(values.get(name))
        self.rows += 1
        return self.rows - 1

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.columns[f.name], f.type) for f in _PIECES], schema=_PIECES)


def block_pieces(block: int, runs: list[tuple], before: str | None, after: str | None, next_block: int | None) -> pa.RecordBatch:
    """The nodes that end within a block; its prefix and suffix minima (kind "min"), runs of sequences that span several
    (kind "span"), and its totals (kind "block").  runs: (key, words, n, first, hash), in order; before and after: the
    neighbouring blocks' nearest keys."""
    m = len(runs)
    keys = [r[0] for r in runs]
    lcp = [-1 if before is None else common(before, keys[0]), *(common(a, b) for a, b in zip(keys, keys[1:]))]
    beyond = -1 if after is None else common(keys[-1], after)
    around = [*lcp, beyond]
    words = [_sums(r[1]) for r in runs]
    turns = [len(r[1]) for r in runs]
    first = [r[3] for r in runs]
    spans = [
        (i > 0 and keys[i - 1] == keys[i]) or (i + 1 < m and keys[i + 1] == keys[i]) or (i == 0 and before == keys[0]) or (i == m - 1 and after == keys[-1])
        for i in range(m)
    ]
    total = {
        "n": _sums([r[2] for r in runs]),
        "leaves": _sums([int(around[i + 1] < turns[i]) for i in range(m)]),
        "a": _sums([r[2] * w[-1] for r, w in zip(runs, words)]),
        "g": _sums([w[-1] - w[max(v, 0)] for w, v in zip(words, lcp)]),
    }
    out, waiting, known = Pieces(), [], {}

    def ends(i: int, hi: int) -> str | None:
        return NOTHING if turns[i] != hi else None if spans[i] else runs[i][4]

    def node(p: int, q: int, lo: int, hi: int, least: int, children: int, parent) -> None:
        w = words[p]
        sums = {c: total[c][q] - total[c][p] for c in _SUMS}
        sums["g"] += w[max(lcp[p], 0)]
        row = out.add(kind="node", block=block, pos=p, lo=lo, hi=hi, conv_id=least, children=children, ends=ends(p, hi), words=[w[max(d - 1, 0)] for d in range(lo + 1, hi + 1)], **sums)
        waiting.append((row, parent))

    # stack of groups of equal LCP: [value, left neighbour, first and last element, children, least id, name]
    stack: list[list] = []
    elements = [*lcp, -1] if after is None else lcp
    for i, value in enumerate(elements):
        least = first[i - 1] if i else None
        # elements without a group yet take the name that the group of element i will have
        joins = ("at", i)
        if i and turns[i - 1] > max(lcp[i - 1], value):
            node(i - 1, i, max(lcp[i - 1], value), turns[i - 1], least, 0, stack[-1][6] if lcp[i - 1] >= value else joins)
        while stack and stack[-1][0] > value:
            v, p, start, _, children, least_of, name = stack.pop()
            least = least_of if least is None else least if least_of is None else min(least, least_of)
            if p is None:
                known[name] = ("P", v)
                side(out, "P", block, start, v, children, words, lcp, turns, total, first, None)
            else:
                parent = stack[-1][6] if stack[-1][0] >= value else joins
                known[name] = (least,)
                node(p, i, max(lcp[p], value), v, least, children + (turns[p] > v), parent)
        more = int(i < m and turns[i] > value)
        if stack and stack[-1][0] == value:
            top = stack[-1]
            top[3], top[4] = i, top[4] + more
            top[5] = least if top[5] is None else min(top[5], least)
            known[joins] = top[6]
        else:
            stack.append([value, stack[-1][3] if stack else None, i, i, more, least, joins])
    if after is not None and turns[-1] > max(lcp[-1], beyond):
        node(m - 1, m, max(lcp[-1], beyond), turns[-1], first[-1], 0, stack[-1][6] if lcp[-1] >= beyond else (next_block, "P", beyond))
    for v, p, start, end, children, _, name in stack:
        known[name] = ("S", v)
        if p is None:
            side(out, "P", block, start, v, children, words, lcp, turns, total, first, None)
            children = 0
        side(out, "S", block, end, v, children, words, lcp, turns, total, first, ends(end, turns[end]) if end < m else None)
    for row, parent in waiting:
        while parent in known:
            parent = known[parent]
        if len(parent) == 1:
            out.columns["parent"][row] = parent[0]
        else:
            at, where, v = parent if len(parent) == 3 else (block, *parent)
            if v >= 0:
                out.columns["ref_block"][row], out.columns["ref_side"][row], out.columns["ref_hi"][row] = at, where, v
    for i in range(m):
        if spans[i]:
            out.add(kind="span", block=block, pos=i)
    out.add(kind="block", block=block, hi=min(elements), conv_id=min(first), **{c: total[c][m] for c in _SUMS})
    return out.batch()


def side(out: Pieces, which: str, block: int, at: int, v: int, children: int, words, lcp, turns, total, first, ends: str | None) -> None:
    """A minimum of the block: P, the first of its value from the left, with the sums of the runs before it; S, the last,
    with those from it on."""
    m = len(turns)
    prefix = words[at] if at < m else words[m - 1]
    sums = {c: total[c][at] if which == "P" else total[c][m] - total[c][at] for c in _SUMS}
    ids = first[:at] if which == "P" else first[at:]
    out.add(kind="min", side=which, block=block, pos=at, hi=v, children=children, turns=turns[at] if at < m else None,
            conv_id=min(ids, default=None), ends=ends, words=prefix[: v + 1] if v >= 0 else [], **sums)


def pieces(run: DataFrame) -> DataFrame:
    """block_pieces of all blocks, each with the last key before it and the first key after it."""
    spark = run.sparkSession
    present = sorted(r.block for r in run.where("idx = 0").select("block").collect())
    if not present:
        return spark.createDataFrame([], _PIECES_SQL)
    order = spark.createDataFrame(list(zip(present, [None, *present], [*present[1:], None])), "block int, before int, after int")
    plain = run.select("block", "idx", "key", "words", "n", "first", "hash", F.lit(None).cast("int").alias("other"))
    edges = run.where("idx = 0 or last").select("block", "idx", "last", "key").join(F.broadcast(order), "block")

    def halo(rows: DataFrame, to: str, idx: int) -> DataFrame:
        return rows.where(F.col(to).isNotNull()).select(
            F.col(to).alias("block"), F.lit(idx).alias("idx"), "key", F.lit(None).cast("array<long>").alias("words"),
            *(F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("first", "long"), ("hash", "string"))), F.col("block").alias("other"),
        )

    whole = plain.unionByName(halo(edges.where("last"), "after", -1)).unionByName(halo(edges.where("idx = 0"), "before", LAST))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, before, after, following = None, [], None, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != block:
                    if held:
                        yield block_pieces(block, held, before, after, following)
                    block, held, before, after, following = row[0], [], None, None, None
                if row[1] == -1:
                    before = row[2]
                elif row[1] == LAST:
                    after, following = row[2], row[7]
                else:
                    held.append(row[2:7])
        if held:
            yield block_pieces(block, held, before, after, following)

    columns = ["block", "idx", "key", "words", "n", "first", "hash", "other"]
    dealt = whole.repartition("block").sortWithinPartitions("block", "idx")
    return materialise(map_arrow(dealt, columns, gather, _PIECES_SQL), "trie-pieces")


class Blocks:
    """What is known of every block, in order: least LCP and id, sums; and the nearest blocks with a smaller least LCP."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.block)
        self.names = [r.block for r in rows]
        self.index = {b: i for i, b in enumerate(self.names)}
        self.least = [r.hi for r in rows]
        self.ids = np.array([r.conv_id for r in rows], np.int64)
        self.sums = {c: _sums([r[c] for r in rows]) for c in _SUMS}
        self.left, self.right = self._smaller(range(len(rows))), self._smaller(range(len(rows) - 1, -1, -1))

    def _smaller(self, order) -> list[int]:
        found, stack = [-1] * len(self.least), []
        for i in order:
            while stack and self.least[stack[-1]] >= self.least[i]:
                stack.pop()
            found[i] = stack[-1] if stack else -1
            stack.append(i)
        return found

    def below(self, at: int, value: int, step: list[int]) -> int:
        """From block `at` on, in one direction, the nearest whose least LCP is under value."""
        while self.least[at] >= value:
            at = step[at]
        return at


def crossing(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that reach over blocks, in the columns of _PIECES, and the least id of every minimum's node
    (ref_block, ref_side, ref_hi, _conv)."""
    minima = parts.where("kind = 'min'")
    info = Blocks(parts.where("kind = 'block'").select("block", "hi", "conv_id", *_SUMS).collect())

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, which, value, children, words = (c.to_pylist() for c in batch.columns)
            lefts, rights = [], []
            for b, s, v in zip(block, which, value):
                i = info.index[b]
                inside = info.least[i] < v
                lefts.append(info.names[i if s == "S" and inside else info.below(i - 1, v, info.left)])
                rights.append(info.names[i if s == "P" and inside else info.below(i + 1, v, info.right)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lefts, pa.int32()), pa.array(rights, pa.int32())], ["block", "side", "hi", "children", "words", "to_left", "to_right"]
            )

    asked = map_arrow(minima.where("hi >= 0"), ["block", "side", "hi", "children", "words"], aim, "block int, side string, hi int, children long, words array<long>, to_left int, to_right int")

    def chain(which: str, to: str, name: str) -> DataFrame:
        entry = F.struct("hi", "pos", "turns", "conv_id", "ends", *_SUMS)
        return minima.where(F.col("side") == which).groupBy(F.col("block").alias(to)).agg(F.collect_list(entry).alias(name))

    # neighbours: of the block's minima under the value, the largest is the nearest
    def nearest(name: str):
        return F.array_max(F.filter(name, lambda e: e["hi"] < F.col("hi")))

    met = asked.join(chain("S", "to_left", "_p"), "to_left").join(chain("P", "to_right", "_q"), "to_right").withColumn("_p", nearest("_p")).withColumn("_q", nearest("_q"))
    flat = met.select(
        "block", "side", "hi", "children", "words", "to_left", "to_right",
        *(F.col(f"_{x}.{c}").alias(f"{x}_{c}") for x in "pq" for c in ("hi", "pos", "turns", "conv_id", "ends", *_SUMS)),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Pieces()
            for r in batch.to_pylist():
                left, right, v = info.index[r["to_left"]], info.index[r["to_right"]], r["hi"]
                sums = {c: r[f"p_{c}"] + r[f"q_{c}"] + info.sums[c][right] - info.sums[c][left + 1] for c in _SUMS}
                ids = [x for x in (r["p_conv_id"], r["q_conv_id"]) if x is not None]
                if right > left + 1:
                    ids.append(int(info.ids[left + 1 : right].min()))
                w, lo = r["words"], max(r["p_hi"], r["q_hi"])
                sums["g"] += w[max(r["p_hi"], 0)]
                parent = (r["to_left"], "S", r["p_hi"]) if r["p_hi"] >= r["q_hi"] else (r["to_right"], "P", r["q_hi"])
                parent = parent if lo >= 0 else (None, None, None)
                # kind and turns carry the minimum that asked, for the table of its node's id
                out.add(kind=r["side"], turns=r["block"], block=r["to_left"], pos=r["p_pos"], lo=lo, hi=v, conv_id=min(ids), children=r["children"],
                        side="open" if r["p_turns"] > v else "ends", ends=r["p_ends"] if r["p_turns"] == v else NOTHING, words=[w[max(d - 1, 0)] for d in range(lo + 1, v + 1)],
                        ref_block=parent[0], ref_side=parent[1], ref_hi=parent[2], **sums)
            yield out.batch()

    made = materialise(map_arrow(flat, flat.columns, join, _PIECES_SQL), "trie-crossing")
    named = made.select(F.col("turns").alias("ref_block"), F.col("kind").alias("ref_side"), F.col("hi").alias("ref_hi"), F.col("conv_id").alias("_conv"))
    same = ("lo", "conv_id", *_SUMS, "words", "ends", "ref_block", "ref_side", "ref_hi", "side")
    nodes = (
        made.groupBy("block", "pos", "hi")
        .agg(F.sum("children").alias("children"), *(F.first(c).alias(c) for c in same))
        .withColumn("children", F.col("children") + (F.col("side") == "open").cast("long"))
        .withColumn("parent", F.lit(None).cast("long"))
    )
    return nodes, named


def spanning(run: DataFrame, parts: DataFrame) -> DataFrame:
    """block and pos of the first of several runs of a sequence, and the hash of all their ids, streamed in order."""
    wanted = parts.where("kind = 'span'").select("block", F.col("pos").alias("idx"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = run.select("block", "idx", "key", "ids").join(wanted, ["block", "idx"]).repartition("key").sortWithinPartitions("key", "block", "idx")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, state, found = None, None, None, []
        for batch in batches:
            for block, idx, own, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or own != key:
                    if state is not None:
                        found.append((*at, state.hexdigest()))
                    key, at, state = own, (block, idx), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if len(found) > 10_000:
                yield _hashes(found)
                found = []
        if state is not None:
            found.append((*at, state.hexdigest()))
        if found:
            yield _hashes(found)

    return map_arrow(rows, ["block", "idx", "key", "ids"], stream, "block int, pos int, _hash string")


def _hashes(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.string()))], ["block", "pos", "_hash"])


def _small(table: DataFrame) -> DataFrame:
    """A written table, sent to all executors if it is short."""
    table = materialise(table, "trie-lookup")
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def prefix_trie(conversations: DataFrame, block_rows: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    run = runs(materialise(rebuilt(conversations), "trie-rebuilt"), block_rows, chunk)
    parts = pieces(run)
    columns = ["block", "pos", "lo", "hi", "conv_id", *_SUMS, "children", "words", "ends", "parent", "ref_block", "ref_side", "ref_hi"]
    wide, named = crossing(parts)
    nodes = parts.where("kind = 'node'").select(*columns).unionByName(wide.select(*columns))
    # nodes with their parent in the block ask for none: keys that match nothing, so that they stay dealt out
    nodes = nodes.withColumn("ref_block", F.coalesce("ref_block", -1 - F.col("block"))).withColumn("ref_hi", F.coalesce("ref_hi", "pos")).withColumn("ref_side", F.coalesce("ref_side", F.lit("")))
    nodes = nodes.join(_small(named), ["ref_block", "ref_side", "ref_hi"], "left").join(_small(spanning(run, parts)), ["block", "pos"], "left")
    node = nodes.select(
        "lo", "hi", "conv_id", *_SUMS, "children", F.coalesce("parent", "_conv").alias("parent"), F.coalesce("ends", "_hash").alias("ends"), F.posexplode("words").alias("_k", "_w")
    ).withColumn("depth", F.col("lo") + 1 + F.col("_k"))
    top, bottom = F.col("_k") == 0, F.col("depth") == F.col("hi")
    return node.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("a") - F.col("g") - (F.col("n") - 1) * F.col("_w")).alias("saved_tokens"),
        F.when(bottom, F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(k, 32)) AS pos, left(k, 32) AS k, w
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc
), built AS (
  SELECT c.conv_id, o.pos, o.k, o.w FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos, o.k, o.w FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), seq AS (
  SELECT conv_id, string_agg(k, '' ORDER BY pos) AS key, list(w ORDER BY pos) AS ws FROM built GROUP BY conv_id
  UNION ALL SELECT conv_id, '', [] FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM built)
), prefixes AS (
  SELECT conv_id, key, d, left(key, 32 * d) AS p, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, len(ws) AS n_turns
  FROM (SELECT conv_id, key, ws, unnest(range(len(ws) + 1)) AS d FROM seq)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p
), kids AS (
  SELECT d - 1 AS d, left(p, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), sums AS (
  SELECT up AS d, left(p, 32 * up) AS p, sum(leaf) AS n_leaves, sum((n_convs - 1) * w) AS saved
  FROM (SELECT n.p, n.n_convs, n.w, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(n.d + 1)) AS up
        FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p) GROUP BY 1, 2
)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p
LEFT JOIN kids k ON k.d = n.d AND k.p = n.p
LEFT JOIN nodes q ON q.d = n.d - 1 AND q.p = left(n.p, 32 * (n.d - 1)) AND n.d > 0
"""
