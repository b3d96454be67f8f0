"""Generation that ends at stop strings: of a stream of pieces, those up to the one by which a stop string is complete.

A stop string may begin and end anywhere in pieces, and stop strings may be parts of each other.  Pieces are sorted within
their streams (a secondary sort) and run through one automaton for all stop strings, whose state is all that is kept of a
stream, however long.  Null and empty pieces are kept and change nothing; without stop strings, or without one in the
stream, all pieces stay.  Ties in the order go by the piece.

Consecutive pieces of a stream can come as one row, an array of them (`runs_until_stop`): stop strings are then searched
for in the bytes of a run, behind as many bytes of the stream as a stop string can begin in.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.cluster import ship


class Automaton:
    """All stop strings at once: states are prefixes of stop strings, the state after some text the longest that ends it."""

    def __init__(self, stops: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.final = [False]
        for stop in stops:
            if not stop:
                raise ValueError("a stop string is empty")
            state = 0
            for c in stop:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.final.append(False)
                state = self.next[state][c]
            self.final[state] = True
        self.fallback = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            self.final[state] |= self.final[self.fallback[state]]
            for c, child in self.next[state].items():
                back = self.fallback[state]
                while back and c not in self.next[back]:
                    back = self.fallback[back]
                self.fallback[child] = self.next[back].get(c, 0)
                todo.append(child)

    def feed(self, state: int, piece: str) -> tuple[int, bool]:
        """The state after a piece, and whether a stop string was complete in it."""
        for c in piece:
            while state and c not in self.next[state]:
                state = self.fallback[state]
            state = self.next[state].get(c, 0)
            if self.final[state]:
                return state, True
        return state, False


def until_stop(pieces: DataFrame, by: list[str], order: str, piece: str, stops: list[str]) -> DataFrame:
    """pieces (by, order, piece) that a generation with these stop strings gives, and `stops`: true for one that ends it."""
    ship(pieces.sparkSession)
    automaton = Automaton(stops)
    columns = [*by, order, piece]
    dealt = pieces.select(*columns).repartition(*map(F.col, by)).sortWithinPartitions(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, ended = None, 0, False
        for batch in batches:
            kept, last = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(by))))
            for row, (key, text) in enumerate(zip(keys, batch.column(len(by) + 1).to_pylist())):
                if key != stream:
                    stream, state, ended = key, 0, False
                if not ended:
                    state, ended = automaton.feed(state, text or "")
                    kept.append(row)
                    last.append(ended)
            rows = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(last, pa.bool_())], [*columns, "stops"])

    return dealt.mapInArrow(run, T.StructType([*(pieces.schema[c] for c in columns), T.StructField("stops", T.BooleanType())]))


def runs_until_stop(runs: DataFrame, by: list[str], order: str, pieces: str, stops: list[str]) -> DataFrame:
    """The same for runs (by, order, pieces: an array of strings) of consecutive pieces: pieces are cut behind the one that
    completes a stop string, `stops` is true for its run, and later runs are left out.  A null run is an empty one."""
    ship(runs.sparkSession)
    if not all(stops):
        raise ValueError("a stop string is empty")
    sought = [s.encode() for s in stops]
    reach = max(map(len, sought), default=1) - 1
    columns = [*by, order, pieces]
    dealt = runs.select(*columns).repartition(*map(F.col, by)).sortWithinPartitions(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, tail, ended = None, b"", False
        for batch in batches:
            column = batch.column(len(by) + 1)
            flat = column.flatten().cast(pa.large_binary())
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))])
            data = b"".join(flat.drop_null().to_pylist()) if flat.null_count else _bytes(flat)
            sizes, last = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, bool)
            for row, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(by)))) if by else [()] * batch.num_rows):
                if key != stream:
                    stream, tail, ended = key, b"", False
                if ended:
                    continue
                a, b = bounds[row], bounds[row + 1]
                text = tail + data[ends[a] : ends[b]]
                done = min((at + len(s) for s in sought if (at := text.find(s)) >= 0), default=None)
                if done is None:
                    tail, sizes[row] = text[len(text) - reach :] if len(text) > reach else text, b - a
                else:
                    ended = last[row] = True
                    sizes[row] = np.searchsorted(ends[a + 1 : b + 1], ends[a] + done - len(tail)) + 1
            kept = np.flatnonzero(sizes >= 0)
            inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds)) < np.repeat(sizes, np.diff(bounds))
            cut = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[kept])]), pa.int32()), column.flatten().filter(pa.array(inside)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(kept)) for i in range(len(by) + 1)), cut, pa.array(last[kept])], [*columns, "stops"])

    return dealt.mapInArrow(run, T.StructType([*(runs.schema[c] for c in columns), T.StructField("stops", T.BooleanType())]))


def _bytes(flat: pa.Array) -> bytes:
    """The values of a large_binary array without nulls, one behind the other."""
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else [0, 0]
    return flat.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
