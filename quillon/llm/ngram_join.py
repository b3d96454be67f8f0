"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Method: MinHash banding.  The number of bands follows from the rows in a band and the recall wanted at the threshold
(`band_count`); bands of ROWS rows keep texts that merely share a passage apart.  Documents with equal n-gram sets are
one class from the start.  Band hashes of classes are shuffled; classes that share one are connected, and connected
classes form a candidate component.  Every pair inside a component is verified on the full n-gram sets: components are
dealt by hash into parts, and each pair of parts is a unit of work, so neither a pair is verified twice nor does a unit
see more than two parts.  A part of a component of n classes has about sqrt(n) of them, PART_CLASSES at most, so that a
large component's units are many and small.  A unit gives per class its number of links and a link of a spanning forest; pairs
themselves are never written.

Result, one row for each document: class_id (least doc_id connected with it by links, itself included), n_links
(other documents with a similarity of at least the threshold, equal sets included), n_text_links (different n-gram
sets among them), n_copies (documents with the same n-gram set), keep (true for one row of each class: the least
doc_id, nulls last).

Words are the runs between ASCII white space, in lower case (A-Z).  A text of fewer words than N is one n-gram; one
without words, or null, has none, no links, and is kept.  Repeated rows are copies of each other.  A document whose
doc_id is null and that has no links has a null class_id.  Carried columns with the names of results are left out.
Texts of any length are read whole, with all their n-grams; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import carried, listed, map_arrow, materialise, read_table, shuffled, text_groups

N, THRESHOLD = 5, 0.8
ROWS, RECALL = 8, 0.9995
#: Classes in a part of a component, at least (of large enough ones) and at most, and n-grams at most; parts are dealt by
#: hash, so these hold on average.
LEAST_CLASSES, PART_CLASSES, PART_GRAMS = 32, 256, 500_000
SALTS = 32
CACHE_WORDS = 200_000
#: Rows of candidates or dropped documents that are sent to all executors; more are joined over a shuffle.
SENT_ROWS = 50_000
RESULT = ["class_id", "n_links", "n_text_links", "n_copies", "keep"]


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands that find a pair at the threshold with this probability: 1 - (1 - t ** rows) ** bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Sketcher:
    def __init__(self, n: int, bands: int, rows: int):
        rng = np.random.default_rng(20240101)
        self.n, self.bands, self.rows = n, bands, rows
        self.factors = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.mix = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words = WordHashes()

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct n-grams."""
        words = (text or "").encode().lower().split()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(self.n, len(h))
        s = np.full(len(h) - k + 1, len(words) if k < self.n else 0, np.uint64)
        for i in range(k):
            s += h[i : len(h) - k + 1 + i] * self.factors[i]
        s ^= s >> np.uint64(32)
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
        return np.unique(s)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(least, (x[at : at + 1024, None] * self.a + self.b).min(axis=0), out=least)
        h = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        return (h * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


_sketchers: dict = {}


def sketcher(*shape: int) -> Sketcher:
    if shape not in _sketchers:
        _sketchers[shape] = Sketcher(*shape)
    return _sketchers[shape]


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs: row (a struct), id, text.  Adds row_id, cls (digest of the n-gram set; null if empty), grams and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = sketcher(n, bands, rows), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in text_groups(batch):
                sets = [tool.grams(t) for t in texts]
                flat = [tool.band_hashes(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
                columns = [
                    pa.array(np.arange(row, row + len(texts))),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))),
                ]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([*carried(part, "row", "id", "text"), *columns], names=["row", "id", "text", "row_id", "cls", "grams", "bands"])

    kind = docs.schema["row"].dataType.simpleString()
    return map_arrow(docs, ["row", "id", "text"], run, f"row {kind}, id bigint, text string, row_id bigint, cls binary, grams bigint, bands array<bigint>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label (least node connected with it) of every node of edges (a, b).

    Each round takes every node to the least of itself and its neighbours, follows that map a few steps, and contracts
    the edges by it.  Tables are written between rounds; only a count of edges reaches the driver."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), f"{name}-labels")
    while edges.count():
        least = edges.select(F.col("b").alias("v"), F.col("a").alias("m")).union(edges.select(F.col("a").alias("v"), F.col("a").alias("m"))).groupBy("v").agg(F.min("m").alias("m"))
        least = materialise(least, f"{name}-least")
        for _ in range(2):
            step = least.select(F.col("v").alias("m"), F.col("m").alias("m2"))
            least = least.join(shuffled(step), "m", "left").select("v", F.coalesce("m2", "m").alias("m"))
        least = materialise(least, f"{name}-jump")
        labels = materialise(labels.join(shuffled(least), labels.label == least.v, "left").select("node", F.coalesce("m", "label").alias("label")), f"{name}-labels")
        ends = [shuffled(least.select(F.col("v").alias(v), F.col("m").alias(m))) for v, m in (("a", "x"), ("b", "y"))]
        moved = edges.join(ends[0], "a").join(ends[1], "b")
        edges = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
    return labels


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right (None: left itself)."""
    both = left + (right or [])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[place]
    inside = shared[place]
    owner, column = owner[inside], column[inside]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right) if right else len(left)), np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        x = np.zeros((len(both), width), np.float32)
        x[owner[a:b], column[a:b] - k * width] = 1
        out += x[: len(left)] @ (x[len(left) :] if right else x).T
    return out.astype(np.int64)


def verify(table: pa.Table, threshold: float) -> pa.Table:
    """One unit: rows cid, copies, side (0 or 1), grams (bytes of the sorted set), and whether it pairs two parts."""
    rows = table.select(["cid", "copies", "side", "grams"]).to_pylist()
    sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
    crossing = bool(sides[1])
    rows = sides[0] + sides[1]
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    n = len(sides[0])
    common = intersections(sets[:n], sets[n:] if crossing else None)
    size = np.array([len(s) for s in sets])
    union = size[:n, None] + (size[None, n:] if crossing else size[None, :]) - common
    linked = common >= threshold * union - 1e-9
    if not crossing:
        np.fill_diagonal(linked, False)
    copies = np.array([r["copies"] for r in rows])
    links, documents = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    links[:n] = linked.sum(axis=1)
    documents[:n] = linked @ (copies[n:] if crossing else copies)
    if crossing:
        links[n:], documents[n:] = linked.sum(axis=0), linked.T @ copies[:n]
    root = list(range(len(rows)))

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for a in range(n):
        for b in np.flatnonzero(linked[a]).tolist():
            x, y = top(a), top(b + n if crossing else b)
            if x != y:
                root[max(x, y)] = min(x, y)
    some = np.flatnonzero(links).tolist()
    cid = [r["cid"] for r in rows]
    return pa.table({"cid": pa.array([cid[k] for k in some], pa.int64()), "root": pa.array([cid[top(k)] for k in some], pa.int64()), "links": pa.array(links[some], pa.int64()), "documents": pa.array(documents[some], pa.int64())})


def links_of(table: DataFrame, classes: DataFrame, n: int, bands: int, rows: int, threshold: float) -> DataFrame:
    """cid, root, links, documents from every unit of every candidate component."""
    each = classes.select("cid", F.explode("bands").alias("h"))
    buckets = each.groupBy("h").agg(F.min("cid").alias("least"), F.count("*").alias("k")).where("k > 1").select("h", "least")
    labels = components(each.join(shuffled(buckets), "h").select(F.col("cid").alias("a"), F.col("least").alias("b")), "near-candidates")
    members = labels.withColumnRenamed("node", "cid").join(shuffled(classes.select("cid", "row_id", "copies", "grams")), "cid")
    each_part = F.least(F.lit(PART_CLASSES), F.greatest(F.lit(LEAST_CLASSES), F.sqrt(F.count("*"))))
    parts = F.ceil(F.greatest(F.count("*") / each_part, F.sum("grams") / PART_GRAMS)).cast("int")
    sizes = members.groupBy("label").agg(parts.alias("parts"))
    members = materialise(members.drop("grams").join(shuffled(sizes), "label").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")), "near-members")
    texts = listed(table.select("row_id", "text"), members, "row_id", most=SENT_ROWS)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sketcher(n, bands, rows)
        for batch in batches:
            for part, found in text_groups(batch):
                sets = pa.array([tool.grams(t).tobytes() for t in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*carried(part, *names), sets], names=[*names, "grams"])

    names = ["cid", "label", "copies", "parts", "part"]
    sets = map_arrow(texts, [*names, "text"], again, "cid bigint, label bigint, copies bigint, parts int, part int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    units = sets.withColumn("other", other).select(
        "cid", "copies", "grams", "label", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side")
    )
    return units.groupBy("label", "i", "j").applyInArrow(lambda t: verify(t, threshold), "cid bigint, root bigint, links bigint, documents bigint")


def classify(docs: DataFrame, carry: list[str], id_column: str, text: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows (row_id, row, text and more), and row_id, row and RESULT of each."""
    bands = band_count(threshold)
    carry = [c for c in carry if c not in RESULT and c != text]
    source = docs.select(F.struct(*carry).alias("row"), F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    table = materialise(sketch(source, n, bands, ROWS), "near-sketch")
    last = F.struct(F.col("id").isNull().alias("none"), "id", "row_id")
    classes = table.where("cls is not null").groupBy("cls").agg(F.min(last).alias("rep"), F.count("*").alias("copies"), F.max("grams").alias("grams"))
    # The bands of a class are those of its first row: all its rows have the same.
    reps = classes.select("cls", "copies", "grams", F.col("rep.id").alias("id"), F.col("rep.none").alias("none"), F.col("rep.row_id").alias("row_id"))
    classes = materialise(reps.join(shuffled(table.select("row_id", "bands")), "row_id").withColumn("cid", F.col("row_id")), "near-classes")
    units = materialise(links_of(table, classes, n, bands, ROWS, threshold), "near-links")
    labels = components(units.select(F.col("cid").alias("a"), F.col("root").alias("b")), "near-groups")
    counted = units.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    linked = classes.select("cls", "cid", "id", "none", "copies").join(shuffled(counted), "cid", "left").join(shuffled(labels.select(F.col("node").alias("cid"), "label")), "cid", "left").where("copies > 1 or links > 0")
    linked = materialise(linked.withColumn("label", F.coalesce("label", "cid")), "near-linked")
    first = linked.groupBy("label").agg(F.min(F.struct("none", "id", "cid")).alias("first"))
    known = linked.join(shuffled(first), "label").select(
        "cls",
        F.col("first.id").alias("least"),
        F.col("first.cid").alias("keeper"),
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("found"),
        F.coalesce("links", F.lit(0)).alias("links"),
        "copies",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salted = table.select("row", "id", "row_id", "cls").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(shuffled(known), ["cls", "salt"], "left")
    return table, joined.select(
        "row_id",
        "row",
        F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("found", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_text_links"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.coalesce(F.col("keeper") == F.col("row_id"), F.lit(True)).alias("keep"),
    )


def near_duplicates(docs: DataFrame, carry: list[str], id_column: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """carry, class_id, n_links, n_text_links, n_copies and keep of every row of docs."""
    return classify(docs, carry, id_column, text, n, threshold)[1].select("row.*", *RESULT)


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all its columns, with one row of each class of near duplicates; texts aren't shuffled if the list of dropped
    rows is short enough to send."""
    whole = docs.withColumn("_all", F.struct(*(c for c in docs.columns if c != text)))
    table, result = classify(whole, ["_all"], id_column, text, n, threshold)
    gone = materialise(result.where("not keep").select("row_id"), "near-dropped")
    return listed(table, gone, "row_id", "left_anti", SENT_ROWS).select("row._all.*", F.col("text").alias(text)).select(*docs.columns)


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
