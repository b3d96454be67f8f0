"""Language identification by nearest centroid.

Method: the letters of a whole text, in lower case with one space between runs, give 2- and 3-grams hashed into
BUCKETS; log counts times inverse document frequency, scaled to length 1, are compared by cosine with several
centroids for each language (spherical k-means).  The best centroid's language is the prediction.  A text is rejected
if its cosine is under a floor that depends on how many letters it has: FLOOR_SHARE of the least cosine of correctly
labelled sample texts of at most that size class; texts of under FLOOR_LETTERS letters have no floor.

Document frequencies count every training document with a lang and a letter.  Centroids come from a sample: SAMPLE_ROWS in all, shared evenly
among all languages, but CENTROIDS rows of each at least.  A language's rows are those with a letter that have its
least hashes of id and text, so that each language with such a row is in the model, whatever its size.  With more than
SAMPLE_ROWS / CENTROIDS languages each has fewer centroids, and one at least.

A text that is null or has no letter is `und` with score 0 and rejected.  Without any training text all are `und`.
Ties go to the language that sorts first.  Repeated rows count as often as they occur, but are in the sample once;
other columns are carried along, but those with the names of results are left out.  Texts of any length are read whole.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import held_out, map_arrow, read_table, text_groups

BUCKETS = 4096
SAMPLE_ROWS = 4000
CENTROIDS = 4
FLOOR_SHARE = 0.6
FLOOR_LETTERS = 64
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> tuple[np.ndarray, int]:
    """N-gram counts by bucket, and the number of letters."""
    if not text:
        return np.zeros(BUCKETS), 0
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[codes]
    n = int(np.count_nonzero(is_letter))
    if not n:
        return np.zeros(BUCKETS), 0
    codes = np.where(is_letter, codes, 32)
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]
    codes = np.concatenate([np.array([32], np.uint32), codes[kept], np.array([32], np.uint32)])
    two = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(3266489917) + codes[2:] * np.uint32(668265263)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    mixed = np.concatenate([two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(13))]) * np.uint32(2246822519)
    return np.bincount(mixed >> shift, minlength=BUCKETS), n


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # by size class: bits of the number of letters

    def vectors(self, raw: np.ndarray, batch: int = 256) -> np.ndarray:
        """Unit vectors of count rows, in single precision and a batch of rows at a time."""
        out, idf = np.empty(raw.shape, np.float32), self.idf.astype(np.float32)
        for at in range(0, len(raw), batch):
            x = np.log1p(raw[at : at + batch].astype(np.float32)) * idf
            out[at : at + batch] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        both = [counts(t) for t in texts]
        letters = np.array([n for _, n in both])
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(np.array([c for c, _ in both])) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        size = np.minimum([int(n).bit_length() for n in letters], len(self.floors) - 1)
        rejected = (letters == 0) | (score < self.floors[size])
        langs = [self.langs[self.owner[b]] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
        return langs, np.where(letters > 0, score, 0.0), rejected


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the row farthest from those so far."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that have each bucket, and documents in all: partial sums by partition, then one sum by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, texts in text_groups(batch, text):
                for t in texts:
                    raw, letters = counts(t)
                    total += raw > 0
                    n += letters > 0
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, BUCKETS), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["bucket", "n"])

    rows = map_arrow(docs, [text], run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    found = dict(zip(rows["bucket"], rows["n"], strict=True))
    return np.array([found.get(b, 0) for b in range(BUCKETS)], float), found.get(-1, 0)


def at_most(labelled: DataFrame, bars: dict[str, int]) -> DataFrame:
    """Rows whose hash is at most their language's bar, each once."""
    table = labelled.sparkSession.createDataFrame(list(bars.items()), "lang string, bar bigint")
    return labelled.join(F.broadcast(table), "lang").where(F.col("hash") <= F.col("bar")).drop("bar").dropDuplicates(["lang", "hash"])


def least_hashes(labelled: DataFrame, sizes: dict[str, int], share: int) -> DataFrame:
    """The `share` rows of each language with its least hashes, or all its rows.  labelled: lang, text, hash.

    A bar that about twice as many rows pass is set first, and raised where repeated rows leave too few."""
    top = (1 << 63) - 1
    bars, exact = {k: min(top, 2 * share * top // n) for k, n in sizes.items()}, {}
    while bars:
        ranked = at_most(labelled.select("lang", "hash"), bars).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
        found = {r["lang"]: r for r in ranked.where(F.col("rank") <= share).groupBy("lang").agg(F.count("*").alias("n"), F.max("hash").alias("bar")).collect()}
        done = {k for k, bar in bars.items() if bar == top or k in found and found[k]["n"] == share}
        exact |= {k: found[k]["bar"] for k in done if k in found}
        bars = {k: min(top, 64 * bar) for k, bar in bars.items() if k not in done}
    return at_most(labelled, exact)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text, lang; all of them may be learned from."""
    labelled = docs.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("hash"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = max(rows // max(len(sizes), 1), CENTROIDS)
    df, n = document_frequency(labelled)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    picked = least_hashes(labelled, sizes, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in text_groups(batch):
                both = [counts(t) for t in texts]
                raw = [np.minimum(c, 65535).astype(np.uint16).tobytes() for c, _ in both]
                yield pa.RecordBatch.from_arrays([group.column(group.schema.get_field_index("lang")), pa.array(raw, pa.binary()), pa.array([m for _, m in both], pa.int64())], names=["lang", "raw", "letters"])

    got = map_arrow(picked, ["lang", "text"], run, "lang string, raw binary, letters bigint").where("letters > 0").toArrow().to_pydict()
    names = sorted(set(got["lang"]))
    model = Model(names, np.zeros(0, int), np.zeros((0, BUCKETS), np.float32), idf, np.zeros(32))
    if not names:
        return model
    x = model.vectors(np.frombuffer(b"".join(got["raw"]), np.uint16).reshape(-1, BUCKETS))
    lang = np.array([names.index(v) for v in got["lang"]])
    each = max(1, min(CENTROIDS, rows // len(names)))
    parts = [kmeans(x[lang == k], each) for k in range(len(names))]
    model.centroids, model.owner = np.concatenate(parts), np.repeat(np.arange(len(names)), [len(p) for p in parts])
    cosine = x @ model.centroids.T
    best = cosine.argmax(axis=1)
    right = model.owner[best] == lang
    size = np.array([int(m).bit_length() for m in got["letters"]])
    least = 1.0
    for k in range(len(model.floors) - 1, -1, -1):  # from long texts to short ones: the floor never rises as texts get shorter
        here = right & (size == k)
        least = min(least, float(cosine[here, best[here]].min())) if here.any() else least
        model.floors[k] = FLOOR_SHARE * least if k >= FLOOR_LETTERS.bit_length() else 0.0
    model.floors[size.max() + 1 :] = model.floors[size.max()]
    return model


def identify(df: DataFrame, model: Model, text: str = "text", with_text: bool = False) -> DataFrame:
    """df with lang_pred, score and rejected."""
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    keep = [c for c in df.columns if c not in new and (with_text or c != text)]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(k, t) for k, t in new.items())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SAMPLE_ROWS, BUCKETS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_groups(batch, text):
                langs, score, rejected = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[*keep, *new])

    return map_arrow(df, list(dict.fromkeys([*keep, text])), run, schema)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id", 3)))
    return identify(docs.select("doc_id", "text", held_out("doc_id", 3).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
