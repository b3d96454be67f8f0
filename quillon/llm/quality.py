"""Quality rules: boosted trees over document statistics, with rules on length and repetition before them.

The trees learn `quality` of labels from a bounded sample of labelled documents (SAMPLE_ROWS at most, those of the least
hashes of the id); every document's statistics come from its whole text.  Constraints: the score never rises with the
shares of repeated words, repeated lines, symbols and capitals.  The bar comes from scores of halves of the sample by
trees fitted to the other half: 0.5, or lower if that would reject more than GOOD_LOSS of the good documents, but not so
low that it would keep more than BAD_KEPT of the bad ones.  Without usable labels of both kinds only the base rules decide.

A null or empty text has no words, and so fails the base rules.  Scores equal to the bar are kept.  Rows keep their
multiplicity and other columns are carried along, but those with the names of results are left out; an empty table gives
no rows.  Texts of any length are counted whole.  Labelled ids with contradictory labels, null ids and null labels teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import gbt
from quillon.llm.common import ASCII_SPACE, map_arrow, read_table, text_groups

SAMPLE_ROWS = 12_000
GOOD_LOSS, BAD_KEPT = 0.002, 0.05
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_shouts"]
#: What the trees see, and which way the score may go as each grows.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "line_words": 0, "distinct": 0, "upper": -1, "digits": 0, "marks": 0, "shouts": 0}
UPPER = {c: None for c in range(65, 91)}


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    width = int(ids.max()) + 1
    if width < 1 << 21:
        key = (ids[:-2] * width + ids[1:-1]) * width + ids[2:]
    else:
        pair = np.unique(ids[:-2] * width + ids[1:-1], return_inverse=True)[1]
        key = pair * width + ids[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[twice + k] = True
    return int(marked.sum())


def statistics(text: str) -> tuple:
    words = text.encode().split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    lower = len(text.translate(UPPER)) if text.isascii() else sum(not c.isupper() for c in text)
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(seen),
        len(text) - lower,
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".,;:!?")),
        text.count("!") + text.count("?"),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """FEATURES from STATS, both as columns."""
    words, chars, symbols, dup, repeat, lines, distinct, upper, digits, marks, shouts = stats.T.astype(float)
    one, per = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack(
        [np.log1p(words), chars / one, symbols / one, dup / np.maximum(lines, 1), repeat / one, words / np.maximum(lines, 1), distinct / one, upper / per, digits / per, marks / one, shouts / one],
        axis=1,
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of STATS in place of the text."""
    keep = [c for c in df.columns if c != text and c not in STATS]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_groups(batch, text):
                found = np.array([statistics(t or "") for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), *(pa.array(c) for c in found.T)], names=[*keep, *STATS])

    return map_arrow(df, [*keep, text], run, schema)


def hash_bar(rows: int, total: int) -> int:
    """The bar that about 0.9 * rows of `total` 63-bit hashes stay under; all of them if there are no more than that."""
    top = (1 << 63) - 1
    return top if 10 * total <= 9 * rows else 9 * rows * top // (10 * total)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of a bounded sample of labelled documents; the sampled ids are few enough to broadcast, by `rows`."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("_most")).where("good = _most").select("doc_id", "good")
    total = known.count()
    hashed = known.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    chosen = hashed.where(F.col("hash") <= hash_bar(rows, total)).orderBy("hash", "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("good", "text")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[gbt.Trees, float]:
    """The trees and the bar that a document's probability of being good must reach."""
    sample = measure(labelled_sample(docs, labels, rows)).limit(2 * rows).toArrow().to_pydict()
    y = np.array(sample["good"], float)
    x = features(np.array([sample[c] for c in STATS], float).T.reshape(-1, len(STATS)))
    order = np.lexsort((*x.T, y))  # the halves don't depend on the order in which rows arrive
    x, y, signs = x[order], y[order], np.array(list(FEATURES.values()))
    trees = gbt.fit(x, y, signs)
    return trees, bar_of(x, y, signs) if len(trees.roots) else 0.0


def bar_of(x: np.ndarray, y: np.ndarray, signs: np.ndarray) -> float:
    """The bar by scores of rows that the trees haven't seen."""
    half, scores = np.arange(len(y)) % 2 == 0, np.empty(len(y))
    for part in (half, ~half):
        other = gbt.fit(x[~part], y[~part], signs)
        scores[part] = other.probability(x[part]) if len(other.roots) else 0.5
    good, bad = np.sort(scores[y > 0]), np.sort(scores[y <= 0])
    least, most = good[int(GOOD_LOSS * len(good))], bad[int((1 - BAD_KEPT) * (len(bad) - 1))]
    return min(0.5, float(max(least, most)))


def judge(df: DataFrame, trees: gbt.Trees, bar: float, text: str = "text", with_text: bool = False) -> DataFrame:
    """df with STATS, quality_score, base_failed and kept."""
    new = [*STATS, "quality_score", "base_failed", "kept"]
    keep = [c for c in df.columns if c not in new and (with_text or c != text)]
    kinds = [*[T.LongType()] * len(STATS), T.DoubleType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([*(df.schema[c] for c in keep), *map(T.StructField, new, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_groups(batch, text):
                stats = np.array([statistics(t or "") for t in texts], np.int64)
                score = trees.probability(features(stats))
                failed = (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > 50 * stats[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(c)) for c in keep), *(pa.array(c) for c in stats.T), pa.array(score), pa.array(failed), pa.array(~failed & (score >= bar))],
                    names=[*keep, *new],
                )

    return map_arrow(df, list(dict.fromkeys([*keep, text])), run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees, bar = train(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, trees, bar).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")
