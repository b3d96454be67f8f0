"""Language-model scoring with a log-bilinear neural model.

Model.  Symbols are the most frequent tokens and, for all other tokens, classes by their last SUFFIX bytes; their number
grows with the corpus (`symbol_bits`).  The symbols at the POSITIONS places before predict the next one (`lbl`).  A token
of a class has the class's probability times its share there; of a class's mass, the share of its tokens seen once is
left to tokens never seen (Good-Turing).  So the probabilities of all known tokens and of unseen tokens by class sum to 1
after any context.

Training is by noise-contrastive estimation in numpy, with sampled noise.  A first model is fitted to about SAMPLE_TOKENS
tokens on the driver, EPOCHS times over.  Then every task goes on from it over all texts of its part of the corpus, and
the tasks' vectors are averaged, each row by how often its symbol occurred in the task: sums of SUM_PARTS models at a time,
so that no task or driver holds more.  What is learned from thus grows with the corpus, as do the token counts.
Scoring: the normalised log-probabilities come from matrix products over batches of places.

Counts of tokens outside the FREQUENT most frequent ones, which are shared with all executors, are joined by token
over a shuffle; no count is left out.  A null text is the empty text: its one token is the end.  Rows are scored one by
one, repeated ids too; a null id is in the training part.  Tokens that tie in count are ordered by their bytes.  Without
training documents all tokens are unknown.  Carried columns with the names of results are left out; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import lbl
from quillon.llm.common import carried, held_out, map_arrow, materialise, read_table, text_groups

FREQUENT = 60_000
#: A longer token is counted and scored like any other, but never held on all executors.
FREQUENT_BYTES = 1024
SUFFIX = 3
#: The least and the most symbols behind the head, as powers of two.
LEAST_BITS, MOST_BITS = 11, 14
#: Tokens that the first model is fitted to; of a text with more than LONG_TOKENS, pieces of PIECE tokens are drawn.
SAMPLE_TOKENS, EPOCHS, LONG_TOKENS, PIECE = 500_000, 6, 65_536, 1024
#: Places in a step of training, on the driver and in tasks; models that are summed up at once.
FIRST_BATCH, TASK_BATCH, SUM_PARTS = 4096, 16_384, 16
#: Distinct tokens that a task counts before it passes the counts on.
HELD = 200_000
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), then the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n over all texts; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pour = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        for batch in batches:
            for _, texts in text_groups(batch):
                for t in texts:
                    seen.update(tokens(t))
                if len(seen) > HELD:
                    yield pour()
                    seen.clear()
        yield pour()

    return map_arrow(docs, ["text"], run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What scoring knows of the corpus: bounded by FREQUENT and the number of symbols."""

    total: int
    distinct: int
    frequent: dict[bytes, int]  # token to place in the arrays
    count: np.ndarray
    symbol: np.ndarray
    suffixes: dict[bytes, int]  # to symbol; any other suffix is the last symbol
    shortlist: int
    mass: np.ndarray  # by symbol: tokens of a class, and those among them seen once
    once: np.ndarray
    base: np.ndarray = field(init=False)
    within: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.base = np.log10((self.count + 0.5) / self.denominator)
        share = np.log10(np.maximum(self.count, 1)) + self.known_share()[self.symbol]
        self.within = np.where(self.symbol < self.shortlist, 0.0, share)

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def unseen(self) -> np.ndarray:
        return (self.once + 0.5) / (self.mass + 1)

    def known_share(self) -> np.ndarray:
        """log10 of the part of a class's probability that a single occurrence of a known token stands for."""
        return np.log10((1 - self.unseen()) / np.maximum(self.mass, 1))

    def symbol_counts(self) -> np.ndarray:
        """Training tokens of each symbol."""
        out = self.mass.copy()
        out[: self.shortlist] = self.count[: self.shortlist] if len(self.frequent) >= self.shortlist else np.pad(self.count[:-1], (0, self.shortlist - len(self.frequent)))
        return out

    def symbol_of(self, token: bytes) -> int:
        return self.suffixes.get(token[-SUFFIX:], len(self.mass) - 1)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places in the arrays (-1: none), symbols, and the words without a place."""
        place = np.fromiter(map(self.frequent.get, words, [-1] * len(words)), np.int64, len(words))
        symbols = self.symbol[place]
        missing = np.flatnonzero(place < 0)
        rest = [words[i] for i in missing.tolist()]
        symbols[missing] = [self.symbol_of(w) for w in rest]
        return place, symbols, rest


def symbol_bits(total: int) -> int:
    """Symbols grow with the square root of the number of tokens."""
    return min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(total, 1)) / 2 - 1)))


def lexicon(counts: DataFrame) -> Lexicon:
    """From token counts; only bounded tables reach the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    symbols = lbl.symbols_for(symbol_bits(total))
    shortlist = lbl.HEAD + 3 * (symbols - lbl.HEAD) // 4
    top = counts.where(F.octet_length("token") <= FREQUENT_BYTES).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow().to_pydict()
    words = sorted(zip(top["token"], top["n"], strict=True), key=lambda x: (-x[1], x[0]))
    words = [x for x in words if x[0] == END] + [x for x in words if x[0] != END]
    short = words[:shortlist]
    listed = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in short], "token binary")
    suffix = F.expr(f"if(octet_length(token) > {SUFFIX}, substring(token, -{SUFFIX}, {SUFFIX}), token)")
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")]
    others = counts.join(F.broadcast(listed), "token", "left_anti")
    best = others.groupBy(suffix.alias("suffix")).agg(*sums).orderBy(F.desc("n"), "suffix").limit(symbols - shortlist - 1).collect()
    rest_n, rest_once = others.agg(*(F.coalesce(c, F.lit(0)) for c in sums)).first()
    mass, once = np.zeros(symbols), np.zeros(symbols)
    suffixes = {}
    for k, r in enumerate(best):
        suffixes[bytes(r["suffix"])] = shortlist + k
        mass[shortlist + k], once[shortlist + k] = r["n"], r["once"]
    mass[-1], once[-1] = rest_n - mass.sum(), rest_once - once.sum()
    symbol = [k if k < len(short) else suffixes.get(w[-SUFFIX:], symbols - 1) for k, (w, _) in enumerate(words)]
    return Lexicon(
        total, distinct, {w: k for k, (w, _) in enumerate(words)}, np.array([n for _, n in words] + [0], float), np.array([*symbol, symbols - 1], np.int64), suffixes, shortlist, mass, once
    )


def group_symbols(lex: Lexicon, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, and how many each has."""
    each = [tokens(t) for t in texts]
    return lex.look_up([w for ws in each for w in ws])[1], np.fromiter(map(len, each), np.int64, len(each))


def sample(docs: DataFrame, known, share: float) -> list[np.ndarray]:
    """Symbols of a share of the texts; of a long text, pieces.  known: broadcast Lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([11, TaskContext.get().partitionId()])
        for batch in batches:
            for _, texts in text_groups(batch):
                symbols, lengths = group_symbols(known.value, texts)
                out = []
                for s in np.split(symbols.astype(np.int32), np.cumsum(lengths)[:-1]):
                    pieces = [s] if len(s) <= LONG_TOKENS else [s[k : k + PIECE] for k in range(0, len(s), PIECE) if rng.random() < LONG_TOKENS / len(s)]
                    out += [p.tobytes() for p in pieces]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["symbols"])

    chosen = docs.where(F.rand(5) < share) if share < 1 else docs
    found = map_arrow(chosen, ["text"], run, "symbols binary").toArrow().column("symbols").to_pylist()
    return [np.frombuffer(x, np.int32) for x in found]


def first_model(texts: list[np.ndarray], counts: np.ndarray) -> tuple[lbl.Model, list[np.ndarray]]:
    """A model fitted to texts of symbols, and the trainer's sums of squares."""
    model = lbl.Model.unigram(counts)
    trainer = lbl.Trainer(model, counts, seed=3)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS if texts else 0):
        mixed = [texts[k] for k in rng.permutation(len(texts)).tolist()]
        trainer.learn(*lbl.pad(np.concatenate(mixed), np.array([len(t) for t in mixed])), FIRST_BATCH)
    return model, trainer.squares


def blocks(model: lbl.Model) -> list[np.ndarray]:
    """The model's rows by what they belong to: symbols, groups and positions."""
    return [np.hstack([model.context, model.target, model.bias[:, None]]), np.hstack([model.group, model.group_bias[:, None]]), model.position]


PARTS = "part int, weights binary, sums binary"


def train_parts(docs: DataFrame, known, start) -> DataFrame:
    """A row for each task: how often each row of the model counts, and its rows times that.  start: broadcast of the
    model and the sums of squares that every task begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, part = known.value, TaskContext.get().partitionId()
        counts, seen = lex.symbol_counts(), np.zeros(len(lex.mass), np.int64)
        model, squares = start.value[0].copy(), [s.copy() for s in start.value[1]]
        trainer = lbl.Trainer(model, counts, seed=100 + part, squares=squares)
        for batch in batches:
            for _, texts in text_groups(batch):
                symbols, lengths = group_symbols(lex, texts)
                seen += np.bincount(symbols, minlength=len(seen))
                trainer.learn(*lbl.pad(symbols, lengths), TASK_BATCH)
        weights = [seen, model.shape.by_group(seen)[0], np.full(lbl.POSITIONS, seen.sum())]
        if seen.any():
            sums = np.concatenate([(w[:, None] * b).reshape(-1) for w, b in zip(weights, blocks(model), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.concatenate(weights).astype(np.float64).tobytes()], pa.binary()), pa.array([sums.astype(np.float32).tobytes()], pa.binary())],
                names=["part", "weights", "sums"],
            )

    return map_arrow(docs, ["text"], run, PARTS)


def add_parts(table: pa.Table) -> pa.Table:
    weights = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("weights"))
    sums = sum(np.frombuffer(x.as_py(), np.float32) for x in table.column("sums"))
    part = table.column("part")[0].as_py() // SUM_PARTS
    return pa.table({"part": pa.array([part], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})


def mean_model(first: lbl.Model, parts: DataFrame) -> lbl.Model:
    """The mean of the tasks' models, row by row; rows that no task counted stay as they are in the first model."""
    parts = materialise(parts, "lm-parts")
    while parts.count() > 1:
        parts = materialise(parts.groupBy((F.col("part") / SUM_PARTS).cast("int").alias("to")).applyInArrow(add_parts, PARTS), "lm-parts")
    rows = parts.collect()
    if not rows:
        return first
    weights, sums = np.frombuffer(rows[0]["weights"], np.float64), np.frombuffer(rows[0]["sums"], np.float32)
    out, at, row = [], 0, 0
    for b in blocks(first):
        w = weights[row : row + len(b), None]
        mean = sums[at : at + b.size].reshape(b.shape) / np.maximum(w, 1)
        out.append(np.where(w > 0, mean, b).astype(np.float32))
        at, row = at + b.size, row + len(b)
    symbols, groups, position = out
    width = lbl.WIDTH
    copy = np.ascontiguousarray
    return lbl.Model(copy(symbols[:, :width]), position, copy(groups[:, :width]), copy(groups[:, width]), copy(symbols[:, width : 2 * width]), copy(symbols[:, -1]))


@dataclass
class Scorer:
    """A fitted model: lexicon and log-bilinear parameters as broadcasts, and the token counts as a table."""

    counts: DataFrame
    lexicon: object
    model: object


def fit(docs: DataFrame) -> Scorer:
    """Learn from all texts of docs."""
    sc = docs.sparkSession.sparkContext
    counts = materialise(token_counts(docs), "lm-counts")
    lex = lexicon(counts)
    known = sc.broadcast(lex)
    first, squares = first_model(sample(docs, known, min(1.0, SAMPLE_TOKENS / max(lex.total, 1))), lex.symbol_counts())
    return Scorer(counts, known, sc.broadcast(mean_model(first, train_parts(docs, known, sc.broadcast((first, squares))))))


def score(docs: DataFrame, fitted: Scorer, carry: list[str]) -> DataFrame:
    """carry, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    A carried column that has the name of one of these is left out."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carry = [c for c in carry if c not in new]
    docs = docs.select(F.struct(*carry).alias("row"), "text")
    known, model = fitted.lexicon, fitted.model
    lex = known.value
    fields = "row_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, tail array<struct<token: binary, symbol: int, n: int>>"
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = known.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, texts in text_groups(batch):
                each = [tokens(t) for t in texts]
                lengths = np.fromiter(map(len, each), np.int64, len(each))
                words = [w for ws in each for w in ws]
                place, symbols, rest = lex.look_up(words)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                found = place >= 0
                flat, real = lbl.pad(symbols, lengths)
                score = model.value.log_probabilities(flat, real)[real] / math.log(10) + np.where(found, lex.within[place], 0.0)
                base = np.where(found, lex.base[place], 0.0)
                bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(~found, starts, dtype=np.int64))])
                own_symbols = symbols[~found]
                flat: list = []
                sizes = []
                for i in range(len(texts)):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    tail = Counter(zip(rest[a:b], own_symbols[a:b].tolist(), strict=True))
                    flat += [(w, s, n) for (w, s), n in tail.items()]
                    sizes.append(len(tail))
                parts = list(zip(*flat, strict=True)) or [(), (), ()]
                structs = pa.StructArray.from_arrays([pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.int32())], names=["token", "symbol", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), structs)
                columns = [
                    *carried(rows, "row"),
                    pa.array(np.arange(row, row + len(texts))),
                    pa.array(lengths),
                    pa.array(np.add.reduceat(found, starts, dtype=np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(score.astype(float), starts)),
                    lists,
                ]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["row", "row_id", "n_tokens", "n_known", "base_score", "score", "tail"])

    partial = materialise(map_arrow(docs, ["row", "text"], run, f"row {kind}, {fields}"), "lm-partial")
    # A row for each symbol, MOST_BITS of them at most.
    shares = zip(range(len(lex.mass)), lex.known_share().tolist(), np.log10(lex.unseen()).tolist())
    shares = docs.sparkSession.createDataFrame(list(shares), "symbol int, share double, unseen double")
    tail = partial.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.*")
    counts = fitted.counts.select("token", F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    rest = (
        tail.join(counts, "token", "left").join(F.broadcast(shares), "symbol")
        .groupBy("row_id")
        .agg(
            F.sum(F.col("n") * F.log10((c + 0.5) / lex.denominator)).alias("more_base"),
            F.sum(F.col("n") * F.when(c > 0, F.log10(c) + F.col("share")).otherwise(F.col("unseen"))).alias("more_score"),
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        )
    )
    joined = partial.drop("tail").join(rest, "row_id", "left")
    more = lambda name: F.coalesce(name, F.lit(0))
    return joined.select(
        "row.*",
        "n_tokens",
        (F.col("n_known") + more("more_known")).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("more_base")).alias("base_score"),
        (F.col("score") + more("more_score")).alias("score"),
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5).alias("held_out"))
    fitted = fit(docs.where(~F.col("held_out")))
    return score(docs, fitted, ["doc_id", "held_out"])
