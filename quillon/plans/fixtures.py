"""Study tables derived from the driver's tables, with the same rules as the SQL in `quillon.plans.fixture_sql`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import MODES, one_line
from quillon.functions.vectors import slices
from quillon.operators.splits import options

CONDITIONS = ("base", "steered")
BRANCHES = [("neutral", ""), *(("pressure", m) for m in MODES), ("natural", ""), ("controlled", "")]
LAYERS, HIDDEN = 4, 16
ALPHA = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_dataset, source_index, question (the whole text, collapsed)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("lang", F.lit(":"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("source_dataset"), F.col("doc_id").alias("source_index"), one_line(F.col("text")).alias("question"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with balanced options; the question column is pruned where it isn't used."""
    return options(questions(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """condition, branch, mode, id, text: an answer text picked by hash for every record, branch and condition."""
    known = known if known is not None else records(spark, sf_dir)
    grid = F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(b).alias("branch"), F.lit(m).alias("mode")) for c in CONDITIONS for b, m in BRANCHES))
    each = known.select("id", "correct_option", "wrong_option", F.explode(grid).alias("g")).select("id", "correct_option", "wrong_option", "g.*")
    h = F.substring(F.sha2(F.concat_ws("|", "condition", "branch", "mode", "id"), 256), 1, 1)
    right, wrong = F.col("correct_option"), F.col("wrong_option")
    text = (
        F.when(h.isin(*"01234567"), right)
        .when(h.isin(*"89ab"), wrong)
        .when(h == "c", F.concat(F.lit(" "), right, F.lit("\n")))
        .when(h == "d", F.concat(wrong, F.lit(".")))
        .when(h == "e", F.lower(right))
        .otherwise("")
    )
    return each.select("condition", "branch", "mode", "id", text.alias("text"))


def gsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, doc_id, answer, response for every order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("n"), (F.col("o_custkey") + 1).cast("string").alias("n1"))
    each = orders.withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    h = F.substring(F.sha2(F.concat_ws("|", "condition", F.col("o_orderkey").cast("string")), 256), 1, 1)
    said = lambda *parts: F.concat(*(F.col(p) if p in ("n", "n1") else F.lit(p) for p in parts))
    response = (
        F.when(h.isin(*"01234"), said("The answer is ", "n", "."))
        .when(h.isin(*"567"), said("We get $", "n", " in all"))
        .when(h.isin(*"89"), said("The answer is ", "n1", ". No, ", "n"))
        .when(h.isin(*"ab"), said("First 12, then the answer is $", "n", ".00."))
        .when(h == "c", F.lit("No number here"))
        .when(h == "d", said("The answer is ", "n"))
        .when(h == "e", said("The answer is ", "n", ",000. Or ", "n", "."))
        .otherwise("")
    )
    return each.select("condition", F.col("o_orderkey").alias("doc_id"), said("It comes to this. #### ", "n").alias("answer"), response.alias("response"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, layer, h, positive, mode: each embedding cut into layers."""
    e = table(spark, sf_dir, "embeddings")
    mode = F.element_at(F.array(*map(F.lit, MODES)), F.col("label") % 3 + 1)
    cut = F.posexplode(slices(F.col("embedding"), HIDDEN, LAYERS)).alias("layer", "h")
    return e.select(F.col("vec_id").alias("item_id"), (F.col("label") % 2 == 1).alias("positive"), mode.alias("mode"), cut)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """context_id, pos, base, steered: ten times the embedding, and that plus a fixed pattern."""
    e = table(spark, sf_dir, "embeddings")
    cut = e.select(F.col("vec_id").alias("context_id"), F.posexplode(slices(F.col("embedding"), HIDDEN, LAYERS)).alias("pos", "h"))
    base = F.transform("h", lambda x: x.cast("double") * 10)
    steered = F.transform("h", lambda x, k: x.cast("double") * 10 + ALPHA * (k % 4 - 1.5))
    return cut.select("context_id", "pos", base.alias("base"), steered.alias("steered"))


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, pos, h, mask: layers as positions, padded on the right."""
    e = table(spark, sf_dir, "embeddings")
    cut = e.select(F.col("vec_id").alias("row_id"), F.posexplode(slices(F.col("embedding"), HIDDEN, LAYERS)).alias("pos", "h"))
    return cut.withColumn("mask", F.col("pos") <= F.col("row_id") % LAYERS)


def direction() -> list[float]:
    """A fixed direction for steering."""
    return [(k % 5 - 2) / 4 for k in range(HIDDEN)]
