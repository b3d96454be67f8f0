"""Secret scans with DataFrame functions alone.

Base.  Assignments to names such as `password`, access keys, and long hexadecimal runs, by their written forms.

Method: two Markov models of characters, one of random strings and one of ordinary identifiers, compared by their log-
likelihood ratio.  Runs of RUN or more characters of ALPHABET, in what base spans leave of a text, are the identifiers of
a corpus.  The labelled samples are: values of base spans (random), and runs with under ORDINARY_DIGITS digits a character
or without letters, as dates and numbers are (ordinary).  Counts of character pairs cover all documents; they are a table of alphabet x alphabet numbers.  The random
model is mixed with equal chances of all characters, and of all characters of the last one's kind (small letters,
capitals, digits), as a secret needn't look like those already known.  A run of any characters is added, as kind `random`,
if its ratio is ODDS or more, so that a short run must differ more at each character than a long one, and if its mean
ratio a character is BAR or more.  Without samples of both labels nothing is added.

Positions come from the gaps between matches: `split` and `regexp_extract_all` see the same leftmost matches, and a
running sum over a text's matches gives code points.  Sums are taken of texts that have a match to report alone.

A null or empty text has no spans; an empty table gives no rows.  Texts of any length are read whole.  Rows are judged one by one, repeated ids too.  Spans
that begin at the same place are in the order of KINDS.  Other columns are carried along, but those with the names of
results are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import listed, materialise, read_table

KINDS = ["assign", "access", "hex", "random"]
# The forms of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KIND_OF = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
RUN = 8
RUNS = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN},}}"
ORDINARY_DIGITS, ODDS, BAR = 0.25, 14.0, 0.4
#: Times that the models are fitted; after the first, runs with a ratio of DOUBT or more are no ordinary ones, as unlabelled
#: secrets would teach the model of ordinary runs what secrets look like.
ROUNDS, DOUBT = 2, 2.0
#: Occurrences that a character's own chance counts for beside those of a pair.
LEAN = 8.0
MASK = "[SECRET]"


def matches(text: Column, kind: int, form: str, group: int, possible: Column) -> Column:
    """kind, whole matches, lengths of the gaps before them, and a group of each; null if `possible` is false."""
    rx = F.lit(form)
    all_of = lambda g: F.regexp_extract_all(text, rx, F.lit(g))
    gaps = F.transform(F.split(text, form, -1), lambda x: F.char_length(x))
    return F.when(possible, F.struct(F.lit(kind).alias("kind"), all_of(0).alias("whole"), gaps.alias("gap"), all_of(group).alias("value")))


def forms(text: Column) -> list[tuple[str, Column]]:
    """The form of each base kind, and a cheap condition that texts without a match mostly fail."""
    small = F.lower(text)
    named = small.contains("passw") | small.contains("secret") | small.contains("token") | small.contains("api")
    return [(ASSIGN, named), (ACCESS, text.contains("AKIA")), (HEX, text.rlike(HEX))]


def replaced(text: Column, kind: int, form: str, possible: Column, fill) -> Column:
    """Text with fill(whole, value) in place of each match of a kind that meets its least length."""
    whole, value = (F.regexp_extract_all(text, F.lit(form), F.lit(g)) for g in (0, 2 * (kind == 0)))
    fills = F.zip_with(whole, value, lambda w, v: F.when(is_long(kind, v), fill(w, v)).otherwise(w))
    parts = F.zip_with(F.split(text, form, -1), fills, lambda g, f: F.array(g, F.coalesce(f, F.lit(""))))
    return F.when(possible, F.array_join(F.flatten(parts), "")).otherwise(text)


def is_long(kind: int, value: Column) -> Column:
    return F.char_length(value) >= [ASSIGN_LEAST, ACCESS_LEAST, 0][kind]


def scan(docs: DataFrame) -> DataFrame:
    """docs: row (a struct) and text.  row, row_id, the matches of each base kind, and the runs in what those leave."""
    text = F.coalesce("text", F.lit(""))
    found = [matches(text, kind, form, 2 * (kind == 0), possible) for kind, (form, possible) in enumerate(forms(text))]
    docs = docs.select("row", F.monotonically_increasing_id().alias("row_id"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"), text.alias("rest"))
    for kind, (form, possible) in enumerate(forms(F.col("rest"))):
        docs = docs.withColumn("rest", replaced(F.col("rest"), kind, form, possible, lambda w, _: F.repeat(F.lit(" "), F.char_length(w))))
    runs = matches(F.col("rest"), len(KINDS) - 1, RUNS, 0, F.lit(True))
    return materialise(docs.select("row", "row_id", "found", runs.alias("runs")), "secrets-scan")


def spans(matched: DataFrame) -> DataFrame:
    """row_id, kind, s, e, value of every match that meets its kind's least length.  matched: row_id and f."""
    by_kind = matched.where(F.size("f.whole") > 0)
    zipped = F.arrays_zip(F.col("f.whole").alias("whole"), F.slice("f.gap", 1, F.size("f.whole")).alias("gap"), F.col("f.value").alias("value"))
    each = by_kind.select("row_id", "f.kind", F.posexplode(zipped).alias("i", "m")).select("row_id", "kind", "i", F.col("m.gap").alias("gap"), F.char_length("m.whole").alias("n"), F.col("m.value").alias("value"))
    until = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(until).cast("int")
    meets = F.when(F.col("kind") == 0, is_long(0, F.col("value"))).when(F.col("kind") == 1, is_long(1, F.col("value"))).otherwise(True)
    return each.select("row_id", "kind", (end - F.col("n")).alias("s"), end.alias("e"), "value").where(meets)


def base_of(table: DataFrame) -> DataFrame:
    return spans(table.select("row_id", F.explode("found").alias("f")))


def digit_share(value: Column) -> Column:
    return 1 - F.char_length(F.translate(value, "0123456789", "")) / F.char_length(value)


def pairs(value: Column) -> Column:
    """Neighbouring characters of a string as an array of two-character strings."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars) - 1
    return F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b))


def ratios(labelled: DataFrame) -> list[float]:
    """log P(b | a; random) - log P(b | a; ordinary) by place(a) * len(ALPHABET) + place(b).  labelled: value, random, n (how often)."""
    size = len(ALPHABET)
    counted = labelled.where(F.char_length("value") > 1).select("random", "n", F.explode(pairs(F.col("value"))).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))
    known = counted.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect()  # 2 * size ** 2 rows at most
    tables = {True: [0.0] * size**2, False: [0.0] * size**2}
    for r in known:
        tables[r["random"]][ALPHABET.index(r["pair"][0]) * size + ALPHABET.index(r["pair"][1])] = r["n"]
    if not all(map(any, tables.values())):
        return [0.0] * size**2
    # A pair's chance leans on that of its second character, so that characters a sample lacks are unlikely there; for two
    # capitals among ordinary runs, on that of the same small letters, as rare words in capitals are words too.
    single = {k: [sum(t[b::size]) for b in range(size)] for k, t in tables.items()}
    single = {k: [(n + 0.5) / (sum(c) + 0.5 * size) for n in c] for k, c in single.items()}
    out, chances = [0.0] * size**2, {}
    for a in sorted(range(size), key=lambda a: ALPHABET[a].isupper()):  # capitals last: they lean on small letters
        for b in range(size):
            place, second = a * size + b, ALPHABET[b]
            both = ALPHABET[a].isupper() and second.isupper()
            like = chances[ALPHABET[a].lower() + second.lower()] if both else single[False][b]
            lean = {True: single[True][b], False: 0.5 * like if ALPHABET[a].isupper() else like}
            chance = {k: (t[place] + LEAN * lean[k]) / (sum(t[a * size : (a + 1) * size]) + LEAN) for k, t in tables.items()}
            chances[ALPHABET[a] + second] = chance[False]
            even = 0.25 / size + sum(0.25 / len(k) for k in KIND_OF if ALPHABET[a] in k and second in k)
            out[place] = math.log(0.5 * chance[True] + even) - math.log(chance[False])
    return out


def total_ratio(value: Column, table: list[float]) -> Column:
    # one literal for the whole table: thousands of them make a plan that is slow to build and to compile
    weights, size = F.split(F.lit(" ".join(map(repr, map(float, table)))), " ").cast("array<double>"), len(ALPHABET)
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.size(codes) - 1
    each = F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.element_at(weights, (a - 1) * size + b))
    return F.aggregate(each, F.lit(0.0), lambda total, x: total + x)


def is_random(value: Column, table: list[float]) -> Column:
    """A run that the models take for random."""
    return total_ratio(value, table) >= F.greatest(F.lit(ODDS), BAR * (F.char_length(value) - 1))


def distinct_runs(table: DataFrame) -> DataFrame:
    """value, n of every run of scanned texts, so that the models look at each once."""
    return materialise(table.select(F.explode("runs.whole").alias("value")).groupBy("value").agg(F.count("*").alias("n")), "secrets-values")


def learn(table: DataFrame, known: DataFrame) -> list[float]:
    """The log ratios of character pairs, from scanned texts and their distinct runs."""
    values = base_of(table).select("value", F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("random"))
    runs = known.where((digit_share(F.col("value")) < ORDINARY_DIGITS) | ~F.col("value").rlike("[A-Za-z]"))
    learned = None
    for _ in range(ROUNDS):
        ordinary = runs if learned is None else runs.where(total_ratio(F.col("value"), learned) < DOUBT)
        learned = ratios(values.unionByName(ordinary.withColumn("random", F.lit(False))))
    return learned


def with_random(table: DataFrame, known: DataFrame, learned: list[float]) -> DataFrame:
    """row_id and runs (as f) of the rows that have a run which the models take for random.

    Lists of 64-bit hashes and of row ids lead there: short ones are sent to all executors, longer ones joined over a
    shuffle.  A row that merely shares a hash has no such run, which the caller sees again."""
    flagged = materialise(known.where(is_random(F.col("value"), learned)).select(F.xxhash64("value").alias("h")), "secrets-random")
    rows = materialise(listed(table.select("row_id", F.explode(F.transform("runs.whole", lambda v: F.xxhash64(v))).alias("h")), flagged, "h", "left_semi").select("row_id").distinct(), "secrets-rows")
    return listed(table.select("row_id", F.col("runs").alias("f")), rows, "row_id", "left_semi")


def find(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry, n_assign, n_access, n_hex, n_random, base and spans (arrays of struct<s, k, e>, sorted)."""
    new = ["n_assign", "n_access", "n_hex", "n_random", "base", "spans"]
    carry = [c for c in carry if c not in new]
    table = scan(docs.select(F.struct(*carry).alias("row"), F.col(text).alias("text")))
    known = distinct_runs(table)
    learned = learn(table, known)
    triple = F.struct("s", F.col("kind").alias("k"), "e")
    base = base_of(table).groupBy("row_id").agg(F.array_sort(F.collect_list(triple)).alias("base"))
    fresh = spans(with_random(table, known, learned)).where(is_random(F.col("value"), learned)).groupBy("row_id").agg(F.collect_list(triple).alias("fresh"))
    joined = table.select("row", "row_id").join(base, "row_id", "left").join(fresh, "row_id", "left")
    none = F.array().cast("array<struct<s: int, k: int, e: int>>")
    joined = joined.select("row", F.coalesce("base", none).alias("base"), F.coalesce("fresh", none).alias("fresh"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return joined.select("row.*", *(count(k).alias(n) for k, n in enumerate(new[:3])), F.size("fresh").cast("long").alias("n_random"), "base", F.array_sort(F.concat("base", "fresh")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with MASK in place of every secret: the value of an assignment, or the whole span otherwise.

    Forms are masked in the order of KINDS, each from the gaps and matches of what the ones before have left."""
    table = scan(docs.select(F.struct(F.lit(0).alias("x")).alias("row"), F.col(text).alias("text")))
    learned = learn(table, distinct_runs(table))
    mask, size = F.lit(MASK), F.char_length
    for kind, (form, possible) in enumerate(forms(F.coalesce(text, F.lit("")))):
        fill = (lambda w, v: F.concat(F.left(w, size(w) - size(v)), mask)) if kind == 0 else (lambda _, __: mask)
        docs = docs.withColumn(text, replaced(F.col(text), kind, form, possible, fill))
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))
    fills = F.transform(runs, lambda w: F.when(is_random(w, learned), mask).otherwise(w))
    parts = F.zip_with(F.split(text, RUNS, -1), fills, lambda g, f: F.array(g, F.coalesce(f, F.lit(""))))
    return docs.withColumn(text, F.when(F.exists(runs, lambda w: is_random(w, learned)), F.array_join(F.flatten(parts), "")).otherwise(F.col(text)))


def spell(column: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, ["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spell("base"), 256).alias("base_sha256"), spell("spans").alias("spans"))
