"""Personal data: fixed patterns, and identifiers in contexts learned from them.

Base.  E-mail addresses, IP addresses, card numbers and phone numbers by their written forms.

Method: bootstrapped contextual extraction.  Base spans are seed entities.  The two words before an entity, the
word before, the word before with the word after, and the word after are lexical patterns; tokens and adjoining groups
with DIGITS digits or more, or an `@`, outside base spans are candidate instances.  Patterns and instances form a graph, scored in ROUNDS turns: a pattern by the share of its
instances that are believed, an instance by its best pattern (a seed always by 1).  A pattern is accepted if its score
is at least CONFIDENCE, it has SUPPORT or more different instances that are seeds or were found by accepted patterns,
and at least SPECIFIC of all occurrences of its rarest word come with an identifier, so that common words never become
patterns.  What accepted patterns find is believed by their score from then on, and scoring starts again, until no
pattern is added.  Candidates in accepted patterns are added as spans of kind `context`, and so are weak ones, which have no say in the graph: shorter tokens with a digit, and capitals.
Letters in lower case alone are no candidates.  Word counts and the graph
cover all documents.

A null text is the empty text and has no spans; an empty table gives no rows.  Texts of any length are read whole.  Rows are judged one by one, repeated ids
too.  Spans that begin at the same place are in the order of KINDS; an instance that several patterns tie for is one span.
Other columns are carried along, but those with the names of results are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import carried, map_arrow, materialise, read_table, text_groups
from quillon.llm.lm_scoring import token_counts

KINDS = ["email", "ip", "card", "phone", "context"]
ROUNDS, CONFIDENCE, SUPPORT, SPECIFIC = 3, 0.8, 5, 0.5
DIGITS = 4
#: Characters of a group and groups in an identifier at most; characters of a weak candidate at least; letters of capitals
#: before groups at most (longer ones may be an identifier); characters of a part of a word that counts as context.
GROUP, GROUPS, SHORT, CAPITALS, PART = 8, 6, 3, 4, 100
#: Parts into which a pattern's or an instance's edges are dealt when scores are joined to them.
SALTS = 16
# The forms of the contract.  A match can't begin inside a run of digits, as it would begin at the run.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
IDENTIFIER = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*|[\"'(\[{<]*[A-Z]{2,}[\"')\]}>,;:.!?]*(?![^\x20\x09-\x0D]))")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'()[]{}<>,;:.!?*#$%&|="


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address form in one pass: at each @, the run before it and the domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def lower(word: str) -> str:
    """A-Z in lower case, as token counts have them."""
    return word.encode().lower().decode()


def is_word(piece: str) -> bool:
    """False for nothing, punctuation alone, and a part of a word too long to be told from others by its part."""
    return len(piece) <= PART and bool(piece.strip(EDGES))


class Words:
    """The words of a text by place, found when they are first asked for."""

    def __init__(self, text: str):
        self.text, self.ends, self.starts = text, [], []

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """Two words before a span and one behind it, whole; parts of words that the span begins or ends in count too."""
        if not self.starts:
            for m in WORD.finditer(self.text):
                self.starts.append(m.start())
                self.ends.append(m.end())
        text, i = self.text, bisect_right(self.starts, start - 1) - 1
        left: list[str] = []
        if i >= 0 and self.ends[i] > start:
            left += [x for x in [text[max(self.starts[i], start - PART - 1) : start]] if is_word(x)]
            i -= 1
        while i >= 0 and len(left) < 2:
            left.insert(0, text[self.starts[i] : self.ends[i]])
            i -= 1
        j, right = bisect_right(self.ends, end), []
        if j < len(self.starts) and self.starts[j] < end:
            right = [x for x in [text[end : min(self.ends[j], end + PART + 1)]] if is_word(x)]
            j += 1
        if not right and j < len(self.starts):
            right = [text[self.starts[j] : self.ends[j]]]
        return [lower(w) for w in left], [lower(w) for w in right]


def patterns(words: Words, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before it, one, one on each side, and one behind it."""
    left, right = words.around(start, end)
    out = [f"L {left[0]} {left[1]}"] if len(left) == 2 else []
    out += [f"O {left[-1]}"] if left else []
    return out + ([f"B {left[-1]} {right[0]}"] if left and right else []) + ([f"R {right[0]}"] if right else [])


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, strong) of tokens and of adjoining groups outside base spans.

    Groups are tokens of GROUP characters or less with digits, one space apart, after capitals at most; more than GROUPS
    of them in a row are a table, and each is a token by itself.  Strong ones have DIGITS digits or an `@`."""
    run: list[tuple[int, int, bool]] = []  # start, end, whether capitals only
    open_end, k = False, 0

    def spill() -> Iterator[tuple[int, int, bool]]:
        if not run:
            return
        parts = [(run[0][0], run[-1][1])] if 1 < len(run) <= GROUPS and any(not x[2] for x in run) else [x[:2] for x in run]
        for a, b in parts:
            piece = text[a:b]
            digits = sum(c in "0123456789" for c in piece)
            if digits >= DIGITS or "@" in piece[1:-1]:
                yield a, b, True
            elif b - a >= SHORT and (digits or len(piece) > CAPITALS):
                yield a, b, False

    for m in IDENTIFIER.finditer(text):
        word = m.group()
        body = word.lstrip(EDGES)
        a = m.start() + len(word) - len(body)
        b = a + len(body.rstrip(EDGES))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b <= a or any(x < b and y > a for x, y in taken[k : k + 8]):
            continue
        if text[a - 1 : a] == "(" and text[b : b + 1] == ")":
            a, b = a - 1, b + 1
        capitals = not any(c in "0123456789@" for c in text[a:b])
        joins = bool(run) and open_end and a - run[-1][1] == 1 and text[a - 1] == " " and b - a <= GROUP and not capitals and "@" not in text[a:b]
        if not joins:
            yield from spill()
            run.clear()
        run.append((a, b, capitals))
        open_end = b - a <= (CAPITALS if capitals else GROUP) and "@" not in text[a:b]
    yield from spill()


def entities(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, value, patterns, seed, strong) of base spans, and of candidates outside them."""
    words = Words(text)
    out = [(a, b, text[a:b], patterns(words, a, b), True, True) for a, _, b in base]
    if base or IDENTIFIER.search(text):
        taken = sorted((a, b) for a, _, b in base)
        out += [(a, b, text[a:b], patterns(words, a, b), False, strong) for a, b, strong in candidates(text, taken)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """docs: row (a struct) and text.  row, row_id, base spans, and entities with their patterns."""
    fields = "row_id bigint, base array<struct<s: int, k: int, e: int>>, found array<struct<s: int, e: int, value: string, patterns: array<string>, seed: boolean, strong: boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        triple = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        entity = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()), ("strong", pa.bool_())]))
        for batch in batches:
            for rows, texts in text_groups(batch):
                base = [base_spans(t or "") for t in texts]
                found = [entities(t or "", b) for t, b in zip(texts, base, strict=True)]
                as_base = pa.array([[dict(zip("ske", x, strict=True)) for x in b] for b in base], triple)
                names = ("s", "e", "value", "patterns", "seed", "strong")
                as_found = pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], entity)
                yield pa.RecordBatch.from_arrays([*carried(rows, "row"), pa.array(range(row, row + len(texts)), pa.int64()), as_base, as_found], names=["row", "row_id", "base", "found"])
                row += len(texts)

    return map_arrow(docs, ["row", "text"], run, f"row {docs.schema['row'].dataType.simpleString()}, {fields}")


def with_scores(edges: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Edges with their key's score: both sides dealt by key and salt, for a key may have any number of edges."""
    spread = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = "value" if key == "pattern" else "pattern"
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"]).drop("salt")


def accepted_patterns(found: DataFrame, counts: DataFrame) -> DataFrame:
    """pattern, score.  found: row_id, value, pattern, seed of every entity in every pattern; counts: token, n."""
    edges = found.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    # Under SUPPORT values of any kind a pattern can never have SUPPORT believed ones.
    wide = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("occurrences")).where(F.col("values") >= SUPPORT)
    words = wide.select("pattern", "occurrences", F.explode(F.slice(F.split("pattern", " "), 2, 2)).alias("word"))
    words = words.join(counts.select(F.col("token").cast("string").alias("word"), F.col("n").alias("in_all")), "word")
    specific = words.groupBy("pattern", "occurrences").agg(F.min("in_all").alias("least")).where(F.col("occurrences") >= SPECIFIC * F.col("least")).select("pattern")
    edges = materialise(with_scores(edges, specific, "pattern"), "pii-edges")
    sure = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("sure"))
    edges, before = edges.select("pattern", "value"), 0
    while True:
        known = with_scores(edges, sure, "value")
        supported = known.groupBy("pattern").agg(F.count_if(F.col("sure") > 0).alias("support")).where(F.col("support") >= SUPPORT).select("pattern")
        graph = materialise(with_scores(known, supported, "pattern"), "pii-graph")
        believed, scores = graph.groupBy("value").agg(F.max("sure").alias("belief")), None
        for _ in range(ROUNDS):
            scores = with_scores(graph, believed, "value").groupBy("pattern").agg((F.sum("belief") / (F.count("*") + 1)).alias("score"))
            believed = with_scores(graph, scores, "pattern").groupBy("value").agg(F.max(F.greatest("sure", "score")).alias("belief"))
        good = materialise(scores.where(F.col("score") >= CONFIDENCE), "pii-patterns")
        n = good.count()
        if n == before:
            return good
        # Beliefs only rise, so accepted patterns stay accepted, and this ends.
        found_by = with_scores(edges, good, "pattern").groupBy("value").agg(F.max("score").alias("score"))
        sure = materialise(sure.join(found_by, "value", "left").select("value", F.greatest("sure", F.coalesce("score", F.lit(0.0))).alias("sure")), "pii-sure")
        before = n


def find(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry, n_email, n_ip, n_card, n_phone, n_context, base (as text) and spans (as text)."""
    new = ["n_email", "n_ip", "n_card", "n_phone", "n_context", "base", "spans"]
    carry = [c for c in carry if c not in new]
    table = materialise(scan(docs.select(F.struct(*carry).alias("row"), F.col(text).alias("text"))), "pii-scan")
    found = table.select("row_id", F.explode("found").alias("f")).select("row_id", "f.s", "f.e", "f.value", "f.seed", "f.strong", F.explode("f.patterns").alias("pattern"))
    good = accepted_patterns(found.where("strong").select("value", "seed", "pattern"), token_counts(docs.select(F.col(text).alias("text"))))
    fresh = with_scores(found.where("not seed"), good.select("pattern"), "pattern")
    span = F.struct("s", F.lit(len(KINDS) - 1).alias("k"), "e")
    fresh = fresh.groupBy("row_id").agg(F.collect_set(span).alias("fresh"))
    joined = table.drop("found").join(fresh, "row_id", "left")
    kinds = F.array(*map(F.lit, KINDS))
    spell = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")
    fresh = F.coalesce("fresh", F.array().cast("array<struct<s: int, k: int, e: int>>"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return joined.select("row.*", *(count(k).alias(n) for k, n in enumerate(new[:4])), F.size(fresh).cast("long").alias("n_context"), spell(F.col("base")).alias("base"), spell(F.concat("base", fresh)).alias("spans"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, ["doc_id"]).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
