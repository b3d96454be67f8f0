"""Each operator against brute force, an exact round trip or held-out accuracy; and the edge cases all must meet."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, gbt, langid, lbl, lm_scoring, media, ngram_join, packing, pii, quality, secrets, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor " * 20_000 + "x" * 50_000


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


ODD = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "one", None), (4, "one", None), (None, "a b c d e f g", "en"), (None, None, None), (5, LONG, "en"), (6, "a b c d e f g", "fr"), (7, "Ünï 漢字 🙂", "x")]
OPERATORS = {
    "lm": lambda d: lm_scoring.score(d, lm_scoring.fit(d), ["doc_id", "score", "row_id"]),
    "join": lambda d: ngram_join.near_duplicates(d, ["doc_id", "score", "row_id", "keep"]),
    "quality": lambda d: quality.judge(d.drop("kept"), *quality.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "language": lambda d: langid.identify(d, langid.train(d)),
    "bpe": lambda d: bpe.decode(bpe.encode(d, bpe.default_path()), bpe.default_path()),
    "media": lambda d: media.read(media.store(d)),
    "pii": lambda d: pii.find(d, ["doc_id", "row_id", "base"]),
    "packing": lambda d: packing.pack(d, packing.default_path(), ["doc_id", "ids", "part"]),
    "secrets": lambda d: secrets.find(d, ["doc_id", "row_id", "spans"]),
    "mask": lambda d: secrets.redact(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_empty_long_repeated_and_clashing(spark, name):
    clash = {c: F.lit("mine") for c in ("score", "row_id", "row", "ids", "part", "base", "spans", "keep", "media", "feature", "n", "label", "n_words", "kept")}
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").repartition(3).withColumns(clash)
    out = OPERATORS[name](docs)
    rows = out.select("doc_id").collect()
    assert set(r["doc_id"] for r in rows) == {None, 1, 2, 3, 4, 5, 6, 7}
    if name != "packing":
        assert len(rows) == len(ODD)
    out.write.format("noop").mode("overwrite").save()
    empty = OPERATORS[name](docs.limit(0))
    assert empty.count() == 0
    assert empty.columns == out.columns


def test_lm_scores_match_counting_and_normalise(spark, documents, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    rows = {r["doc_id"]: r for r in lm_scoring.op1_lm_scoring(spark, SF).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""]
    seen = Counter(w for i, t in texts.items() if not held[i] for w in words(t))
    total, distinct = sum(seen.values()), len(seen)
    for i, t in texts.items():
        r, ws = rows[i], words(t)
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in seen for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    better = [rows[i]["score"] > rows[i]["base_score"] for i in texts if held[i]]
    assert np.mean(better) > 0.9


def test_lm_token_probabilities_sum_to_one(spark, documents):
    """After a context: all known tokens, and what each symbol leaves to tokens never seen."""
    fitted = lm_scoring.fit(documents.select("text").limit(60))
    lex, model = fitted.lexicon.value, fitted.model.value
    counts = {bytes(r["token"]): r["n"] for r in fitted.counts.collect()}
    known = lex.known_share()
    within = np.where(np.arange(len(lex.mass)) < lex.shortlist, 0.0, lex.unseen())
    for w, n in counts.items():
        place = lex.frequent.get(w)
        s = lex.symbol[place] if place is not None else lex.symbol_of(w)
        within[s] += 1 if s < lex.shortlist else n * 10.0 ** known[s]
    for context in ([0, 0, 0], [5, 9, 40], [200, 3, 77]):
        flat = np.array([[*context, s] for s in range(len(lex.mass))], np.int32)
        real = np.zeros(flat.shape, bool)
        real[:, 3] = True
        chance = np.exp(model.log_probabilities(flat.reshape(-1), real.reshape(-1)).reshape(-1, 4)[:, 3].astype(float))
        assert abs(chance.sum() - 1) < 1e-4 and abs((chance * within).sum() - 1) < 1e-3


def dense_log_probabilities(m, text):
    """By the definition, place by place."""
    out, before = [], [0, 0, 0]
    for s in text:
        h = sum(m.context[w] * c for w, c in zip(before[::-1], m.position))
        groups = np.exp(m.group @ h + m.group_bias)
        g = int(m.shape.group_of(np.array(s)))
        value = np.log(groups[g] / groups.sum())
        if s >= lbl.HEAD:
            inside = np.exp(m.target[m.shape.rows(g)] @ h + m.bias[m.shape.rows(g)])
            value += np.log(inside[s - m.shape.rows(g).start] / inside.sum())
        out.append(value)
        before = [*before[1:], s]
    return out


def test_lm_products_match_the_definition(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, lbl.symbols_for(8), n) for n in (1, 2, 50, 0, 300)]
    model = lbl.Model.unigram(np.bincount(np.concatenate(texts), minlength=lbl.symbols_for(8)) + 1.0)
    flat, real = lbl.pad(np.concatenate(texts), np.array([len(t) for t in texts]))
    want = np.concatenate([dense_log_probabilities(model, t) for t in texts])
    for window in (7, 64, 10_000):
        assert np.allclose(model.log_probabilities(flat, real, window)[real], want, atol=1e-3)
    model.group *= 1e4  # scores far beyond what single precision can exponentiate
    assert np.isfinite(model.log_probabilities(flat, real)).all()


def test_lm_learns_what_two_words_before_say():
    """The third of three words depends on the first; no context of one word can tell."""
    rng = np.random.default_rng(3)
    symbols = lbl.symbols_for(8)
    made = lambda n: np.concatenate([[a, 9, a + 100, 0] for a in rng.integers(40, 60, n)])
    train, test = made(6000), made(200)
    counts = np.bincount(train, minlength=symbols).astype(float)
    model, _ = lm_scoring.first_model(np.split(train, 100), counts)
    flat, real = lbl.pad(test, np.full(200, 4))
    got = model.log_probabilities(flat, real)[real].reshape(-1, 4)
    assert np.exp(got[:, 2]).mean() > 0.5 and abs(np.exp(got[:, 0]).mean() - 0.05) < 0.02


def test_lm_parts_are_summed_in_steps(spark, documents, monkeypatch):
    docs = documents.select("text").limit(100).repartition(23)
    monkeypatch.setattr(lm_scoring, "SUM_PARTS", 3)
    fitted = lm_scoring.fit(docs)
    known, model = fitted.lexicon, fitted.model.value
    start = spark.sparkContext.broadcast((model, [np.ones(len(a), np.float32) for a in model.arrays()]))
    rows = lm_scoring.materialise(lm_scoring.train_parts(docs, known, start), "parts")
    weights = sum(np.frombuffer(r["weights"], np.float64) for r in rows.collect())
    sums = sum(np.frombuffer(r["sums"], np.float32).astype(float) for r in rows.collect())
    assert (weights[: len(known.value.mass)] == known.value.symbol_counts()).all()
    want = sums[: len(known.value.mass) * 65].reshape(-1, 65)[:, :32] / np.maximum(weights[: len(known.value.mass), None], 1)
    used = weights[: len(known.value.mass)] > 0
    assert np.allclose(lm_scoring.mean_model(model, rows).context[used], want[used], atol=1e-4)


def test_lm_symbols_grow_with_the_corpus():
    bits = [lm_scoring.symbol_bits(2**k) for k in range(50)]
    assert bits == sorted(bits) and bits[0] == lm_scoring.LEAST_BITS and bits[-1] == lm_scoring.MOST_BITS and len(set(bits)) == 4


def jaccard_links(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}


def test_ngram_join_against_all_pairs(spark, texts):
    links = jaccard_links(texts)
    for r in ngram_join.op2_ngram_join(spark, SF).collect():
        group, todo = set(), [r["doc_id"]]
        while todo:
            group |= {v := todo.pop()}
            todo += links[v] - group
        assert (r["n_links"], r["class_id"], r["keep"]) == (len(links[r["doc_id"]]), min(group), min(group) == r["doc_id"])


def test_large_group_is_cut_into_units(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_CLASSES", 7)
    monkeypatch.setattr(ngram_join, "LEAST_CLASSES", 2)
    base = [f"w{k}" for k in range(200)]
    made = {i: " ".join(base[: 3 * i % 150] + [f"own{i}"] + base[3 * i % 150 + 1 :]) for i in range(40)} | {i: made for i, made in ((100, " ".join(base)), (101, " ".join(base)))}
    links = jaccard_links(made)
    docs = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    for r in ngram_join.near_duplicates(docs, ["doc_id"]).collect():
        assert (r["n_links"], r["class_id"]) == (len(links[r["doc_id"]]), 0)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in ngram_join.components(edges, "chain").collect()}
    assert labels == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_band_count_meets_recall():
    n = ngram_join.band_count()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** n >= ngram_join.RECALL > 1 - (1 - 0.8**ngram_join.ROWS) ** (n - 1)


def brute_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:k] for k, x in enumerate(lines)), len(marked)


def test_quality_statistics_and_labels(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in quality.op3_quality(spark, SF).collect():
        stats = brute_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == stats
        assert r["base_failed"] == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r["base_failed"] and r["kept"])
        if not r["base_failed"] and r["doc_id"] in labels:
            assert r["kept"] == bool(labels[r["doc_id"]])


def test_label_sample_has_a_share_at_any_size():
    for total in (0, 5, 10_000, 100_000, 10**9, 5 * 10**10, 10**13):
        bar = quality.hash_bar(12_000, total)
        assert bar == (1 << 63) - 1 if total <= 10_800 else abs(bar / 2**63 * total - 10_800) < 1


def test_quality_on_labels_it_has_not_seen(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    trees, bar = quality.train(docs, labels.where(~held))
    rows = quality.judge(docs.join(labels.where(held), "doc_id"), trees, bar).where("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_quality_bar_is_not_pulled_down_by_wrong_labels():
    rng = np.random.default_rng(3)
    x = rng.random((2000, len(quality.FEATURES)))
    y = (x[:, 1] > 0.3).astype(float)
    y[(y == 0) & (rng.random(2000) < 0.02)] = 1  # junk labelled good
    signs = np.zeros(len(quality.FEATURES))
    fresh = rng.random((4000, len(quality.FEATURES)))
    kept = gbt.fit(x, y, signs).probability(fresh) >= quality.bar_of(x, y, signs)
    good = fresh[:, 1] > 0.3
    assert kept[~good].mean() <= 0.1 and kept[good].mean() >= 0.98


def test_trees_keep_monotone_order():
    rng = np.random.default_rng(1)
    x = rng.random((1200, 2))
    y = ((x[:, 0] + 0.1 * rng.standard_normal(1200)) > 0.5).astype(float)
    trees = gbt.fit(x[:600], y[:600], np.array([1, 0]))
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4)], axis=1)
    assert (np.diff(trees.margin(grid)) >= -1e-12).all()
    assert ((trees.probability(x[600:]) > 0.5) == (y[600:] > 0.5)).mean() > 0.85


def test_language_held_out_accuracy(spark, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = [r for r in langid.op4_langid(spark, SF).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95


def test_language_unknown_and_rejected(spark, documents):
    model = langid.train(documents)
    far = "жзйлщ " * 300
    langs, score, rejected = model.predict([None, "12 34", far, documents.first()["text"]])
    assert langs[:2] == ["und", "und"] and score[0] == 0
    assert rejected.tolist() == [True, True, True, False]


ALPHABET = "ab 'stBÀÉİ\n\t\x1c\x85\xa0éß漢🙂1٣.,-_@́​Σ²½ª<|"


def test_every_language_is_in_the_model(spark, monkeypatch):
    many = spark.createDataFrame([(3 * k + j, f"tok{chr(97 + k % 26)}{chr(97 + k // 26)} " * 3 + f"w{j}", f"l{k}") for k in range(300) for j in range(3)], "doc_id bigint, text string, lang string")
    assert langid.train(many).langs == sorted(f"l{k}" for k in range(300))
    monkeypatch.setattr(langid, "document_frequency", lambda _: (np.ones(langid.BUCKETS), 2))
    hot = spark.range(1_200_000).select(F.col("id").alias("doc_id"), F.lit("many words").alias("text"), F.lit("hot").alias("lang"))
    few = spark.createDataFrame([(-1, "altro testo", "few"), (-2, "12", "none")], hot.schema)
    assert langid.train(hot.union(few), rows=2).langs == ["few", "hot"]


def test_language_sample_has_the_least_hashes(spark):
    docs = spark.range(5000).select((F.col("id") % 700).alias("doc_id"), F.lit("many words").alias("text"), F.when(F.col("id") % 700 < 650, "a").otherwise("b").alias("lang"))
    docs = docs.union(spark.range(4000).select(F.lit(9000).alias("doc_id"), F.lit("copies"), F.lit("c")))
    keyed = docs.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("hash"))
    rows = {(r["lang"], r["hash"]) for r in keyed.collect()}
    want = {x for k in "abc" for x in sorted(x for x in rows if x[0] == k)[:40]}
    got = langid.least_hashes(keyed, {r["lang"]: r["count"] for r in keyed.groupBy("lang").count().collect()}, 40).collect()
    assert sorted((r["lang"], r["hash"]) for r in got) == sorted(want)


def odd_texts(n):
    rnd = random.Random(5)
    fixed = ["", "<|endoftext|>", "a<|endoftext|> b", "x  y", "end ", "It's I'LL don't", "A" * 300, " " * 70 + "z", "0123456789" * 50]
    return fixed + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_bpe_against_the_library(texts):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    mine, library = bpe.RankBpe(path), Tokenizer.from_file(path)
    for t in [*odd_texts(1500), *list(texts.values())[:60]]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode_texts([t])[0].tolist() == ids
        assert mine.decode_ids(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_caches_may_turn_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    small, usual = bpe.RankBpe(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    for t in ["one two three four five", "four five six", "one one two", "seven"]:
        assert small.encode_texts([t])[0].tolist() == usual.encode_texts([t])[0].tolist()


def test_bpe_query_digests(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    for r in bpe.op5_bpe(spark, SF).limit(40).collect():
        t = texts[r["doc_id"]]
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("units", [1, 2, 7, 8, 9, 4096, 4097])
def test_jpeg_round_trip(units):
    raw = np.random.default_rng(units).integers(0, 256, 192 * units, dtype=np.uint8).tobytes()
    [(payload, n, feature)] = media.read_jpegs(media.encode_jpegs([raw], [len(raw) - 5]))
    assert (payload, n) == (raw, len(raw) - 5)
    assert feature.startswith(f"{8 * min(units, 4096)}x")


def test_jpegs_of_a_group_with_runs_and_restart_intervals(monkeypatch):
    rnd = np.random.default_rng(4)
    made = [b"e" * 384, b"\xff" * 192, b" " * 960, bytes([101] * 191 + [7]), b"a" + b"e" * 17 + b"\xe5" * 174, *(rnd.integers(90, 130, 192 * k, dtype=np.uint8).tobytes() for k in range(1, 40))]
    for units in (1, 3, 100):
        monkeypatch.setattr(media, "RESTART", units)
        assert [x[0] for x in media.read_jpegs(media.encode_jpegs(made, [1] * len(made)))] == made


def test_jpeg_damage_is_an_error():
    [whole] = media.encode_jpegs([bytes(range(192)) * 4], [768])
    at = whole.index(b"\xff\xd1")
    for bad in (whole[:at] + whole[at + 2 :], whole[:at] + b"\xff\xd2" + whole[at + 2 :], whole[: at - 40] + whole[at:], b"GIF"):
        with pytest.raises(ValueError):
            media.read_jpegs([bad])


def java_image(spark, width, height, bytes_or_pixels):
    """A file as the JVM's own codec writes it, or the samples it reads, component by component."""
    jvm, io = spark._jvm, spark._jvm.javax.imageio.ImageIO
    if isinstance(bytes_or_pixels, bytes):
        reader = io.getImageReadersByFormatName("jpeg").next()
        reader.setInput(io.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytes_or_pixels)))
        raster = reader.readRaster(0, None)
        band = spark.sparkContext._gateway.new_array(jvm.int, width * height)
        return [np.array(list(raster.getSamples(0, 0, width, height, k, band))).reshape(height, width) for k in range(3)]
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for (y, x), v in np.ndenumerate(bytes_or_pixels):
        image.setRGB(x, y, int(v) * 0x10101)
    out = jvm.java.io.ByteArrayOutputStream()
    assert io.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_foreign_jpeg_thumbnail(spark):
    """Subsampled, without restart markers, other tables, sides that are no multiples of a block."""
    y, x = np.mgrid[0:37, 0:70]
    pixels = 30 + 2 * x + y + 9 * ((x // 3 + y // 5) % 2)
    image = media.parse_markers(java_image(spark, 70, 37, pixels))
    assert len({c[:2] for c in image["components"].values()}) == 2 and image["scans"][0]["restart"] == 0
    small = media.thumbnail(image, media.decode_scans([image])[0]).astype(int)
    means = pixels[:32, :64].reshape(4, 8, 8, 8).mean(axis=(1, 3))
    assert np.abs(small[:4, :8] - means).max() <= 2


def test_own_jpeg_read_by_another_codec(spark):
    raw = (b"eeeeghabcdefgggghfeeeddcba" * 90)[: 192 * 10]
    [whole] = media.encode_jpegs([raw], [len(raw)])
    image = media.parse_markers(whole)
    small = media.thumbnail(image, media.decode_scans([image])[0])
    for band, k in zip(java_image(spark, 80, 8, whole), range(3), strict=True):
        means = band.reshape(1, 8, 10, 8).mean(axis=(1, 3))[0]
        first = np.frombuffer(raw, np.uint8).reshape(10, 3, 64)[:, k, 0].astype(int) - 101
        assert np.abs(means - 128 - first).max() <= 1.5
        assert k or (small[0] == 128 + first).all()


def test_media_query(spark, texts):
    rows = media.op6_media(spark, SF).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        raw_padded = raw + b" " * (-len(raw) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(raw_padded), zlib.crc32(raw_padded[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(raw_padded).hexdigest()
    for r in rows[:60]:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192)
        [whole] = media.encode_jpegs([payload], [len(raw)])
        assert (r["media_bytes"], r["media_sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
        pixels = np.frombuffer(payload, np.uint8)[::192].astype(int) - 101  # the first byte of each unit
        pixels = (np.where(pixels > 127, pixels - 256, pixels) + 128).astype(np.uint8)[None]
        grid = pixels[np.zeros(8, int)][:, np.arange(9) * pixels.shape[1] // 9].astype(int)
        bits = "".join(str(int(b > a)) for line in grid for a, b in zip(line, line[1:]))
        assert r["feature"] == f"{8 * pixels.shape[1]}x8:{int(bits, 2):016x}:{hashlib.sha256(pixels.tobytes()).hexdigest()[:16]}"


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 700
    pages = [(1, "http://a", long), (2, None, long), (3, "http://c d", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 90), (8, "u", "y" * (3 << 20)), (9, "u", "z" * 1200), (9, "u", "z" * 1200)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("extra", F.lit(1))
    folders = warc.write(df, f"file://{tmp_path}/w")
    captures = warc.assemble(warc.read(spark, folders)).collect()
    assert len(captures) == len(pages)
    for c in captures:
        assert c["request"]["kind"] == "request" and c["metadata"]["kind"] == "metadata"
        assert c["request"]["page_id"] == c["response"]["page_id"] == c["metadata"]["page_id"]
    got = sorted(((c["response"]["page_id"], c["response"]["kind"], c["response"]["refers_to"]) for c in captures), key=str)
    kinds = [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (9, "response", None), (None, "revisit", 3)]
    assert got == sorted(kinds, key=str)
    by_id = {c["response"]["page_id"]: c["response"] for c in captures}
    assert bytes(by_id[7]["payload"]).decode() == pages[7][2]
    assert by_id[1]["payload_digest"] == hashlib.sha1(long.encode()).hexdigest() and by_id[1]["payload_bytes"] == 1400
    assert by_id[1]["refers_to_record"] == by_id[3]["record_id"]


def test_warc_without_pages(spark, tmp_path):
    assert warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}/w") == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(v if k % 2 == 0 else (2 * v - 9 * (v > 4)) for k, v in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_against_plain_patterns(texts):
    rnd = random.Random(3)
    odd = ["".join(rnd.choice("ab.@-+ 0123456789()%") for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    for t in [*odd, *texts.values(), "a@b@c.com", "4111 1111 1111 1111", "4111-1111-1111-1111 x"]:
        assert pii.base_spans(t) == brute_pii(t)


def test_pii_learns_contexts(spark):
    seeds = [(k, f"some words then badge number +1 202 555 {1000 + k} and so on") for k in range(30)]
    plain = [(100 + k, f"the year {1900 + k} was long and the day was {2000 + k} too") for k in range(30)]
    docs = spark.createDataFrame([*seeds, *plain, (500, "here badge number QX-77812-Z stands alone")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in pii.find(docs, ["doc_id"]).collect()}
    a = "here badge number ".__len__()
    assert rows[500]["spans"] == f"context:{a}:{a + 10}"
    assert all(rows[i]["spans"] == "" for i, _ in plain)
    assert all(rows[i]["n_phone"] == 1 and rows[i]["n_context"] == 0 for i, _ in seeds)


def test_pii_learns_contexts_from_found_identifiers(spark):
    texts = [f"some words then badge number +1 202 555 {1000 + k} and so on" for k in range(60)]
    texts += [f"here badge number QX-{77000 + k}-Z stands alone" for k in range(30)]
    texts += [f"with employee code QX-{77000 + k}-Z it went" for k in range(30)]  # no base span, all found above
    texts += [f"with employee code RY-{55000 + k} it went" for k in range(3)]
    texts += [f"the year {1900 + k} was long and the day was {2000 + k} too" for k in range(30)]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"]).collect()
    assert {r["doc_id"]: r["n_context"] for r in rows} == {i: int("QX" in t or "RY" in t) for i, t in enumerate(texts)}


def test_pii_single_cue_words_groups_and_short_tokens(spark):
    long = "y" * 150
    texts = [f"was{k} so{k} passport +1 202 555 {1000 + k} then{k} on" for k in range(30)]  # one word stays the same
    texts += [f"was{k} so{k} +1 303 555 {1000 + k} handset on{k}" for k in range(30)]
    texts += [f"so{k} {long} +1 404 555 {1000 + k} end{k}" for k in range(30)]
    new = [("and his passport ", "X1234567", " too"), ("or passport ", "QX 77 812", " here"), ("or passport ", "X12", " here"), ("or passport ", "KLMPQRS", " here"), ("or passport ", "(202) 555-0143", " here")]
    new += [("about ", "B-99 812", " handset was"), (f"with {long} ", "77-812-Z", " was")]
    other = [f"with {'y' * 149} 77-8{k}2-Z was" for k in range(9)]
    texts += [a + x + b for a, x, b in new] + other + ["the year 1999 was long"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"]).collect()
    got = {r["doc_id"]: r["spans"] for r in rows}
    for k, (a, x, _) in enumerate(new):
        assert got[90 + k] == f"context:{len(a)}:{len(a + x)}", x
    assert all(got[90 + len(new) + k] == "" for k in range(len(other) + 1))
    assert list(pii.candidates("1 2 3 4 5 6 7 8 9 1990. 2000 x", [])) == [(18, 22, True), (24, 28, True)]


def test_packing_covers_every_id(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    pieces = packing.op9_packing(spark, SF).collect()
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts, size in [*((v, len(ids[k])) for k, v in by_doc.items()), *((v, None) for v in by_sequence.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == size or size is None and at <= 2048
    assert set(by_doc) == set(ids)
    totals = [sum(n for _, n in v) for v in by_sequence.values()]
    assert all(t & (t - 1) == 0 for t in totals)  # no sequence needs padding


def test_packing_ids_match_the_library(texts):
    from tokenizers import Tokenizer

    path = packing.default_path()
    mine, library = packing.ChunkEncoder(path), Tokenizer.from_file(path)
    for t in [*odd_texts(1500), *list(texts.values())[:60]]:
        assert np.frombuffer(mine.encode_texts([t])[0], mine.dtype).tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_plan_is_feasible():
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(1, 2048, 5000), minlength=2048)
    histogram[700] += 3000
    plan = packing.make_plan(histogram)
    assert (plan.planned <= histogram).all() and plan.planned.sum() > 0
    filled = Counter()
    for length in range(1, 2048):
        for rank in range(int(histogram[length])):
            for sequence, _, size in plan.place(length, rank):
                filled[sequence] += size
    assert all(n <= 2048 for n in filled.values()) and sum(n == 2048 for n in filled.values()) >= len(filled) - 11


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def secret_texts():
    rnd = random.Random(9)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = ["password: token: abcdefgh12", "é🙂 API_KEY = 'abc.def/ghi='", "AKIAAKIA12345678", "AKIASHORT", "a" * 40, "SECRET=x", "passwd=12345678 token=\"zzzzzzzzzz\""]
    out += [f"x token = {pick(alnum, 24)} y {pick('0123456789abcdef', 40)} é AKIA{pick('ABCDEFGH0123', 16)}" for _ in range(40)]
    out += [f"plain {w}_configuration_manager and {w}-container-registry-name or {w}handlerfactory2" for w in ["user", "order", "state", "thread", "window"] * 12]
    return [*out, f"loose {pick(alnum, 40)} end"]


def test_secret_spans_against_plain_patterns(spark, texts):
    made = dict(enumerate([*secret_texts(), *texts.values()]))
    docs = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in secrets.find(docs, ["doc_id"]).collect()}
    for i, t in made.items():
        assert [(x["s"], x["k"], x["e"]) for x in rows[i]["base"]] == brute_secrets(t)
    loose = len(secret_texts()) - 1
    assert [(x["s"], x["k"], x["e"]) for x in rows[loose]["spans"]] == [(6, 3, 46)]
    # The base form, which doesn't try again, has read `token` as the value of the password; the models find the rest.
    assert [(x["s"], x["k"], x["e"]) for x in rows[0]["spans"]] == [(17, 3, 27)]
    # No other text has one, but for a rest of a key in capitals (3), where ordinary runs have hardly any capitals.
    assert {i for i, r in rows.items() if r["n_random"]} - {3} == {0, loose} and sum(r["n_random"] for r in rows.values()) <= 3


def test_secret_runs_of_letters_short_ones_and_rests_of_base_spans(spark):
    rnd = random.Random(4)
    small, mixed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    made = [pick(small, 40) for _ in range(20)] + [pick(mixed, 10) for _ in range(20)] + [pick("0123456789abcdef", 32) + "-" + pick(mixed, 24) for _ in range(20)]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    clean = texts + [f"in 2024-01-{k:02d} at +1 202 555-{1000 + k}, number {10**11 + 7**k}" for k in range(40)]
    # Values for the random sample, and texts without a secret.
    given = [f"password={pick(mixed, 20)}" for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate([f"now {m} then" for m in made] + clean + given)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in secrets.find(docs, ["doc_id"]).collect()}
    caught = [rows[i]["spans"][-1] if rows[i]["n_random"] else None for i in range(len(made))]
    assert all(caught[:20]) and all(caught[40:]) and sum(map(bool, caught[20:40])) >= 10  # of 10 characters, some
    for m, c, i in zip(made, caught, range(len(made))):
        if c:
            assert (c["s"], c["e"]) == (4 + 32 * (i >= 40), 4 + len(m))
    assert sum(rows[len(made) + k]["n_random"] for k in range(len(clean))) == 0
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(masked[i] == ("now [SECRET][SECRET] then" if i >= 40 else "now [SECRET] then") for i, c in enumerate(caught) if c)


def test_secrets_are_masked(spark):
    made = dict(enumerate(secret_texts()))
    docs = spark.createDataFrame([(i, t, "keep") for i, t in made.items()], "doc_id bigint, text string, other string")
    rows = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert rows[1]["text"] == "é🙂 API_KEY = '[SECRET]'"
    assert rows[len(made) - 1]["text"] == "loose [SECRET] end"
    assert rows[0]["text"] in (made[0], "password: token: [SECRET]") and rows[3]["text"] in (made[3], "[SECRET]")
    assert not any(brute_secrets(r["text"]) for r in rows.values())
    assert {r["other"] for r in rows.values()} == {"keep"}


def test_ngram_join_sends_no_growing_table(spark):
    """Tables that grow with the documents are joined over shuffles, however small they are here."""
    from quillon.llm import ngram_join

    docs = spark.createDataFrame([(k, f"a b c d e f g h {k // 2}") for k in range(40)], "doc_id long, text string")
    plan = ngram_join.near_duplicates(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
