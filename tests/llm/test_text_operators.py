"""Operators on texts against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import fingerprints, jaccard, langid, mixing, packing, sharding, substrings
from tracewell.llm.queries_packing import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 120, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopéß", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(n)]
    passage = " ".join(rng.choices(words, k=40))
    for k in range(0, n, 7):
        texts[k] = f"{texts[k]}\n{passage}\t{texts[k][:30]}"
    for k in range(5, n, 11):  # near copies: one word changed
        own = texts[k - 1].split(" ")
        own[len(own) // 2] = "changed"
        texts[k] = " ".join(own)
    for k in range(3, n, 10):
        texts[k] = texts[k - 3]
    texts[:6] = ["", "  \t ", "one two", texts[6], "a" * 70_000, "x y z " * 4000]
    rows: list[tuple] = [(i, t, rng.choice(["en", "fr"]), rng.choice(["s1", "s1", "s2", None]), len(t)) for i, t in enumerate(texts)]
    rows.append((n, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated ids and rows, null ids, and columns whose names clash with results."""
    text = " ".join(f"w{i}" for i in range(30))
    data = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, None, None, None), (None, text + " z", "en", "s", 0), (2, text, "en", "s", 0), (2, "other words here", "en", "s", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    for name in ("shard", "slot", "n_words", "kept", "score", "rejected", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# two-pass shuffle


def test_shards_are_even_and_whole(docs, rows):
    got = sharding.two_pass_shuffle(docs, 7, bucket_bytes=50_000).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows] and {r.doc_id: r.text for r in got} == {r[0]: r[1] for r in rows}
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shuffle_depends_on_seed_alone(docs):
    place = lambda df, seed: {r.doc_id: (r.shard, r.slot) for r in sharding.two_pass_shuffle(df, 4, seed).collect()}
    first = place(docs, 1)
    assert first == place(docs.repartition(6, "text"), 1) and first != place(docs, 2)


def test_shuffle_depends_on_no_core_count(docs, monkeypatch):
    from pyspark import SparkContext

    place = lambda: {r.doc_id: (r.shard, r.slot) for r in sharding.two_pass_shuffle(docs, 4, 1).collect()}
    first = place()
    monkeypatch.setattr(SparkContext, "defaultParallelism", property(lambda self: 64))
    assert first == place()
    with pytest.raises(ValueError, match="__bucket"):
        sharding.two_pass_shuffle(docs.withColumn("__bucket", F.lit(1)), 4)


def test_shuffle_of_odd_rows(odd, spark, tmp_path):
    got = sharding.two_pass_shuffle(odd, 2)
    assert got.count() == 6 and got.columns.count("slot") == 1
    sharding.write_shards(got, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
    assert sharding.two_pass_shuffle(odd.limit(0), 2).count() == 0


def test_shard_query_keeps_its_law(spark, sf_dir):
    """Every column of the query over its table."""
    from tracewell.llm.queries_shards import SHARDS, op2_sharding

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, slots = op2_sharding(spark, sf_dir).collect(), defaultdict(list)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


# bottom-k


def test_sketches_are_exact_when_small_and_merge(docs, rows):
    df = fingerprints.with_sketch(docs, "text", "s")
    got = {r.doc_id: r for r in df.select("doc_id", "s", fingerprints.distinct_shingles(F.col("s")).alias("n")).collect()}

    def shingles(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, t, *_ in rows:
        true = shingles(t)
        assert len(got[i].s) == min(len(true), fingerprints.K)
        assert abs(got[i].n - len(true)) <= 0.4 * len(true) + 1e-9
        if len(true) < fingerprints.K:
            assert got[i].n == len(true)
    assert got[6].s == got[3].s and got[0].s == got[120].s == []
    pair = df.where("doc_id in (4, 5, 14)").select("doc_id", "s")
    both = pair.alias("a").join(pair.alias("b"), F.col("a.doc_id") < F.col("b.doc_id"))
    for r in both.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), fingerprints.resemblance(F.col("a.s"), F.col("b.s")).alias("j"), fingerprints.containment(F.col("a.s"), F.col("b.s")).alias("c")).collect():
        a, b = shingles(rows[r.x][1]), shingles(rows[r.y][1])
        assert abs(r.j - len(a & b) / len(a | b)) < 0.15 and abs(r.c - len(a & b) / len(a)) < 0.3


def test_next_document_over_blocks(docs, rows, odd, spark):
    for block_rows in (1000, 30, 2):
        found, following = fingerprints.with_next(docs, block_rows)
        got = {r.doc_id: r.f for r in found.withColumn("f", following("text")).where("tail = 0").collect()}
        texts = [r[1] or "" for r in rows]
        assert got == {i: texts[(i + 1) % len(texts)] for i in range(len(texts))}
        assert found.where("tail = 1").count() == found.select("block").distinct().count()  # one copy a block
    clustered = spark.createDataFrame([(i if i % 3 else i * 10**15, f"t{i}") for i in range(900)], "doc_id long, text string")
    sizes = [r["count"] for r in fingerprints.with_next(clustered, 30)[0].groupBy("block").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 60
    without = spark.createDataFrame([(None, f"t{i}") for i in range(400)] + [(1, "x")], "doc_id long, text string")
    found, following = fingerprints.with_next(without, 20)
    got = found.withColumn("f", following("text")).where("tail = 0").collect()
    assert len(got) == 401 and len({r.f for r in got}) == 401 and len({r.block for r in got}) >= 15
    for block_rows in (1, 1000):
        found, following = fingerprints.with_next(odd, block_rows)
        assert found.withColumn("f", following("text")).where("tail = 0 and f is not null").count() == 6
    assert fingerprints.with_next(odd.limit(0))[0].count() == 0


def bottom_k(text: str) -> list[int]:
    """A text's sketch, shingle by shingle: 64-bit hashes chained from word to word, as signed numbers."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    own = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
    if len(own) >= fingerprints.WIDTH:
        parts = [own[k : k + fingerprints.WIDTH] for k in range(len(own) - fingerprints.WIDTH + 1)]
    else:
        parts = [own] if own else []
    out = set()
    for part in parts:
        h = 42
        for w in part:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        out.add(signed(h))
    return sorted(out)[: fingerprints.K]


def test_fingerprint_query_equals_brute_force(spark, sf_dir):
    """Every column of the query over its table, the last document's successor included."""
    from tracewell.llm.queries_fingerprints import op3_fingerprints

    likeness = lambda a, b: 1.0 if not a and not b else len(set(sorted(set(a) | set(b))[: fingerprints.K]) & set(a) & set(b)) / len(sorted(set(a) | set(b))[: fingerprints.K])
    as_hex = lambda sketch: " ".join(f"{x % (1 << 64):x}" for x in sketch)
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in op3_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for k, (i, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        own, changed, after = map(bottom_k, (text, edited, following))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (as_hex(own), as_hex(changed))
        assert abs(got[i].near_edited - likeness(own, changed)) < 1e-12 and abs(got[i].near_next - likeness(own, after)) < 1e-12


# count-min substring dedup


def removed(rows, width=13):
    order = sorted((r for r in rows), key=lambda r: r[0])
    first, out = {}, {}
    for i, t, *_ in order:
        w = WORD.findall(t or "")
        cover = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first.setdefault(tuple(w[j : j + width]), i) < i:
                cover[j : j + width] = [True] * width
        out[i] = (len(w), sum(cover), " ".join(a for a, c in zip(w, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize(("hot", "most"), [(substrings.HOT, substrings.MOST_HOT), (4, substrings.MOST_HOT), (2, 5)])
def test_substrings_equal_brute_force(docs, rows, monkeypatch, hot, most):
    monkeypatch.setattr(substrings, "MOST_HOT", most)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, hot=hot).collect()}
    assert got == removed(rows)


def test_units_of_null_ids(spark, monkeypatch):
    """Rows of null id and rows of one id are dealt by their texts."""
    monkeypatch.setattr(substrings, "UNIT_BYTES", 4096)
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(20))
    data = [(None if k % 2 else 7, f"{passage} " * (k % 3) + " ".join(f"w{rng.randrange(10**6)}" for _ in range(5)), None, None, 0) for k in range(2000)]
    df = spark.createDataFrame([(-1, passage, None, None, 0), *data], SCHEMA)
    cut = substrings.remove_repeats(df.withColumn("n", F.lit(1)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        used = cut.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(used) == 4 and max(r["count"] for r in used) < 1000
    rows = cut.collect()
    assert len(rows) == 2001 and all(r.kept == r.text.replace(f"{passage} ", "").strip() for r in rows if r.doc_id != -1)
    with pytest.raises(ValueError, match="__unit"):
        substrings.remove_repeats(df.withColumn("__unit", F.lit(1)))


def test_substrings_without_repeats(spark):
    """No window that is estimated to be repeated; then windows that repeat in one document only."""
    rng = random.Random(12)
    data = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(40)), None, None, 0) for i in range(5)]
    got = substrings.remove_repeats(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 5 and all(r.n_words == 40 and r.n_removed == 0 and r.kept == r.text for r in got)
    again = [(i, f"{t} {t}", *rest) for i, t, *rest in data]
    assert all(r.n_words == 80 and r.n_removed == 0 for r in substrings.remove_repeats(spark.createDataFrame(again, SCHEMA)).collect())


def test_substrings_of_odd_rows(odd):
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.text, r.n_words, r.n_removed) for r in substrings.remove_repeats(odd).collect())
    by = {(i, n): r for i, _, n, r in got}
    assert len(got) == 6 and by[1, 30] == 0 and by[2, 30] == 30 and by[2, 3] == 0 and by[99, 30] == 30 and by[99, 31] == 30
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


# chosen-path join


def classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, links = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in ids}


def test_join_equals_brute_force(docs, rows):
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect()} == classes(rows)


def test_join_of_large_groups_in_chunks(spark, monkeypatch):
    """Leaves and groups far beyond a chunk: every link must be counted."""
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard, "LEAF_CHUNK", 32)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    data = []
    for i in range(130):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        data.append((i, " ".join(w), None, None, 0))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == classes(data)


def test_join_of_odd_rows(odd):
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 4), (1, None, 4), (None, None, 4), (None, None, 4), (2, None, 4), (2, 2, 0)], key=str)
    assert jaccard.jaccard_join(odd.limit(0)).count() == 0


def test_runs_reach_the_recall():
    """The chance of a run from the recursion equals that of simulated trees, and depth grows with the sets."""
    assert [jaccard.depth_for(n) for n in (10, 10**5, 10**9)] == [2, 3, 6]
    assert jaccard.runs_for(0.999, 3) > jaccard.runs_for(0.999, 2) > jaccard.runs_for(0.9, 2)
    rng = np.random.default_rng(0)

    def together(agree: int, depth: int) -> bool:
        return depth == 0 or any(together(agree, depth - 1) for _ in range(rng.binomial(agree, 1 / (0.8 * jaccard.POSITIONS))))

    missed = 0.0
    for _ in range(400):
        agree = rng.binomial(jaccard.POSITIONS, 0.8)
        missed += not any(together(agree, 2) for _ in range(jaccard.runs_for(0.9, 2)))
    assert missed / 400 < 0.15


def test_recall_of_pairs_at_the_threshold(spark):
    """Lone pairs whose similarity is just the threshold, among many unrelated texts that fill large buckets."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    data, pairs = [], 150
    for k in range(pairs):
        own = [word() for _ in range(184)]  # 180 shingles; 20 new ones at the end leave 160 of 200 in common
        data += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:164] + [word() for _ in range(20)]))]
    data += [(10_000 + k, " ".join(word() for _ in range(60))) for k in range(300)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1] == (2 * k, 1) for k in range(pairs))
    assert found >= pairs - 2 and all(got[10_000 + k] == (10_000 + k, 0) for k in range(300))


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 200)], "path long, rep long")
    sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("path <> 7")
    for keys in (1, 10_000):
        monkeypatch.setattr(jaccard, "HOT_KEYS", keys)
        got = sorted(tuple(r) for r in jaccard.skew_join(rows, sizes, "path", 699).select("path", "rep", "n").collect())
        assert got == sorted([(0, i, 500) for i in range(500)] + [(k, k, 1) for k in range(1, 200) if k != 7])


# Kneser-Ney


def english_and_vowels(n=160):
    rng = random.Random(1)
    make = {"en": ["the", "of", "and", "thing", "ing", "sh"], "xx": ["oua", "eau", "ie", "que", "les", "vi"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(make))
        text = " ".join("".join(rng.choices(make[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 40)))
        rows.append((i, text, lang, None, 0))
    return rows


def test_languages_of_new_texts(spark):
    rows = english_and_vowels()
    models = langid.train_models(spark.createDataFrame(rows[:120], SCHEMA))
    odd = [(900, None, None, None, 0), (901, "123 ... !!", None, None, 0), (902, "Q" * 5000 + " zxqj kwvx", None, None, 0), (903, "theé", None, None, 0)]
    df = spark.createDataFrame(rows[120:] + odd, SCHEMA).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.predict(df, models).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected and 0.5 <= got[i].score <= 1 for i, _, lang, *_ in rows[120:])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[900].rejected and got[900].cross_entropy is None
    assert got[902].rejected and not got[903].rejected


def test_models_keep_all_ngrams(spark):
    """More n-grams than any bound on a model: none is lost, and all figures come from the full counts."""
    rng = random.Random(8)
    words = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(8)) for _ in range(44_000)]
    rows = [(k, " ".join(words[k : k + 400]), "zz", None, 0) for k in range(0, len(words), 400)] + english_and_vowels(40)
    train = spark.createDataFrame(rows, SCHEMA)
    models = langid.train_models(train)
    counts = Counter()
    for r in train.where(F.pmod(F.xxhash64("text"), F.lit(10)) != 0).collect():
        for w in r.text.split():
            s = langid.START * (langid.ORDER - 1) + w + langid.END
            counts.update((r.lang, s[k : k + langid.ORDER]) for k in range(len(s) - langid.ORDER + 1))
    assert len(counts) > 310_000
    whole = langid.build_models([(name, gram, n) for (name, gram), n in counts.items()])
    assert models.langs == whole.langs and models.floor == whole.floor
    for table in langid.TABLES:
        for ours, theirs in zip(getattr(models, table), getattr(whole, table), strict=True):
            assert ours.shape == theirs.shape and (ours == theirs).all() if ours.dtype == np.uint64 else np.allclose(ours, theirs, atol=1e-7)


def slow_cross_entropy(words: list[str], counts: Counter, floor: float) -> float:
    """Interpolated Kneser-Ney, character by character, straight from its formula; ``counts`` of the longest n-grams."""
    levels = {langid.ORDER: dict(counts)}
    for n in range(langid.ORDER - 1, 0, -1):
        levels[n] = dict(Counter(g[1:] for g in levels[n + 1]))  # how many characters precede each
    discounts = {}
    for n, own in levels.items():
        ones, twos = (sum(c == t for c in own.values()) for t in (1, 2))
        discounts[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def probability(context: str, char: str) -> float:
        n = len(context) + 1
        lower = probability(context[1:], char) if n > 1 else floor
        after = [c for g, c in levels[n].items() if g[:-1] == context]
        if not after:
            return lower
        return max(levels[n].get(context + char, 0) - discounts[n], 0) / sum(after) + discounts[n] * len(after) / sum(after) * lower

    total = chars = 0
    for w in words:
        s = langid.START * (langid.ORDER - 1) + w + langid.END
        for k in range(langid.ORDER - 1, len(s)):
            total -= math.log(probability(s[k - langid.ORDER + 1 : k], s[k]))
            chars += 1
    return total / chars


def test_cross_entropies_equal_slow_kneser_ney(spark):
    rows = english_and_vowels(70)
    train = spark.createDataFrame(rows[:60], SCHEMA)
    models = langid.train_models(train)
    counts: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang, *_ in train.where(F.pmod(F.xxhash64("text"), F.lit(10)) != 0).collect():
        for w in text.split():
            s = langid.START * (langid.ORDER - 1) + w + langid.END
            counts[lang].update(s[k : k + langid.ORDER] for k in range(len(s) - langid.ORDER + 1))
    floor = 1 / (len({g[-1] for own in counts.values() for g in own}) + 1)
    texts = [r[1] for r in rows[60:66]] + ["zq zq", "the Oua"]
    found, _ = models.cross_entropies(pa.array(texts))
    for text, row in zip(texts, found, strict=True):
        assert np.allclose(row, [slow_cross_entropy(text.lower().split(), counts[lang], floor) for lang in models.langs], rtol=1e-6, atol=1e-6)


def test_sixty_languages(spark, monkeypatch):
    """Languages that share most n-grams, in parts of a few words; each text against the model of its language alone."""
    monkeypatch.setattr(langid, "CELLS", 2000)
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrst"
    own = {f"l{k:02}": ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(25)] for k in range(60)}
    data = [(i, " ".join(rng.choices(own[name], k=60)), name, None, 0) for i, name in enumerate(name for name in own for _ in range(12))]
    train = spark.createDataFrame([d for d in data if d[0] % 12], SCHEMA)
    models = langid.train_models(train)
    assert models.langs == sorted(own) and all(len(x) < 60 * len(np.unique(x)) / 4 for x in models.grams[2:])  # entries, not columns
    test = [d for d in data if d[0] % 12 == 0]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(test, SCHEMA), models).collect()}
    assert got == {d[0]: d[2] for d in test}
    whole, n = models.cross_entropies(pa.array([d[1] for d in test]))
    monkeypatch.setattr(langid, "CELLS", 1 << 30)
    again, m = models.cross_entropies(pa.array([d[1] for d in test]))
    assert np.allclose(whole, again, rtol=1e-9) and (n == m).all()


def test_language_of_few_texts_is_learned(spark):
    """A language whose only text calibrates is counted, too."""
    rows = english_and_vowels(60)
    for k in range(200):
        text = " ".join(f"zu{'wxk'[(k + j) % 3]}o" for j in range(20)) + f" q{'a' * (k % 50)}{'b' * (k // 50)}"
        rare = spark.createDataFrame([(1000, text, "rare", None, 0)], SCHEMA)
        if rare.where(F.pmod(F.xxhash64("text"), F.lit(10)) == 0).count():
            break
    models = langid.train_models(spark.createDataFrame(rows, SCHEMA).unionByName(rare))
    got = {r.doc_id: r for r in langid.predict(rare, models).collect()}
    assert got[1000].lang_pred == "rare" and not got[1000].rejected


def test_model_is_a_distribution():
    """After each context the probabilities of all characters, and what is kept for unknown ones, add up to 1."""
    grams = Counter()
    for w in ["the", "then", "that", "thin", "a"]:
        s = langid.START * (langid.ORDER - 1) + w + langid.END
        grams.update(s[k : k + langid.ORDER] for k in range(len(s) - langid.ORDER + 1))
    models = langid.build_models([("en", g, n) for g, n in grams.items()])
    known = sorted({g[-1] for g in grams})
    for prefix in ("", "t", "th", "tha", "xyz"):
        points = np.array([[ord(c) for c in langid.START * (langid.ORDER - 1) + prefix + end] for end in [*known, "?"]], np.uint64)
        places = np.arange(1, len(points) + 1) * points.shape[1] - 1
        assert abs(models.character_probabilities(points.ravel(), places).sum() - 1) < 1e-5


def test_langid_without_training_rows(spark, odd):
    models = langid.train_models(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, models).collect()} == {"und"}
    assert langid.predict(odd.limit(0), langid.train_models(odd)).count() == 0


# Efraimidis-Spirakis


def test_targets():
    assert mixing.targets_of([10, 10, 100], [1, 2, 3], 120, 3) == [22.5, 30.0, 67.5]  # 20, 40, 60; 10 too many go 1 to 3
    assert mixing.targets_of([0, 5], [1, 1], 100, 3) == [0.0, 15.0] and mixing.targets_of([], [], 0, 3) == []


def test_mix_meets_its_targets(docs, rows, spark):
    quality = spark.createDataFrame([(i, 2.0) for i in range(0, 120, 2)] + [(4, 1.0)], "doc_id long, weight double")
    got = mixing.mix(docs, (1, 2, 3), quality, cells=8).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert {r.doc_id: r["size"] for r in got} == sizes and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == sum(r["size"] for r in own)
    again = mixing.mix(docs.repartition(5), (1, 2, 3), quality, cells=4096).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    words = mixing.apply_mix(docs, spark.createDataFrame(got)).select(F.sum(mixing.word_count("text"))).first()[0]
    assert words == sum(r.taken for r in got)


def test_mix_prefers_good_documents(spark):
    data = [(i, "w " * 10, None, "a", 0) for i in range(400)] + [(1000, "w " * 12000, None, "b", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    quality = spark.createDataFrame([(i, 8.0) for i in range(200)], "doc_id long, weight double")
    taken = {r.doc_id: r.taken for r in mixing.mix(df, (1, 9), quality, budget=20_000, max_epochs=3).collect()}
    assert sum(taken[i] for i in range(200)) > 2 * sum(taken[i] for i in range(200, 400))


@pytest.mark.parametrize("cell_rows", [3, mixing.CELL_ROWS])
def test_mix_of_unequal_weights(spark, monkeypatch, cell_rows):
    """Weights of one and of a million, in one source and between sources, against sorting all keys."""
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    rng = random.Random(8)
    weight = {i: [1e-6, 1.0, 1e6][i % 3] if i < 300 else 1e6 for i in range(600)}
    size = {i: rng.randint(0, 9) for i in weight}
    source = {i: "mixed" if i < 300 else "heavy" for i in weight}
    df = spark.createDataFrame([(i, "w " * size[i], None, source[i], 0) for i in weight], SCHEMA)
    quality = spark.createDataFrame(list(weight.items()), "doc_id long, weight double")
    got = {r.doc_id: r for r in mixing.mix(df, (1, 1), quality, budget=1000, cells=16).collect()}
    for name in ("mixed", "heavy"):
        own = [i for i in weight if source[i] == name]
        total = sum(size[i] for i in own)
        key = {}
        for i in own:
            word = hashlib.md5(f"{i}|{hashlib.md5(('w ' * size[i]).encode()).hexdigest()}|29".encode()).hexdigest()[:13]
            key[i] = -math.log((int(word, 16) + 0.5) / 2**52) / weight[i]
        epochs, rest = divmod(500, total)
        for i in sorted(own, key=lambda i: (key[i], i)):
            part = min(rest, size[i])
            rest -= part
            assert got[i].taken == epochs * size[i] + part


def test_mix_takes_a_whole_source(spark):
    """A target within half a word of a whole epoch is that epoch."""
    df = spark.createDataFrame([(i, "w " * 5, None, "a", 0) for i in range(9)], SCHEMA)
    assert [r.taken for r in mixing.mix(df, (1,), budget=44.7).collect()] == [5] * 9


def test_mix_of_odd_rows(odd):
    got = mixing.mix(odd)
    assert got.count() == 6 and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.apply_mix(odd, got).count() >= 1


# cutting stock


def test_packing_is_whole_and_tight(docs, rows):
    pieces = packing.cut_pieces(docs, tokenizer_path(), length=512, with_ids=True)
    packed = packing.pack(pieces.drop("ids"), length=512, units=64).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    true = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        ids = true[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(true[r.doc_id])
    for i, own in by_doc.items():
        assert sum(r.length for r in own) == len(true[i]) and sorted(r.start for r in own) == [512 * k for k in range(len(own))]
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 512
    total = sum(map(len, true.values()))
    assert set(by_doc) == set(true) and len(by_sequence) <= 1.06 * total / 512 + 2
    whole = packing.sequences(packing.pack(pieces.drop("ids"), 512, 64), pieces, 512).collect()
    assert all(len(r.input_ids) == 512 for r in whole) and len(whole) == len(by_sequence)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_have_the_ids_of_whole_texts(spark, docs, rows, name):
    """Also by a tokenizer that keeps white space, whose texts can't be cut at it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    assert packing.WordTokens(tokenizer_path(name)).by_word == name.startswith("word")
    got = defaultdict(list)
    for r in sorted(packing.cut_pieces(docs, tokenizer_path(name), length=512, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += r.ids
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t, *_ in rows}


def test_cutting_stock_covers_all():
    rng = np.random.default_rng(0)
    for counts in (rng.integers(0, 50, 32), np.zeros(16, int), np.eye(1, 16, 15, dtype=int)[0] * 7):
        used = packing.cutting_stock(counts)
        assert (sum((n * u for n, u in used), np.zeros(len(counts), int)) == counts).all()
        assert all((u * np.arange(1, len(u) + 1)).sum() <= len(u) for _, u in used)
    counts = np.zeros(100, int)
    counts[[44, 34, 19]] = 97, 610, 395  # 45, 35, 20 of 100
    assert sum(n for n, _ in packing.cutting_stock(counts)) == 362  # 97 of 45+35+20, 256.5 of 35+35+20, 8.3 of 5 x 20


def test_packing_of_odd_rows(odd):
    pieces = packing.cut_pieces(odd, tokenizer_path())
    assert packing.pack(pieces).count() == 6 and packing.pack(packing.cut_pieces(odd.limit(0), tokenizer_path())).count() == 0


@pytest.mark.parametrize("longest", [packing.LONGEST, 2])
def test_word_memory_is_bounded(monkeypatch, longest):
    """Words come back with their own ids, whatever was forgotten, and also words that hold the mark."""
    monkeypatch.setattr(packing, "REMEMBERED", 4)
    monkeypatch.setattr(packing, "LONGEST", longest)
    monkeypatch.setattr(packing, "ENCODE_WORDS", 3)
    tokens = packing.WordTokens(tokenizer_path())
    assert tokens.mark is not None
    for words in (["a", "hello"], ["world", "a", "again", "hello,", "x\x01y", "\x01"], ["hello,", "again", "a", "it's", "\u0301e", "12ab"], ["a"], []):
        ids, starts, lengths = tokens.encode(pa.array(words, pa.large_string()))
        for w, s, n in zip(words, starts, lengths, strict=True):
            assert ids[s : s + n].tolist() == tokens.tokenizer.encode(w, add_special_tokens=False).ids
        assert len(tokens.first) <= 4 and (np.diff(tokens.first.astype(float)) >= 0).all()


def test_cutting_stock_ends_beside_a_session(spark):
    """250 length classes: the driver's solve must not wait for threads of a linear algebra library."""
    assert spark.range(3).count() == 3
    counts = np.random.default_rng(3).integers(1, 400, 256)
    used = packing.cutting_stock(counts)
    assert (sum(n * u for n, u in used) == counts).all() and sum(n for n, _ in used) <= 1.06 * (counts * np.arange(1, 257)).sum() / 256
    singular = np.array([[1.0, 2.0], [2.0, 4.0]])
    assert packing.inverted(singular, np.eye(2)) is not None and np.allclose(packing.inverted(np.array([[0.0, 2.0], [4.0, 0.0]]), np.eye(2)), [[0, 0.25], [0.5, 0]])


def test_short_documents_fill_sequences(spark):
    """Documents of a few tokens share bundles, so that little of a sequence is padding."""
    data = [(i, "one two three"[: 3 + i % 11], None, None, 0) for i in range(6000)] + [(-1, None, None, None, 0)] * 5
    packed = packing.pack(packing.cut_pieces(spark.createDataFrame(data, SCHEMA), tokenizer_path())).collect()
    assert len(packed) == len(data)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(by) <= 1.08 * sum(r.length for r in packed) / 4096 + 2


def test_packing_query_is_whole(spark, sf_dir):
    """The query over its table: every id of every document in one place, and ids as the tokenizer gives them."""
    from tokenizers import Tokenizer

    from tracewell.llm.queries_packing import op9_packing

    tokenizer = Tokenizer.from_file(tokenizer_path())
    true = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, places = op9_packing(spark, sf_dir).collect(), defaultdict(list)
    covered = Counter()
    for r in rows:
        ids = true[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(true[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(covered.values()) == {1} and len(covered) == sum(map(len, true.values()))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 4096
    assert len(places) <= 1.06 * len(covered) / 4096 + 2
