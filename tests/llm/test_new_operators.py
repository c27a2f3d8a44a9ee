"""Centroid clustering, token counts and ranked lexical search."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewell.llm import centroids, lexical, tokencount
from tracewell.llm.queries_packing import tokenizer_path
from tracewell.llm.queries_tokens import op12_tokens

# centroid clustering


def lloyd(points: np.ndarray, start: np.ndarray, rounds: int):
    """Plain rounds in Python integers."""
    centres = [list(map(int, c)) for c in start]
    assign = lambda: [min(range(len(centres)), key=lambda j: (sum((int(a) - b) ** 2 for a, b in zip(p, centres[j], strict=True)), j)) for p in points]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            mine = [points[i] for i in range(len(points)) if own[i] == j]
            if mine:
                centres[j] = [sum(int(p[d]) for p in mine) // len(mine) for d in range(points.shape[1])]
    return assign(), centres


def clustered(spark, points, start, rounds, **options):
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, q array<long>").repartition(3)
    return centroids.cluster(rows, start, rounds, **options)


@pytest.mark.parametrize("history_bytes", [1 << 20, 0])
def test_clusters_equal_plain_rounds(spark, history_bytes):
    rng = np.random.default_rng(5)
    middles = rng.integers(-60, 60, (6, 4))
    points = np.concatenate([m + rng.integers(-8, 9, (60, 4)) for m in middles])
    found = clustered(spark, points, points[:6], 9, history_bytes=history_bytes)
    own, centres = lloyd(points, points[:6], 9)
    rows = sorted(map(tuple, found.assigned.select("id", "cluster", "distance").collect()))
    assert found.centroids.tolist() == centres
    assert rows == [(i, own[i], sum((int(a) - b) ** 2 for a, b in zip(points[i], centres[own[i]], strict=True))) for i in range(len(points))]
    assert found.evaluated[0] == 6 * len(points) and found.evaluated[-1] < 6 * len(points) / 2


def test_ties_and_empty_clusters(spark):
    points = np.array([[0, 0], [2, 0], [1, 0], [1, 0], [1, 0]])
    found = clustered(spark, points, np.array([[0, 0], [2, 0], [50, 50], [2, 0]]), 3)
    own, centres = lloyd(points, np.array([[0, 0], [2, 0], [50, 50], [2, 0]]), 3)
    assert sorted((r.id, r.cluster) for r in found.assigned.collect()) == list(enumerate(own))
    assert found.centroids.tolist() == centres and centres[2] == [50, 50]
    about = centroids.with_inertia(found).collect()
    assert {r.inertia for r in about} == {sum(r.distance for r in about)}


def test_displacement_is_measured_at_once():
    """A centroid that moved away and came back loosens nothing; summed drifts would."""
    q = np.array([[0, 0], [100, 0]])
    history = np.array([[[0, 0], [100, 0]], [[40, 0], [100, 0]], [[1, 0], [100, 0]]])
    state = centroids.evaluate_all(q, history[0], 0)
    found = centroids.reassign(q, state, history, 0, -1)
    assert found.evaluated.tolist() == [0, 0] and found.cluster.tolist() == [0, 1]


def test_odd_vectors(spark):
    kept = [float(x) / 8 for x in range(4)]
    rows = [(1, kept), (None, kept), (1, kept), (2, None), (3, kept[:3]), (4, [*kept, 1.0]), (5, [1.0, None, 2.0, 3.0]), (6, [1.0, float("nan"), 2.0, 3.0]), (7, [1.0, float("inf"), 2.0, 3.0]), (8, [])]
    frame = spark.createDataFrame(rows, "id long, q array<double>")
    whole = centroids.whole_vectors(frame, "q", 4, 8)
    assert sorted((r.id or 0, tuple(r.q)) for r in whole.collect()) == [(0, (0, 1, 2, 3)), (1, (0, 1, 2, 3)), (1, (0, 1, 2, 3))]
    start = centroids.first_by_hash(whole, whole["id"].cast("string"), "q", 16)
    assert len(start) == 3
    assert [r.cluster for r in centroids.with_inertia(centroids.cluster(whole, start, 3)).collect()] == [0, 0, 0]
    assert len(centroids.first_by_hash(whole.limit(0), whole["id"].cast("string"), "q", 16)) == 0
    with pytest.raises(Exception, match="or more"):
        clustered(spark, np.array([[1 << 28, 0]]), np.array([[0, 0]]), 1)


# token counts


NASTY = [
    None, "", " \n", "a<|endoftext|>b <|startoftext|><|endoftext|>", "it's WE'RE x y é ́a é", "漢字 12ab ﬁ​foo\u0085bar", "İstanbul ΑΣ",
    "x" * 5000, "<|end oftext|> '́s", "a\x00b\x1cc\x1dd", "'s't 'S don'T 'lL", "\U0001f600\U0001f600", "hello world, " * 3000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_the_library(spark, monkeypatch, name):
    monkeypatch.setattr(tokencount, "SLICE", 4096)
    monkeypatch.setattr(tokencount, "REMEMBERED", 7)
    path = tokenizer_path(name)
    tokenizer = Tokenizer.from_file(path)
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(NASTY * 2)]
    found = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string, slice string").repartition(3), path)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=str)


def test_word_cut_is_tried():
    assert tokencount.Cutter(tokenizer_path()).by_word
    assert not tokencount.Cutter(tokenizer_path("byte_bpe_50k.json")).by_word


def test_token_query_equals_the_library(spark, sf_dir):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sizes = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    found = op12_tokens(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted((r.doc_id, len((r.text or "").encode()), sizes[r.doc_id], sizes[r.doc_id] > 2048) for r in docs)


def test_tokens_of_no_documents(spark):
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


# ranked lexical search


def terms(text: str | None) -> list[str]:
    fold = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    return [fold(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for place, (i, c) in enumerate(own):
            m = 75 + 25 * sum(c.values()) * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, place))
        out += [(item, rank, None if s[1] else s[2], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("slice_bytes", "at_once"), [(600, 200_000), (1 << 20, 40)])
def test_search_equals_brute_force(spark, monkeypatch, slice_bytes, at_once):
    monkeypatch.setattr(lexical, "SLICE", slice_bytes)
    rng = random.Random(11)
    lexicon = [f"W{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)] + ["Été", "été", "x_y", "3a"]
    text = lambda a, b: " ".join(rng.choices(lexicon, k=rng.randint(a, b)))
    docs = [(i // 2, text(0, 60)) for i in range(160)] + [(None, text(5, 60)), (7, None), (8, ""), (9, "-- !"), (3, text(3000, 3000))]
    docs += [(1000 + i, docs[5][1]) for i in range(30)]
    items = [(i, text(1, 25)) for i in range(14)] + [(14, None), (15, "nowhere"), (15, "W1 w1 W1"), (None, "w2")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score long").repartition(3)
    found = lexical.search(frame, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank long"), 20, terms_at_once=at_once)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(docs, items, 20)


def test_search_scores_few_documents():
    """Bounds leave most of a block unseen where a few documents stand out."""
    rng = np.random.default_rng(3)
    corpus = lexical.Corpus(4000, 400_000, np.array([900, 700, 500]))
    lists = [np.sort(rng.choice(4000, 2000, replace=False)) for _ in range(3)]
    tf = [np.where(x < 40, 50, 1) for x in lists]
    gaps = [np.diff(x, prepend=0) for x in lists]
    block = lexical.Block(np.arange(4000), np.full(4000, 100), lexical.pack(np.array([0, 1, 1], np.uint32), np.full(3, 2000, np.uint32)), lexical.pack(np.concatenate(gaps).astype(np.uint32), np.concatenate(tf).astype(np.uint32)), corpus)
    best = lexical.Best(5)
    scored = block.search(np.arange(3), corpus.weights, best)
    dense = np.zeros(4000, np.int64)
    for weight, x, n in zip(corpus.weights, lists, tf, strict=True):
        dense[x] += weight * (10**9 * n // (1000 * n + 1200))
    order = np.lexsort((np.arange(4000), -dense))[:5]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == dense[order].tolist()
    assert scored < 400


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(items.selectExpr("item_id AS doc_id", "text"), items.limit(0)).count() == 0
    assert lexical.search(items.selectExpr("item_id AS doc_id", "text"), items).count() == 1
