"""Chat formatting, WARC archives, binary codes, the queries and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.sqlcheck import normal, same_as_sql

import corpus_pipeline
from tracewell.llm import chat, hamming, warc
from tracewell.llm._pack import pack, unpack
from tracewell.llm.queries import ORACLE_SQL, QUERIES

LOG = "conv_id long, turn long, seq long, kind string, role string, text string"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], sf_dir)


# chat


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<|b<\\|c<|<|", "\\<|", "plain < | text"])
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n" and "\n" not in chat.escape_role("\n")


def folded(events):
    """Messages by replaying the events one by one."""
    turns: dict[int, list[str]] = {}
    for _, turn, _, kind, role, text in sorted(events, key=lambda e: e[2]):
        role, text = role or "", text or ""
        if kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                del turns[later]
        if kind in ("message", "edit", "regenerate"):
            old = turns.get(turn, ["", ""])
            turns[turn] = [role or old[0], "" if kind == "regenerate" else text]
        else:
            own = turns.setdefault(turn, [role, ""])
            own[1] += text
    return [tuple(turns[t]) for t in sorted(turns)]


def test_events_fold_into_messages(spark):
    rng = random.Random(2)
    events = []
    for conv in range(12):
        seq = 0
        for turn in range(5):
            role = "assistant" if turn % 2 else "user"
            for kind in ["message", *rng.choices(["delta", "delta", "edit", "regenerate"], k=rng.randint(0, 4))]:
                events.append((conv, turn, seq, kind, role, None if kind == "regenerate" else rng.choice(["hi", "<|im_end|>", "", "x\ny"])))
                seq += 1
        events.append((conv, 1, seq, "regenerate", "assistant", None))
        events.append((conv, 1, seq + 1, "delta", "assistant", "again"))
    by = defaultdict(list)
    for e in events:
        by[e[0]].append(e)
    rng.shuffle(events)
    got = defaultdict(list)
    spans = defaultdict(str)
    for r in sorted(chat.render(spark.createDataFrame(events, LOG).repartition(3)).collect(), key=lambda r: (r.conv_id, r.part)):
        got[r.conv_id] += chat.parse(r.formatted)
        spans[r.conv_id] += "".join(chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_starts, r.loss_ends, strict=True))
    assert got == {c: folded(e) for c, e in by.items()}
    assert spans == {c: "".join(t for role, t in folded(e) if role == "assistant") for c, e in by.items()}


def test_parts_of_long_conversations(spark, monkeypatch):
    rows = [(1, t, "assistant", "y" * 50) for t in range(40)] + [(None, 0, None, None), (2, None, "user", "n"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    whole = chat.render(chat.messages(log, ["turn", "role", "text"])).collect()
    assert {r.conv_id: r.n_turns for r in whole} == {1: 40, None: 1, 2: 3}
    monkeypatch.setattr(chat, "PART_CHARS", 200)
    parts = chat.render(chat.messages(log, ["turn", "role", "text"])).where("conv_id = 1").collect()
    assert len(parts) > 5 and "".join(r.formatted for r in sorted(parts, key=lambda r: r.part)) == next(r.formatted for r in whole if r.conv_id == 1)
    assert chat.render(chat.messages(log.limit(0), ["turn", "role", "text"])).count() == 0


# WARC


def test_archives_and_back(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 5}</p>\r\n\r\nWARC/1.1\r\n") for i in range(40)] + [(100, None, None), (101, "u\r\nv", ""), (102, "w", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("offset", F.lit("clash"))
    index = warc.write_archives(pages, "page_id", "url", "html", f"file://{tmp_path}/w")
    got = {r.record_id: r for r in warc.read_records(index).collect()}
    holder = defaultdict(int)
    for i, _, t in rows:
        holder[t or ""] = max(holder[t or ""], i)
    for i, url, t in rows:
        r, raw = got[i], (t or "").encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if holder[t or ""] == i:
            assert r.record_type == "response" and bytes(r.payload) == raw and r.refers_to is None
        else:
            assert r.record_type == "revisit" and bytes(r.payload) == b"" and r.refers_to == holder[t or ""]
        assert r.url == (url or "").replace("\r\n", "%0D%0A")
    some = index.where("record_id in (3, 39, 102)")
    assert {r.record_id for r in warc.read_records(some).collect()} == {3, 39, 102}
    large = warc.write_archives(pages, "page_id", "url", "html", f"file://{tmp_path}/v", min_revisit_bytes=1)
    assert large.where("record_id = 100 and record_type = 'response'").count() == 1
    assert warc.read_records(warc.write_archives(pages.limit(0), "page_id", "url", "html")).count() == 0


@pytest.mark.parametrize("hot", [100, 2])
def test_archives_of_null_ids_and_repeated_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    rows = [(None, "a", "x"), (None, "b", "x"), (5, "c", "y"), (5, "c", "y"), (None, "d", "y"), (3, "e", "y"), (7, "f", None), (8, "g", ""), (9, "h", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    got = sorted((r.url, r.record_id, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in warc.read_records(warc.write_archives(pages, "page_id", "url", "html")).collect())
    assert got == [
        ("a", None, "response", None, "x"), ("b", None, "response", None, "x"), ("c", 5, "response", None, "y"), ("c", 5, "response", None, "y"), ("d", None, "revisit", 5, ""),
        ("e", 3, "revisit", 5, ""), ("f", 7, "revisit", 8, ""), ("g", 8, "response", None, ""), ("h", 9, "response", None, "é" * 300_000),
    ]


def test_warc_query_with_equal_payloads(spark, tmp_path):
    """The query and its SQL over pages of which some are equal."""
    rows = [(i, f"u{i}", None if i % 9 == 0 else f"<p>{i % 4}</p>") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ours, theirs = QUERIES["op8_warc"](spark, str(tmp_path)).toPandas(), con.sql(ORACLE_SQL["op8_warc"]).df()
    assert normal(ours) == normal(theirs) and (ours["record_type"] == "revisit").sum() == 55


def test_runs_join_close_ranges():
    found = list(warc._runs([("a", 0, 10), ("a", 10, 5), ("a", 10**6, 5), ("b", 0, 1)]))
    assert [(f, len(r)) for f, r in found] == [("a", 2), ("a", 1), ("b", 1)]


# binary codes


def brute_force(codes, q, k):
    """``rank, distance, id`` of the k nearest of ``{id: words}``."""
    d = sorted((sum((x ^ y).bit_count() for x, y in zip(c, q, strict=True)), i) for i, c in codes)
    return [(r, *x) for r, x in enumerate(d[:k], 1)]


@pytest.mark.parametrize(("bits", "cell_codes", "cell_queries"), [(64, 100_000, 20_000), (64, 40, 3), (200, 60, 1000), (10, 5, 5)])
def test_nearest_codes_equal_brute_force(spark, bits, cell_codes, cell_queries):
    rng = np.random.default_rng(4)
    words = -(-bits // 64)
    codes = [[int(rng.integers(0, 1 << min(63, bits - 64 * w))) for w in range(words)] for _ in range(500)]
    for i in range(100, 160):
        codes[i] = list(codes[5])
    for i in range(200, 400):  # a crowd that shares most segments
        codes[i] = [codes[200][0] ^ (1 << int(rng.integers(0, min(62, bits)))), *codes[200][1:]]
    codes[7][0] = -(1 << 63) if bits >= 64 else codes[7][0]
    rows = list(enumerate(codes)) + [(None, codes[0]), (9999, None), (3, codes[400])]
    base = spark.createDataFrame(rows, "id long, code array<long>").withColumn("distance", F.lit("clash")).repartition(3)
    got = defaultdict(list)
    for r in hamming.top_k(base, base.where("id % 23 = 0"), 12, bits, cell_codes, cell_queries).collect():
        got[r.query_id].append((r.rank, r.distance, r.found_id))
    unsigned = [(i, [x % (1 << 64) for x in c]) for i, c in rows if i is not None and c is not None]
    for q in range(0, 500, 23):
        assert sorted(got[q]) == brute_force(unsigned, [x % (1 << 64) for x in codes[q]], 12)
    assert len(got) == 22


def test_nearest_of_few_codes(spark):
    base = spark.createDataFrame([(0, [1]), (1, [3]), (2, [-1])], "id long, code array<long>")
    few = hamming.top_k(base, base.where("id = 1"), 10).collect()
    assert [(r.found_id, r.distance) for r in sorted(few, key=lambda r: r.rank)] == [(1, 0), (0, 1), (2, 62)]
    assert hamming.top_k(base.limit(0), base, 3).count() == 0 and hamming.top_k(base, base.limit(0), 3).count() == 0
    twice = base.where("id = 1").unionByName(base.where("id = 1"))
    assert hamming.top_k(base, twice, 2).count() == 4


def test_first_radius_is_below_what_random_codes_need():
    def probability(n, d):
        return n * sum(math.comb(64, i) for i in range(d + 1)) / 2**64

    for n in (1, 500, 50_000, 10**9):
        parts = hamming.widths(64, n)
        start = hamming.first_radius(64, n, 10, parts)
        assert 0 <= start < max(parts)
        assert start == 0 or probability(n, len(parts) * (start + 1) - 1) < 10
    assert hamming.first_radius(64, 10**9, 10, hamming.widths(64, 10**9)) == 2 and hamming.first_radius(10, 3, 1, [5, 5]) == 1


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0] + [-1.0] * 62 + [2.0] + [0.0, 5.0],), ([0.0, 3.0],), ([None, None, 1.0],)], "v array<double>")
    assert [r.c for r in df.select(hamming.sign_code(F.col("v")).alias("c")).collect()] == [[1 - 2**63], [2], [4]]
    assert [r.c for r in df.select(hamming.sign_code(F.col("v"), 66).alias("c")).collect()] == [[1 - 2**63, 2], [2, 0], [4, 0]]
    assert hamming.widths(64, 50_000) == [16] * 4 and sum(hamming.widths(200, 10**9)) == 200


# helpers and the whole


def test_pack_round_trip():
    arrays = [np.arange(1000, dtype=np.uint64), np.empty(0, np.int32), np.array([3], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


def test_pipeline_stages(spark, sf_dir):
    from tracewell.llm._tables import documents, written

    docs = documents(spark, sf_dir)
    first, kept = docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.select("doc_id").distinct().count())
    assert kept[0] >= 0.98 * first and kept[1] <= kept[0] and kept[1] >= 0.8 * first
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packed.select("doc_id").distinct().count() == kept[3]


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(60), "en", "s", 1) for i in range(40)] + [(100, text(6000), "en", "s", 1), (101, None, "en", "s", 1), (102, "", None, None, None), (None, text(50), None, "s", None), (103, text(50), "en", None, 1)]
    rows += [rows[3], rows[3], (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("shard", "score", "rejected", "kept", "taken", "target", "sequence_id", "path", "rep"):
        docs = docs.withColumn(name, F.lit("clash"))
    spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    for found in (docs, docs.limit(0)):
        kept = found
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == corpus_pipeline.COLUMNS
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        ids = {r.doc_id for r in packed}
        assert (set(range(40)) | {100, None, 103} >= ids and len(ids) >= 40) if found is docs else not packed


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """One row of each class stays, the first by id and text, whatever ids its rows share with other classes."""
    text = lambda group, near=0: " ".join([f"{group}{i}" for i in range(60)] + ["near"] * near)
    classes = [
        [(None, text("a")), (1, text("a", 1)), (2, text("a"))],
        [(None, text("b")), (5, text("b", 1))],
        [(1, text("c")), (6, text("c")), (6, text("c", 1))],  # 1 is a duplicate in the first class
        [(7, text("d")), (7, text("d"))],
        [(7, text("e", 1)), (7, text("e"))],
        [(None, "x y")],
        [(None, None)],
        [(8, "")],
        [(8, None)],
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t or "")) for c in classes for i, t in c]
    random.Random(6).shuffle(rows)
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(3), "").collect()
    first = lambda c: min(c, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(map(first, classes), key=str)


def test_predictions_of_held_out_documents(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_langid"](spark, sf_dir).where("held_out").collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
