"""The registered queries of the training-data operators: their SQL, their contracts by hand, and the
pipeline's stages against brute force."""

import collections
import os
import re
import zlib

import pytest
from test_text_operators import base_by_hand, linked

from orbitweave.llm import decontaminate, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = ["documents", "labels", "pages", "benchmark"]


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_toxicity_query(spark, documents):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = queries.op2_crf_toxicity(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.85 * len(held)


def test_quality_query(spark, documents):
    rows = queries.op8_perplexity_quality(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        counts = base_by_hand(documents[r["doc_id"]]["text"] or "")
        assert tuple(r[c] for c in quality.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])
        assert (r["log_ppl"] is None) == r["base_failed"]


def test_sharding_query(spark, documents):
    rows = queries.op10_rendezvous_shards(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    slots = collections.defaultdict(list)
    for r in rows:
        raw = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def without_phrases(text, items):
    """Cut by hand: all words of all phrases at once, until none is left."""
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    fold = {c: c + 32 for c in range(65, 91)}
    phrases = {tuple(w[k : k + 10]) for i in items for w in [re.findall(pattern, i.translate(fold))] if w for k in range(max(1, len(w) - 9))}
    words = re.findall(pattern, text.translate(fold))
    while True:
        hit = set()
        for n in {len(p) for p in phrases}:
            hit |= {k + j for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in phrases for j in range(n)}
        if not hit:
            return words
        words = [w for k, w in enumerate(words) if k not in hit]


def test_pipeline_against_brute_force(spark, documents):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(p.STAGES)
    good = p.written(stage["quality_rules"](spark, docs, DATA), "t")
    verdict = {r["doc_id"]: r["kept"] for r in quality.assess(docs.select("doc_id", "lang", "text")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, k in verdict.items() if k}

    civil = p.written(stage["toxicity"](spark, good, DATA), "t")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    learnt = [r["doc_id"] for r in good.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    model = toxicity.fit(good.where(good.doc_id.isin(learnt)), labels)
    scores = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(good.select("doc_id", "text"), model).collect()}
    assert {r["doc_id"] for r in civil.collect()} == {i for i, s in scores.items() if s < 0.3}

    single = p.written(stage["near_duplicates"](spark, civil, DATA), "t")
    groups = linked([(r["doc_id"], r["text"]) for r in civil.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, first) in groups.items() if i == first}

    clean = p.written(stage["decontamination"](spark, single, DATA), "t")
    items = [r["text"] or "" for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {r["doc_id"]: w for r in single.collect() if (w := without_phrases(r["text"] or "", items)) or not decontaminate.words_of(r["text"] or "")}
    got = {r["doc_id"]: [w.decode() for w in decontaminate.words_of(r["text"] or "")] for r in clean.collect()}
    assert got == want
    packed = stage["packing"](spark, clean, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(got) and all(r["offset"] + r["length"] <= 4096 for r in packed)
