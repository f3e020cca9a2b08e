"""Sharding, mixing and the pipeline."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motorlot.llm import decontamination, mixing, quality, sharding
import plain


def test_shards_hold_every_row_once(make_docs):
    rows = [(k, f"text {k % 7}" * (k % 50)) for k in range(500)] + [(1, "same"), (1, "same"), (None, None), (None, "x"), (2, ""), (3, "long " * 50_000)]
    docs = make_docs(rows)
    for size in (200, 1 << 24):
        out = sharding.shuffled(docs, bucket_bytes=size)
        assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
        got = out.collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        sizes = Counter(r["shard"] for r in got)
        assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
        for s, n in sizes.items():
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
        again = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shuffled(docs, bucket_bytes=size).collect()}
        assert again == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got}


def test_shuffle_leaves_no_trace_of_the_order(make_docs):
    got = sorted(sharding.shuffled(make_docs([(k, "t") for k in range(2000)])).collect(), key=lambda r: r["slot"] * 16 + r["shard"])
    rank = [r["doc_id"] for r in got]
    assert abs(sum(rank[:1000]) / 1000 - 999.5) < 80
    assert sum(b == a + 1 for a, b in zip(rank, rank[1:])) < 12
    other = sorted(sharding.shuffled(make_docs([(k, "t") for k in range(2000)]), seed=8).collect(), key=lambda r: r["slot"] * 16 + r["shard"])
    assert rank != [r["doc_id"] for r in other]


def test_rows_repeated_very_often_spread_over_buckets(make_docs):
    rows = [(7, "same")] * 3000 + [(None, None)] * 1500 + [(k, "t") for k in range(200)]
    docs = make_docs(rows)
    copies = sharding.numbered(docs, "doc_id", "text", 1000)
    assert copies.groupBy("doc_id", "_copy").count().where("count > 1").isEmpty() and copies.count() == len(rows)
    sizes = copies.groupBy(sharding.scatter("doc_id", "text", 20, 7)).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 350
    out = sharding.shuffled(docs, bucket_bytes=4000, most_equal=1000)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(rows) and out.columns[:5] == docs.columns[:5]
    assert out.groupBy("shard", "slot").count().where("count > 1").isEmpty()


def test_shard_digest_and_files(spark, make_docs, tmp_path):
    docs = make_docs([(1, "é"), (2, None), (3, "")])
    rows = {r["doc_id"]: r for r in sharding.digest(sharding.shuffled(docs)).collect()}
    assert {k: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for k, r in rows.items()} == {1: (3, zlib.crc32("é".encode()), "rows", None), 2: (1, 0, "rows", None), 3: (1, 0, "rows", None)}
    sharding.write_shards(sharding.shuffled(docs), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_targets_share_by_weight_under_the_cap(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 0), (None, 300)]
    got = {r[0]: r[2] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weights, size = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, dict(sizes)
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        level = rest / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in size if s not in capped and level * weights[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * size[s] if s in capped else level * weights[s] for s in size}
    assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(sum(size.values()))


def test_mixture_comes_near_its_targets(make_docs):
    rows = [(k, "w " * (k % 40), "abc"[k % 3]) for k in range(6000)] + [(None, "a b", None), (None, None, None), (7, "w w", "a"), (7, "w w", "a"), (9000, "", "z")]
    docs = make_docs(rows)
    out = mixing.digest(docs).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in out)
    taken, target = Counter(), {}
    for r in out:
        taken[r["target"]] += r["taken"]
    for t in {r["target"] for r in out if r["target"] > 1000}:
        assert taken[t] == pytest.approx(t, rel=0.06)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(mixing.word_count())).first()[0]
    assert words == sum(r["taken"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.digest(docs.repartition(3)).collect()))


def test_pipeline_against_its_stages_done_plainly(spark, folder):
    docs, labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "text").collect()]
    takes = {r["doc_id"] for r in quality.judged(docs, labels).where("predicted = 1").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in takes]
    groups = plain.near_duplicates(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    hits = plain.contamination(left, [(r["item_id"], r["text"]) for r in benchmark.collect()])
    left = {i for i, _ in left if not hits[i][1]}
    copies = {r["doc_id"]: r["copies"] for r in mixing.repeats(docs.where(F.col("doc_id").isin(sorted(left)))).collect()}
    assert Counter(i for i, _ in rows) == Counter({i: n for i, n in copies.items() if n})


def test_stages_take_odd_and_empty_input(spark, folder, make_docs):
    odd = make_docs([(None, None), (1, ""), (1, ""), (2, "a b c"), (None, "word " * 30_000), (3, "x y z", None)]).drop("shard", "score")
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns + (["shard", "slot"] if k == len(corpus_pipeline.STAGES) - 1 else [])
            assert out.count() <= 3 * docs.count()
