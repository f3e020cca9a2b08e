"""Operators on single documents: quality, URLs, tokens, WARC, passages, lines."""

import hashlib
import random
import time
import re
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from motorlot.llm import decontamination, lines, quality, token_counts, url_rules, warc
from motorlot.llm.store import held_out
import plain

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_against_the_library(make_docs, library):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "▁", "a", "the", " the", "é", "é", "日本", "<s>", "</s>", "<unk>", "<0x0A>", "\t", "\x00", "👍", "!!", "ing", "İ", "﻿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(800)]
    texts += [None, "", " ", "\n", "a" * 3000, "the" * 900, " " * 700, "日" * 600, "".join(rng.choice("aeinthrs") for _ in range(4000)), "word " * 5000]
    got = {r[0]: tuple(r)[1:] for r in token_counts.token_counts(make_docs(list(enumerate(texts))), MODEL).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or ""))
        assert got[i] == (len((text or "").encode()), n, n > 4096), repr(text)


def test_heap_and_arrays_merge_alike():
    merges, rng = token_counts.Merges(MODEL), random.Random(2)
    for _ in range(200):
        ids, _ = merges.symbols("".join(rng.choice("aeinthrs▁! ") for _ in range(rng.randrange(2, 90))))
        assert merges.count_long(ids) == merges.merge(np.array(ids), np.array([len(ids)]))[0]


def test_token_counts_repeat_rows(make_docs):
    got = token_counts.token_counts(make_docs([(1, "one two"), (1, "one two"), (None, "x")]), MODEL)
    assert sorted(r["n_tokens"] for r in got.collect()) == [1, 2, 2]


RULES = url_rules.HOST_RULES + url_rules.OWN_RULES
URLS = [
    ("http://a.example.org/es/1", "example.org/es/", "block"), ("http://EXAMPLE.org/en/12", "example.org/en/1", "block"), ("http://x.org/", "org/", "allow"),
    ("http://x.org", None, "allow"), ("http://notexample.org/es/", "org/", "allow"), ("https://a.com/fr/x", "com/fr/", "allow"), ("https://a.com/de/", "com/de/", "block"),
    ("https://a.com/DE/", None, "allow"), ("https://a.com?u=http://b.org/", None, "allow"), ("https://casino.net/", None, "block"), ("https://casinos.net/", None, "allow"),
    ("https://a.net/?utm_source=x", None, "block"), ("https://a.net/login", None, "block"), ("a.org/x", None, "allow"), ("", None, "allow"), (None, None, "allow"), ("://", None, "allow"),
    ("http://a.net/a\nb.org/", None, "allow"), ("http://x.org/casino", "org/", "allow"), ("http://é.org/ü", "org/", "allow"),
]


def test_urls(spark):
    rows = [(i, u, "h", "old") for i, (u, _, _) in enumerate(URLS)] + [(None, URLS[0][0], "h", "old"), (0, URLS[0][0], "h", "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string")
    out = url_rules.judged(spark, pages)
    assert out.columns == ["page_id", "url", "token", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["rule"], r["verdict"]) == next(x[1:] for x in URLS if x[0] == r["url"]), r
    by_id = {r["page_id"]: r for r in got}
    assert (by_id[1]["host"], by_id[1]["path"]) == ("example.org", "/en/12") and (by_id[15]["host"], by_id[15]["path"]) == ("", "")


def test_rules_are_fetched_by_their_rarest_token(spark):
    rule = url_rules.Rule("two", "block", "common.*rare", ("common", "rare"))
    pages = spark.createDataFrame([(k, f"http://a/common/{k}") for k in range(5)] + [(9, "http://a/common/rare")], "page_id long, url string")
    assert [r["page_id"] for r in url_rules.judged(spark, pages, (rule,)).where("verdict = 'block'").collect()] == [9]
    with pytest.raises(ValueError):
        url_rules.judged(spark, pages, (url_rules.Rule("none", "block", ".*", ()),))
    assert url_rules.judged(spark, pages, ()).where("verdict = 'allow'").count() == 6


@pytest.mark.parametrize("name", ["url_rules", "sharding", "decontamination", "mixing"])
def test_native_operators_import_no_arrow(name):
    source = Path(url_rules.__file__).with_name(f"{name}.py").read_text()
    assert not re.search(r"^\s*(import|from) (pyarrow|pandas|numpy)", source, re.M)


PAGE = "<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><h1>Head</h1><p>One<br>two &lt;3 <b>bold</b></p><a href='/x?a=1&amp;b=2'>L</a><p>Ünï 日本</p></body></html>"


def test_derivatives_keep_their_links(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "http://b", "plain\r\n\r\nWARC/1.0 text", "x"), (4, "http://c", "", "x")], "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    out = warc.derived(source)
    rows = {(r["page_id"], r["warc_type"]): r for r in out.collect()}
    responses = {r["page_id"]: r for r in source.collect()}
    assert out.count() == 10 and len(responses) == 4
    text, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert text["block"].split("\n") == ["A & B", "Head", "One", "two <3 bold", "L", "Ünï 日本"]
    assert "title: A & B\r\n" in meta["block"] and "outlink: /x?a=1&b=2\r\n" in meta["block"] and "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta["block"]
    assert f"source-payload-digest: {warc.digest_of(PAGE.encode())}" in meta["block"]
    for (page, _), r in rows.items():
        assert r["refers_to"] == responses[page]["record_id"] and r["target_uri"] == responses[page]["target_uri"]
        assert r["block_digest"] == warc.digest_of(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    assert rows[2, "conversion"]["block"] == ""

    records = source.unionByName(out).drop("page_id").distinct()
    warc.write_records(records, str(tmp_path / "files"))
    back = warc.read_records(spark, str(tmp_path / "files"))
    assert back.where("not whole").count() == 0
    assert sorted(map(str, back.drop("whole").select(*warc.COLUMNS).collect())) == sorted(map(str, records.select(*warc.COLUMNS).collect()))


def test_pages_are_read_as_by_plain_patterns(spark, folder):
    pages = [r[0] for r in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect() if r[0]]
    rng = random.Random(9)
    parts = ["<a href=x>", "<a href='y z'>", '<A HREF = "q>r">', "<a>", "<a href=>", "<a name=n href=m", "</a>", "<title>", "</title>", "<p>", "<br/>", "<!-- c -->", "<!--", "-->", "<script>", "</script >",
             "<template>", "</template>", "<noscript>", "</noscript>", "<style a>", "</STYLE>", "one ", "two&amp;", "<3", "< b>", "\n", "'", '"', ">"]
    pages += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    for page in pages:
        assert (warc.plain_text(page), warc.title_of(page), warc.links_of(page)) == plain.page_parts(page), page


@pytest.mark.parametrize("piece", ["<template ", "<title>", "<a ", "<a href=", "<a href='", "<!-- ", "<script>", "<noscript x", "</title", "<p ", "&amp"])
def test_pages_take_time_in_proportion(piece):
    page = piece * 60_000
    start = time.process_time()
    warc.plain_text(page), warc.title_of(page), warc.links_of(page)
    assert time.process_time() - start < 2


def test_a_record_cut_inside_is_not_whole(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\ny")], "page_id long, url string, html string")
    warc.write_records(warc.responses(pages).drop("page_id"), str(tmp_path / "files"))
    assert warc.read_records(spark, str(tmp_path / "files")).where("whole").count() == 0


def test_passages_against_every_window(spark, make_docs):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["the", "ÜBER", "日本", "4"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for k in range(12)]
    items += [(3, "the the the the"), (None, "null item words here now"), (20, ""), (21, None), (22, "--- !!")]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            take = (rng.choice(items)[1] or "").upper().split()
            start = rng.randrange(len(take) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = take[start:start + 12] if rng.random() < 0.4 else take
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(100, None), (101, ""), (102, "the " * 50), (103, "Null item WORDS here now")]
    benchmark = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, pos int, term string")
    for block in (7, 10_000):
        got = {r[0]: tuple(r[1:5]) for r in decontamination.contamination(make_docs(docs), benchmark, block=block).collect()}
        assert got == plain.contamination(docs, items)
    kept = decontamination.clean(make_docs(docs), benchmark)
    assert kept.columns == make_docs(docs).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, x in plain.contamination(docs, items).items() if not x[1]}


def test_passages_by_place_and_nearness(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = make_docs([(1, "x Alpha, beta gamma delta y alpha beta gamma delta"), (2, "delta x gamma y beta z alpha"), (3, "alpha " + "pad " * 30 + "beta gamma delta"), (1, "x")])
    exact = {tuple(r) for r in decontamination.phrase_matches(docs, benchmark).collect()}
    assert exact == {(1, 1, 4, "1"), (1, 6, 4, "1")}
    near = {tuple(r) for r in decontamination.proximity_matches(docs, benchmark).collect()}
    assert near == {(1, "1", True), (2, "1", False)}


LINE = "This line is long enough to count"


def test_lines_against_a_plain_version(make_docs, monkeypatch):
    rng = random.Random(4)
    pool = [LINE, LINE.upper(), f"  {LINE}\t", "short", "ünï " * 5, "ünïü" * 5, "x" * 19, "x" * 20, "", " ", "Ä" * 20, "ä" * 20] + [f"line number {k} of the pool" for k in range(30)]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for k in range(80)]
    docs += [(200, None), (201, ""), (None, LINE + "\nown"), (5, LINE), (5, LINE), (300, "\r\n".join([LINE, "a" * 100_000, LINE]))]
    plain_rows = sorted(plain.lines(docs), key=str)
    for chunk, shard, slices in ((2 << 20, 50_000, 10_000), (200, 3, 2), (1, 1, 1)):
        monkeypatch.setattr(lines, "CHUNK_BYTES", chunk)
        got = lines.deduped(make_docs(docs).repartition(2), shard_keys=shard, slice_chunks=slices)
        assert sorted(map(tuple, got.collect()), key=str) == plain_rows
    digests = {r[3] for r in lines.digest(lines.deduped(make_docs(docs))).collect()}
    assert digests == {hashlib.sha256(x[3].encode()).hexdigest() for x in plain_rows}


def test_perfect_hash_gives_each_line_its_slot():
    rng = np.random.default_rng(5)
    both = np.unique(rng.integers(0, 2**64 - 1, (5000, 2), dtype=np.uint64), axis=0)
    both[:40, 0] = both[0, 0]  # lines that share the first half of their hash are told apart by the second
    both[40:80, 1] = both[40, 1]
    h, f = both.T.copy()
    sizes, bits, slots = lines.perfect(h, f)
    assert sorted(slots) == list(range(len(h))) and bits.sum() == len(h) and sum(sizes) == len(bits)
    frame = pd.DataFrame({"shard": 3, "h": h.view(np.int64), "f": f.view(np.int64), "n": np.arange(len(h)), "keeper": -np.arange(len(h))})
    shard = lines.Shard(lines.built(frame).iloc[0].to_dict())
    found = shard.slots(h, f)
    assert (shard.counts[found] == np.arange(len(h))).all() and (shard.keepers[found] == -np.arange(len(h))).all()
    assert (shard.slots(h + np.uint64(1), f + np.uint64(7)) < 0).all()


def test_quality_on_documents_that_were_held_out(spark, folder):
    data = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.digest(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(6)
    rows, votes = rng.random((60, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 60).astype(float)
    model = quality.fitted(rows, votes, dimensions=8, neighbours=5)
    new = rng.random((20, quality.TERMS)).astype(np.float32)
    z, scores = model.latent(new), model.scores(new)
    for v, s in zip(z, scores):
        cosine = model.vectors @ v
        near = np.argsort(-cosine)[:5]
        w = np.maximum(cosine[near], 0) ** quality.POWER + 1e-12
        assert s == pytest.approx((w * votes[near]).sum() / w.sum())


def test_scores_do_not_hang_on_blocks_or_order_where_cosines_tie():
    rng = np.random.default_rng(3)
    base = rng.random((40, quality.TERMS)).astype(np.float32)
    rows, votes = base[rng.integers(0, 40, 900)], rng.integers(0, 2, 900).astype(float)
    model, new = quality.fitted(rows, votes), base[rng.integers(0, 40, 300)]
    want = model.scores(new)
    for size in (1, 37, 300):
        assert np.allclose(want, np.concatenate([model.scores(new[k:k + size]) for k in range(0, 300, size)]), atol=1e-9)
    order = rng.permutation(900)
    model.vectors, model.votes = model.vectors[order], votes[order]
    assert np.allclose(want, model.scores(new), atol=1e-9)


def test_quality_odd_rows(spark, make_docs):
    docs = make_docs([(k, f"fine words number {k} are here") for k in range(8)] + [(k, "JUNK!! " * 9) for k in range(20, 28)] + [(50, None), (51, ""), (None, "x"), (52, "y"), (52, "y")])
    labels = spark.createDataFrame([(k, 1, 0, 0.1) for k in range(8)] + [(k, 0, 0, 0.1) for k in range(20, 28)] + [(1, 1, 0, 0.1), (2, None, 0, 0.1), (None, 1, 0, 0.1), (99, 1, 0, 0.1)], "doc_id long, quality int, toxic int, score double")
    got = quality.judged(docs, labels, neighbours=3)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r["score"] is not None for r in rows)
    assert all(r["predicted"] == (1 if r["doc_id"] < 20 else 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 30)
    assert quality.accepted(docs, labels.limit(0)).count() == docs.count()


def test_labels_of_held_out_rows_change_nothing(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.digest(docs, labels).collect())) == sorted(map(tuple, quality.digest(docs, turned).collect()))
    assert [r[0] for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").orderBy("doc_id").collect()] == [r[0] for r in docs.orderBy("doc_id").collect() if plain.held_out(r[0])]
