"""Alignment of two tokenizers: tokens point to their farthest-right overlapping token; pointer doubling labels the groups."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from motorlot.llm.store import saved

CHUNK_BYTES = 2 << 20
# Characters that are taken to tokens at a time: a task's arrays hold about this much text, however large a chunk is.
PIECE_CHARS = 1 << 17
SPACE = "▁"
# Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts that only A's own library takes: characters outside blocks on whose classes all Unicode versions agree, long runs.
OTHER = re.compile(r"[^\t\n\r -~\u00a1-\u024f\u2010-\u2027\u2030-\u203a\u20ac]|[^ \n]{300}|[ \n]{300}")


class Tokenizers:
    """A byte-level BPE file (A) and a piece BPE model with byte fallback (B), with the bytes of each of their tokens.

    A's own library encodes any text. Where ids follow the order of the merges, texts of plain characters go through
    the same merges as byte ranks, four times as fast; long runs do not, since their cost would grow with the square.
    """

    def __init__(self, byte_file: str, byte_level: str, piece_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: i for i, c in enumerate(byte_level)}
        vocabulary, plain = self.a.get_vocab(with_added_tokens=True), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        merged = [plain["".join(m if isinstance(m, list) else m.split(" "))] for m in json.loads(byte_file)["model"]["merges"]]
        ordered = all(x < y for x, y in zip(merged, merged[1:]))
        self.ranks = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={self.a_bytes[i]: i for t, i in plain.items() if t not in special}, special_tokens={}) if ordered else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = ([np.array([f"{i}{c}" for i in range(len(t))], dtype=object) for c in marks] for t, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))

    def encode_a(self, text: str) -> list[int]:
        if self.ranks and not OTHER.search(text):
            return self.ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of A and B for each text; both empty where the joined bytes of either differ from blank + text."""
        first, second = [self.encode_a(" " + x) if x else [] for x in texts], self.b.encode(texts, num_threads=1)
        for a, b, x in zip(first, second, texts):
            data = b" " + x.encode("utf-8", "replace")
            if not x or b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
                a.clear()
                b.clear()
        return first, second


@lru_cache(maxsize=1)
def loaded(byte_file: str, piece_model: bytes) -> Tokenizers:
    """One set of tokenizers for a worker, whatever number of tasks it runs."""
    return Tokenizers(byte_file, byte_alphabet(), piece_model)


def byte_alphabet() -> str:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies: printable ones for themselves."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in keep else chr(next(rest)) for b in range(256))


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token the B token that ends its group, by pointer jumping.

    Both token rows cover the same bytes, so the farthest-right token that overlaps a token holds its last byte, and it is
    of the other row. A B token that ends where an A token ends is terminal and points to itself. Successors are doubled
    for all tokens at once until nothing moves: the rounds are the logarithm of the longest chain.
    """
    n = len(a_ends)
    from_a, from_b = ends_before(b_ends, a_ends) + n, ends_before(a_ends, b_ends)
    ended = a_ends[from_b] == b_ends if n else np.zeros(0, dtype=bool)
    to = np.concatenate((from_a, np.where(ended, np.arange(len(b_ends)) + n, from_b)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n] - n, to[n:] - n
        to = further


def ends_before(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the ends lie before each place: the number of the token that holds the byte in front of it."""
    marks = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int32)
    marks[ends] = 1
    return np.cumsum(marks)[at - 1].astype(np.int64) if len(ends) else np.zeros(0, dtype=np.int64)


def aligned(texts: list[str], tools: Tokenizers) -> dict[str, np.ndarray | list]:
    """Columns of one chunk of texts: sizes of each text, its digest, and its distinct id pairs with their numbers of links."""
    a_ids, b_ids = tools.encode(texts)
    a_size, b_size = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
    a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in ((a_ids, a_size), (b_ids, b_size)))
    a_doc, b_doc = np.repeat(np.arange(len(texts)), a_size), np.repeat(np.arange(len(texts)), b_size)
    a_ends, b_ends = np.cumsum(tools.a_length[a]), np.cumsum(tools.b_length[b])
    a_group, b_group = terminals(a_ends, b_ends)
    last = np.unique(b_group)
    a_group, b_group = np.searchsorted(last, a_group), np.searchsorted(last, b_group)
    n_groups = np.bincount(b_doc[last], minlength=len(texts))

    # Tokens of A in front of each group and of B behind it: each group is its A tokens, then its B tokens.
    a_before = np.concatenate(([0], np.cumsum(np.bincount(a_group, minlength=len(last)))))
    b_before = np.concatenate(([0], np.cumsum(np.bincount(b_group, minlength=len(last)))))
    names = np.empty(len(a) + len(b), dtype=object)
    a_last, b_last = np.append(a_group[1:] != a_group[:-1], True)[:len(a)], np.append(b_group[1:] != b_group[:-1], True)[:len(b)]
    names[np.arange(len(a)) + b_before[a_group]] = np.where(a_last, tools.a_names[1][a], tools.a_names[0][a])
    names[np.arange(len(b)) + a_before[b_group + 1]] = np.where(b_last, tools.b_names[1][b], tools.b_names[0][b])
    ends = np.cumsum(a_size + b_size)
    digests = [hashlib.sha256("".join(names[e - n:e])[:-1].encode()).hexdigest() if n else "" for e, n in zip(ends.tolist(), (a_size + b_size).tolist())]

    # Between two neighbouring ends of either row lies just one pair of overlapping tokens.
    ended = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, dtype=bool)
    ended[a_ends] = ended[b_ends] = True
    cuts = np.flatnonzero(ended)
    at_a, at_b = ends_before(a_ends, cuts), ends_before(b_ends, cuts)
    width = len(tools.b_bytes)
    span = len(tools.a_bytes) * width
    doc = a_doc[at_a]
    keys = np.sort(doc * span + a[at_a] * width + b[at_b])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    keys, links = keys[first], np.diff(np.append(first, len(keys)))
    return {
        "n_a": a_size, "n_b": b_size, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(texts)), "digest": digests,
        "offsets": np.searchsorted(keys // span, np.arange(len(texts) + 1)), "pairs": keys % span, "links": links,
    }


def pieces(lengths: list[int], chunk: int, piece: int) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, whether a chunk ends there) of runs of texts that reach the length of a piece or end a chunk."""
    start, held, part = 0, 0, 0
    for stop, n in enumerate(lengths, 1):
        held, part = held + n, part + n
        full = held >= chunk or stop == len(lengths)
        if full or part >= piece:
            yield start, stop, full
            start, part, held = stop, 0, 0 if full else held


def alignments(docs: DataFrame, byte_file: str, piece_model: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of docs: key, chunk, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links.

    pairs are the distinct (A id, B id) pairs of the text as A id * size of B + B id, links their numbers of links. A chunk
    is a run of rows in one task with about chunk_bytes of text, or one longer text; it is worked off in pieces of about
    PIECE_CHARS, so that a worker's memory hangs on neither the chunk nor the batch.
    """
    with open(byte_file, encoding="utf-8") as a, open(piece_model, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tools, chunk = loaded(*shared.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for start, stop, full in pieces(lengths, chunk_bytes, PIECE_CHARS):
                n = stop - start
                c = aligned([x or "" for x in batch.column(1).slice(start, n).to_pylist()], tools)
                offsets = pa.array(c["offsets"], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c[name], kind)) for name, kind in (("pairs", pa.int64()), ("links", pa.int32()))]
                counts = [pa.array(c[name], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(np.full(n, chunk), pa.int64()), *counts, pa.array(c["digest"], pa.string()), *lists],
                                                 ["key", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])
                chunk += full

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(made, f"key {kind}, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): number of texts that hold the pair linked, and whether no pair of its A id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts.withColumn("a", F.floor(F.col("pair") / width)), "pair_counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(docs: DataFrame, byte_file: str, piece_model: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that A or B does not give back as blank + text, have zeros and no digest. Each row
    counts as a document of its own, repeated rows and ids too; other columns are not read; an empty table gives an
    empty result.

    Counts go over all rows. They come back to the texts through the distinct pairs of each chunk, not of each text: a
    chunk asks once for each pair, so a pair that stands everywhere costs one row a chunk, and no task holds more than a
    chunk of texts and the pairs in it. Nothing is broadcast but the two tokenizer files.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    rows = saved(alignments(docs, byte_file, piece_model, key, text, chunk_bytes), "alignments")
    wanted = rows.select(F.col("chunk").alias("asker"), F.explode("pairs").alias("pair")).distinct()
    told = wanted.join(pair_counts(rows, width), "pair")
    kind = rows.schema["key"].dataType.simpleString()
    columns = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (left["pairs"], left["links"])]
        pairs, links = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().astype(np.int64)
        known = right["pair"].to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], pairs)] if len(known) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(lists[0].offsets.to_numpy()) if len(left) else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(left)), sizes)
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(sizes)))])
        assert len(doc) == len(pairs)
        best = total(links * right["best"].to_numpy()[at].astype(np.int64))
        count_sum = total(links * right["n"].to_numpy()[at])
        return pa.table([left["key"], *[left[c] for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(best, pa.int64()), pa.array(count_sum, pa.int64()), left["groups_sha256"]], names=columns)

    out = rows.groupBy("chunk").cogroup(told.groupBy("asker")).applyInArrow(looked_up, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", key)
