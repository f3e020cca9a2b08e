"""Exact token counts of byte-fallback piece BPE by rank-synchronous merging in ragged numpy arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
CACHE_WORDS = 400_000
LONG_WORD = 256
LIMIT = 4096


class Merges:
    """Pieces of a sentencepiece BPE model as arrays: ids of symbols, and the piece and rank of each pair that merges.

    Rank follows the score; pieces of one score share a rank, and of pairs with one rank the leftmost merges first.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        pieces = [model.id_to_piece(i) for i in range(size) if not special[i]]
        scores = np.array([model.get_score(i) for i in range(size) if not special[i]])
        if any(model.is_unused(i) for i in range(size)) or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the model has unused pieces or pieces across words")
        _, rank = np.unique(-scores, return_inverse=True)
        ids = {p: i for i, p in enumerate(pieces)}
        for char in sorted({c for p in pieces for c in p} - ids.keys()):
            ids[char] = len(ids)
        self.n, self.chars = len(ids) + 1, {p: i for p, i in ids.items() if len(p) == 1}
        pairs = {ids[p[:k]] * self.n + ids[p[k:]]: i for i, p in enumerate(pieces) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.rank = rank[self.made].astype(np.int64)
        # Symbols that are no piece count by byte; the last id stands for characters in no piece.
        self.cost = np.ones(self.n, dtype=np.int64)
        for char, i in self.chars.items():
            if i >= len(pieces):
                self.cost[i] = len(char.encode())
        self.line_ends = not any("\n" in p for p in ids)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or a value above all ranks) and piece of each pair."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def symbols(self, word: str) -> tuple[list[int], int]:
        """Ids of the characters, and what characters in no piece add beyond one token."""
        ids = [self.chars.get(c, self.n - 1) for c in word]
        return ids, sum(len(c.encode("utf-8", "replace")) - 1 for c, i in zip(word, ids) if i == self.n - 1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a word starts with the space mark or follows a line end."""
        out = np.zeros(len(words), dtype=np.int64)
        short, flat, lengths = [], [], []
        for i, word in enumerate(words):
            ids, out[i] = self.symbols(word)
            if len(ids) > LONG_WORD:
                out[i] += self.count_long(ids)
            elif ids:
                short.append(i)
                flat += ids
                lengths.append(len(ids))
        if short:
            out[short] += self.merge(np.array(flat, dtype=np.int64), np.array(lengths))
        return out

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merge the lowest-rank pair (the leftmost of equals) of every sequence at once until no pair is left."""
        done = np.zeros(len(lengths), dtype=np.int64)
        names = np.arange(len(lengths))
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        rank, made = np.full(len(flat), NONE), np.zeros(len(flat), dtype=np.int64)
        rank[:-1], made[:-1] = self.look_up(flat[:-1], flat[1:])
        while True:
            rank[np.append(first[1:], len(flat)) - 1] = NONE
            best = np.minimum.reduceat((rank << 32) | np.arange(len(flat)), first)
            live = best < (NONE << 32)
            if not live.all():
                ended = np.add.reduceat(self.cost[flat], first)
                done[names[~live]] = ended[~live]
                if not live.any():
                    return done
                keep = np.repeat(live, lengths)
                shift = np.cumsum(~keep)
                best = best[live]
                best -= shift[best & MASK]
                flat, rank, made = flat[keep], rank[keep], made[keep]
                names, lengths = names[live], lengths[live]
            at = best & MASK
            flat[at] = made[at]
            left = np.ones(len(flat), dtype=bool)
            left[at + 1] = False
            at = at - np.arange(len(at))
            flat, rank, made = flat[left], rank[left], made[left]
            lengths = lengths - 1
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            near = np.concatenate((at[at + 1 < len(flat)], at[at > first] - 1))
            rank[near], made[near] = self.look_up(flat[near], flat[near + 1])

    def count_long(self, ids: list[int]) -> int:
        """The same merges for one long sequence, with a heap over a linked list."""
        ids, n = list(ids), len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, made = self.look_up(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(rank[i]), i, ids[i], ids[i + 1], int(made[i])) for i in np.flatnonzero(rank < NONE)]
        heapq.heapify(heap)
        table = self.pairs()
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = piece, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for l, r in ((before[i], i), (i, after[i])):
                if l >= 0 and r < n and (found := table.get(ids[l] * self.n + ids[r])):
                    heapq.heappush(heap, (found[0], l, ids[l], ids[r], found[1]))
        return int(sum(self.cost[i] for i in ids if i >= 0))

    def pairs(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        return self._pairs


NONE, MASK = np.int64(1 << 30), np.int64((1 << 32) - 1)
MARKED = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def words_of(text: str, merges: Merges) -> list[str]:
    """Parts of a text that no merge crosses: runs of space marks with the word behind them, cut at line ends.

    A space turns into a space mark and the text gets one in front. Each line end is a token of its own, as long as no
    piece holds one.
    """
    if not text:
        return []
    out: list[str] = []
    for i, line in enumerate(text.split("\n") if merges.line_ends else [text]):
        if i:
            out.append("\n")
        if "  " in line or SPACE in line or (i == 0 and line[:1] == " "):
            out += MARKED.findall((SPACE if i == 0 else "") + line.replace(" ", SPACE))
        else:
            first, *rest = line.split(" ")
            out.append(SPACE + first if i == 0 else first)
            out += [SPACE + word for word in rest]
    return out


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the key, n_bytes, n_tokens and over_limit (n_tokens above `limit`).

    The count is that of the model's own library without begin and end marks. Null counts as empty, an empty text has no
    token; repeated rows give repeated results; other columns are not read. The merge table, bounded by the vocabulary,
    is broadcast. A task holds one Arrow batch, and counts of up to CACHE_WORDS distinct words. Very long words without a
    space are merged with a heap, so no text takes more than n log n steps.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(model_file))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = merges.value, {}
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes, totals = [], []
            for start in range(0, len(texts), 256):
                parts = [words_of(x, table) for x in texts[start:start + 256]]
                if len(known) > CACHE_WORDS:
                    known = {}
                new = list(set().union(*parts).difference(known))
                known.update(zip(new, table.count(new).tolist()))
                totals += [sum(map(known.__getitem__, p)) for p in parts]
                sizes += [len(x.encode("utf-8", "replace")) for x in texts[start:start + 256]]
            n = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([t > limit for t in totals], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(counted, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
