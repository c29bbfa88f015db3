"""Problem 8: token ids of a whole corpus under a public byte-level BPE.

Speculate and verify.  Text is split into words by the tokenizer's pattern;
each distinct word gets a greedy longest-match proposal, every adjacent pair
of proposed tokens is tested for compatibility in one vectorised pass, and
only words with an incompatible pair are merged exactly.

Why it is exact: a token sequence is the BPE encoding of its bytes iff each
adjacent pair is, taken alone, the encoding of the pair's bytes.  A pair fails
when undoing the last merges on both sides of the seam uncovers two tokens
whose merge would have come before the merge that hides them.

Defined results: null and empty texts give an empty list.  Special-token
strings are ordinary text.  Texts are processed whole, however long.
"""

from __future__ import annotations

import heapq
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY_FILE = "byte_bpe_50k.json"
#: Fixed value: the tokenizer's word pattern.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker before its cache starts again.
CACHE_WORDS = 400_000


def _printable_bytes() -> dict[str, int]:
    """The byte each printable stand-in character of the vocabulary file means."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class SpeculativeEncoder:
    """Encodes words of one byte-level BPE vocabulary; one per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        stand_in = _printable_bytes()
        raw = lambda token: bytes(stand_in[c] for c in token)
        vocabulary = {t: i for t, i in model["vocab"].items() if all(c in stand_in for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        size = max(vocabulary.values()) + 1
        # Ranks order the merges; a base byte has rank -1 and splits into itself.
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b, ab) in enumerate(made):
            self.merged[a, b] = ab
            self.rank[ab], self.left[ab], self.right[ab] = rank, a, b
        keys = np.array([a << 32 | b for a, b, _ in made], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.arange(len(made), dtype=np.int64)[order]
        self.id_of = {raw(t): i for t, i in vocabulary.items()}
        self.longest = max(map(len, self.id_of))
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.split = regex.compile(WORD_PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.verified: dict[int, bool] = {}
        self.words_exact = 0

    # -- speculation ---------------------------------------------------------
    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match, left to right."""
        out, at, ids, longest = [], 0, self.id_of, self.longest
        while at < len(data):
            end = min(len(data), at + longest)
            while (token := ids.get(data[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    # -- verification --------------------------------------------------------
    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For arrays of adjacent tokens: is each pair its own encoding?

        Both sides are undone step by step, later merge first.  ``bar`` is the
        rank from which on a merge across the seam would come too late.
        """
        first, second = first.copy(), second.copy()
        good = np.ones(len(first), bool)
        bar = np.full(len(first), np.iinfo(np.int64).max)
        live = np.arange(len(first))
        while len(live):
            a, b = first[live], second[live]
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_rank[at] < bar[live])
            good[live[clash]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            undo_a = rank_a > rank_b
            more = ~clash & (np.maximum(rank_a, rank_b) >= 0)
            # Equal merges run left to right: undoing the right one leaves room
            # for a seam merge of the same rank, undoing the left one doesn't.
            bar[live] = np.where(undo_a, rank_a, rank_b + 1)
            first[live] = np.where(undo_a, self.right[a], a)
            second[live] = np.where(undo_a, b, self.left[b])
            live = live[more]
        return good

    def exact(self, data: bytes) -> list[int]:
        """Plain BPE by a heap of merges over a linked list."""
        self.words_exact += 1
        token = [self.byte_id[b] for b in data]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merged.get((token[i], token[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, token[i], token[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = self.merged[a, b], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in token if t >= 0]

    # -- words and texts -----------------------------------------------------
    def learn(self, words: set[str]) -> None:
        """Put the encodings of new words into the cache."""
        many: list[tuple[str, bytes, list[int]]] = []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            whole = self.id_of.get(data)
            if whole is not None:
                self.cache[word] = (whole,)
            else:
                many.append((word, data, self.propose(data)))
        keys = {a << 32 | b for _, _, p in many for a, b in zip(p, p[1:])}
        fresh = np.fromiter((k for k in keys if k not in self.verified), np.int64)
        if len(fresh):
            good = self.compatible(fresh >> 32, fresh & 0xFFFFFFFF)
            self.verified.update(zip(fresh.tolist(), good.tolist()))
        for word, data, proposal in many:
            if not all(self.verified[a << 32 | b] for a, b in zip(proposal, proposal[1:])):
                proposal = self.exact(data)
            self.cache[word] = tuple(proposal)

    def encode_batch(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """The tokens of each text, word by word."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.verified) > 4 * CACHE_WORDS:
            self.verified.clear()
        split = self.split
        words = [split(t) if t else [] for t in texts]
        if new := set(chain.from_iterable(words)).difference(self.cache):
            self.learn(new)
        look = self.cache.__getitem__
        return [list(map(look, w)) for w in words]


@lru_cache(maxsize=4)
def encoder(path: str) -> SpeculativeEncoder:
    return SpeculativeEncoder(path)


def token_ids(text: Column, vocabulary_dir: str = VOCABULARY_DIR) -> Column:
    """``array<int>`` of token ids of a text column."""
    path = os.path.join(vocabulary_dir, VOCABULARY_FILE)

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        words = encoder(path).encode_batch(column.to_pylist())
        flat = [list(chain.from_iterable(w)) for w in words]
        ends = np.zeros(len(flat) + 1, np.int32)
        np.cumsum(list(map(len, flat)), out=ends[1:])
        values = np.fromiter(chain.from_iterable(flat), np.int32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return encode(text)


def token_count(text: Column, vocabulary_dir: str = VOCABULARY_DIR) -> Column:
    """Number of tokens of a text column, without building the id lists in Arrow."""
    path = os.path.join(vocabulary_dir, VOCABULARY_FILE)

    @F.arrow_udf("int")
    def count(column: pa.Array) -> pa.Array:
        words = encoder(path).encode_batch(column.to_pylist())
        return pa.array([sum(map(len, w)) for w in words], pa.int32())

    return count(text)


def encode_corpus(
    documents: DataFrame, text: str = "text", vocabulary_dir: str = VOCABULARY_DIR
) -> DataFrame:
    """``documents`` with a column ``ids``; a column of that name is replaced."""
    return documents.withColumn("ids", token_ids(F.col(text), vocabulary_dir))
