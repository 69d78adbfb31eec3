"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a word form a doubly linked list; a heap holds the adjacent pairs by rank and
place. The lowest is popped and merged until none is left, so that the count is the number
of initial symbols less the number of merges. No identifier is ever emitted.

Null and empty texts have 0 tokens; repeated rows give repeated results; other columns of
the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import Recent, map_batches, texts

#: The pattern of byte-level tokenizers that splits text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = WORDS.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: Bytes of each of the two generations of a worker's caches.
CHUNKS, PIECES = 40 << 20, 30 << 20
#: A space that a word does not follow directly.
LOOSE = re.compile(r" (?=\s|$)")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that
    print stand for themselves, the others take the code points from 256 on, in order."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class HeapCounter:
    """Counts the tokens of a text for one byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        number = spec["model"]["vocab"]
        self.base = [number[c] for c in byte_symbols()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number[a] << 32 | number[b]] = rank
            self.made.append(number[a + b])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.words = regex.compile(WORDS)
        self.by_word = Recent(self.merged, PIECES)
        self.by_chunk = Recent(self.of_chunk, CHUNKS)

    def merged(self, word: str) -> int:
        """The tokens of one word. A heap entry is rank and place in one integer; it is void when
        the pair at that place has another rank by now."""
        symbols = [self.base[b] for b in word.encode()]
        left = len(symbols)
        rank_of = self.ranks.get
        heap = []
        for i in range(left - 1):
            rank = rank_of(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return left
        heapq.heapify(heap)
        after = [*range(1, left), -1]
        before = [*range(-1, left - 1)]
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j < 0 or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue
            new = symbols[i] = self.made[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                rank = rank_of(new << 32 | symbols[k])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 32 | new)
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | h)
        return left

    def of_words(self, piece: str) -> int:
        return sum(map(self.by_word.__getitem__, self.words.findall(piece)))

    def of_chunk(self, chunk: str) -> int:
        """The tokens of a space and the chunk after it."""
        if chunk.isalpha():
            return self.by_word[" " + chunk]
        if len(chunk) > 1 and chunk[-1] in ",." and chunk[:-1].isalpha():
            return self.by_word[" " + chunk[:-1]] + self.by_word[chunk[-1]]
        return self.of_words(" " + chunk)

    def of_piece(self, piece: str) -> int:
        """No word spans the place before a single space with a non-space after it, so that the
        text is counted by the chunks between such spaces, which repeat."""
        if LOOSE.search(piece):
            return self.of_words(piece)
        first, *chunks = piece.split(" ")
        return self.of_words(first) + sum(map(self.by_chunk.__getitem__, chunks))

    def count(self, text: str) -> int:
        if not text:
            return 0
        pieces = self.added.split(text) if self.added else [text]
        return sum(self.of_piece(p) for p in pieces if p) + len(pieces) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> HeapCounter:
    """One for each Python worker."""
    return HeapCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``
    tokens) of every row, as the tokenizers library counts without special tokens added."""

    def rows(batch: pa.RecordBatch) -> dict:
        own = counter(vocabulary)
        found = texts(batch.column(1))
        counts = [own.count(t) for t in found]
        return {
            id_col: batch.column(0),
            "n_bytes": [len(t.encode()) for t in found],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), rows, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
