"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. A round looks all adjacent
pairs up by binary search over the sorted pair keys, takes the lowest rank of each word and
merges its occurrences at once; words without a pair left drop out of the array.

Null and empty texts have no identifiers and decode to the empty text. Special strings inside
a text become their own identifiers, as the library does by default. Repeated rows give
repeated results; other columns are kept where the caller asks for them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import map_batches, texts
from tessera.llm.token_counts import byte_symbols

#: Bytes of each of the two generations of a worker's cache of chunks, and of an entry's objects.
CACHE, ENTRY = 12 << 20, 200
#: Bytes of text whose new words are merged together; identifiers that are decoded at once.
BATCH, DECODED = 1 << 19, 1 << 16
NO_PAIR = np.iinfo(np.int64).max


class BatchCodec:
    """Encoder and decoder for one word-level BPE vocabulary (a tokenizers JSON file with NFC,
    white space and lower-case normalisation and an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        tokens = {i: token.encode() for token, i in vocab.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        # every token with a space behind it, one after the other, and where each begins
        listed = [tokens.get(i, b"") + b" " for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.token_length = np.array([len(t) for t in listed], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.size = max(vocab.values()) + 1
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last_id = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, new = (np.array([vocab[x] for x in column], np.int64) for column in (
            [a for a, _ in pairs], [b for _, b in pairs],
            [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        # the narrowest integers that hold a key, so that more of the table stays near the processor
        self.key_type = np.uint32 if self.size <= 1 << 16 else np.int64
        self.keys, self.ranks, self.new = keys[order].astype(self.key_type), order, new[order]
        splits = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(splits.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self.splitter = regex.compile(f"({'|'.join(map(regex.escape, found))})") if found else None
        self.space = regex.compile(r"\p{White_Space}+")
        #: chunk without white space, or a special string's identifier -> its identifiers' bytes
        self.known: dict[str | int, bytes] = {}
        self.old: dict[str | int, bytes] = {}
        self.held = 0

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The identifiers of all words in one array, and where each word's end."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), lengths)
        symbols = self.byte_id[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last_id[flat[ends]]
        done_owner, done_symbols = [], []
        while len(symbols):
            keys = (symbols[:-1] * self.size + symbols[1:]).astype(self.key_type)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ok = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(ok, self.ranks[at], NO_PAIR), NO_PAIR)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
            busy = lowest != NO_PAIR
            done_owner.append(owner[~busy])
            done_symbols.append(symbols[~busy])
            pick = busy & (rank == lowest)
            # of a run of overlapping pairs (a a a), every other one, from the left
            runs = np.flatnonzero(pick & ~np.append(False, pick[:-1]))
            places = np.flatnonzero(pick)
            first = runs[np.searchsorted(runs, places, side="right") - 1]
            places = places[(places - first) % 2 == 0]
            symbols[places] = self.new[at[places]]
            keep = busy
            keep[places + 1] = False
            owner, symbols = owner[keep], symbols[keep]
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype("<u4"), np.cumsum(np.bincount(owner, minlength=len(raw)))

    def normal(self, piece: str) -> list[str]:
        """The normalised piece as chunks between white space."""
        if not unicodedata.is_normalized("NFC", piece):
            piece = unicodedata.normalize("NFC", piece)
        # the library lower-cases character by character, without the rule for a final sigma
        piece = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()
        if any(c in piece for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split alone
            return [c for c in self.space.split(piece) if c]
        return piece.split()

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk without white space."""
        if chunk.isalpha():
            return [chunk]
        if len(chunk) > 1 and chunk[-1] in ",." and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Entries of the cache for new chunks."""
        split = [self.pieces(c) for c in chunks]
        words = list({w for ws in split for w in ws})
        entries = {}
        if words:
            symbols, cuts = self.merge(words)
            ids, ends = symbols.tobytes(), (4 * cuts).tolist()
            entries = {word: ids[start:end] for word, start, end in zip(words, [0, *ends], ends, strict=False)}
        return {chunk: entries[ws[0]] if len(ws) == 1 else b"".join([entries[w] for w in ws]) for chunk, ws in zip(chunks, split, strict=True)}

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's identifiers as little-endian 32-bit integers."""
        split: list[list[str | int]] = []
        for text in batch:
            chunks: list = []
            for piece in self.splitter.split(text) if self.splitter else [text]:
                if piece in self.special:
                    chunks.append(self.special[piece])
                elif piece:
                    chunks += self.normal(piece)
            split.append(chunks)
        if self.held > CACHE:
            self.old, self.known, self.held = self.known, {}, 0
        fresh, added = [], {}
        for chunk in set().union(*split).difference(self.known):
            if chunk in self.old:
                added[chunk] = self.old[chunk]
            elif isinstance(chunk, int):
                added[chunk] = np.array([chunk], "<u4").tobytes()
            else:
                fresh.append(chunk)
        added |= self.learn(fresh)
        self.known |= added
        self.held += ENTRY * len(added) + sum(map(len, fresh)) + sum(map(len, added.values()))
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The text of each list of identifiers: tokens joined by spaces, as the vocabulary has no
        decoder. All identifiers lie in one flat array and are gathered from the flat array of
        tokens, a bounded number at once."""
        ids = np.frombuffer(b"".join(encoded), "<u4")
        last = np.cumsum([len(e) // 4 for e in encoded])
        ends, parts, base = np.zeros(len(encoded), np.int64), [], 0
        for low in range(0, len(ids), DECODED):
            some = ids[low : low + DECODED]
            lengths = self.token_length[some]
            stops = np.cumsum(lengths)
            places = np.repeat(self.token_start[some] - stops + lengths, lengths)
            places += np.arange(len(places))
            parts.append(self.token_bytes[places].tobytes())
            here = slice(*np.searchsorted(last, [low, low + len(some)], side="right"))
            ends[here] = base + stops[last[here] - low - 1]
            base += len(parts[-1])
        whole, out, start = b"".join(parts), [], 0
        for end in ends.tolist():
            # the last space goes; a text without identifiers ends where it begins
            out.append(whole[start : max(start, end - 1)])
            start = end
        return out

    def encode_batch(self, batch: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: its identifiers; the text that they decode to."""
        encoded = self.encode(batch)
        return list(zip(encoded, self.decode(encoded), strict=True))


@lru_cache(maxsize=2)
def codec(path: str) -> BatchCodec:
    """One for each Python worker."""
    return BatchCodec(path)


def _coded(docs: DataFrame, vocabulary: str, columns, schema: str, id_col: str, text_col: str) -> DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]

    def rows(batch: pa.RecordBatch) -> dict:
        coded = columns(codec(vocabulary).encode_batch(texts(batch.column(1))))
        return {id_col: batch.column(0)} | {k: [c[k] for c in coded] for k in names}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), rows, f"{id_col} {kind}, {schema}", BATCH, codec.cache_clear)


def bpe_encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``ids`` (array of integers), ``n_tokens`` and ``decoded`` text."""

    def columns(coded):
        return [{"ids": np.frombuffer(ids, "<u4").astype("int32"), "n_tokens": len(ids) // 4, "decoded": text.decode()} for ids, text in coded]

    return _coded(docs, vocabulary, columns, "ids array<int>, n_tokens bigint, decoded string", id_col, text_col)


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_tokens`` and the SHA-256 of the identifiers and of the decoded text of every row,
    taken where they are made, so that neither travels."""

    def columns(coded):
        return [{"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(text).hexdigest()} for ids, text in coded]

    return _coded(docs, vocabulary, columns, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
