"""Benchmark decontamination by a prefix-filtered set join.

An item is a set of windows of eight consecutive words (an item of fewer words is one window), and
a window a set of shingles of ``SHINGLE`` words that must be contained in full. Shingles are ordered
by rarity, their document frequency over the whole corpus; with full containment a window's
necessary prefix is its rarest shingle, the rest of it need not be joined. Documents emit the
places of the shingles that are some window's prefix (a filter of bounded size keeps others in
their tasks), each with the words around it, which the window spans at most; they meet the windows
in a join on the shingle. The length and positional bounds (the window must lie inside the document
around the place) filter the pairs, and comparing the words themselves over the item-sized window
verifies them.

Items are a table like others: windows, their shingles, frequencies and the owners of a window are
tables joined in Spark, broadcast only behind a check of their size. Equal windows are one, joined
with their items after the documents have met it.

Null and empty texts have no words. Items without words have no window and occur nowhere;
items without an id are left out; items that share an id count as one. Repeated documents give
repeated results, rows that share an id each their own. Ids may be of any type; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, joined, map_batches
from tessera.llm.words import NOT_ALNUM, Words, key_filter, may_hold, windows, words_of

WINDOW, SHINGLE = 8, 3
#: Word characters: digits, letters lower-cased from A-Z, and all beyond ASCII.
LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def _canonical(words: Words, start: int, end: int) -> str:
    """The words from ``start`` to before ``end``, lower-cased, with single blanks between."""
    return b" ".join(words.text(start, end).translate(LOWER).split()).decode()


def _windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """``item``, the text of each of its windows, its words ``n`` and the hashes of its
    ``shingles`` (of ``SHINGLE`` words, or of all if it has fewer)."""

    def rows(batch: pa.RecordBatch) -> dict:
        words = words_of(batch.column(1), NOT_ALNUM)
        names = batch.column(0).to_pylist()
        out: dict[str, list] = {"item": [], "window": [], "n": [], "shingles": []}
        every = {k: windows(words.hashes, k).view(np.int64) for k in range(1, SHINGLE + 1)}
        for k, name in enumerate(names):
            low, high = int(words.first[k]), int(words.first[k + 1])
            n = min(size, high - low)
            width = min(SHINGLE, n)
            for start in range(low, high - n + 1) if n else ():
                out["item"].append(name), out["n"].append(n), out["window"].append(_canonical(words, start, start + n))
                out["shingles"].append(every[width][start : start + n - width + 1])
        return out

    kind = items.schema[item_col].dataType.simpleString()
    chosen = items.where(F.col(item_col).isNotNull()).select(item_col, text_col)
    return map_batches(chosen, rows, f"item {kind}, window string, n int, shingles array<bigint>", 1 << 20)


def _frequencies(docs: DataFrame, text_col: str, keys: Broadcast, widths: list[int]) -> DataFrame:
    """``key`` and in how many documents it occurs (``df``), of the shingles that the filter passes."""

    def rows(batch: pa.RecordBatch) -> dict:
        words = words_of(batch.column(0), NOT_ALNUM)
        found = []
        for width in widths:
            key = windows(words.hashes, width).view(np.int64)
            at = np.flatnonzero(may_hold(keys.value, key))
            owner = np.searchsorted(words.first, at, side="right") - 1
            inside = at + width <= words.first[owner + 1]
            pairs = np.unique(np.stack([owner[inside], key[at[inside]]]), axis=1)  # once a document
            found.append(pairs[1])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        return {"key": values, "df": counts}

    return map_batches(docs.select(text_col), rows, "key bigint, df bigint").groupBy("key").agg(F.sum("df").alias("df"))


def _places(docs: DataFrame, id_col: str, text_col: str, prefixes: Broadcast, widths: list[int], size: int) -> DataFrame:
    """Every row's id, a number of its own, ``n_words``, and the ``places`` of possible prefixes:
    ``key``, its place ``at``, and the words ``around`` it from place ``start``."""

    def rows(batch: pa.RecordBatch) -> dict:
        words = words_of(batch.column(2), NOT_ALNUM)
        places: list[list] = [[] for _ in range(batch.num_rows)]
        for width in widths:
            key = windows(words.hashes, width).view(np.int64)
            at = np.flatnonzero(may_hold(prefixes.value, key))
            owner = np.searchsorted(words.first, at, side="right") - 1
            low, high = words.first[owner], words.first[owner + 1]
            inside = np.flatnonzero(at + width <= high)
            for k, k_low, k_high, place, h in zip(*(x[inside].tolist() for x in (owner, low, high, at, key[at])), strict=True):
                start, end = max(k_low, place - size + width), min(k_high, place + size)
                places[k].append({"key": h, "at": place - k_low, "start": start - k_low, "around": _canonical(words, start, end)})
        return {"row": batch.column(0), "id": batch.column(1), "n_words": np.diff(words.first), "places": places}

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row bigint, id {kind}, n_words bigint, places array<struct<key: bigint, at: int, start: int, around: string>>"
    return map_batches(docs.select(F.monotonically_increasing_id().alias("row"), id_col, text_col), rows, schema)


def _covered(spans: Column) -> Column:
    """The words in spans that may overlap."""
    zero = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(
        F.array_sort(spans), zero,
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["start"], a["end"]))).alias("hit"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["hit"],
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
) -> DataFrame:
    """For every document row: ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``n_items`` and the sorted ``items`` with occurring windows, ``contaminated`` (``min_items``
    items at least), ``items_sha256``."""
    spark = docs.sparkSession
    owned = cut(_windows(items, size, item_col, item_text_col))
    kinds = owned.groupBy("window").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    kinds = cut(kinds.withColumn("id", F.monotonically_increasing_id()))
    widths = sorted(r.w for r in kinds.select(F.least("n", F.lit(SHINGLE)).alias("w")).distinct().collect())  # SHINGLE rows at most
    each = kinds.select("id", F.posexplode("shingles").alias("at", "key"))
    keys = cut(each.select("key").distinct())
    frequent = cut(_frequencies(docs, text_col, spark.sparkContext.broadcast(key_filter(keys, "key")), widths)) if widths else None
    if frequent is not None:
        each = joined(each, frequent, "key", "left")
    else:
        each = each.withColumn("df", F.lit(0))
    # the rarest shingle of a window; one that no document holds rules the window out
    rarest = each.groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "at")).alias("p")).where("p.df > 0")
    wanted = cut(kinds.select("id", "n", "window").join(rarest.select("id", "p.key", F.col("p.at").alias("offset")), "id"))
    # a short window's key is of fewer words: it can't be confused with another's, as widths are hashed in
    prefixes = spark.sparkContext.broadcast(key_filter(wanted, "key"))
    found = cut(_places(docs, id_col, text_col, prefixes, widths, size))
    discard(keys, frequent, kinds)
    at = found.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    met = joined(at, wanted, "key", "inner")
    begin = F.col("at") - F.col("offset")
    words = F.slice(F.split("around", " "), (begin - F.col("start") + 1).cast("int"), F.col("n"))
    met = met.where((begin >= F.col("start")) & (begin + F.col("n") <= F.col("n_words")))
    hits = cut(met.where(F.array_join(words, " ") == F.col("window")).select("row", "id", "n", begin.cast("bigint").alias("begin"), "window"))
    # each document's spans, merged, and the items of its windows
    spans = hits.groupBy("row").agg(F.collect_set(F.struct(F.col("begin").alias("start"), (F.col("begin") + F.col("n")).alias("end"))).alias("spans"))
    owners = cut(owned.select("window", F.col("item").cast("string").alias("item")).distinct())
    named = joined(hits.select("row", "window").distinct(), owners, "window", "inner")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = cut(spans.select("row", _covered(F.col("spans")).alias("n_hit")).join(named, "row"))
    discard(owned, hits, wanted, owners)
    out = joined(found.select("row", "id", "n_words"), marks, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"), items_of.alias("items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.size(items_of) >= min_items).alias("contaminated"),
    )
