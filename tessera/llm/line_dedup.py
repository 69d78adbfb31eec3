"""Line dedup: a deletion-neighbourhood join on lines.

The edit bound is one word inserted, deleted or replaced. A line of ``fuzzy_words`` words or
more emits, as hashed keys, every variant with one word left out, and itself; lines with equal
variants meet, their edit distance is verified on the words, and the earliest line (by document,
then line) is kept. Equal lines meet whatever their length, if they are not blank and have
``min_words`` words. Case and blanks at the ends do not count.

A line is dropped if an equal line or one within the bound stands earlier, whether or not that
one is kept itself: each decision depends on the input alone.

So that not every line emits its variants, lines of which no other line shares a half are left
out before: if one word is changed, either the first half of the words or the last is intact, so
that this loses no pair; and a line that shares one half only leaves out words of the other. A
group of equal variants is reduced to its earliest member by an aggregate, never listed as pairs.
DataFrame functions only.

Null and empty texts have no lines to drop; documents without an id are left as they are; rows
that share an id are one document for the order, and lines at the same place of such rows do not
drop each other. Other columns, whatever their names, are kept, but for one named ``line_dedup``,
which the result's replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, joined

MIN_WORDS, FUZZY_WORDS = 1, 8


def _normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _size(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(17), line).alias("h2")]


def _half_keys(fuzzy_words: int) -> Column:
    """Keys of the halves that a line ``s`` of ``n`` words shares with lines of one word more, less
    or other, each with its side: 0 for the first words."""
    keys = []
    for less in (0, 1):
        m = F.col("n") - less
        half = F.floor(m / 2).cast("int")
        for side, part in ((0, F.call_function("substring_index", F.col("s"), F.lit(" "), half)), (1, F.call_function("substring_index", F.col("s"), F.lit(" "), half - m))):
            keys.append(F.when(m >= fuzzy_words, F.struct(F.xxhash64(F.lit(side), m, part).alias("half"), F.lit(side).alias("side"))))
    return F.array_compact(F.array(*keys))


def _without(i: Column, n: Column) -> Column:
    """The line ``s`` without its word ``i`` of ``n``, from 1."""
    part = lambda k: F.call_function("substring_index", F.col("s"), F.lit(" "), k)
    return F.when(i == 1, part(1 - n)).when(i == n, part(n - 1)).otherwise(F.concat(part(i - 1), F.lit(" "), part(i - n)))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``pos`` (from 0) of each line to drop, with ``first`` (doc, pos) of the earliest
    line that it repeats."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.select("doc", "pos", _normal(F.col("line")).alias("s")).where(F.col("s").rlike(r"\S"))
    lines = lines.withColumn("n", _size(F.col("s"))).where(F.col("n") >= min_words)
    found = cut(lines.select("doc", "pos", *_keys(F.col("s")), F.when(F.col("n") >= fuzzy_words, _half_keys(fuzzy_words)).alias("halves")))
    place = F.struct("doc", "pos")
    kinds = cut(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves")))
    repeated = kinds.where("copies > 1").select("h1", "h2", "first")
    near, scratch = _near(docs, kinds, id_col, text_col)
    earlier = cut(repeated.unionByName(near).groupBy("h1", "h2").agg(F.min("first").alias("first")))
    discard(kinds, *scratch)
    return joined(found.select("doc", "pos", "h1", "h2"), earlier, ["h1", "h2"], "inner").where(F.col("first") < place).select("doc", "pos", "first")


def _near(docs: DataFrame, kinds: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """``h1``, ``h2`` and ``first`` of lines with another within the bound that stands earlier:
    that one's place. Second, the tables to discard after it."""
    halves = kinds.select("h1", "h2", "first", F.explode("halves").alias("half")).select("h1", "h2", "first", "half.half", "half.side")
    shared = cut(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"))
    wanted = joined(halves, shared, "half", "inner").groupBy("first", "h1", "h2").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    by_doc = cut(wanted.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h1", "h2", "low", "high")).alias("at")))
    texts = joined(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), by_doc, "doc", "inner")
    lines = texts.select("doc", "at", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # rows that share an id bring other lines to the same place: the hash tells them apart
    mine = F.filter("at", lambda x: x["pos"] == F.col("pos"))
    lines = lines.select("doc", "pos", _normal(F.col("line")).alias("s"), mine.alias("mine")).where(F.size("mine") > 0)
    lines = lines.select("doc", "pos", "s", F.get(F.filter("mine", lambda x: x["h1"] == F.xxhash64("s")), F.lit(0)).alias("h")).where("h IS NOT NULL")
    own = lines.select(F.struct("doc", "pos").alias("first"), "s", "h.h1", "h.h2", "h.low", "h.high").dropDuplicates(["h1", "h2"])
    # a line's number follows the order of lines, so that it stands for its place
    own = cut(own.orderBy("first").withColumn("id", F.monotonically_increasing_id()).withColumn("n", _size(F.col("s"))))
    discard(shared, by_doc)
    start = F.when(F.col("low") == 0, F.when(F.col("high") == 1, 1).otherwise(F.floor((F.col("n") - 1) / 2) + 1)).otherwise(1)
    stop = F.when(F.col("high") == 0, F.col("n")).when(F.col("low") == 0, F.col("n")).otherwise(F.floor(F.col("n") / 2) + 1)
    left_out = own.select("id", "n", "s", F.explode(F.sequence(start.cast("int"), stop.cast("int"))).alias("i"))
    emitted = left_out.select("id", "n", "i", F.xxhash64(_without(F.col("i"), F.col("n"))).alias("key")).unionByName(
        own.select("id", "n", F.lit(0).alias("i"), F.xxhash64("s").alias("key"))
    )
    emitted = cut(emitted)
    # replaced: the same place left out of lines of the same size
    same = cut(emitted.where("i > 0").groupBy("key", "n", "i").agg(F.min("id").alias("other"), F.max("id").alias("last")).where("other < last").drop("last"))
    replaced = joined(emitted, same, ["key", "n", "i"], "inner").where("other < id").select("id", "other", "i", F.lit(0).alias("more"))
    # one word more or less: a line, and another with a word left out
    met = emitted.withColumn("m", F.col("n") - F.when(F.col("i") > 0, 1).otherwise(0))
    both = met.groupBy("key", "m").agg(
        F.min(F.when(F.col("i") == 0, F.col("id"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.struct("id", "i"))).alias("longer")
    ).where("whole IS NOT NULL AND longer IS NOT NULL")
    both = cut(both.select("key", "m", "whole", F.col("longer.id").alias("longer"), F.col("longer.i").alias("at")))
    whole = F.col("i") == 0
    resized = joined(met, both, ["key", "m"], "inner").select(
        "id", F.when(whole, F.col("longer")).otherwise(F.col("whole")).alias("other"), F.when(whole, F.col("at")).otherwise(F.col("i")).alias("i"), F.when(whole, 1).otherwise(-1).alias("more"),
    ).where("other < id")
    pairs = replaced.unionByName(resized).groupBy("id", "other", "more").agg(F.min("i").alias("i"))
    theirs = own.select(F.col("id").alias("other"), F.col("first").alias("before"), F.struct("s", "n").alias("u"))
    checked = pairs.join(own.select("id", "h1", "h2", F.struct("s", "n").alias("w")), "id").join(theirs, "other")

    def cut_out(line: str) -> Column:
        words, i = F.split(f"{line}.s", " "), F.col("i")
        return F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, i + 1, F.col(f"{line}.n") - i))

    words = lambda line: F.split(f"{line}.s", " ")
    exact = F.when(F.col("more") == 0, (F.col("w.n") == F.col("u.n")) & (cut_out("w") == cut_out("u")))
    exact = exact.when(F.col("more") == 1, cut_out("u") == words("w")).otherwise(cut_out("w") == words("u"))
    return checked.where(exact).groupBy("h1", "h2").agg(F.min("before").alias("first")), [own, emitted, same, both]


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the lines to drop taken out of ``text_col``, and ``line_dedup``, a
    struct of ``n_lines``, ``n_dropped`` and ``emptied`` (nothing but blanks is left of a text
    that lost lines)."""
    drop = dropped_lines(docs, min_words, fuzzy_words, id_col, text_col)
    drop = cut(drop.groupBy(F.col("doc").alias("key")).agg(F.collect_set("pos").alias("drop")))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("key"), docs[text_col].alias("text"))
    rows = joined(rows, drop, "key", "left").select("row", "text", "drop", F.split("text", "\n").alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    rows = rows.withColumn("kept", F.when(F.col("drop").isNotNull(), F.transform(places, lambda i: F.get("lines", i))))
    rows = rows.withColumn("left", F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")))
    n_dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("bigint")
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size("lines")).otherwise(0).cast("bigint")
    emptied = F.coalesce((n_dropped > 0) & ~F.col("left").rlike(r"\S"), F.lit(False))
    result = F.struct(n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), emptied.alias("emptied")).alias("line_dedup")
    kept = [F.col("left").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != "line_dedup"]
    return rows.select(*kept, result)
