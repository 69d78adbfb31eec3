"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct five-word shingles as 64-bit hashes; documents with equal
sets form one class. The order of shingles is by rarity: those below a cut of the hash range by
their document frequency over the whole corpus, then the others by hash. Two sets of a Jaccard
similarity of t share a shingle among the first ``n - ceil(t n) + 1`` of each, their prefixes.
Classes with an equal prefix and size form one group.

Groups that share a prefix shingle are paired if their sizes and the shingle's places in both
orders allow a link; of each pair the shared shingles are counted, and those that have too few of
them, whatever the rest of the sets holds, go. The pairs that are left are expanded to member
classes and verified on their whole sets.

Shingles in the prefixes of more than ``LISTED`` classes are not paired that way, as pairs would
grow with the square of the classes. The most typical group of such a shingle is its pivot: all
others are verified against it, a number of pairs linear in the postings. Members linked to it need
no pair among each other for the components. Where some are apart from it, members go whose
elements stand in no other set around the pivots, so many that they can be linked to none. Where many
are apart still, the member that differs least from the elements that most of them have takes the
pivot's place. What is still apart from its pivot is compared with the
pivot's other members: where few are apart, pair by pair within the bounds of the triangle
inequality; where many are, by a prefix join on their differences from the pivot. Two sets that are
linked while one lies beyond the threshold from the pivot must share a part of these differences
that their sizes give exactly. No pair that could connect two components is skipped. What is found
spans the components: not every link, nor how many links a text has.

Class identifiers and shingles are 64-bit hashes; a collision could move a similarity by one
shingle. Null, empty and blank texts have the empty set and link with nothing; texts of fewer
words than ``size`` are one shingle. Rows that share an id keep their own sets and rows. Ids may be
of any type with an order; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, joined, map_batches
from tessera.llm.components import components
from tessera.llm.words import SPACE, key_filter, may_hold, windows, words_of

SIZE, PERCENT = 5, 75
#: Classes of a shingle up to which they are compared pair by pair, and members apart from a pivot
#: up to which they are; beyond, around pivots and by differences. Both ways are exact.
LISTED = 16
#: Members of a pivot, about, whose majority says where its better centre is. Any centre gives the
#: same components; all members are candidates for it, and all are verified against it.
CENTRED = 64
#: Share of the hash range whose shingles are ordered by document frequency. More than the share of
#: a set that its prefix needs, so that a prefix holds the rarer ones of them alone.
CUT_SHARE = 0.36
CUT_HASH = int(CUT_SHARE * 2**64) - 2**63


@dataclass
class Sets:
    """The sets of a batch of texts: text k has the sorted signed hashes ``flat[first[k]:first[k + 1]]``."""

    flat: np.ndarray
    first: np.ndarray

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.first[k] : self.first[k + 1]]


def sets_of(column: pa.Array, size: int = SIZE) -> Sets:
    """The texts' shingles. Bytes are lower-cased and split as ASCII, which is what lower-casing
    A-Z and splitting at ASCII white space means."""
    words = words_of(column, SPACE)
    first, last = words.first[:-1], words.first[1:]
    counts = last - first
    sizes = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    ends = np.cumsum(sizes)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for width in range(1, size + 1):
        chosen = np.flatnonzero((counts >= size) if width == size else (counts == width))
        if len(chosen):
            every = windows(words.hashes, width)
            for k, at, n, end in zip(chosen.tolist(), first[chosen].tolist(), sizes[chosen].tolist(), ends[chosen].tolist(), strict=True):
                flat[end - n : end] = every[at : at + n]
    signed = (flat ^ np.uint64(1 << 63)).view(np.int64)
    begins = ends - sizes
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        signed[begin:end].sort()
    kept = np.ones(len(signed), bool)
    kept[1:] = signed[1:] != signed[:-1]
    kept[begins[sizes > 0]] = True
    total = np.concatenate([[0], np.cumsum(kept)])
    return Sets(signed[kept], total[np.concatenate([[0], ends])])


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """One text's set as sorted signed 64-bit hashes."""
    return sets_of(pa.array([text or ""]), size)[0]


def needed(n: int, percent: int) -> int:
    """The shingles in common that a set of n needs at least."""
    return -(-n * percent // 100)


def class_of(own: np.ndarray) -> int:
    digest = xxhash.xxh3_64_intdigest(own.tobytes())
    return digest - (1 << 64) if digest >= 1 << 63 else digest


def set_info(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``doc``, set size ``n``, shingles below the cut ``below`` and ``class`` (null: empty set)."""

    def rows(batch: pa.RecordBatch) -> dict:
        sets = sets_of(batch.column(1), size)
        n = np.diff(sets.first)
        low = np.concatenate([[0], np.cumsum(sets.flat < CUT_HASH)])[sets.first]
        return {"doc": batch.column(0), "n": n, "below": np.diff(low), "class": [class_of(sets[k]) if n[k] else None for k in range(len(n))]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), rows, f"doc {kind}, n bigint, below bigint, class bigint")


def _postings(docs: DataFrame, size: int, percent: int, text_col: str, often: Broadcast | None = None) -> DataFrame:
    """``token`` and ``class``: of each set the shingles below the cut, and as many after it as
    the prefix still needs, of those that the filter ``often`` passes. A slice's equal sets are
    emitted once."""

    def rows(batch: pa.RecordBatch) -> dict:
        sets, seen = sets_of(batch.column(0), size), set()
        tokens, classes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(batch.num_rows):
            own = sets[k]
            if len(own) and (key := class_of(own)) not in seen:
                seen.add(key)
                take = max(int(np.searchsorted(own, CUT_HASH)), len(own) - needed(len(own), percent) + 1)
                tokens.append(own[:take])
                classes.append(np.full(take, key, np.int64))
        token, key = np.concatenate(tokens), np.concatenate(classes)
        passed = may_hold(often.value, token) if often else slice(None)
        return {"token": token[passed], "class": key[passed]}

    return map_batches(docs.select(text_col), rows, "token bigint, class bigint")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``class`` and its sorted ``set`` for the classes of ``wanted`` (``class``, ``doc``)."""
    chosen = joined(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), wanted, "doc", "inner")

    def rows(batch: pa.RecordBatch) -> dict:
        sets, keys = sets_of(batch.column(1), size), batch.column(0).to_pylist()
        chosen = [k for k, key in enumerate(keys) if len(sets[k]) and class_of(sets[k]) == key]
        return {"class": [keys[k] for k in chosen], "set": [sets[k] for k in chosen]}

    return map_batches(chosen.select("class", "text"), rows, "class bigint, set array<bigint>").dropDuplicates(["class"])


def _shared(docs: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    """``token``, ``class`` and ``df`` of the postings whose token has others. A filter of the tokens
    that occur more than once keeps most others out of the shuffle; the join is exact."""
    df = _postings(docs, size, percent, text_col).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    df = cut(df)
    often = key_filter(df, "token")
    return cut(_postings(docs, size, percent, text_col, docs.sparkSession.sparkContext.broadcast(often)).join(df, "token"))


def _prefixes(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Each class's prefix shingles that other classes have too, in order, its group, and how
    frequent its shingles are on average (``typical``): copies with few changes come first."""
    own = shared.groupBy("class").agg(F.collect_set(F.struct("df", "token")).alias("own"))
    at = own.join(classes, "class").withColumn("k", F.expr(f"n - (n * {percent} + 99) div 100 + 1"))
    low = F.array_sort(F.filter("own", lambda x: x["token"] < CUT_HASH))
    high = F.array_sort(F.filter("own", lambda x: x["token"] >= CUT_HASH)["token"])
    at = at.select("class", "doc", "n", "k", "below", low.alias("low"), high.alias("high"))
    single = F.col("below") - F.size("low")  # shingles of this class alone come first
    room = F.greatest(F.lit(0), F.col("k") - single).cast("int")
    # of those beyond the cut, the postings hold more than the prefix needs
    prefix = F.concat(F.slice("low", F.lit(1), room)["token"], F.when(F.col("k") > F.col("below"), F.col("high")).otherwise(F.array().cast("array<bigint>")))
    alone = (single > 0) | (F.col("k") - F.col("below") > F.size("high"))
    typical = F.aggregate("low", F.lit(0.0), lambda total, x: total + F.log2(x["df"])) / F.greatest(F.lit(1), "below")
    at = at.select("class", "doc", "n", "below", single.alias("single"), prefix.alias("prefix"), alone.alias("alone"), typical.alias("typical"))
    at = at.where(F.size("prefix") > 0)
    return at.withColumn("same", F.when(F.col("alone"), F.xxhash64("class", F.lit(0))).otherwise(F.xxhash64("n", "prefix", F.lit(1)))).drop("alone")


def _needed_together(percent: int) -> Column:
    """The shingles that groups ``a`` and ``b`` must share for a link."""
    return F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))


def _listed_pairs(posted: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of classes that may be linked, from the shingles of few classes
    (``posted``: ``group``, ``n``, its place ``at`` of the ``token``, from 1 (null beyond the cut),
    and ``many``, the shingles of its prefix that are not among these)."""
    side = lambda x: posted.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("group", "n", "at", "many")))
    n_a, n_b, needed_both = F.col("n_a"), F.col("n_b"), _needed_together(percent)
    fits = (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (F.col("group_a") < F.col("group_b"))
    room = F.least("at_a", "at_b") + F.least(n_a - F.col("at_a"), n_b - F.col("at_b"))
    met = side("a").join(side("b"), "token").where(fits & F.coalesce(room >= needed_both, F.lit(True)))
    met = met.groupBy("group_a", "group_b").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("n_a", "n_b", "many_a", "many_b")))
    after = lambda n: F.expr(f"({n} * {percent} + 99) div 100 - 1")  # what follows the prefix
    most = F.col("shared") + F.least("many_a", "many_b") + F.greatest(after("n_a"), after("n_b"))
    met = met.where(most >= needed_both).select("group_a", "group_b")
    expand = lambda x: member.select(F.col("group").alias(f"group_{x}"), F.col("class").alias(x))
    return met.join(expand("a"), "group_a").join(expand("b"), "group_b").select("a", "b")


def _linked(n: Column, d: Column, percent: int) -> Column:
    """Whether two sets of ``n`` elements together that differ in ``d`` of them are similar."""
    return (100 + percent) * d <= (100 - percent) * n


def _with_set(rows: DataFrame, sets: DataFrame, x: str) -> DataFrame:
    """Adds ``set_x`` of the classes ``x``. Only sets that these have are shuffled."""
    wanted = cut(rows.select(F.col(x).alias("class")).distinct())
    own = joined(sets, wanted, "class", "left_semi").select(F.col("class").alias(x), F.col("set").alias(f"set_{x}"))
    return rows.join(own, x)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``set_a`` and ``set_b``."""
    return _with_set(_with_set(pairs, sets, "a"), sets, "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``, ``star``, their sizes, the elements ``d`` in one of them only, and ``link`` of
    each pair, on whole sets."""
    met = _with_sets(pairs, sets)
    size = lambda c: F.size(c).cast("bigint")
    met = met.select("a", "b", "star", size("set_a").alias("n_a"), size("set_b").alias("n_b"), size(F.array_intersect("set_a", "set_b")).alias("both"))
    met = met.withColumn("d", F.col("n_a") + F.col("n_b") - 2 * F.col("both")).drop("both")
    return cut(met.withColumn("link", _linked(F.col("n_a") + F.col("n_b"), F.col("d"), percent)))


def _side(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{name}") for c in ("b", "n_b", "d", "comp")), *columns)


def _fits(percent: int) -> Column:
    """Pairs across components that sizes and the triangle inequality leave."""
    n = F.col("n_b_x") + F.col("n_b_y")
    return (F.col("comp_x") != F.col("comp_y")) & _linked(n, F.abs(F.col("n_b_x") - F.col("n_b_y")), percent) & _linked(n, F.abs(F.col("d_x") - F.col("d_y")), percent)


def _posted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` and each ``token`` that one of both sets has alone."""
    diff = F.concat(F.array_except("set_b", "set_a"), F.array_except("set_a", "set_b"))
    return _with_sets(pairs.select("a", "b"), sets).select("a", "b", F.explode(diff).alias("token"))


def _differing(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a``, ``b``, ``token``, ``df`` and ``weight``: the elements in which b's set differs from
    a's and others' do too, how many of a's members do, and how many elements the row stands for:
    those that differ for the same members of a (a passage's) are one. Second, the table to discard
    after it."""
    posted = cut(_posted(pairs, sets))
    members = F.bit_xor(F.xxhash64("b", "a"))
    beside = posted.groupBy("a", "token").agg(F.count("*").alias("df"), members.alias("members")).where("df > 1")
    met = posted.join(beside, ["a", "token"]).groupBy("a", "b", "df", "members").agg(F.count("*").alias("weight"))
    return met.withColumnRenamed("members", "token"), posted


def _centred(many: DataFrame, sets: DataFrame) -> DataFrame:
    """For pivots with many members apart: ``old``, the member ``a`` that is nearest to what most
    members have, if it is nearer than the pivot, and each other member ``b``. Most means more than
    half of the members, or, of more than ``CENTRED`` members, of those with the least hashes, which
    are much the same for pivots of much the same members."""
    taken = cut(many.where((F.xxhash64("b") / 2.0**64 + 0.5) * F.col("members") < CENTRED).select("a", "b"))
    half = taken.groupBy("a").agg((F.count("*") / 2).alias("half"))
    usual = _posted(taken, sets).groupBy("a", "token").agg(F.count("*").alias("df")).join(half, "a").where("df > half")
    usual = cut(usual.groupBy("a").agg(F.collect_list("token").alias("usual")))
    middle = F.concat(F.array_except("set_a", "usual"), F.array_except("usual", "set_a"))
    middle = cut(_with_set(usual, sets, "a").select("a", middle.alias("middle")))
    members = many.select("a", "b").unionByName(many.select("a", F.col("a").alias("b")).distinct())
    members = cut(joined(members, middle.select("a"), "a", "left_semi"))
    near = joined(_with_set(members, sets, "b"), middle, "a", "inner")
    beyond = F.size("set_b") + F.size("middle") - 2 * F.size(F.array_intersect("set_b", "middle"))
    near = near.select("a", F.struct(beyond.alias("beyond"), (F.col("b") != F.col("a")).alias("other"), "b").alias("near"))
    centre = near.groupBy("a").agg(F.min("near").alias("near")).where("near.other").select("a", F.col("near.b").alias("centre"))
    out = cut(members.join(centre, "a").where("b <> centre").select(F.col("a").alias("old"), F.col("centre").alias("a"), "b"))
    discard(taken, usual, middle, members)
    return out


def _differences(many: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``b_x`` (apart from its pivot) and ``b_y`` that may be linked: with differences of d_x
    and d_y elements from the pivot they share d_x + d_y less what a link allows, halved, of these
    at least. The differences are in order of rarity among the pivot's members. Second, the table to
    discard after it."""
    up, down = 100 + percent, 100 - percent
    # what any partner of one apart shares with it, and what any member shares with a partner apart
    apart = F.expr(f"d - greatest(1, ceil(({up} * d - {down} * (n_b + n_a)) / {2 * up})) + 1")
    other = F.expr(f"d - greatest(0, floor(({up} * d - {down} * (n_b - n_a)) / {2 * up}))")
    own = many.select("a", "b", "n_b", "d", "comp", F.when(F.col("held"), 0).otherwise(apart).alias("probes"), other.alias("kept"))
    each = Window.partitionBy("a", "b")
    # elements that no other member shares come first, and need no row
    before = F.coalesce(F.sum("weight").over(each.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    differing, scratch = _differing(many, sets)
    met = differing.withColumn("at", before - F.sum("weight").over(each)).drop("df", "weight").join(own, ["a", "b"]).withColumn("at", F.col("at") + F.col("d"))
    posted = cut(met.where(F.col("at") < F.greatest("probes", "kept")))
    discard(scratch)
    x = _side(posted.where("at < probes"), "x", "a", "token", F.col("at").alias("at_x"))
    y = _side(posted.where("at < kept"), "y", "a", "token", F.col("at").alias("at_y"))
    shared = up * (F.col("d_x") + F.col("d_y")) - down * (F.col("n_b_x") + F.col("n_b_y"))
    enough = shared <= 2 * up * F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y"))
    met = x.withColumnRenamed("a", "a_x").withColumnRenamed("token", "token_x").join(y, (F.col("a_x") == F.col("a")) & (F.col("token_x") == F.col("token")) & _fits(percent) & enough)
    return met.select("b_x", "b_y"), posted


def _placed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Members ``b`` of pivots ``a`` that are not all in one component of the links: ``comp``,
    whether it is the pivot's (``held``), and how many are ``apart`` of the pivot's ``members``."""
    comp = components(found)
    of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    met = pairs.join(of("b"), "b", "left").join(of("a"), "a", "left").withColumn("comp", F.coalesce("b_comp", "b"))
    return _counted(cut(met.select("a", "b", "n_a", "n_b", "d", "comp", (F.col("comp") == F.coalesce("a_comp", "a")).alias("held"))))


def _counted(met: DataFrame) -> DataFrame:
    """Adds ``apart`` and ``members``, for pivots where there may be a link yet to find."""
    apart = met.groupBy("a").agg(F.count_if(~F.col("held")).alias("apart"), F.count("*").alias("members")).where("apart > 0 AND members > 1")
    return cut(met.join(apart, "a"))


def _with_partners(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``placed`` without the members that can be linked to no other class of it, as too many of
    their elements stand in no other. Those that a member shares with its nearest pivot do stand in
    another, and need no row."""
    pivots = cut(placed.select(F.col("a").alias("class")).distinct())
    near = placed.groupBy("b").agg(F.min(F.struct("d", "a"))["a"].alias("a"))
    near = cut(joined(near, pivots, near["b"] == pivots["class"], "left_anti"))
    own = _with_sets(near, sets).select(F.col("b").alias("class"), F.explode(F.array_except("set_b", "set_a")).alias("token"))
    own = own.unionByName(joined(sets, pivots, "class", "left_semi").select("class", F.explode("set").alias("token")))
    single = own.groupBy("token").agg(F.count("*").alias("df"), F.max("class").alias("b")).where("df = 1")
    single = cut(single.groupBy("b").agg(F.count("*").alias("single")))
    may = F.expr(f"n_b - coalesce(single, 0) >= (n_b * {percent} + 99) div 100")
    met = cut(joined(placed.drop("apart", "members"), single, "b", "left").where(may).drop("single"))
    out = _counted(met)
    discard(pivots, near, single, met)
    return out


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of members of one pivot, in different components so far, that may be linked."""
    few = placed.where(F.col("apart") <= LISTED)
    listed = _side(few.where("NOT held"), "x", F.col("a").alias("a_x")).join(_side(few, "y", "a"), (F.col("a_x") == F.col("a")) & _fits(percent)).select("b_x", "b_y")
    differing, scratch = _differences(placed.where(F.col("apart") > LISTED), sets, percent)
    found = listed.unionByName(differing)
    out = cut(found.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct())
    discard(scratch)
    return out


def links(docs: DataFrame, info: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``u``, ``v`` between classes that connect all that are similar, each verified: a
    spanning set, not all pairs within a component."""
    classes = cut(
        info.where("class IS NOT NULL").groupBy("class").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("below").alias("below"))
    )
    shared = _shared(docs, size, percent, text_col)
    grouped = cut(_prefixes(shared, classes, percent))
    discard(shared)
    of_group = grouped.groupBy("same").agg(F.max(F.struct("typical", "class"))["class"].alias("group"), F.count("*").alias("members"))
    member = cut(grouped.join(of_group, "same").select("class", "group", "members", "n", "below", "single", "prefix", "typical"))
    posted = member.where("class = group").select("group", "members", "n", "below", "typical", "single", F.posexplode("prefix").alias("at", "token"))
    posted = posted.withColumn("at", F.when(F.col("token") < CUT_HASH, F.col("at") + 1 + F.col("single"))).drop("single", "below")
    lists = posted.groupBy("token").agg(F.max(F.struct("typical", "group"))["group"].alias("pivot"), F.sum("members").alias("classes")).where("classes > 1")
    posted = cut(posted.drop("typical").join(lists, "token").withColumn("long", F.col("classes") > LISTED))
    many = cut(posted.groupBy("group").agg(F.count_if("long").alias("many"), F.first("members").alias("members")))
    # of shingles of many classes: all that have one against its pivot
    group_pairs = posted.where("long AND group <> pivot").select(F.col("pivot").alias("a"), "group").distinct()
    expanded = group_pairs.join(member.select("group", F.col("class").alias("b")), "group").select("a", "b")
    several = many.where("members > 1").select("group", "many")
    own = member.where("members > 1").join(several, "group")
    inside = own.where("many > 0 AND class <> group").select(F.col("group").alias("a"), F.col("class").alias("b"))
    # of shingles of few: pairs of groups, and of a group's members
    listed = _listed_pairs(posted.where("NOT long").join(many.select("group", "many"), "group"), member.select("group", "class"), percent)
    few = own.where("many = 0")
    within = few.select("group", F.col("class").alias("a")).join(few.select("group", F.col("class").alias("b")), "group").where("a < b").select("a", "b")
    stars = expanded.unionByName(inside).withColumn("star", F.lit(True))
    pairs = cut(stars.unionByName(listed.unionByName(within).withColumn("star", F.lit(False))).groupBy("a", "b").agg(F.max("star").alias("star")))
    discard(grouped, member, posted, many)
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = cut(ends.join(classes.select("class", "doc"), "class"))
    sets = cut(_sets(docs, wanted, size, id_col, text_col))
    discard(classes, wanted)
    first = _verified(pairs, sets, percent)
    discard(pairs)
    linked = lambda df: df.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = linked(first)
    placed = _placed(first.where("star").drop("star"), found)
    placed, before = _with_partners(placed, sets, percent), placed
    discard(before)
    centred = _centred(placed.where(F.col("apart") > LISTED), sets)
    again = before = None
    if not centred.isEmpty():
        again = _verified(cut(centred.select("a", "b").distinct().withColumn("star", F.lit(True))), sets, percent)
        found = found.unionByName(linked(again))
        rest = placed.join(centred.select(F.col("old").alias("a")).distinct(), "a", "left_anti").select("a", "b", "n_a", "n_b", "d")
        # a centre may be another shingle's pivot
        met = rest.unionByName(again.drop("star", "link")).dropDuplicates(["a", "b"])
        placed, before = _placed(met, found), placed
    last = _verified(across := _across(placed, sets, percent).withColumn("star", F.lit(True)), sets, percent)
    out = cut(found.unionByName(linked(last)))
    discard(first, centred, again, before, placed, across, last, sets)
    return out


def ngram_jaccard_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the least id reachable by links) of every
    row. A null id takes no part: its row is its own component, with a null component_id."""
    info = cut(set_info(docs, size, id_col, text_col))
    known = docs.where(F.col(id_col).isNotNull())
    found = info.where("doc IS NOT NULL")
    comp = components(links(known, found, size, percent, id_col, text_col))
    of_class = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"))
    in_comp = of_class.join(comp.withColumnRenamed("node", "class"), "class", "left")
    in_comp = cut(in_comp.where("copies > 1 OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "class")))
    least = in_comp.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = cut(in_comp.join(least, "comp").select("class", "component_id"))
    out = joined(info, named, "class", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))
