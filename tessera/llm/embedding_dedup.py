"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are turned onto the principal axes of all vectors, so that the leading dimensions hold most
of each, and dealt into blocks by their first coordinate. Pairs of blocks whose first coordinates
lie further apart than the threshold allows are never formed. A pair of blocks is compared tile by
tile: products are summed over the leading dimensions first, the rest of a product is bounded by
the norms of the suffixes (the norm is one more dimension of the leading product, so that one
multiplication gives the bound), and what cannot reach the threshold stops there. The others go on
over twice the dimensions, then over all. Pairs within 1e-9 of the threshold are decided by the
cosine of the vectors as given.

The number of block pairs grows with the square of the vectors; a vector is sent to as many tasks as
there are blocks near its own. A block holds ``BLOCK_BYTES`` at most, and there are enough of them
for the cluster's cores.

Equal vectors form one class, counted with its members, so that a third of all rows being copies
costs one vector. A pair of blocks returns the number of links of each of its vectors and a
spanning forest of the links, never the pairs themselves.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
Vectors of different lengths are compared among their own. Rows that share an id are counted as
vectors of their own; a null id is a vector like others. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import _arrow_schema, cut, discard, joined, map_batches
from tessera.llm.components import components

THRESHOLD = 0.95
#: Bytes of a block's vectors at most, vectors of a tile, vectors below which a length is one block.
BLOCK_BYTES, TILE, ALONE = 8 << 20, 512, 2048
#: Lengths that get axes of their own (those of most vectors, up to that length); others keep their
#: order of dimensions, which costs time only.
AXES, WIDEST = 8, 1024
#: Share of a vector's square that the leading dimensions leave to the suffix.
SUFFIX = 0.7


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec``, ``raw`` (doubles as bytes, scaled by a power of two; null if it links with nothing)
    and its digest ``h1``, ``h2``."""

    def rows(batch: pa.RecordBatch) -> dict:
        column = batch.column(1)
        flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
        raw, keys = [], []
        for start, end in zip([0, *ends], ends, strict=False):
            x = flat[start:end]
            most = np.abs(x).max() if end > start else 0.0
            if 0 < most < math.inf:  # not so for NaN
                x = np.ldexp(x, -math.frexp(most)[1]) + 0.0
                raw.append(x.tobytes())
                keys.append(xxhash.xxh3_128_digest(raw[-1]))
            else:
                raw.append(None)
                keys.append(None)
        half = lambda k, at: None if k is None else int.from_bytes(k[at : at + 8], "little", signed=True)
        return {"vec": batch.column(0), "raw": raw, "h1": [half(k, 0) for k in keys], "h2": [half(k, 8) for k in keys]}

    kind = vectors.schema[id_col].dataType.simpleString()
    return map_batches(vectors.select(id_col, vector_col), rows, f"vec {kind}, raw binary, h1 bigint, h2 bigint")


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(-1, width)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_width(raw: list[bytes]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        places.setdefault(len(r) // 8, []).append(i)
    return places


def principal_axes(kinds: DataFrame, widths: list[int]) -> dict[int, np.ndarray]:
    """For each of the lengths: eigenvectors of the second moments over all its vectors, those of
    most weight first."""
    arrow = _arrow_schema(StructType.fromDDL("width int, i int, j int, s double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for width, at in _by_width(raw).items():
                x = _units(_matrix([raw[i] for i in at], width))
                sums[width] = sums.get(width, 0) + x.T @ x
        for w, s in sums.items():
            columns = [np.full(w * w, w), np.repeat(np.arange(w), w), np.tile(np.arange(w), w)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(s.ravel())], schema=arrow)

    chosen = kinds.where((F.length("raw") / 8).isin(widths)).select("raw")
    sums = chosen.mapInArrow(run, "width int, i int, j int, s double").groupBy("width", "i", "j").agg(F.sum("s").alias("s"))
    moments = {w: np.zeros((w, w)) for w in widths}
    found = sums.toPandas()  # AXES x WIDEST x WIDEST rows at most
    for w, own in found.groupby("width"):
        moments[w][own["i"], own["j"]] = own["s"]
    axes = {}
    for w, m in moments.items():
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        axes[w] = np.ascontiguousarray(vectors[:, np.argsort(-values)])
    return axes


class Side:
    """A block's vectors in order of the first coordinate: turned, their suffix norms, and as given."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray | None):
        turned = _units(raw) @ axes if axes is not None else _units(raw)
        self.order = np.argsort(turned[:, 0], kind="stable")
        self.raw, self.x = raw[self.order], turned[self.order]
        self.suffix = np.sqrt(np.maximum(0, np.cumsum((self.x**2)[:, ::-1], axis=1)[:, ::-1]))

    def lead(self) -> int:
        """The leading dimensions that leave ``SUFFIX`` of the squares to the rest on average."""
        left = (self.suffix**2).mean(0)
        return int(np.argmax(left <= SUFFIX)) if (left <= SUFFIX).any() else self.x.shape[1]

    def leading(self, n: int) -> np.ndarray:
        rest = self.suffix[:, n : n + 1] if n < self.x.shape[1] else np.zeros((len(self.x), 1))
        return np.concatenate([self.x[:, :n], rest], axis=1).astype(np.float32)


def _exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray, products: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs are linked; those near the threshold by the cosine of the vectors as given."""
    out = products >= threshold
    near = np.flatnonzero(np.abs(products - threshold) < 1e-9)
    if len(near):
        x, y = a.raw[i[near]], b.raw[j[near]]
        dot = lambda p, q: np.einsum("ij,ij->i", p, q)
        out[near] = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))) >= threshold
    return out


def tiles_linked(a: Side, b: Side, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of each pair of tiles, as places (i, j) in the two sides; for one side with
    itself (``same``) each pair once."""
    n = min(a.lead(), b.lead())
    lead_a = a.leading(n)
    lead_b = lead_a if same else b.leading(n)
    radius, width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9, a.x.shape[1]
    twice = min(width, 2 * n)
    rest = lambda s, k: s.suffix[k, twice] if twice < width else 0.0
    for p in range(0, len(a.x), TILE):
        own = slice(p, min(p + TILE, len(a.x)))
        for q in range(p if same else 0, len(b.x), TILE):
            other = slice(q, min(q + TILE, len(b.x)))
            if b.x[q, 0] - a.x[own.stop - 1, 0] > radius:
                break  # tiles are in order of the first coordinate
            if a.x[p, 0] - b.x[other.stop - 1, 0] > radius:
                continue
            bound = lead_a[own] @ lead_b[other].T
            alive = np.flatnonzero(bound.ravel() >= np.float32(threshold - 1e-5))
            if not len(alive):
                continue
            if len(alive) * 30 > bound.size:  # many: all dimensions of the whole tile
                products = (a.x[own] @ b.x[other].T).ravel()
                alive = np.flatnonzero(products >= threshold - 1e-9)
                products = products[alive]
                i, j = np.divmod(alive, bound.shape[1])
                i, j = i + p, j + q
            else:
                i, j = np.divmod(alive, bound.shape[1])
                i, j = i + p, j + q
                partial = np.einsum("ij,ij->i", a.x[i, :twice], b.x[j, :twice])
                left = partial + rest(a, i) * rest(b, j) >= threshold - 1e-9
                i, j = i[left], j[left]
                products = partial[left]
                if twice < width:
                    products = products + np.einsum("ij,ij->i", a.x[i, twice:], b.x[j, twice:])
                kept = products >= threshold - 1e-9
                i, j, products = i[kept], j[kept], products[kept]
            if same and p == q:
                once = i < j
                i, j, products = i[once], j[once], products[once]
            linked = _exact(a, b, i, j, products, threshold)
            if linked.any():
                yield i[linked], j[linked]


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links i-j: (node, least node of its tree) of all but the least."""
    nodes, places = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = places[: len(i)], places[len(i) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def compare_blocks(table: pa.Table, axes: dict[int, np.ndarray], threshold: float) -> dict[str, np.ndarray]:
    """Of one pair of blocks (columns ``side``, ``id``, ``copies``, ``raw``; one side if it is a
    block with itself): ``u`` and its number of ``links``, and ``u``, ``v`` of a spanning forest."""
    first = table.column("side").to_numpy() == 0
    raw = table.column("raw").to_pylist()
    width = len(raw[0]) // 8
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    at = [np.flatnonzero(first), np.flatnonzero(~first)]
    same = not len(at[0]) or not len(at[1])
    sides = [Side(_matrix([raw[k] for k in places], width), axes.get(width)) for places in at if len(places)]
    places = [p[s.order] for p, s in zip([p for p in at if len(p)], sides, strict=True)]
    mine, other = places[0], places[-1]
    links, u, v = np.zeros(len(ids), np.int64), [], []
    for i, j in tiles_linked(sides[0], sides[-1], threshold, same):
        i, j = mine[i], other[j]
        links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
        ends = forest(i, j)
        u.append(ends[0]), v.append(ends[1])
    if u:
        u, v = forest(np.concatenate(u), np.concatenate(v))
    counted = np.flatnonzero(links)
    none = np.zeros(0, np.int64)
    return {
        "u": np.concatenate([ids[counted], ids[u] if len(u) else none]), "v": np.concatenate([np.full(len(counted), -1), ids[v] if len(v) else none]),
        "links": np.concatenate([links[counted], np.zeros(len(u), np.int64)]),
    }


def _blocks(placed: DataFrame, threshold: float, cores: int) -> tuple[DataFrame, DataFrame]:
    """``id`` with its ``block``, and for each block the pairs (``block_x``, ``block_y``)
    that it is in, and its ``side``."""
    total = placed.agg(F.sum(F.col("width").cast("bigint"))).first()[0] or 0
    wanted = max(1, math.ceil(math.sqrt(6 * cores)), math.ceil(8 * total / BLOCK_BYTES))
    cuts = [k / wanted for k in range(1, wanted)]
    at = placed.groupBy("width").agg(F.count("*").alias("n"), (F.percentile_approx("a", cuts, 20 * wanted) if cuts else F.array().cast("array<double>")).alias("cuts"))
    at = cut(at.select("width", F.when(F.col("n") > ALONE, F.col("cuts")).otherwise(F.array().cast("array<double>")).alias("cuts")))
    ranged = joined(placed, at, "width", "inner").select("id", "width", "a", F.size(F.filter("cuts", lambda c: c < F.col("a"))).alias("range"))
    sizes = cut(ranged.groupBy("width", "range").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("a").alias("high")))
    parts = F.ceil(F.col("n") * F.col("width") * 8 / BLOCK_BYTES).cast("int")
    own = cut(sizes.select("width", "range", "low", "high", parts.alias("parts")))
    dealt = joined(ranged, own.select("width", "range", "parts"), ["width", "range"], "inner")
    dealt = dealt.select("id", F.xxhash64("width", "range", F.pmod(F.xxhash64("id"), "parts")).alias("block"))
    each = own.select("width", "low", "high", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "range")
    each = cut(each.select("width", "low", "high", F.xxhash64("width", "range", F.col("part").cast("bigint")).alias("block")))
    x, y = (each.select("width", *(F.col(c).alias(f"{c}_{s}") for c in ("low", "high", "block"))) for s in "xy")
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    near = (F.col("block_x") <= F.col("block_y")) & (F.col("low_x") - F.col("high_y") <= radius) & (F.col("low_y") - F.col("high_x") <= radius)
    pairs = x.join(y, "width").where(near).select("block_x", "block_y")
    sides = pairs.select(F.col("block_x").alias("block"), "block_x", "block_y", F.lit(0).alias("side")).unionByName(
        pairs.where("block_x <> block_y").select(F.col("block_y").alias("block"), "block_x", "block_y", F.lit(1).alias("side"))
    )
    return dealt, cut(sides)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row. A null id never names a
    component unless all of its component are null."""
    spark = vectors.sparkSession
    found = cut(_vectors(vectors, id_col, vector_col))
    kinds = found.where("raw IS NOT NULL").groupBy("h1", "h2").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("vec").alias("least"))
    kinds = cut(kinds.withColumn("id", F.monotonically_increasing_id()))
    often = kinds.groupBy((F.length("raw") / 8).cast("int").alias("width")).agg(F.count("*").alias("n")).where(f"width BETWEEN 2 AND {WIDEST}")
    widths = [r.width for r in often.orderBy(F.desc("n"), "width").limit(AXES).collect()]
    axes = spark.sparkContext.broadcast(principal_axes(kinds, widths) if widths else {})

    def first_coordinate(batch: pa.RecordBatch) -> dict:
        raw = batch.column(1).to_pylist()
        out = np.zeros(len(raw))
        for width, at in _by_width(raw).items():
            x = _units(_matrix([raw[i] for i in at], width))
            out[at] = x @ axes.value[width][:, 0] if width in axes.value else x[:, 0]
        return {"id": batch.column(0), "width": [len(r) // 8 for r in raw], "a": out}

    placed = cut(map_batches(kinds.select("id", "raw"), first_coordinate, "id bigint, width int, a double"))
    dealt, sides = _blocks(placed, threshold, spark.sparkContext.defaultParallelism)
    sent = joined(kinds.select("id", "copies", "raw").join(dealt, "id"), sides, "block", "inner").select("block_x", "block_y", "side", "id", "copies", "raw")
    schema = _arrow_schema(StructType.fromDDL("u bigint, v bigint, links bigint"))

    def compared(table: pa.Table) -> pa.Table:
        out = compare_blocks(table, axes.value, threshold)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    results = cut(sent.groupBy("block_x", "block_y").applyInArrow(compared, "u bigint, v bigint, links bigint"))
    discard(placed, sides)
    comp = components(results.where("v >= 0").select("u", "v"))
    counts = results.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    known = kinds.select("id", "h1", "h2", "copies", "least").join(counts, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    known = cut(known.withColumn("comp", F.coalesce("comp", "id")).withColumn("n", F.coalesce("links", F.lit(0)) + F.col("copies") - 1))
    discard(kinds, results)
    least = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = cut(known.where("n > 0").join(least, "comp").select("h1", "h2", "n", "component_id"))
    out = joined(found.select("vec", "h1", "h2"), named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec") == component, F.lit(False)).alias("kept"))
