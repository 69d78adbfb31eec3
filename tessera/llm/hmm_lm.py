"""Language-model scoring by a hidden Markov model.

Latent states emit word classes: the most frequent words have a class each, the others one by
their ending, and within a class a word's probability is its share of the corpus counts, plus
one, unseen words together counting as one more. States and transitions are trained by
Baum-Welch: a start on a bounded sample in the driver, then rounds over all training texts, whose
expected counts are summed across partitions, until the likelihood settles or ``ROUNDS`` are over.
A text's likelihood is exact, by scaled forward recursion over its whole sequence.

Long texts are taken in pieces side by side without a cut in the model: the product of a piece's
transition and emission matrices carries the forward and the backward vectors exactly from piece to
piece, so that starts, transitions at the borders and likelihoods are those of the whole text.

Counts of all words are gathered from the whole corpus. The most frequent ``FREQUENT`` are
broadcast, a table of fixed size; occurrences of others meet their counts in a join. Words are
identified by 64-bit hashes. Null and empty texts hold the end alone. A null id is not held out.
Repeated rows give repeated results. Without training texts all words are unseen and states are
uniform. Ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import _arrow_schema, cut, discard, give_back, in_chunks, map_batches
from tessera.llm.toxicity import held_out
from tessera.llm.words import SPACE, Words, mixed, words_of

#: Latent states, words with a class of their own, classes by ending, words in the broadcast table.
STATES, OWN, ENDINGS, FREQUENT = 8, 4096, 2048, 1 << 18
#: The start: texts and bytes of text at most, and rounds in the driver. Then rounds over all
#: training texts at most, and the gain of the likelihood of a token below which they end.
START_TEXTS, START_BYTES, START_ROUNDS, ROUNDS, SETTLED = 400, 2 << 20, 12, 3, 1e-3
#: Tokens of a piece, and steps of a recursion between scalings.
PIECE = 256
#: Tokens that are trained on at once (two bytes each as codes).
BATCH = 400_000
#: The end's hash; no word has it but by chance.
END = -(1 << 62) - 12345
SMOOTH = 0.05


def ending_classes(words: Words, chosen: np.ndarray) -> np.ndarray:
    """A class for each chosen word by its last three bytes, lower-cased."""
    code, starts, ends = np.zeros(len(chosen), np.uint64), words.starts[chosen], words.ends[chosen]
    for k in (3, 2, 1):
        at = ends - k
        byte = np.where(at >= starts, words.data[np.maximum(at, 0)] if len(words.data) else 0, 0)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        code = code * np.uint64(256) + byte.astype(np.uint64)
    return (mixed(code * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ENDINGS)).astype(np.int64)


def with_ends(words: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text's words and ``end`` after them, flat; where each text begins."""
    first = words.first + np.arange(len(words.first))
    out = np.full(len(values) + len(words.first) - 1, end, np.int64)
    places = np.arange(len(values)) + np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out[places] = values
    return out, first


def count_words(training: DataFrame) -> DataFrame:
    """``hash``, ``ending`` and count ``c`` of every distinct token of the texts (column 0)."""

    def rows(batch: pa.RecordBatch) -> dict:
        words = words_of(batch.column(0), SPACE)
        hashes, at, counts = np.unique(words.hashes.view(np.int64), return_index=True, return_counts=True)
        endings = ending_classes(words, at)
        end = [END], [0], [batch.num_rows]
        return {k: np.concatenate([x, e]) for k, x, e in zip(("hash", "ending", "c"), (hashes, endings, counts), end, strict=True)}

    found = map_batches(training, rows, "hash bigint, ending int, c bigint")
    return found.groupBy("hash").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, frequent: int) -> pd.DataFrame:
    """The words of the largest counts, in order, all that share a count or none: a table of fixed
    size. The least count comes from the histogram of counts, which has few rows."""
    histogram = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for c, n in histogram:
        total += n
        if total > frequent:
            break
        least = c
    found = counts.where(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()
    c, key, last = (found.column(x).to_numpy() for x in ("c", "hash", "ending"))
    order = np.lexsort((key, -c))
    return pd.DataFrame({"hash": key[order], "ending": last[order], "c": c[order]})


class Vocabulary:
    """The frequent words' counts and classes. Classes 0..OWN-1 are words, then endings; the end
    has the last."""

    CLASSES = OWN + ENDINGS + 1

    def __init__(self, hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray):
        """Words in order of frequency."""
        rank = np.arange(len(hashes))
        classes = np.where(rank < OWN, rank, OWN + endings)
        classes[hashes == END] = OWN + ENDINGS
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], classes[order].astype(np.int32)
        self.log_counts = np.log10(counts[order] + 1.0)
        #: whether the word's class is its own
        self.single = (self.classes < OWN) | (self.classes == OWN + ENDINGS)

        # a hash table with open addresses, a fourth full at most
        bits = max(4, int(4 * len(hashes)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        for place, slot in enumerate((self.hashes.view(np.uint64) & self.mask).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & int(self.mask)
            self.slots[slot] = place

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the table, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        left, slot = np.arange(len(hashes)), hashes.view(np.uint64) & self.mask
        while len(left) and len(self.hashes):
            at = self.slots[slot]
            own = self.hashes[at] == hashes[left]
            hit = own & (at >= 0)
            out[left[hit]] = at[hit]
            more = np.flatnonzero((at >= 0) & ~own)
            left, slot = left[more], (slot[more] + np.uint64(1)) & self.mask
        return out

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts' tokens, flat: hashes, places and classes; and where each text begins."""
        words = words_of(column, SPACE)
        places = self.places(words.hashes.view(np.int64))
        classes = self.classes[places].astype(np.int64) if len(self.classes) else np.zeros(len(places), np.int64)
        unknown = np.flatnonzero(places < 0)
        classes[unknown] = OWN + ending_classes(words, unknown)
        hashes, first = with_ends(words, words.hashes.view(np.int64), END)
        end = self.places(np.array([END]))[0]
        return hashes, with_ends(words, places, end)[0], with_ends(words, classes, OWN + ENDINGS)[0], first


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        start, moves, emits = start + SMOOTH, moves + SMOOTH, emits + SMOOTH
        self.start = start / start.sum()
        self.moves = moves / moves.sum(1, keepdims=True)
        self.by_class = np.ascontiguousarray((emits / emits.sum(1, keepdims=True)).T)

    @classmethod
    def first(cls, classes: np.ndarray) -> Model:
        """Emissions as in the corpus, shaken, and states that rather stay."""
        random = np.random.default_rng(7)
        counts = np.bincount(classes, minlength=Vocabulary.CLASSES) + 0.1
        emits = counts * random.gamma(2.0, 1.0, (STATES, Vocabulary.CLASSES))
        return cls(np.ones(STATES), np.eye(STATES) * 20 + 1, emits)


@dataclass
class Pieces:
    """Texts in pieces, longest first: ``starts`` in the flat tokens, ``lengths``, the ``text`` and
    the place ``nth`` in it of each, and for each step how many pieces go on (``active``)."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    nth: np.ndarray
    active: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, first: np.ndarray) -> Pieces:
        sizes = np.diff(first)
        counts = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = first[text] + nth * PIECE
        lengths = np.minimum(PIECE, first[text + 1] - starts)
        order = np.argsort(-lengths, kind="stable")
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        return cls(flat, starts[order], lengths[order], text[order], nth[order], active)


def _transfers(model: Model, p: Pieces, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled product of the matrices of each of the ``chosen`` pieces (in their order), and
    the logarithm of its scale."""
    starts, lengths = p.starts[chosen], p.lengths[chosen]
    out = np.broadcast_to(np.eye(STATES), (len(chosen), STATES, STATES)).copy()
    logs = np.zeros(len(chosen))
    for t in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        now = (out[:n].reshape(-1, STATES) @ model.moves).reshape(n, STATES, STATES) * model.by_class[p.flat[starts[:n] + t]][:, None, :]
        if t % 8 == 7 or t + 1 == lengths[0] or n < len(out):
            scale = now.sum((1, 2))
            now /= scale[:, None, None]
            logs[:n] += np.log(scale)
        out[:n] = now
    scale = out.sum((1, 2))
    return out / scale[:, None, None], logs + np.log(scale)


def _forward(model: Model, p: Pieces, chosen: np.ndarray, begin: np.ndarray, keep: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each chosen piece's last forward vector, scaled, and the logarithm of all scales; ``begin`` are
    the probabilities of states before the first emission. ``keep`` gets each token's vector and scale."""
    starts, lengths = p.starts[chosen], p.lengths[chosen]
    out, logs = begin.copy(), np.zeros(len(chosen))
    ones = np.ones(STATES)
    for t in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        at = starts[:n] + t
        now = (out[:n] @ model.moves if t else out[:n]) * model.by_class[p.flat[at]]
        scale = now @ ones
        now /= scale[:, None]
        logs[:n] += np.log(scale)
        out[:n] = now
        if keep is not None:
            keep[0][at], keep[1][at] = now, scale
    return out, logs


def _chained(model: Model, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece: the state probabilities before its first emission (``begin``), the backward
    vector at its last token up to a factor (``after``), and each text's log likelihood."""
    n_texts = int(p.text.max(initial=-1)) + 1
    head = np.flatnonzero(p.nth == 0)
    begin, after = np.broadcast_to(model.start, (len(p.starts), STATES)).copy(), np.ones((len(p.starts), STATES))
    ends, logs = _forward(model, p, head, begin[head])
    total, last = np.zeros(n_texts), np.zeros((n_texts, STATES))
    total[p.text[head]], last[p.text[head]] = logs, ends
    rest = np.flatnonzero(p.nth > 0)
    if len(rest):
        matrices, scales = _transfers(model, p, rest)
        by_nth = [np.flatnonzero(p.nth[rest] == k) for k in range(1, int(p.nth.max()) + 1)]
        for at in by_nth:
            text = p.text[rest[at]]
            begin[rest[at]] = last[text] @ model.moves
            now = np.einsum("ni,nij->nj", last[text], matrices[at])
            own = now.sum(1)
            total[text] += scales[at] + np.log(own)
            last[text] = now / own[:, None]
        behind = np.ones((n_texts, STATES))
        piece = np.full((n_texts, len(by_nth) + 1), -1)
        piece[p.text, p.nth] = np.arange(len(p.text))
        for k in range(len(by_nth), 0, -1):
            at = by_nth[k - 1]
            text = p.text[rest[at]]
            now = np.einsum("nij,nj->ni", matrices[at], behind[text])
            behind[text] = now / now.sum(1)[:, None]
            after[piece[text, k - 1]] = behind[text]
    return begin, after, total


def log_likelihoods(model: Model, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural logarithm of each text's probability (``flat`` classes, none empty)."""
    return _chained(model, Pieces.of(flat, first))[2]


def expected_counts(model: Model, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, transitions and emissions of the texts, and their log likelihood."""
    p = Pieces.of(flat, first)
    begin, after, total = _chained(model, p)
    alpha, scale = np.empty((len(flat), STATES)), np.empty(len(flat))
    every = np.arange(len(p.starts))
    ends, _ = _forward(model, p, every, begin, (alpha, scale))
    beta_end = after / np.einsum("ni,ni->n", ends, after)[:, None]
    moves, turned = np.zeros((STATES, STATES)), model.moves.T.copy()
    beta = np.ones((0, STATES))
    for t in range(len(p.active) - 1, -1, -1):
        n, later = int(p.active[t]), len(beta)
        at = p.starts[:n] + t
        back = beta_end[:n].copy()
        if later:
            following = at[:later] + 1
            ahead = model.by_class[flat[following]] * beta / scale[following][:, None]
            moves += alpha[at[:later]].T @ ahead
            back[:later] = ahead @ turned
        alpha[at] *= back  # now the posterior
        beta = back
    # transitions from a piece's last token to the next one's first
    rest = np.flatnonzero(p.nth > 0)
    if len(rest):
        at = p.starts[rest]
        before = np.empty((len(rest), STATES))
        where = {(int(x), int(k)): i for i, (x, k) in enumerate(zip(p.text, p.nth, strict=True))}
        before[:] = ends[[where[int(p.text[i]), int(p.nth[i]) - 1] for i in rest]]
        # the first token's backward vector, from its posterior
        first_beta = alpha[at] / np.maximum((begin[rest] * model.by_class[flat[at]]) / scale[at][:, None], 1e-300)
        moves += before.T @ (model.by_class[flat[at]] * first_beta / scale[at][:, None])
    start = alpha[p.starts[p.nth == 0]].sum(0)
    emitted = np.stack([np.bincount(flat, alpha[:, k], Vocabulary.CLASSES) for k in range(STATES)])
    return start, moves * model.moves, emitted, float(total.sum())


def _start_texts(training: DataFrame) -> list[str]:
    """The start's sample: of the texts in order of a hash of their ids, as many as its bounds let in."""
    key = F.xxhash64("id")
    sizes = training.where("id IS NOT NULL").select("id", key.alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    # twice as many as are wanted, from a part of the hash range that holds them
    share = min(1.0, 8 * START_TEXTS / max(1, sizes.count()))
    if share < 1:
        sizes = sizes.where(F.col("key") < int((2 * share - 1) * (1 << 63)))
    chosen, held = [], 0
    for r in sizes.orderBy("key", "id").limit(2 * START_TEXTS).collect():
        if held + r.size <= START_BYTES and len(chosen) < START_TEXTS:
            chosen.append(r.id)
            held += r.size
    kind = training.schema["id"].dataType.simpleString()
    wanted = training.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(chosen)], f"id {kind}")
    # rows that share an id give one text
    found = training.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return [r.text for r in found.orderBy(F.xxhash64("id"), "id").collect()]


def train(training: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model, from all texts of ``training`` (columns id and text)."""
    sample = _start_texts(training)
    _, _, flat, first = vocabulary.coded(pa.array(sample, pa.string()))
    model, before = Model.first(flat), None
    for _ in range(START_ROUNDS if sample else 0):
        model = Model(*expected_counts(model, flat, first)[:3])
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)

    def codes(batch: pa.RecordBatch) -> dict:
        _, _, classes, begin = shared.value.coded(batch.column(0))
        classes = classes.astype(np.int16)
        return {"codes": [classes[i:j].tobytes() for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]}

    coded = cut(map_batches(training.select("text"), codes, "codes binary"))  # read in each round
    schema = "kind int, item int, " + ", ".join(f"s{k} double" for k in range(STATES))
    arrow = _arrow_schema(StructType.fromDDL(schema))
    for _ in range(rounds if sample else 0):
        shared = training.sparkSession.sparkContext.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            start, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, Vocabulary.CLASSES))
            score, tokens = 0.0, 0
            for batch in batches:
                for part in in_chunks(batch, 2 * BATCH):
                    column = part.column(0)
                    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
                    flat = np.frombuffer(column.buffers()[2], np.int16)[first[0] : first[-1]].astype(np.int64)
                    first = first - first[0]
                    own = expected_counts(model, flat, first)
                    start, moves, emits = start + own[0], moves + own[1], emits + own[2]
                    score, tokens = score + own[3], tokens + len(flat)
            used = np.flatnonzero(emits.any(0))
            table = np.concatenate([start[None], moves, emits.T[used], [[score, tokens] + [0.0] * (STATES - 2)]])
            kinds = np.repeat([0, 1, 2, 3], [1, STATES, len(used), 1]).astype("int32")
            items = np.concatenate([[0], np.arange(STATES), used, [0]]).astype("int32")
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(items), *(pa.array(table[:, k]) for k in range(STATES))], schema=arrow)
            give_back()

        found = coded.mapInArrow(sums, schema).groupBy("kind", "item").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)))
        rows = found.toPandas()  # one row a class at most
        start, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, Vocabulary.CLASSES))
        values, likelihood = rows[[f"s{k}" for k in range(STATES)]].to_numpy(float), 0.0
        for kind, item, row in zip(rows["kind"], rows["item"], values, strict=True):
            if kind == 0:
                start = row
            elif kind == 1:
                moves[item] = row
            elif kind == 2:
                emits[:, item] = row
            else:
                likelihood = row[0] / max(row[1], 1)
        model = Model(start, moves, emits)
        shared.unpersist()
        if before is not None and likelihood - before < SETTLED:
            break
        before = likelihood
    discard(coded)
    return model


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (the
    unigram model's) and ``score`` (the hidden Markov model's log10 probability) of every row."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col), modulus, remainder).alias("held"))
    training = own.where("NOT held").select("id", "text")
    counts = cut(count_words(training.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, frequent)
    vocabulary = Vocabulary(top["hash"].to_numpy(np.int64), top["ending"].to_numpy(np.int64), top["c"].to_numpy(np.int64))
    # what a class's words weigh together: counts plus one each, and one for the unseen
    mass = np.zeros(Vocabulary.CLASSES)
    for r in counts.groupBy("ending").agg(F.sum(F.col("c") + 1).alias("m")).collect():  # ENDINGS rows
        mass[OWN + r.ending] = r.m
    head = top[: min(OWN, len(top))]
    np.subtract.at(mass, OWN + head["ending"].to_numpy(int), head["c"].to_numpy(float) + 1)
    in_tail = top[OWN:]
    for r in in_tail[in_tail["hash"] == END].itertuples():
        mass[OWN + r.ending] -= r.c + 1
    log_mass = np.log10(np.maximum(mass, 0) + 1)
    log_mass[:OWN] = log_mass[-1] = 0
    model = train(training, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, model, log_mass))
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, held boolean, n bigint, known bigint, logs double, single double, mass double, path double"
    schema = f"row bigint, hash bigint, n bigint, doc struct<{fields.replace(' ', ': ').replace(',: ', ', ')}>"

    def rows(batch: pa.RecordBatch) -> dict:
        vocabulary, model, log_mass = shared.value
        hashes, places, classes, first = vocabulary.coded(batch.column(3))
        known = places >= 0
        logs = np.where(known, vocabulary.log_counts[places] if len(vocabulary.hashes) else 0.0, 0.0)
        single = np.where(known & vocabulary.single[places], logs, 0.0) if len(vocabulary.hashes) else logs * 0
        sums = lambda x: np.add.reduceat(x, first[:-1]).tolist()  # every text has its end
        paths = (log_likelihoods(model, classes, first) / np.log(10)).tolist()
        columns = [batch.column(1).to_pylist(), batch.column(2).to_pylist(), np.diff(first).tolist(), *map(sums, (known.astype(np.int64), logs, single, log_mass[classes])), paths]
        names = ("id", "held", "n", "known", "logs", "single", "mass", "path")
        docs = [dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True)]
        row = batch.column(0).to_numpy()
        # a text's words beyond the table, each once with its number
        rare = np.flatnonzero(~known)
        owner = np.searchsorted(first, rare, side="right") - 1
        order = np.lexsort((hashes[rare], owner))
        owner, rare = owner[order], hashes[rare][order]
        begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1]))) if len(rare) else np.zeros(0, int)
        times = np.diff(np.append(begin, len(rare)))
        # a document's own row meets no word; it gets a hash, lest all of them go to one task
        apart = (mixed(row.astype(np.uint64) + np.uint64(1)) >> np.uint64(1)).astype(np.int64)
        return {
            "row": np.concatenate([row, row[owner[begin]]]), "hash": np.concatenate([apart, rare[begin]]), "n": np.concatenate([np.zeros(len(row), np.int64), times]),
            "doc": docs + [None] * len(begin),
        }

    met = map_batches(own.select(F.monotonically_increasing_id().alias("row"), "id", "held", "text"), rows, schema)
    met = met.join(counts.select("hash", "c"), "hash", "left").withColumn("c", F.when(F.col("doc").isNull(), F.col("c")))
    sums = met.groupBy("row").agg(
        F.max("doc").alias("doc"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
    )
    logs = F.col("doc.logs") + F.col("logs")
    return sums.select(
        F.col("doc.id").alias(id_col), F.col("doc.held").alias("held_out"), F.col("doc.n").alias("n_tokens"),
        (F.col("doc.known") + F.col("known")).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (logs - F.col("doc.n") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("doc.path") + logs - F.col("doc.single") - F.col("doc.mass")).alias("score"),
    )
