"""Toxicity by a weighted finite-state pattern grammar.

Sequential weighted transducers read a clause's words as symbols: insults (with a weight that is
learned), threats, targets, negations and reporting words. The grammar is their composition:
each rewrites the symbols that it is about (an insult or threat near a target counts more, a
negated one less, reported ones less) and passes the others on. The first reads from the clause's
end and marks insults and threats before a target. A clause scores what its path weighs; clauses, not isolated words, make a document's features, and a logistic function turns
those into a score.

Labels are learned from a bounded sample of labelled rows (``SAMPLE``, the least by hash of the
id; a documented parameter), less those held out. Words, and beginnings of words, that stand in
toxic documents far more often than in others, and not by accident among all the words seen, become
insults of a weight. The grammar's own words are of four languages. Scores depend on the
text alone. Null and empty texts have no clauses; without labels of both kinds the grammar's own
words decide. Labels without an id or a toxic mark are ignored; of repeated ones, the largest
counts. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Recent, cut, discard, map_batches, texts
from tessera.llm.decontaminate import LOWER

#: Labelled rows learned from at most.
SAMPLE = 20_000
#: Beginnings of longer words that may become entries, in bytes.
STEMS = (4, 5, 6, 7)
#: An entry's least toxic documents, the share of toxic ones among its documents, and the chance
#: that any of all entries seen stands in as many toxic documents by accident.
SUPPORT, PRECISION, CHANCE = 3, 0.5, 0.05
#: Share of a beginning's toxic documents from which a longer one takes its place.
COVER = 0.9
PREDICT = 0.3
#: Bytes of each of the two generations of a worker's two caches; emptied when a task ends.
CACHE = 6 << 20

# The grammar's own words.
INSULTS = (
    "idiot idiots moron morons stupid scum worthless loser losers trash pathetic disgusting clown clowns imbecile fool dumb garbage filth vermin "
    "dummkopf abschaum versager widerlich ekelhaft wertlos idiota idiotas imbécil estúpido estúpida basura escoria inútil asqueroso "
    "idiote idiotes imbécile ordure racaille minable répugnant"
).split()
THREATS = "kill hurt destroy beat stab shoot burn hang murder attack crush smash töten umbringen verprügeln erschießen matar golpear apuñalar tuer frapper poignarder".split()
TARGETS = (
    "you your yours yourself he she they them him her his their those these people all everyone u ur du dich dir dein deine ihr euch sie ihn ihm "
    "tú tu ti te usted ustedes vosotros él ella ellos ellas toi vous votre vos il elle ils elles lui"
).split()
NEGATIONS = "not no never neither nor without isn aren wasn weren don doesn didn hardly nicht kein keine keiner nie niemals pas jamais aucun nunca jamas jamás tampoco".split()
REPORTS = (
    "said says say called calls quoted quote wrote writes claimed claims alleged according reported asked told word term phrase "
    "sagte sagten nannte schrieb behauptete laut dijo dijeron llamó escribió según afirmó dit disait appelé écrit selon affirmé"
).split()

CLAUSE = re.compile(rb"[.!?;:\n]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DONE, INSULT_AT, THREAT_AT = range(9)
#: Insults and threats, with a target soon after them (``_AT``) or not.
WEIGHED = (INSULT, THREAT, INSULT_AT, THREAT_AT)


@dataclass(frozen=True)
class Transducer:
    """Sequential: from a state, a symbol leads to (state, symbol written, factor, gain). A pair
    that is not listed passes the symbol on and goes to ``decay`` of the state. A clause's token
    carries a weight; the arc multiplies it by the factor, and adds ``gain`` of it to the path."""

    arcs: dict[tuple[int, int], tuple[int, int, float, float]]
    decay: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int, weight: float) -> tuple[int, int, float, float]:
        found = self.arcs.get((state, symbol))
        if found is None:
            return self.decay.get(state, state), symbol, weight, 0.0
        to, out, factor, gain = found
        return to, out, weight * factor, gain * weight * factor


def compose(backward: Transducer, *parts: Transducer):
    """The cascade of transducers as one function over a clause's (symbol, weight) tokens;
    ``backward`` reads them from the end before the others."""

    def run(tokens: list[tuple[int, float]]) -> float:
        state, read = 0, []
        for symbol, weight in reversed(tokens):
            state, symbol, weight, _ = backward.step(state, symbol, weight)
            read.append((symbol, weight))
        states, total = [0] * len(parts), 0.0
        for symbol, weight in reversed(read):
            for k, part in enumerate(parts):
                states[k], symbol, weight, gain = part.step(states[k], symbol, weight)
                total += gain
        return total

    return run


def window(opener: int, touched: tuple[int, ...], factor: float, length: int) -> Transducer:
    """After an ``opener``, the weights of ``touched`` symbols are multiplied, for ``length``
    tokens."""
    arcs = {(s, opener): (length, opener, 1.0, 0.0) for s in range(length + 1)}
    arcs |= {(s, t): (s - 1, t, factor, 0.0) for s in range(1, length + 1) for t in touched}
    return Transducer(arcs, {s: s - 1 for s in range(1, length + 1)})


#: From the clause's end: a target follows within four tokens.
AHEAD = Transducer(
    {(s, TARGET): (4, TARGET, 1.0, 0.0) for s in range(5)}
    | {(s, x): (s - 1, at, 1.0, 0.0) for s in range(1, 5) for x, at in ((INSULT, INSULT_AT), (THREAT, THREAT_AT))},
    {s: s - 1 for s in range(1, 5)},
)
NEGATED = window(NEGATION, WEIGHED, 0.4, 3)
REPORTED = window(REPORT, WEIGHED, 0.5, 8)
#: Once, whether the target stands before, after or on both sides.
AIMED = window(TARGET, WEIGHED, 1.5, 5)
AIMED.arcs.update({(0, x): (0, x, 1.5, 0.0) for x in (INSULT_AT, THREAT_AT)})
#: An insult counts by itself; a threat with a target before or after it.
SCORED_INSULT = Transducer({(0, x): (0, DONE, 1.0, 1.0) for x in (INSULT, INSULT_AT)})
SCORED_THREAT = Transducer(
    {(s, TARGET): (4, TARGET, 1.0, 0.0) for s in range(5)} | {(s, THREAT): (s - 1, DONE, 1.0, 1.0) for s in range(1, 5)}
    | {(s, THREAT_AT): (max(s - 1, 0), DONE, 1.0, 1.0) for s in range(5)},
    {s: s - 1 for s in range(1, 5)},
)
GRAMMAR = compose(AHEAD, NEGATED, REPORTED, AIMED, SCORED_INSULT, SCORED_THREAT)


class Lexicon:
    """Symbol and weight of a word."""

    def __init__(self, learned: dict[bytes, float]):
        self.learned = learned
        self.own = {w.encode(): (kind, weight) for kind, weight, words in (
            (REPORT, 1.0, REPORTS), (NEGATION, 1.0, NEGATIONS), (TARGET, 1.0, TARGETS), (THREAT, 1.0, THREATS), (INSULT, 3.0, INSULTS),
        ) for w in words}
        self.of = Recent(self.find, CACHE)
        self.marked = Recent(lambda w: self.of[w][0] in (INSULT, THREAT), CACHE)

    def find(self, word: bytes) -> tuple[int, float]:
        best = self.own.get(word)
        weights = [self.learned.get(word, 0.0)] + [self.learned.get(word[:k] + b"*", 0.0) for k in STEMS if len(word) > k]
        if max(weights) > (best[1] if best and best[0] == INSULT else 0.0):
            return INSULT, max(weights)
        return best or (OTHER, 0.0)

    def features(self, text: str) -> tuple[float, float, float]:
        """Of the matched clauses: their score summed, the best one's, and their number; all damped."""
        data = text.encode()
        words = set(data.translate(LOWER).split())
        if not any(map(self.marked.__getitem__, words)):
            return 0.0, 0.0, 0.0
        total = best = matched = 0.0
        for clause in CLAUSE.split(data):
            tokens = list(map(self.of.__getitem__, clause.translate(LOWER).split()))
            if any(s in (INSULT, THREAT) for s, _ in tokens):
                score = GRAMMAR(tokens)
                if score > 0:
                    total, best, matched = total + score, max(best, score), matched + 1
        return math.log1p(total), math.log1p(best), math.log1p(matched)


def held_out(id_col: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def entries_of(text: str) -> set[bytes]:
    """The words of a text, and their beginnings marked by a star."""
    words = set(text.encode().translate(LOWER).split())
    return words | {w[:k] + b"*" for w in words for k in STEMS if len(w) > k}


def learn_lexicon(labelled: DataFrame) -> dict[bytes, float]:
    """Weights of entries by their document frequency in toxic and other texts (columns ``text``
    and ``toxic``). A beginning that qualifies stands for all longer entries that it begins."""

    def rows(batch: pa.RecordBatch) -> dict:
        counts: dict[bytes, list[int]] = {}
        n = [0, 0]
        for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            n[toxic] += 1
            for entry in entries_of(text):
                counts.setdefault(entry, [0, 0])[toxic] += 1
        counts[b""] = n
        return {"entry": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

    sums = map_batches(labelled, rows, "entry binary, clean bigint, toxic bigint").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = cut(sums)
    totals = sums.where(F.length("entry") == 0).first()
    clean, toxic = (totals.clean, totals.toxic) if totals else (0, 0)
    if not clean or not toxic:
        return {}
    # an entry is kept if its excess of toxic documents is no accident among so many entries
    bound, base = math.log(max(2, sums.count()) / CHANCE), toxic / (clean + toxic)
    often = sums.where((F.length("entry") > 0) & (F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean") + 1)))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    found = {bytes(r.entry): (r.clean, r.toxic) for r in often.where(gain >= bound).collect()}  # of the sample's words
    discard(sums)
    weights, narrower = {}, set()
    for entry, (b, a) in found.items():
        # a beginning gives way to a longer one with nearly all its toxic documents and fewer clean ones
        for k in STEMS:
            stem = entry[:k] + b"*"
            if k < len(entry.rstrip(b"*")) and stem in found and a >= COVER * found[stem][1] and b < found[stem][0]:
                narrower.add(stem)
    for entry in sorted(found.keys() - narrower, key=lambda e: (len(e), e)):
        if any(entry[:k] + b"*" in weights for k in STEMS if k < len(entry.rstrip(b"*"))):
            continue
        a, b = found[entry][1], found[entry][0]
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        # an entry of few documents may be chance
        weights[entry] = max(0.0, weight) * a / (a + SUPPORT)
    return weights


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Without labels: a matched clause with an insult is about even.
DEFAULT = np.array([1.0, 1.0, 0.5, -3.0])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[dict[bytes, float], np.ndarray]:
    """Lexicon and coefficients from the labelled rows that are not held out."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    marks = cut(marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic")))
    # the least by hash: from a part of the hash range that holds them, so that few rows are sorted
    key, share = F.xxhash64("id"), min(1.0, 2 * sample / max(1, marks.count()))
    chosen = marks.where(key < int((2 * share - 1) * (1 << 63))) if share < 1 else marks
    chosen = F.broadcast(chosen.orderBy(key, "id").limit(sample))  # ``sample`` rows at most
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    # rows that share an id give one text, so that the sample keeps its bound
    first = cut(labelled.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))
    lexicon = learn_lexicon(first)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batch: pa.RecordBatch) -> dict:
        own = Lexicon(shared.value)
        found = [own.features(t) for t in texts(batch.column(0))]
        return {f"f{i}": [f[i] for f in found] for i in range(3)} | {"toxic": batch.column(1)}

    got = map_batches(first, rows, "f0 double, f1 double, f2 double, toxic int").toPandas()  # ``sample`` rows at most
    discard(first, marks)
    y = got["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return lexicon, DEFAULT
    return lexicon, fit_logistic(got[["f0", "f1", "f2"]].to_numpy(float), y)


_LEXICONS: dict[int, Lexicon] = {}


def _at_end() -> None:
    for lexicon in _LEXICONS.values():
        lexicon.of.drop(), lexicon.marked.drop()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = PREDICT) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` (score of ``threshold`` or more) of
    every row."""
    lexicon, weights = learn(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))
    key = zlib.crc32(repr(sorted(lexicon.items())).encode())

    def rows(batch: pa.RecordBatch) -> dict:
        lexicon, weights = shared.value
        if key not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[key] = Lexicon(lexicon)
        own = _LEXICONS[key]
        x = np.array([own.features(t) for t in texts(batch.column(2))]).reshape(-1, 3)
        score = 1 / (1 + np.exp(-np.clip(x @ weights[:3] + weights[3], -30, 30)))
        return {id_col: batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= threshold).astype("int32")}

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    return map_batches(chosen, rows, f"{id_col} {kind}, held_out boolean, score double, predicted int", at_end=_at_end)
