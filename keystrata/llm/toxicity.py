"""Toxicity by class-conditional Kneser-Ney models.

Two models of the bytes of words, one of toxic and one of ordinary documents, give each word a difference of
log-likelihoods. Orders above ``SHARED`` are counted by class; they back off to orders that are counted over
both classes together, so expressions that are rare in either meet the same smoothed probabilities. The
counts of the class with more documents weigh as much less. A document is described by length-normalised
differences: the mean over all its words, the means over its 1, 3 and 8 most toxic words (a short insult
in a long text is not averaged away), and how many of its words, and what share, pass each of ``PASSED``. A
logistic curve, fitted on labelled documents that the models have not seen, turns these into a score from 0
to 1. There each labelled document weighs alike, but a toxic one ``MISSED`` times, for it is worse to miss.

The curve takes, of each class, 7 in 22 of the labelled documents and ``CALIBRATE`` at most, those with the
least hash of their doc_id; the models count the n-grams of all others, over their whole texts and by partial
aggregates, and hold every n-gram. Up to ``GRAMS`` distinct ones they are broadcast; larger models are a file
that each executor fetches once and whose pages its workers share.
A gram is its bytes in a 64-bit number and a model is sorted arrays of these, so that the words which a
worker has not met are scored together. Scoring covers every row and whole texts, also very long ones.
Null and empty texts have no words and are scored as such. Labels that are null, or of documents that don't
exist, teach nothing; a document labelled twice counts as toxic if one label says so; without labels of both
classes every score is the share of toxic labels. Repeated rows get equal scores; a null doc_id is never held
out. Columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.learning import held_out, known_labels, logistic
from keystrata.llm.scratch import BROADCAST_IDS, Tables, bound_batches
from keystrata.llm.words import per_worker, release, word_bytes

ORDER, SHARED, DISCOUNT = 6, 2, 0.75
CALIBRATE, CALIBRATE_PARTS, MISSED, RIDGE = 700, (7, 22), 3.0, 5.0
GRAMS, HELD_GRAMS = 2_000_000, 300_000
#: Bytes of words that a worker counts at a time, whose numbers take some 60 times as much, and characters that it scores.
COUNTED, SCORED = 1 << 18, 1 << 20
TOP, PASSED = (1, 3, 8), (1, 2, 3, 4, 6)
CACHED_WORDS, CACHED_BYTES = 150_000, 8 << 20


def _low(codes: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of grams."""
    return codes & np.uint64((1 << 8 * n) - 1)


def _reach(codes: np.ndarray, n: int) -> np.ndarray:
    """Whether grams have ``n`` bytes or more; no word holds a byte 0."""
    return codes >= np.uint64(1 << 8 * (n - 1))


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """A gram for each byte of ``words`` and their ends: it and up to ``order`` - 1 bytes before it; where words begin.

    Blanks stand for a word's begin and end. The gram's last byte is the lowest byte of the number.
    """
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    blank, place = data == 32, np.arange(len(data))
    before = place[1:] - np.maximum.accumulate(np.where(blank, place, 0))[:-1]
    codes = data[1:].astype(np.uint64)
    for k in range(1, order):
        at = np.flatnonzero(before >= k)
        codes[at] |= data[at + 1 - k].astype(np.uint64) << np.uint64(8 * k)
    return codes, np.flatnonzero(blank)[:-1]


def _tally(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, of = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(of, counts, len(distinct))


class KneserNey:
    """Interpolated Kneser-Ney over the bytes of words, for two classes that share the counts of low orders."""

    def __init__(self, tops: tuple[tuple[np.ndarray, np.ndarray], ...], order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT):
        """``tops``: by class, distinct grams of all words and how often they occur."""
        self.order, self.discount, self.least = order, discount, 1 / 256
        by_class = [{order: _tally(*top)} for top in tops]
        # Lower orders count the distinct bytes before a gram; what begins a word has nothing before it.
        for by_order in by_class:
            for n in range(order, 1, -1):
                codes, counts = by_order[n]
                whole = _reach(codes, n)
                by_order[n - 1] = _tally(np.where(whole, _low(codes, n - 1), codes), np.where(whole, np.minimum(1, counts), counts))
        both = [_tally(*(np.concatenate([by_order[n][i] for by_order in by_class]) for i in (0, 1))) for n in range(1, shared + 1)]
        common = [self._table(*x) for x in both]
        self.tables = [common + [self._table(*by_order[n]) for n in range(shared + 1, order + 1)] for by_order in by_class]

    def _table(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Grams and their counts less the discount; histories, their sums and what the discount takes from them."""
        past, of = np.unique(codes >> np.uint64(8), return_inverse=True)
        kept = (np.maximum(counts - self.discount, 0), np.bincount(of, counts, len(past)), np.bincount(of, np.minimum(counts, self.discount), len(past)))
        kept, total, taken = (x.astype(np.float32) for x in kept)
        return codes, kept, past, total, taken

    def probability(self, c: int, codes: np.ndarray) -> np.ndarray:
        """P(last byte | those before it) in class ``c`` of each gram."""
        p = np.full(len(codes), self.least)
        for n, (known, kept, past, total, taken) in enumerate(self.tables[c], 1):
            at = np.flatnonzero(_reach(codes, n))
            if len(past) and len(at):
                gram = _low(codes[at], n)
                history = gram >> np.uint64(8)
                i = np.minimum(np.searchsorted(past, history), len(past) - 1)
                met = past[i] == history
                at, gram, i = at[met], gram[met], i[met]
                j = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                p[at] = (np.where(known[j] == gram, kept[j], 0) + taken[i] * p[at]) / total[i]
        return p

    def differences(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words:
            return np.empty(0)
        codes, begins = grams(words, self.order)
        distinct, of = np.unique(codes, return_inverse=True)
        return np.add.reduceat(np.log(self.probability(1, distinct) / self.probability(0, distinct))[of], begins)


def features(differences: np.ndarray) -> list[float]:
    """Length-normalised differences of one document: of all words, of the most toxic few, and how many pass each bound."""
    n = len(differences)
    if not n:
        return [0.0] * (2 + len(TOP) + 2 * len(PASSED))
    top = np.sort(np.partition(differences, n - min(n, TOP[-1]))[n - min(n, TOP[-1]) :])[::-1]
    passed = [int((differences > x).sum()) for x in PASSED]
    return [float(differences.mean()), *(float(top[:k].mean()) for k in TOP), math.log1p(n), *map(math.log1p, passed), *(x / (1 + n) for x in passed)]


class Scorer:
    """The models with the logistic curve; scores whole texts. Words it has met are kept, up to a bound in number and bytes."""

    def __init__(self, model: KneserNey | None, curve=None, share: float = 0.0):
        self.model, self.curve, self.share = model, curve, share
        self.cache: dict[bytes, float] = {}
        self.held = 0

    def features(self, texts: list) -> np.ndarray:
        out, at, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= SCORED or end == len(texts):
                out += self._features(texts[at:end])
                at, size = end, 0
        return np.array(out).reshape(len(texts), -1)

    def _features(self, texts: list) -> list[list[float]]:
        words = [word_bytes(x) for x in texts]
        new = list(set().union(*words) - self.cache.keys())
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.cache.update(zip(part, self.model.differences(part).tolist(), strict=True))
            self.held += sum(map(len, part))
        out = [features(np.fromiter(map(self.cache.__getitem__, x), np.float64, len(x))) for x in words]
        if len(self.cache) > CACHED_WORDS or self.held > CACHED_BYTES:
            self.cache, self.held = {}, 0
        return out

    def __call__(self, texts: list) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.share)
        return self.curve(self.features(texts)) if len(texts) else np.empty(0)


def worded(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Labels and words of a batch's texts (text, label), ``COUNTED`` bytes or little more at a time."""
    held: tuple[list[bytes], list[bytes]] = ([], [])
    size = [0, 0]
    for text, label in zip(batch.column(0), batch.column(1), strict=True):
        c = label.as_py()
        for word in word_bytes(text.as_py()):
            held[c].append(word)
            size[c] += len(word) + 1
            if size[c] >= COUNTED:
                yield c, held[c]
                held[c].clear()
                size[c] = 0
    yield from ((c, words) for c, words in enumerate(held) if words)


def count_grams(taught: DataFrame) -> DataFrame:
    """gram, ordinary, toxic: how often each gram occurs in texts (text, label) of either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merge() -> int:
            """Makes one part of each class's; the grams that are held then."""
            for parts in held:
                if len(parts) > 1:
                    parts[:] = [_tally(*(np.concatenate([x[i] for x in parts]) for i in (0, 1)))]
            return sum(len(x[0]) for parts in held for x in parts)

        def full() -> Iterator[pa.RecordBatch]:
            for c, parts in enumerate(held):
                if parts:
                    ((codes, counts),) = parts
                    none = np.zeros(len(codes), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (codes.astype(np.int64), *((counts.astype(np.int64), none)[:: 1 - 2 * c]))], ["gram", "ordinary", "toxic"])
                    parts.clear()

        for batch in batches:
            for c, words in worded(batch):
                held[c].append(np.unique(grams(words)[0], return_counts=True))
                if sum(len(x[0]) for parts in held for x in parts) > 2 * HELD_GRAMS and merge() > HELD_GRAMS:
                    yield from full()
        merge()
        yield from full()

    return taught.mapInArrow(count, "gram long, ordinary long, toxic long").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def gathered(counted: DataFrame, most: int | None = None) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """By class, all grams of ``counted`` and their counts; for a caller that gives ``most``, without the rarest beyond it."""
    if most is not None:
        n = F.least(F.col("ordinary") + F.col("toxic"), F.lit(1000))
        left, least = 0, 1
        for row in sorted(counted.groupBy(n.alias("n")).agg(F.count("*").alias("grams")).collect(), key=lambda r: -r.n):
            left += row.grams
            if left > most:
                least = row.n + 1
                break
        counted = counted.where(F.col("ordinary") + F.col("toxic") >= least)
    table = counted.toArrow()
    codes = table.column(0).to_numpy().astype(np.uint64)
    tops = []
    for i in (1, 2):
        counts = table.column(i).to_numpy()
        tops.append((codes[counts > 0], counts[counts > 0].astype(float)))
    return tuple(tops)


class Shipped:
    """Gives workers a model: broadcast up to ``most`` grams, beyond as a file of its arrays that they map, not load."""

    def __init__(self, spark: SparkSession, model: KneserNey | None, most: int | None = None):
        self.broadcast, self.parts, self.name = None, None, f"keystrata-model-{uuid.uuid4().hex}"
        if model is None or sum(len(by_class[-1][0]) for by_class in model.tables) <= (GRAMS if most is None else most):
            self.broadcast = spark.sparkContext.broadcast(model)
            return
        path = os.path.join(tempfile.mkdtemp(prefix="keystrata-model-"), self.name)
        atexit.register(_forget, path)
        with open(path, "wb") as out:
            places: dict[int, tuple[str, int, int]] = {}  # tables that both classes share are written once

            def place(x: np.ndarray) -> tuple[str, int, int]:
                if id(x) not in places:
                    out.write(b"\0" * (-out.tell() % 8))
                    places[id(x)] = (x.dtype.str, len(x), out.tell())
                    out.write(memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else b"")
                return places[id(x)]

            self.parts = [[tuple(map(place, table)) for table in by_class] for by_class in model.tables]
        self.rest = {k: v for k, v in vars(model).items() if k != "tables"}
        spark.sparkContext.addFile(path)

    def __call__(self) -> KneserNey | None:
        if self.parts is None:
            return self.broadcast.value
        path, model = SparkFiles.get(self.name), KneserNey.__new__(KneserNey)
        vars(model).update(self.rest)
        model.tables = [[tuple(np.memmap(path, t, "r", at, (n,)) if n else np.empty(0, t) for t, n, at in table) for table in by_class] for by_class in self.parts]
        return model

    def unpersist(self) -> None:
        if self.broadcast is not None:
            self.broadcast.unpersist()


def _forget(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)
        os.rmdir(os.path.dirname(path))


def fit(docs: DataFrame, labels: DataFrame, unseen: Column) -> tuple:
    """(model, curve, share) from labelled documents; ``unseen`` tells the label rows that may not teach."""
    spark = docs.sparkSession
    with Tables(spark) as tables:
        known = tables.write(known_labels(labels, "toxic", unseen), "known")
        shares = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
        share = shares.get(1, 0) / max(1, sum(shares.values()))
        # Repeated rows of a document are one; of its texts the least counts.
        rows = docs.select("doc_id", "text").join(F.broadcast(known) if sum(shares.values()) <= BROADCAST_IDS else known, "doc_id")
        taught = tables.write(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled")
        sizes = {r.label: r.n for r in taught.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if not {0, 1} <= set(sizes):
            return None, None, share
        part, parts = CALIBRATE_PARTS
        aside = {c: min(CALIBRATE, max(int(sizes[c] > 1), sizes[c] * part // parts)) for c in (0, 1)}
        if not min(aside.values()):
            return None, None, share
        hashed = taught.select("doc_id", "label", F.xxhash64("doc_id", F.lit(7)).alias("h"))
        first, second = (hashed.where(F.col("label") == c).orderBy("h", "doc_id").limit(n).select("doc_id") for c, n in aside.items())
        chosen = F.broadcast(tables.write(first.unionAll(second), "aside"))  # two numbers of CALIBRATE rows at most

        counted = tables.write(count_grams(taught.join(chosen, "doc_id", "left_anti").select("text", "label")), "grams")
        fits = [max(1, sizes[c] - aside[c]) for c in (0, 1)]
        model = KneserNey(tuple((codes, counts * min(fits) / n) for (codes, counts), n in zip(gathered(counted), fits, strict=True)))
        shipped = Shipped(spark, model)

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            scorer = Scorer(shipped())
            for batch in batches:
                if batch.num_rows:
                    x = scorer.features(batch.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

        rows = taught.join(chosen, "doc_id", "left_semi").select("text", "label").mapInArrow(describe, "label int, x array<double>").toArrow()
        shipped.unpersist()
    y = np.array(rows.column(0).to_pylist())
    weight = np.array([sizes[c] / aside[c] for c in (0, 1)]) * (1, MISSED)
    return model, logistic(np.array(rows.column(1).to_pylist()), y, weight[y], RIDGE), share


def score_column(docs: DataFrame, labels: DataFrame, unseen: Column, text: Column) -> Column:
    """A double column from 0 to 1: how likely ``text`` is to be labelled toxic."""
    spark = docs.sparkSession
    bound_batches(spark)
    model, curve, share = fit(docs, labels, unseen)
    shipped, version = Shipped(spark, model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = per_worker("toxicity", lambda: Scorer(shipped(), curve, share), version)
        for batch in batches:
            yield pd.Series(scorer(batch.tolist()))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, score, predicted. Rows with crc32(doc_id) mod 4 = 2 are held out."""
    unseen = held_out(F.col("doc_id"), 4, 2)
    scored = docs.select("doc_id", unseen.alias("held_out"), score_column(docs, labels, unseen, docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
