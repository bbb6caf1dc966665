"""Quality by Bradley-Terry ranking.

A document's strength is a weighted sum of its features. Pairs of one labelled good and one labelled bad
document are preferences; the weights minimise the logistic loss on the differences of their features.
The cut is a quantile of the strengths of labelled documents: it lies where the share of bad labels ends,
or in the middle of the gap between the classes where they are apart there. Scores are the logistic curve
of the strength above the cut, with the cut itself at 0.3.

Fitting takes every labelled document that may teach, over its whole text, and every pair of a good and a bad
one. For a given difference of strengths all pairs weigh alike, so the sums over pairs follow from sums of
features by bins of strength (``STEP`` wide, each row dealt to the two bins beside its strength by nearness, which
leaves an error of some 1e-6): the work grows with the documents. Up to ``COLLECTED`` of them it is done in the
driver, beyond by Spark over a written table of features; the cut is the quantile of all strengths in either case.
Scoring covers every row.
Null and empty texts have all features zero and are scored as such. Null labels teach nothing; a document
labelled twice counts with its larger label; without labels of both classes every score is the share of
good ones. Repeated rows get equal scores; a null doc_id is never held out. Very long texts are read whole,
columns other than doc_id and text are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.learning import Curve, held_out, labelled_texts, newton
from keystrata.llm.scratch import Tables, bound_batches
from keystrata.llm.words import release, utf8

STEP, COLLECTED, CUT_BINS = 1 / 64, 20_000, 1024
THRESHOLD = 0.3
#: Bytes counted together; the rest of ASCII is the last class.
_KINDS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9, 13), "line": (10,), "stop": b".,;:'-", "mark": b"!?", "symbol": b"#$%&*+/<=>@\\^_`|~(){}[]\"", "other": range(128, 256)}
_OF = np.full(256, len(_KINDS), np.int64)
for _n, _codes in enumerate(_KINDS.values()):
    _OF[list(_codes)] = _n


_MARK, _SYMBOL, _SPACE, _LINE = (list(_KINDS).index(k) for k in ("mark", "symbol", "space", "line"))


def symbol_shares(kinds: np.ndarray) -> np.ndarray:
    """By line that is not blank: marks and symbols that follow one or stand alone between spaces, for each space and one more.

    ``kinds`` are the kinds of a text's bytes.
    """
    ends = np.r_[_LINE, kinds, _LINE]
    sign, gap = (ends == _MARK) | (ends == _SYMBOL), (ends == _SPACE) | (ends == _LINE)
    odd = (sign[1:-1] & sign[:-2]) | (sign[1:-1] & gap[:-2] & gap[2:])
    starts = np.r_[0, np.flatnonzero(kinds == _LINE) + 1]
    starts = starts[starts < len(kinds)]
    counts = [np.add.reduceat(x, starts) for x in (odd.astype(int), (kinds == _SPACE).astype(int), (~gap[1:-1]).astype(int))]
    return (counts[0] / (counts[1] + 1))[counts[2] > 0]


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, lengths, repetition of words and lines, and the worst line's share of odd symbols."""
    data = utf8(text)
    if not data:
        return [0.0] * 22
    of = _OF[np.frombuffer(data, np.uint8)]
    kinds = np.bincount(of, minlength=len(_KINDS) + 1) / len(data)
    words = data.split()
    counts = Counter(words)
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    twice = len(lines) - len(set(lines))
    follow = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    odd = symbol_shares(of)
    caps = sum(len(x) for x in lines if len(x) > 20 and x.decode("utf-8", "replace").isupper())
    most = counts.most_common(1)[0][1] if counts else 0
    return [*map(float, kinds), len(data) / n / 10, math.log1p(len(words)), len(counts) / n, most / n, follow / n, twice / max(1, len(lines)), len(lines) / n,
        float(odd.max(initial=0)), float(odd.sum()) / max(1, len(lines)), caps / len(data), sum(1 for w in words if len(w) > 25) / n, math.log1p(len(data) / max(1, len(lines)))]


def standard(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as deviations from the middle, held within eight."""
    return np.clip((x - middle) / scale, -8, 8)


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int | None = None, l2: float = 1.0, seed: int = 11) -> Curve:
    """Strengths learned from all pairs of a good and a bad row of ``x``, or from ``pairs`` of them, as a curve without a bias."""
    if pairs is None:
        return all_pairs(Here(x, y), l2)
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = standard(x, middle, scale)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pick = np.random.default_rng(seed)
    left, right = pick.choice(good, pairs), pick.choice(bad, pairs)
    w = newton(z[left] - z[right], np.ones(pairs), np.full(pairs, 1000 / pairs), l2, False)
    return Strength(middle, scale, w, 0.0)


def by_bin(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the bin plus the label, and the sums of (1, z) there; a row goes to the two bins beside its strength by nearness."""
    at = z @ w / STEP
    low = np.floor(at)
    part = (at - low)[:, None]
    rows = np.hstack([np.ones((len(z), 1)), z])
    keys, rows = np.concatenate([low, low + 1]).astype(np.int64) * 2 + np.tile(y, 2), np.vstack([rows * (1 - part), rows * part])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(rows[order], starts, axis=0)


class Here:
    """Sums over rows that are at hand."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.width = x, y, x.shape[1]

    def total(self, f) -> np.ndarray:
        """The sum over all rows: ``f`` gives that of some (x, y)."""
        return f(self.x, self.y)

    def bins(self, middle: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return by_bin(standard(self.x, middle, scale), self.y, w)

    def cut(self, curve: Curve, share: float) -> float:
        return cut(curve.margin(self.x), self.y, share)


class There:
    """The same over a written table (label, x0, x1, ...)."""

    def __init__(self, table: DataFrame, tables: Tables):
        self.table, self.tables, self.width = table, tables, len(table.columns) - 1

    def _map(self, f, schema: str) -> DataFrame:
        """``f`` takes (x, y) of a batch and gives columns."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                if batch.num_rows:
                    y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                    columns = f(np.column_stack(x), y.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [field.split()[0] for field in schema.split(", ")])

        return self.table.mapInArrow(work, schema)

    def total(self, f) -> np.ndarray:
        def flat(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            value = np.asarray(f(x, y), float)
            return [np.arange(value.size), value.ravel()]

        shape = np.asarray(f(np.zeros((1, self.width)), np.zeros(1, np.int64))).shape
        rows = self._map(flat, "place long, value double").groupBy("place").agg(F.sum("value")).toArrow()
        out = np.zeros(math.prod(shape))
        out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return out.reshape(shape)

    def bins(self, middle: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def sums(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            keys, rows = by_bin(standard(x, middle, scale), y, w)
            return [keys, *rows.T]

        names = [f"s{i}" for i in range(self.width + 1)]
        rows = self._map(sums, ", ".join(["bin long", *(f"{n} double" for n in names)])).groupBy("bin").agg(*(F.sum(n) for n in names)).toArrow()
        return rows.column(0).to_numpy(), np.column_stack([c.to_numpy() for c in rows.columns[1:]])

    def cut(self, curve: Curve, share: float) -> float:
        """As ``cut``: the range of strengths that holds the quantile is narrowed until it is small."""
        strengths = self._map(lambda x, y: [curve.margin(x), y], "s double, label long")
        by = self.tables.write(strengths.groupBy("s").agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")), "strengths")
        low, high, n, bad, good = by.agg(F.min("s"), F.max("s"), F.count("*"), F.sum("bad"), F.sum("good")).first()
        weight = lambda rows: rows.column("bad").to_numpy() * ((1 - share) / bad) + rows.column("good").to_numpy() * (share / good)
        below, most = 0.0, 1 - share - 1e-12
        while n > COLLECTED:
            place = F.least(F.floor((F.col("s") - low) * (CUT_BINS / (high - low))), F.lit(CUT_BINS - 1))
            inside = by.where(F.col("s").between(low, high)).groupBy(place.alias("place"))
            rows = inside.agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow().sort_by("place")
            at = below + np.cumsum(weight(rows))
            i = min(int(np.searchsorted(at, most)), len(at) - 1)
            below = float(at[i - 1]) if i else below
            low, high, n = (rows.column(k)[i].as_py() for k in ("low", "high", "n"))
        rows = by.where(F.col("s").between(low, high)).toArrow().sort_by("s")
        s, at = rows.column("s").to_numpy(), below + np.cumsum(weight(rows))
        i = min(int(np.searchsorted(at, most)), len(s) - 1)
        n_bad, n_good = rows.column("bad")[i].as_py(), rows.column("good")[i].as_py()
        last = share / good if n_good else (1 - share) / bad
        if n_bad + n_good > 1 and at[i] - last >= most:  # among equal strengths
            return float(s[i])
        other = s[i + 1] if i + 1 < len(s) else by.where(F.col("s") > float(s[i])).agg(F.min("s")).first()[0]
        if other is None:  # the greatest of all: the two last rows
            other = s[i] if n_bad + n_good > 1 else by.where(F.col("s") < float(s[i])).agg(F.max("s")).first()[0]
        return float(s[i] + other) / 2


def _against(kernel: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each bin k the sum over bins l of ``kernel``[l - k] * ``sums``[l]; the kernel's middle is l = k."""
    size = 1 << (3 * len(sums)).bit_length()
    found = np.fft.irfft(np.fft.rfft(kernel[::-1], size)[:, None] * np.fft.rfft(sums, size, axis=0), size, axis=0)
    return found[len(sums) - 1 : 2 * len(sums) - 1]


def all_pairs(rows: Here | There, l2: float = 1.0) -> Curve:
    """Weights of least logistic loss over all pairs of a good and a bad row, by Newton's method; the mean pair weighs 1000 in all."""
    n = rows.total(lambda x, y: np.array([len(y) - y.sum(), y.sum()], float))
    middle = rows.total(lambda x, y: x.sum(axis=0)) / n.sum()
    scale = np.sqrt(rows.total(lambda x, y: ((x - middle) ** 2).sum(axis=0)) / n.sum()) + 1e-9
    w, each = np.zeros(rows.width), 1000 / n.prod()
    for _ in range(60):
        keys, sums = rows.bins(middle, scale, w)
        least = int(keys.min()) >> 1
        size = (int(keys.max()) >> 1) - least + 1
        grid = np.zeros((2, size, rows.width + 1))
        grid[keys & 1, (keys >> 1) - least] = sums
        bad, good = grid
        lost = 1 / (1 + np.exp(-np.clip(np.arange(1 - size, size) * STEP, -40, 40)))  # of a pair, by the bad one's lead
        bend = lost * (1 - lost)
        lost_good, lost_bad = _against(lost, bad[:, :1])[:, 0], _against(lost[::-1], good[:, :1])[:, 0]
        bends = [_against(bend, x[:, :1])[:, 0] for x in (good, bad)]  # by the label of the row they are for
        crossed = good[:, 1:].T @ _against(bend, bad[:, 1:])
        places = (least + np.arange(size)) * STEP

        def square(x: np.ndarray, y: np.ndarray, w=w, bends=bends, places=places) -> np.ndarray:
            z = standard(x, middle, scale)
            s = z @ w
            return (z * np.where(y == 1, np.interp(s, places, bends[1]), np.interp(s, places, bends[0]))[:, None]).T @ z

        slope = l2 * w - each * (lost_good @ good[:, 1:] - lost_bad @ bad[:, 1:])
        curve = each * (rows.total(square) - crossed - crossed.T) + np.diag(np.full(rows.width, l2 + 1e-9))
        step = np.linalg.solve(curve, slope)
        far = np.abs(step).max()
        w = w - step * min(1.0, 4.0 / max(far, 1e-12))
        if far < 1e-6:
            break
    return Strength(middle, scale, w, 0.0)


class Strength(Curve):
    """A curve over features that are standardised and held within eight deviations."""

    def margin(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.middle, self.scale) @ self.weights + self.bias


def cut(strength: np.ndarray, y: np.ndarray, share: float) -> float:
    """The quantile of strengths at which the share of bad labels ends, each class weighted by its share of labels."""
    order = np.argsort(strength)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))[order]
    s, bad = strength[order], 1 - share
    at = int(np.searchsorted(np.cumsum(weight), bad - 1e-12))
    at = min(max(at, 0), len(s) - 2)
    return float((s[at] + s[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, unseen: Column) -> tuple[Curve | None, float]:
    """(curve, share of good labels) from labelled documents; ``unseen`` tells the label rows that may not teach."""
    width = len(features(None))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(x) for x in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, x.T.copy())], ["label", *(f"x{i}" for i in range(width))])

    with Tables(docs.sparkSession) as tables:
        texts, share = labelled_texts(docs, labels, "quality", unseen, tables)
        schema = ", ".join(["label int", *(f"x{i} double" for i in range(width))])
        table = tables.write(texts.select("text", "label").mapInArrow(describe, schema), "features")
        sizes = {r.label: r.n for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if not {0, 1} <= set(sizes):
            return None, share
        rows: Here | There = There(table, tables)
        if sum(sizes.values()) <= COLLECTED:
            y, *x = (c.to_numpy() for c in table.toArrow().columns)
            x = np.column_stack(x)
            order = np.lexsort([*x.T, y])  # the same sums, whatever the order of rows
            rows = Here(x[order], y[order].astype(np.int64))
        curve = all_pairs(rows)
        curve.bias = math.log(THRESHOLD / (1 - THRESHOLD)) - rows.cut(curve, share)
    return curve, share


def score_column(docs: DataFrame, labels: DataFrame, unseen: Column, text: Column) -> Column:
    """A double column from 0 to 1: how likely ``text`` is to be labelled good."""
    spark = docs.sparkSession
    bound_batches(spark)
    curve, share = fit(docs, labels, unseen)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for batch in batches:
            if curve is None:
                yield pd.Series(np.full(len(batch), share))
            else:
                yield pd.Series(curve(np.array([features(x) for x in batch]).reshape(len(batch), -1)))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, score, predicted. Rows with crc32(doc_id) mod 5 = 0 are held out."""
    unseen = held_out(F.col("doc_id"), 5, 0)
    scored = docs.select("doc_id", unseen.alias("held_out"), score_column(docs, labels, unseen, docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
