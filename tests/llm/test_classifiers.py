import math
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keystrata.llm import quality, toxicity
from keystrata.llm.learning import held_out
from keystrata.llm.words import word_bytes
from tests.llm.conftest import frame, records

LABELS = "doc_id long, quality int, toxic int, text string, score double"
INSULTS = ["fropwit", "grubnack", "dulzorb"]


@pytest.fixture
def labelled(spark, prose):
    """400 documents; a quarter toxic, a quarter (others) junk."""
    rnd, texts, labels = random.Random(2), [], []
    for i in range(400):
        words = prose(rnd.randrange(20, 120)).split()
        toxic, good = int(i % 4 == 1), int(i % 4 != 2)
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS) + rnd.choice(["", "s", "ed"]))
        if not good:
            words = [w + rnd.choice(["***", "###", "%%%"]) for w in words]
        texts.append(" ".join(words))
        labels.append((i, good, toxic, "clash", 0.0))
    labels += [(5, None, None, None, None), (None, 1, 1, None, None), (9999, 0, 0, None, None), (1, 1, 0, None, None)]
    return frame(spark, [*texts, None, "", " ", "x" * 40_000, (None, texts[1]), (0, texts[0])]), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize(("score", "parts", "part", "positive"), [(toxicity.score_toxicity, 4, 2, lambda i: i % 4 == 1), (quality.score_quality, 5, 0, lambda i: i % 4 != 2)])
def test_held_out_accuracy_and_shape(labelled, score, parts, part, positive):
    found = records(score(*labelled))
    assert len(found) == 406
    right, n = 0, 0
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % parts == part)
        if r["held_out"] and i < 400:
            n, right = n + 1, right + (r["predicted"] == positive(i))
    assert n > 50 and right / n > 0.95
    assert len({r["score"] for r in found if r["doc_id"] == 0}) == 1


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_held_out_labels_teach_nothing(labelled, score):
    docs, labels = labelled
    parts, part = (4, 2) if score is toxicity.score_toxicity else (5, 0)
    out = held_out(F.col("doc_id"), parts, part)
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda r: (str(r["doc_id"]), r["score"])
    a, b = sorted(records(score(docs, labels)), key=key), sorted(records(score(docs, turned)), key=key)
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b])


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_missing_classes_and_empty_tables(spark, labelled, empty, score):
    docs, labels = labelled
    one = labels.where("quality = 1 AND toxic = 0")
    assert {r["score"] for r in records(score(docs, one))} == ({0.0} if score is toxicity.score_toxicity else {1.0})
    assert {r["score"] for r in records(score(docs, labels.limit(0)))} == {0.0}
    assert records(score(empty, labels)) == []
    assert records(score(empty, labels.limit(0))) == []


def model_of(counts):
    """The models of words with (ordinary, toxic) counts."""
    tops = []
    for c in (0, 1):
        words = [w.encode() for w, n in counts.items() for _ in range(n[c])]
        tops.append(tuple(x.astype(t) for x, t in zip(np.unique(toxicity.grams(words)[0], return_counts=True), ("u8", float), strict=True)))
    return toxicity.KneserNey(tuple(tops))


def code(gram):
    return np.array([int.from_bytes(gram, "big")], np.uint64)


def plain_kneser_ney(counts, order=6, shared=2, discount=0.75):
    """P(class, gram) by dictionaries of byte strings, from the definition; ``counts``: (ordinary, toxic) by word."""
    tables = []
    for c in (0, 1):
        of = {order: Counter()}
        for word, n in counts.items():
            text = b" " + word.encode() + b" "
            for end in range(1, len(text)):
                if n[c]:
                    of[order][text[max(0, end - order + 1) : end + 1]] += n[c]
        for n in range(order, 1, -1):
            of[n - 1] = Counter()
            for gram, k in of[n].items():
                of[n - 1][gram[1:] if len(gram) == n else gram] += min(1, k) if len(gram) == n else k
        tables.append(of)
    for n in range(1, shared + 1):
        tables[0][n] = tables[1][n] = tables[0][n] + tables[1][n]

    def probability(c, gram):
        p = 1 / 256
        for n in range(1, len(gram) + 1):
            table = tables[c][n]
            follow = {g: k for g, k in table.items() if g[:-1] == gram[-n:-1]}
            if follow:
                p = (max(table[gram[-n:]] - discount, 0) + sum(min(k, discount) for k in follow.values()) * p) / sum(follow.values())
        return p

    def difference(word):
        text = b" " + word.encode() + b" "
        spans = [text[max(0, end - order + 1) : end + 1] for end in range(1, len(text))]
        return sum(math.log(probability(1, g) / probability(0, g)) for g in spans)

    return probability, difference


def test_kneser_ney_equals_the_definition(prose):
    rnd = random.Random(4)
    counts = {w: (rnd.randrange(4), rnd.randrange(4)) for w in set(prose(60).split())} | {"zé": (0, 3), "a": (9, 1), "longwordofbytes" * 3: (1, 2)}
    model, (probability, difference) = model_of(counts), plain_kneser_ney(counts)
    for c in (0, 1):
        for gram in (b"a ", b" a", b" a ", "é ".encode(), b"ofbyte", b"q", b" q", b"xyzzy "):
            assert model.probability(c, code(gram))[0] == pytest.approx(probability(c, gram), rel=1e-5)
    words = [*counts, "unseen", "zééé", "x" * 300]
    assert model.differences([w.encode() for w in words]) == pytest.approx([difference(w) for w in words], rel=1e-4, abs=1e-4)


def test_kneser_ney_sums_to_one():
    model = model_of({"ab": (3, 1), "abc": (1, 2), "b": (0, 4)})
    for history in (b" ", b" a", b" ab"):
        for c in (0, 1):
            total = sum(model.probability(c, code(history + bytes([x])))[0] for x in range(1, 256))
            assert 0.9 < total <= 1 + 1e-5
    known, unknown = model.differences([b"b", b"ab"])
    assert known > unknown


def test_unseen_forms_of_a_toxic_stem_are_recognised():
    model = model_of({w: (50, 50) for w in ("the", "other", "gram", "stone", "river")} | {f"zork{x}": (0, 9) for x in ("a", "ed", "ing", "s")})
    stem, river = model.differences([b"zorkful", b"rivers"])
    assert stem > 3 > abs(river)


def test_scores_equal_the_plain_formulas(spark, labelled):
    """Counts, models, features and curve of a fit, taken again by plain Python over all labelled texts."""
    docs, labels = labelled
    unseen = held_out(F.col("doc_id"), 4, 2)
    model, curve, _ = toxicity.fit(docs, labels, unseen)
    texts = {r["doc_id"]: r["text"] for r in records(docs) if r["doc_id"] is not None}
    toxic = {i: int(i % 4 == 1) for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    order = {r["i"]: r["h"] for r in records(spark.createDataFrame([(i,) for i in toxic], "i long").select("i", F.xxhash64("i", F.lit(7)).alias("h")))}
    counts, sizes = defaultdict(lambda: [0.0, 0.0]), {}
    for c in (0, 1):
        own = sorted((i for i in toxic if toxic[i] == c), key=lambda i: (order[i], i))
        sizes[c] = own[len(own) * 7 // 22 :]
    for c in (0, 1):
        for i in sizes[c]:
            for word in word_bytes(texts[i]):
                counts[word.decode()][c] += min(map(len, sizes.values())) / len(sizes[c])
    _, difference = plain_kneser_ney(counts)
    known = {}
    scores = {r["doc_id"]: r["score"] for r in records(toxicity.score_toxicity(docs, labels))}
    for i in range(0, 400, 40):
        words = [w.decode() for w in word_bytes(texts[i])]
        d = np.array([known.setdefault(w, difference(w)) for w in words])
        top = np.sort(d)[::-1]
        passed = [(d > x).sum() for x in (1, 2, 3, 4, 6)]
        x = [d.mean(), top[0], top[:3].mean(), top[:8].mean(), math.log(1 + len(d)), *(math.log(1 + p) for p in passed), *(p / (1 + len(d)) for p in passed)]
        margin = sum((v - m) / s * w for v, m, s, w in zip(x, curve.middle, curve.scale, curve.weights, strict=True)) + curve.bias
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-4)


@pytest.mark.parametrize(("score", "label", "parts", "part", "caught", "false"), [(toxicity.score_toxicity, "toxic", 4, 2, 0.75, 0.05), (quality.score_quality, "quality", 5, 0, 0.95, 0.05)])
def test_held_out_rates_on_the_labelled_tables(spark, score, label, parts, part, caught, false):
    data = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    truth = {r["doc_id"]: r[label] for r in records(labels)}
    held = [r for r in records(score(docs, labels)) if r["held_out"] and truth[r["doc_id"]] is not None]
    rate = lambda c: sum(r["predicted"] for r in held if truth[r["doc_id"]] == c) / sum(truth[r["doc_id"]] == c for r in held)
    assert rate(1) >= caught and rate(0) <= false


def test_the_rarest_grams_go_where_there_are_too_many(spark):
    counted = spark.createDataFrame([(i, i, 1) for i in range(100)], "gram long, ordinary long, toxic long")
    assert len(toxicity.gathered(counted)[1][0]) == 100
    assert sorted(toxicity.gathered(counted, 10)[1][0].tolist()) == list(range(90, 100))


def test_grams_beyond_the_broadcast_stay_in_the_model(spark, labelled, monkeypatch):
    """A fit keeps every gram, and a model that is mapped from a file gives the scores of one that is broadcast."""
    docs, labels = labelled
    key = lambda r: (str(r["doc_id"]), r["score"])
    broadcast = sorted(records(toxicity.score_toxicity(docs, labels)), key=key)
    unseen = held_out(F.col("doc_id"), 4, 2)
    sizes = [len(x[-1][0]) for x in toxicity.fit(docs, labels, unseen)[0].tables]
    monkeypatch.setattr(toxicity, "GRAMS", 50)
    assert [len(x[-1][0]) for x in toxicity.fit(docs, labels, unseen)[0].tables] == sizes and min(sizes) > 50
    assert sorted(records(toxicity.score_toxicity(docs, labels)), key=key) == broadcast


def test_more_grams_than_are_broadcast_are_all_gathered(spark):
    counted = spark.range(toxicity.GRAMS + 100).selectExpr("id AS gram", "1L AS ordinary", "0L AS toxic")
    assert [len(codes) for codes, _ in toxicity.gathered(counted)] == [toxicity.GRAMS + 100, 0]


def plain_symbol_shares(text):
    """By line that is not blank: signs behind signs or alone between spaces, over spaces and one more."""
    out = []
    signs = set("!?#$%&*+/<=>@\\^_`|~(){}[]\"")
    for line in text.split("\n"):
        if line.strip(" \t\r"):
            padded = f" {line} "
            odd = sum(1 for i in range(1, len(padded) - 1) if padded[i] in signs and (padded[i - 1] in signs or (padded[i - 1] in " \t\r" and padded[i + 1] in " \t\r")))
            out.append(odd / (sum(c in " \t\r" for c in line) + 1))
    return out


@pytest.mark.parametrize("text", ["a b c", "a!! b", "x | y | z\n\n  \nplain line\n###", "!", "#\n#", "wörd*** ok### (see) | a\tb", "\n\n", " "])
def test_symbol_shares_equal_a_plain_count(text):
    found = quality.symbol_shares(quality._OF[np.frombuffer(text.encode(), np.uint8)])
    assert found.tolist() == pytest.approx(plain_symbol_shares(text))


def test_quality_scores_equal_the_plain_formulas(labelled):
    """Scores from the fit's weights; these are where the loss on pairs has no slope; the cut scores 0.3."""
    docs, labels = labelled
    unseen = held_out(F.col("doc_id"), 5, 0)
    curve, share = quality.fit(docs, labels, unseen)
    texts = {r["doc_id"]: r["text"] for r in records(docs) if r["doc_id"] is not None and r["doc_id"] < 400}
    for r in records(quality.score_quality(docs, labels)):
        if r["doc_id"] in texts and r["doc_id"] % 20 == 1:
            x = quality.features(texts[r["doc_id"]])
            margin = curve.bias + sum(min(8, max(-8, (v - m) / s)) * w for v, m, s, w in zip(x, curve.middle, curve.scale, curve.weights, strict=True))
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
    pick = np.random.default_rng(0)
    x, y = np.vstack([pick.normal(0, 1, (60, 3)), pick.normal(0.7, 1, (60, 3))]), np.repeat([0, 1], 60)
    learned = quality.bradley_terry(x, y, pairs=2000, l2=1.0, seed=3)
    z = np.clip((x - learned.middle) / learned.scale, -8, 8)
    draw = np.random.default_rng(3)
    left, right = draw.choice(np.flatnonzero(y == 1), 2000), draw.choice(np.flatnonzero(y == 0), 2000)
    difference = z[left] - z[right]
    slope = sum(-d / (1 + math.exp(float(d @ learned.weights))) for d in difference) * 1000 / 2000 + learned.weights
    assert np.abs(slope).max() < 1e-3
    assert share == pytest.approx(sum(i % 4 != 2 for i in range(400) if zlib.crc32(str(i).encode()) % 5) / sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(400)), abs=0.01)


def test_bradley_terry_learns_the_order():
    pick = np.random.default_rng(0)
    y = np.repeat([0, 1], 100)
    x = np.column_stack([pick.normal(y * 3.0, 1), pick.normal(size=200)])
    curve = quality.bradley_terry(x, y, pairs=4000)
    assert curve.weights[0] > 5 * abs(curve.weights[1])


def test_bradley_terry_takes_all_pairs():
    """The loss over every pair has no slope where the fit ends."""
    pick = np.random.default_rng(1)
    x, y = np.vstack([pick.normal(0, 1, (60, 3)), pick.normal(0.7, 1, (90, 3))]), np.repeat([0, 1], [60, 90])
    learned = quality.bradley_terry(x, y)
    z = np.clip((x - learned.middle) / learned.scale, -8, 8)
    difference = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    slope = -(difference / (1 + np.exp(difference @ learned.weights))[:, None]).sum(axis=0) * 1000 / len(difference) + learned.weights
    assert np.abs(slope).max() < 1e-2
    drawn = quality.bradley_terry(x, y, pairs=200_000)
    assert learned.weights == pytest.approx(drawn.weights, abs=0.03)


def test_every_labelled_document_teaches_quality(spark, labelled, monkeypatch):
    """Of more documents than are collected none is left out, and the fit is the one that the driver makes of all."""
    docs, labels = labelled
    unseen = held_out(F.col("doc_id"), 5, 0)
    here, share = quality.fit(docs, labels, unseen)
    seen = []
    fitted = quality.all_pairs
    monkeypatch.setattr(quality, "all_pairs", lambda rows: (seen.append(rows.total(lambda x, y: np.array([len(y)]))[0]), fitted(rows))[1])
    monkeypatch.setattr(quality, "COLLECTED", 20)
    monkeypatch.setattr(quality, "CUT_BINS", 4)
    there, _ = quality.fit(docs, labels, unseen)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(400))]
    assert there.weights == pytest.approx(here.weights, abs=1e-6) and there.bias == pytest.approx(here.bias, abs=1e-6)


@pytest.mark.parametrize("share", [0.001, 0.3, 0.5, 0.9, 0.999])
def test_quality_cut_of_a_table_is_that_of_an_array(spark, share, monkeypatch):
    from keystrata.llm.scratch import Tables

    monkeypatch.setattr(quality, "COLLECTED", 5)
    pick = np.random.default_rng(2)
    x, y = np.round(pick.normal(size=(200, 1)), 2), pick.integers(0, 2, 200)
    curve = quality.Strength(np.zeros(1), np.ones(1), np.ones(1), 0.0)
    with Tables(spark) as tables:
        table = spark.createDataFrame([(int(b), float(a)) for a, b in zip(x[:, 0], y, strict=True)], "label int, x0 double")
        assert quality.There(table, tables).cut(curve, share) == pytest.approx(quality.cut(curve.margin(x), y, share), abs=0.011)


def test_quality_cut_is_the_quantile_of_bad_labels():
    strength, y = np.arange(10.0), np.array([0] * 3 + [1] * 7)
    assert quality.cut(strength, y, 0.7) == 2.5


def test_every_labelled_document_reaches_the_counts(spark, prose):
    """All but the few for the curve are counted."""
    docs, labels = frame(spark, [prose(12) for _ in range(4800)]), spark.createDataFrame([(i, 1, i % 2, "", 0.0) for i in range(4800)], LABELS)
    counted = toxicity.count_grams(docs.select("text", (F.col("doc_id") % 2).cast("int").alias("label")))
    ends = counted.where("gram % 256 = 32").agg(F.sum("ordinary"), F.sum("toxic")).first()
    assert tuple(ends) == (2400 * 12, 2400 * 12)
    model, curve, share = toxicity.fit(docs, labels, F.lit(False))
    for c in (0, 1):
        codes, kept, past, total, taken = model.tables[c][-1]
        words = total[np.isin(past, codes[codes % 256 == 32] >> np.uint64(8))].sum()
        assert words >= (2400 - toxicity.CALIBRATE) * 12 * 0.9
    assert curve is not None and share == 0.5


def test_the_sample_is_drawn_from_documents_that_are_there(spark, prose):
    """Labels of missing documents take no place in the sample."""
    texts = [(10**6 + i, prose(15) + (" fropwit" if i % 2 else "")) for i in range(40)]
    labels = [(i, 1, i % 2, "", 0.0) for i in range(6000)] + [(10**6 + i, 1, i % 2, "", 0.0) for i in range(40)]
    model, curve, _ = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, LABELS), F.lit(False))
    assert curve is not None and model.differences([b"fropwits"])[0] > 1


class _Taken:
    """Stands for a DataFrame: keeps the function that workers would run."""

    def mapInArrow(self, work, schema):
        self.work = work
        return self

    def groupBy(self, *_):
        return self

    def agg(self, *_):
        return self


def test_a_worker_counts_and_scores_a_large_batch_in_little_memory(spark, prose):
    """Numbers for each byte of a batch of 4 MB took some 350 MB a worker."""

    texts = [" ".join([prose(400)] * 40 + [f"w{i}"]) for i in range(60)] + [None, "", " ".join([prose(400)] * 400)]
    labels = [i % 2 for i in range(len(texts))]
    taken = toxicity.count_grams(_Taken())
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(labels)], ["text", "label"])
    assert sum(len(x or "") for x in texts) > 4 << 20
    tracemalloc.start()
    counted = [Counter(), Counter()]
    for part in taken.work(iter([batch])):
        for c, name in enumerate(("ordinary", "toxic")):
            counted[c].update(dict(zip(part["gram"].to_pylist(), part[name].to_pylist(), strict=True)))
    _, counting = tracemalloc.get_traced_memory()
    assert counting < 100 << 20
    tops = [np.unique(toxicity.grams([w for x, y in zip(texts, labels, strict=True) if y == c for w in word_bytes(x)])[0], return_counts=True) for c in (0, 1)]
    for c, (codes, counts) in enumerate(tops):
        assert +counted[c] == dict(zip(codes.astype(np.int64).tolist(), counts.tolist(), strict=True))
    scorer = toxicity.Scorer(toxicity.KneserNey(tuple((codes, counts.astype(float)) for codes, counts in tops)))
    one_by_one = np.concatenate([toxicity.Scorer(scorer.model).features([x]) for x in texts[-4:]])
    scorer.features(texts[:1])
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    every = scorer.features(texts)
    assert tracemalloc.get_traced_memory()[1] - before < 160 << 20
    tracemalloc.stop()
    assert np.allclose(every[-4:], one_by_one, rtol=0, atol=1e-12) and every.shape == (len(texts), 15)
