import random

import numpy as np
import pytest

from keystrata.llm import near_dedup as N
from keystrata.llm.scratch import Tables
from tests.llm.conftest import frame, records


def brute(texts, size, percent=80):
    """component by doc_id, over all pairs."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        w = w if t else []
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def corpus(prose, rnd):
    texts = [None, "", "  \n", "one", "ONE", "one two", "x" * 5000]
    for _ in range(25):
        words = prose(rnd.randrange(12, 160)).split()
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(4)):
            w = list(words)
            for _ in range(rnd.randrange(0, 5)):
                w[rnd.randrange(len(w))] = prose(1)
            texts.append(" ".join(w) if rnd.random() < 0.7 else "  ".join(w).upper().replace("É", "é"))
    texts += [texts[8]] * 7
    return texts


@pytest.mark.parametrize("size", [4, 5])
def test_equals_all_pairs(spark, prose, size):
    texts = corpus(prose, random.Random(size))
    found = {r["doc_id"]: r for r in records(N.near_duplicates(frame(spark, texts), size=size))}
    wanted = brute(texts, size)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == wanted
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_crowded_buckets_lose_no_link(spark, prose, monkeypatch):
    """One group of many near copies, with the bound for crowds so low that its way is taken."""
    monkeypatch.setattr(N, "CROWD", 6)
    monkeypatch.setattr(N, "BLOCK", 20)
    rnd, base, texts = random.Random(3), prose(120).split(), []
    for _ in range(70):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = prose(1)
        texts.append(" ".join(w))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in records(N.near_duplicates(frame(spark, texts), size=4))}
    assert found == brute(texts, 4)


def test_representatives_keep_all_columns(spark):
    docs = frame(spark, ["a b c d e f g", "a b c d e f g", None, None, "other words stand here now"])
    kept = N.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in records(kept)) == [0, 2, 3, 4]


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "alone here it is now"), (7, None), (None, None)])
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in records(N.near_duplicates(docs))), key=str)
    assert found == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (7, 7, True), (None, None, True)], key=str)


def test_empty_table(empty):
    assert records(N.near_duplicates(empty)) == []


def test_registers_merge_as_unions_and_estimate():
    pick = np.random.default_rng(1)
    a, b = np.unique(pick.integers(0, 2**63, 900).astype(np.uint64)), np.unique(pick.integers(0, 2**63, 600).astype(np.uint64))
    ra, rb, rc = (N.registers(x) for x in (a, np.union1d(a[:300], b), np.union1d(a, b)))
    assert (np.maximum(ra, N.registers(b)) == rc).all()
    true = 300 / (len(a) + len(b))
    guess = N.likely(ra[None], rb[None], np.array([len(a)]), np.array([len(b) + 300]))
    assert abs(guess[0] - true) < 0.15
    assert N.likely(ra[None], ra[None], np.array([900.0]), np.array([900.0]))[0] == 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100 + i, 150) for i in range(40)] + [(7, 7)]
    with Tables(spark) as tables:
        found = {r["id"]: r["component"] for r in records(N.components(spark.createDataFrame(chain, "a long, b long"), tables))}
    assert {i: c for i, c in found.items() if i < 50} == {i: 0 for i in range(1, 31)}
    assert {found[i] for i in [*range(101, 140), 150]} == {100}


@pytest.mark.parametrize("percent", [60, 70, 90])
def test_other_similarities(spark, prose, percent):
    texts = corpus(prose, random.Random(percent))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in records(N.near_duplicates(frame(spark, texts), percent=percent, size=1))}
    assert found == brute(texts, 1, percent)


def test_similarities_without_enough_registers_are_refused(docs):
    with pytest.raises(ValueError):
        N.near_duplicates(docs(["a b"]), percent=5)
    assert N.band_rows(80) == 4


def test_one_group_of_thousands(spark, prose, monkeypatch):
    """Copies with up to a fifth of their words changed, most from a small vocabulary: all pairs, in crowded buckets."""
    monkeypatch.setattr(N, "BLOCK", 100)
    rnd, base = random.Random(8), prose(60).split()
    texts = []
    for _ in range(2000):
        w = list(base)
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(base) if rnd.random() < 0.5 else prose(1)
        texts.append(" ".join(w))
    sets = [frozenset(zip(w, w[1:], strict=False)) for w in map(str.split, texts)]
    number = {g: i for i, g in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        m[i, [number[g] for g in x]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    least = np.arange(len(sets))
    while True:
        lower = np.where(linked, least[None, :], len(sets)).min(axis=1)
        if (lower == least).all():
            break
        least = lower
    found = {r["doc_id"]: r["component_id"] for r in records(N.near_duplicates(frame(spark, texts), size=2))}
    assert [found[i] for i in range(len(texts))] == least.tolist()
    assert len(set(least.tolist())) > 20


def test_an_identifier_with_several_texts(spark, prose):
    """Links belong to texts: doc 4 stands for a text that copies doc 3, and for one that copies nothing."""
    a, b = prose(80), prose(80)
    docs = frame(spark, [(3, a), (4, a + " more"), (4, b), (9, b)])
    assert sorted((r["doc_id"], r["component_id"]) for r in records(N.near_duplicates(docs))) == [(3, 3), (4, 3), (4, 4), (9, 4)]
    assert sorted((r["doc_id"], r["text"]) for r in records(N.representatives(docs))) == sorted([(3, a), (4, b)])


def test_one_of_equal_rows_and_of_rows_without_id_stays(spark, prose):
    a, b, c = prose(60), prose(60), prose(60)
    docs = frame(spark, [(1, a), (1, a), (2, a), (None, b), (None, b), (None, c), (8, c), (5, ""), (5, "")])
    kept = sorted(((r["doc_id"], r["text"]) for r in records(N.representatives(docs))), key=str)
    assert kept == sorted([(1, a), (None, b), (8, c), (5, ""), (5, "")], key=str)
