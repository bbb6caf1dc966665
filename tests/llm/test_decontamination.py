import hashlib
import re

import pytest

from keystrata.llm import decontamination as D
from tests.llm.conftest import frame, records


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc_id, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, 9, 8) for i, t in items], "item_id long, text string, n int, words int")


def check(spark, texts, items):
    numbered = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    found = D.decontaminate(frame(spark, numbered), bench(spark, items))
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in records(found)), key=str)
    assert got == brute(numbered, items)
    return found


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_equals_brute_force(spark, prose, monkeypatch, bound):
    monkeypatch.setattr(D, "BROADCAST_GRAMS", bound)
    a, b, c = prose(40), prose(10), prose(11)
    items = [(1, a), (2, b), (3, c), (4, b), (4, b), (5, "Short; ITEM here"), (6, "é"), (7, None), (8, "!!"), (10, a), (12, "x x x x x x x x x x x x")]
    texts = [a, f"{prose(5)} {b.upper().replace('É', 'é')}, {prose(3)}", " ".join(a.split()[3:14]) + "." + c, " ".join(a.split()[3:12]), "short item HERE short item", None, "", "?!", "x " * 40, prose(300), f"{c} {c} {b}", "É é", "a" * 3000]
    check(spark, texts, items)


def test_repeated_rows_and_null_ids(spark, prose):
    a, b = prose(12), prose(12)
    check(spark, [(1, a), (1, a), (1, b), (None, a), (None, b), (2, None), (2, None)], [(1, a)])


def test_empty_tables(spark, empty, prose):
    assert records(D.decontaminate(empty, bench(spark, [(1, prose(20))]))) == []
    check(spark, [prose(20)], [])
    check(spark, [prose(20)], [(1, None), (2, "...")])


def test_clean_keeps_columns_and_clean_rows(spark, prose):
    a = prose(30)
    docs = frame(spark, [a, prose(30), None, (None, a), (None, prose(9))])
    kept = D.clean(docs, bench(spark, [(1, " ".join(a.split()[5:15]))]))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in records(kept)) == ["1", "2", "None"]


def test_winnowing_guarantee(spark, prose):
    """Every window of ten words keeps a gram, the same whatever stands around it."""
    text = prose(60)
    inner = " ".join(text.split()[20:30])
    spots = lambda t: {(v & ~D.PLACE): D.PLACE - (v & D.PLACE) for v in D.placed(spark.range(1).select(D.words_of(D.F.lit(t)).alias("words")), D.WINDOW).first().spots}
    ((gram, place),) = spots(inner).items()
    assert spots(text)[gram] == 20 + place


@pytest.mark.parametrize("width", [1, 2, 3, 5, 6, 9])
def test_folding_equals_a_plain_combination(spark, width):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 4, 5, 6, 12)], "x array<long>").withColumn("x", D.F.transform("x", lambda v: D.F.chr(v + 97)))
    found = [r["x"] for r in records(D.folded(rows, "x", width, lambda a, b: D.F.concat(a, b)))]
    whole = "abcdefghijkl"
    assert found == [[whole[i : i + width] for i in range(n - width + 1)] for n in (0, 1, 4, 5, 6, 12)]


def test_main_path_has_no_python(spark, prose):
    df = D.decontaminate(frame(spark, [prose(20)]), bench(spark, [(1, prose(20))]))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
