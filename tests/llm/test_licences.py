import random
import re
import time

import pytest

from keystrata.llm import licences as L
from tests.llm.conftest import frame, records


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w = words(text)
    return sorted((i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


TEXTS = [None, "", "...", "MIT License", "the MIT\n License, mit license!", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "gnu generall public licence", "Released under teh MIT Licence",
    "Apache-License Apache  License", "admit license", "cc by cc by cc by", "x " * 3000 + "mit license", "Élan MIT LICENSE", "permission is herebye granted, free of charge", "gnu lesser general public license"]


def test_base_places_equal_brute_force(spark):
    found = {r["doc_id"]: r for r in records(L.digest(L.scan(frame(spark, TEXTS))))}
    for i, text in enumerate(TEXTS):
        base, r = brute_base(text), found[i]
        assert (r["n_words"], r["n_base"]) == (len(words(text)), len(base)), text
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["score"] == 1 or not base


@pytest.mark.parametrize(("text", "labels"), [("gnu generall public licence", "gpl"), ("Released under teh MIT Licence", "mit"), ("permission is herebye granted, free of charge", "mit"), ("plain words about nothing", ""), ("gnu lesser general public license", "lgpl")])
def test_notices_with_errors(spark, text, labels):
    assert records(L.digest(L.scan(frame(spark, [text]))))[0]["labels"] == labels


def test_every_notice_within_its_errors_is_found():
    """Pigeonhole: harm in every piece but one."""
    for text, label in L.NOTICES:
        notice = L.Notice(text, label)
        for spared in range(notice.errors + 1):
            data = bytearray(notice.text)
            for n, (seed, at) in enumerate(notice.seeds):
                if n != spared:
                    data[at + len(seed) // 2] = ord("#")
            assert notice.finds(b" before " + bytes(data) + b" after "), (text, spared)


def test_spans_are_words_of_the_text():
    n, exact, near, score = L.scan_text("one two released under the MIT license three", [L.Notice(*x) for x in L.NOTICES])
    assert n == 8 and exact == [("mit", 5)] and score == 1
    assert [x[1:3] for x in near if x[0] == "mit"] == [(5, 6)]


def test_rows_and_empty_table(spark, empty):
    assert [r["n_words"] for r in records(L.scan(frame(spark, [(None, "a"), (1, "a b"), (1, "a b")])))] == [1, 2, 2]
    assert records(L.digest(L.scan(empty))) == []


def test_worse_occurrences_beside_a_better_one_are_found():
    near = L.scan_text("all rihts reservd all rights reservd all rights reserved all rights resrved", [L.Notice(*x) for x in L.NOTICES])[2]
    assert [x for x in near if x[0] == "reserved"] == [("reserved", 0, 2, 2), ("reserved", 3, 5, 1), ("reserved", 6, 8, 0), ("reserved", 9, 11, 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_near(text, notices):
    """All runs of words within the errors of a notice; of those that overlap the one with fewest errors, then the first."""
    w, found = words(text), []
    for notice in notices:
        size, taken = len(notice.text), []
        runs = []
        for i in range(len(w)):
            for j in range(i, len(w)):
                run = " ".join(w[i : j + 1]).encode()
                if len(run) > size + notice.errors:
                    break
                if len(run) >= size - notice.errors and (d := distance(run, notice.text)) <= notice.errors:
                    runs.append((d, i, j))
        for d, i, j in sorted(runs):
            if all(j < a or i > b for _, a, b in taken):
                taken.append((d, i, j))
        found += [(notice.label, i, j, d) for d, i, j in taken]
    return sorted(found, key=lambda x: (x[1], x[0], x[2], x[3]))


def harmed(rnd, text, errors):
    for _ in range(errors):
        at, kind = rnd.randrange(len(text)), rnd.randrange(4)
        text = text[:at] + ("" if kind == 0 else rnd.choice("abcdeilnorst") + (text[at:] if kind == 1 else text[at + 1 :])) + ("" if kind else text[at + 1 :])
    return text


def test_notices_equal_brute_force(prose):
    """Many harmed notices in one text, side by side and among other words: every label and every error count."""
    rnd, notices = random.Random(6), [L.Notice(*x) for x in L.NOTICES]
    seen = 0
    for _ in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 8)):
            notice = rnd.choice(L.NOTICES)[0]
            parts += [harmed(rnd, notice, rnd.randrange(0, len(notice) // 9 + 2)), *([prose(rnd.randrange(1, 4))] if rnd.random() < 0.5 else [])]
        text = " ".join(parts)
        near, wanted = L.scan_text(text, notices)[2], brute_near(text, notices)
        assert near == wanted, text
        seen += len(near)
    assert seen > 150


@pytest.mark.parametrize("text", ["mozila public license mozilla public license", "gnu general public licence gnu general public license", "all right reserved all rights reserved"])
def test_adjacent_notices_are_both_found(text):
    assert len(L.scan_text(text, [L.Notice(*x) for x in L.NOTICES])[2]) == 2


def test_a_very_long_text_takes_time_in_proportion():
    notices = [L.Notice(*x) for x in L.NOTICES]
    began = time.time()
    n, exact, near, _ = L.scan_text("mit license all rights resrved " * 150_000, notices)  # 4.6 MB
    assert (n, len(exact)) == (750_000, 150_000) and len(near) == 300_000
    assert time.time() - began < 60
