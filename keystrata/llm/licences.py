"""License scans: exact phrases, and short notices found in spite of errors.

A notice of n characters may have n // ``CHARS_PER_ERROR`` errors (insertions, deletions, substitutions).
Cut into one piece more than that, at least one piece stands unharmed in every occurrence (pigeonhole), so
exact searches for the pieces find all candidates. The regex library's bounded-error matching then decides
on the surroundings of each seed, from word to word, and reports span and errors. Of finds that overlap, the
one with fewest errors stands, then the first.

All matching is on words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty texts
have no words and no finds. Very long texts are scanned whole, in time in proportion to their length and their
finds. Rows are scanned one by one: repeated rows, null identifiers, ties and empty tables need no care, and
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.scratch import bound_batches
from keystrata.llm.words import Recent, release, word_bytes

# Phrases that are sought word for word, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices that are sought with errors, with their labels.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("apache license", "apache"),
    ("mit license", "mit"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge", "mit"),
    ("all rights reserved", "reserved"),
)
CHARS_PER_ERROR = 9


class Notice:
    """A notice with its seeds: (piece, its offset in the notice)."""

    def __init__(self, text: str, label: str):
        self.text, self.label, self.errors = text.encode(), label, len(text) // CHARS_PER_ERROR
        cuts = [len(text) * i // (self.errors + 1) for i in range(self.errors + 2)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(b"(?b)(?<= )(?:%b){e<=%d}(?= )" % (regex.escape(self.text, special_only=True), self.errors))
        self.verified = Recent(self._best, 20_000)

    def _best(self, window: bytes) -> tuple[int, int, int] | tuple[()]:
        match = self.pattern.search(window)
        return (match.start(), match.end(), sum(match.fuzzy_counts)) if match else ()

    def finds(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, errors) of occurrences in ``data`` (words between blanks), none overlapping another, in order."""
        met: set[tuple[int, int, int]] = set()
        for seed, offset in self.seeds:
            at = data.find(seed)
            while at >= 0:
                # All of an occurrence around this seed, with the blanks before and behind it.
                begin = max(0, at - offset - self.errors - 1)
                if best := self.verified[data[begin : at - offset + len(self.text) + self.errors + 1]]:
                    met.add((best[2], begin + best[0], begin + best[1]))
                at = data.find(seed, at + 1)
        taken: list[tuple[int, int, int]] = []
        for errors, start, end in sorted(met):
            n = bisect_right(taken, (start,))
            if (n == 0 or taken[n - 1][1] <= start) and (n == len(taken) or end <= taken[n][0]):
                insort(taken, (start, end, errors))
        return taken


def scan_text(text: str | None, notices: list[Notice]) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int]], float]:
    """Number of words; exact places (label, first word); notices (label, first word, last word, errors); score."""
    words = word_bytes(text)
    data = b" " + b" ".join(words) + b" "
    exact: list[tuple[int, str]] = []
    for phrase, label in PHRASES:
        needle = b" %b " % phrase.encode()
        at = data.find(needle)
        while at >= 0:
            exact.append((at, label))
            at = data.find(needle, at + 1)
    near = [(start, end - 1, errors, notice) for notice in notices for start, end, errors in notice.finds(data)]
    if not exact and not near:
        return len(words), [], [], 0.0
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    word = lambda at: np.searchsorted(blanks, at).tolist()
    places = sorted(zip([x[1] for x in exact], word([x[0] for x in exact]), strict=True), key=lambda x: (x[1], x[0]))
    spans = zip(near, word([x[0] for x in near]), word([x[1] for x in near]), strict=True)
    found = sorted(((x[3].label, first - 1, last - 1, x[2]) for x, first, last in spans), key=lambda x: (x[1], x[0], x[2], x[3]))
    return len(words), places, found, 1.0 if places else max(1 - x[2] / len(x[3].text) for x in near)


SCAN = "doc_id long, n_words long, exact array<struct<label string, word long>>, near array<struct<label string, first_word long, last_word long, errors int>>, score double"


def scan(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, exact, near, score.

    ``score`` is 1 with an exact phrase, else the best notice's share of unharmed characters, else 0.
    """
    bound_batches(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("exact", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
        ("near", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())]))), ("score", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        notices = [Notice(*x) for x in NOTICES]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, places, near, score = scan_text(text, notices)
                rows.append((doc_id, n, [{"label": a, "word": w} for a, w in places], [{"label": a, "first_word": i, "last_word": j, "errors": e} for a, i, j, e in near], score))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SCAN)


def digest(found: DataFrame) -> DataFrame:
    """``scan`` as one flat row for each document: counts, first and last exact place, labels."""
    exact = F.transform("exact", lambda x: x["label"])
    near = F.transform("near", lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    words = F.transform("exact", lambda x: x["word"])
    return found.select("doc_id", "n_words", F.size("exact").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(exact).alias("base_labels"), joined(F.concat(exact, near)).alias("labels"), "score", F.size("near").cast("long").alias("n_near"))
