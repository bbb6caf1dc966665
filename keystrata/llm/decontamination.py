"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Each word is hashed once, and ``GRAM`` neighbouring hashes become the hash of a gram by doubling (of two,
of four, of five words). Winnowing keeps the least gram of every ``SPAN`` neighbours, the rightmost of equals;
a gram's place stands in the low bits of its number, so the least number is that gram. Two texts that share
``GRAM + SPAN - 1`` words, the length of a window, keep the same gram at the same place of it, so joining the
kept grams of documents with the one kept gram of each benchmark window finds every occurrence. Only then are
words cut out around a hit, which is extended to the whole window and compared word by word. Items that are
shorter than a window are one window themselves; grams of exactly their length (there are at most nine lengths)
find those.

The grams of the benchmark, two numbers each, are broadcast while they number at most ``BROADCAST_GRAMS``,
otherwise they are joined by a shuffle. Windows and items stay rows: a window of very many items is no list.
What a document hits is gathered by document, never by item or window.

Null texts, and texts without words, have no words, no hits and no items; very long texts are read whole.
Rows of ``documents`` that repeat an identifier are told apart by their texts and each gets its own result; a
null identifier is a value like any other. Items without words never occur; rows that repeat an item count
once. Columns other than the identifiers and texts are not read; an empty table gives no rows, and an empty
benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.scratch import Tables, few, write

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BROADCAST_GRAMS = 1_000_000
PLACE = (1 << 30) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in texts of either case.
BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The array of words of a text."""
    return F.filter(F.split(lowered(text), BETWEEN), lambda word: word != "")


def count_words(text: Column) -> Column:
    """How many words a text has; case makes no difference."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_ANY), "")).cast("long")


def folded(table: DataFrame, column: str, width: int, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """``table`` with ``column`` (an array) replaced by the combination of each ``width`` neighbours, in order.

    Runs of 2, 4, 8 ... neighbours are combined first, each in a column of its own: no element is combined twice.
    """
    runs, size = {1: column}, 1

    def joined(left: str, right: str, shift: int, n: int) -> Column:
        count = F.greatest(F.size(column) - (n - 1), F.lit(0))
        return F.zip_with(F.slice(left, 1, count), F.slice(right, shift + 1, count), combine)

    while size * 2 <= width:
        runs[size * 2] = f"_run_{size * 2}"
        table = table.withColumn(runs[size * 2], joined(runs[size], runs[size], size, size * 2))
        size *= 2
    whole, done = runs[size], size
    while done < width:
        size = max(n for n in runs if done + n <= width)
        table = table.withColumn(f"_fold_{done + size}", joined(whole, runs[size], done, done + size))
        whole, done = f"_fold_{done + size}", done + size
    return table.withColumn("_whole", F.col(whole)).drop(column, *[x for x in table.columns if x.startswith(("_run_", "_fold_"))]).withColumnRenamed("_whole", column)


def placed(table: DataFrame, n: int) -> DataFrame:
    """``table`` (words, ...) with ``spots``: the numbers of the kept grams, or of all grams of ``n`` words for short windows.

    The high bits are the gram's hash, the low ones count down from PLACE: the later of two equal grams is less.
    """
    table = table.withColumn("spots", F.transform("words", lambda word: F.xxhash64(word)))
    table = folded(table, "spots", GRAM if n == WINDOW else n, lambda a, b: F.xxhash64(a, b))
    table = table.withColumn("spots", F.transform("spots", lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.lit(PLACE) - i)))
    if n < WINDOW:
        return table
    return folded(table, "spots", SPAN, lambda a, b: F.least(a, b)).withColumn("spots", F.array_distinct("spots"))


def split_spot(spot: Column) -> tuple[Column, Column]:
    """The hash of a gram and its place (word, from 0) from its number."""
    return spot.bitwiseAND(F.lit(~PLACE)), F.lit(PLACE) - spot.bitwiseAND(F.lit(PLACE))


def windows(items: DataFrame) -> DataFrame:
    """Windows of ``items`` (item_id, text) by item: item, window (its words), their number n."""
    worded = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    each = worded.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, F.lit(WINDOW)))).alias("window"))
    return each.distinct().withColumn("n", F.size("window"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document that has a hit: doc_id, text_hash, n_hit (words inside occurrences) and items, sorted.

    Covered words and items are made distinct before they are counted, in partial aggregates by document.
    """
    key = ["doc_id", "text_hash"]
    same = lambda a, b: [F.equal_null(a[k], b[k]) for k in key]
    with Tables(docs.sparkSession) as tables:
        members = tables.write(windows(benchmark), "windows")
        lengths = sorted(r.n for r in members.select("n").distinct().collect())
        if not lengths:
            return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
        distinct = members.select(F.col("window").alias("words"), "n").distinct()
        known = reduce(DataFrame.unionAll, (placed(distinct.where(F.col("n") == n), n).select("words", "n", F.get("spots", F.lit(0)).alias("spot")) for n in lengths))
        gram, place = split_spot(F.col("spot"))
        known = tables.write(known.select(F.col("words").alias("window"), "n", gram.alias("gram"), place.alias("place")), "grams")
        sought = few(tables.write(known.select(F.col("n").alias("of_n"), F.col("gram").alias("of_gram")).distinct(), "sought"), BROADCAST_GRAMS)

        worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
        found = []
        for n in lengths:
            # Not explode(): the filter that Spark infers for it would compute all of this a second time, column within column.
            spots = placed(worded, n).select(*key, F.explode_outer("spots").alias("spot")).where("spot IS NOT NULL")
            spots = spots.select(*key, F.lit(n).alias("n"), gram.alias("gram"), place.alias("p"))
            found.append(spots.join(sought.where(F.col("of_n") == n), F.col("gram") == F.col("of_gram"), "left_semi"))
        found = tables.write(reduce(DataFrame.unionAll, found), "spots")

        hit = few(tables.write(found.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).distinct(), "hit"))
        text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        text = text.join(hit, F.equal_null("doc_id", "of_doc") & (F.col("text_hash") == F.col("of_text")), "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
        text = text.select(*key, words_of(F.col("text")).alias("words"))
        places = found.groupBy(*key).agg(F.collect_list(F.struct("n", "gram", "p")).alias("places"))
        reach = WINDOW - GRAM
        first = lambda p: F.greatest(p - reach, F.lit(0))
        near = text.join(places, same(text, places)).select(text["doc_id"], text["text_hash"], F.explode(F.transform("places", lambda s: F.struct(
            s["n"].alias("n"), s["gram"].alias("gram"), s["p"].alias("p"), F.slice("words", first(s["p"]) + 1, F.lit(2 * reach + GRAM)).alias("near")))).alias("s")).select(*key, "s.*")
        at = F.col("p") - F.col("place")
        near = near.join(known, ["n", "gram"]).where((at >= 0) & (F.slice("near", at - first(F.col("p")) + 1, F.col("n")) == F.col("window")))
        found = tables.write(near.select(*key, at.alias("at"), "n", "window"), "hits")

        covered = found.select(*key, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("word")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
        named = found.select(*key, "window").distinct().join(members, "window").select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
        return write(covered.join(named, same(covered, named)).select(covered["doc_id"], covered["text_hash"], "n_hit", "items"), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), count_words(F.col("text")).alias("n_words"))
    found = hits(docs, benchmark).select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "n_hit", "items")
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of ``benchmark`` occurs."""
    dirty = write(hits(docs, benchmark).select(F.col("doc_id").alias("_of_doc"), F.col("text_hash").alias("_of_text")), "dirty")
    return docs.join(few(dirty), docs["doc_id"].eqNullSafe(F.col("_of_doc")) & (F.xxhash64(docs["text"]) == F.col("_of_text")), "left_anti")
