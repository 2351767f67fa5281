"""Spelling variants: words one edit apart, found by pivotal bigrams.

A word's bigrams are put in order of how rare they are among all words. Its prefix are the
three rarest places and all further places of the third one's bigram. Two of them that do not
overlap are its pivots, chosen by dynamic programming for the shortest lists they are searched
in. One edit spoils at most one of two disjoint bigrams, so of two near words one, the one
whose prefix ends no later in the order, has a pivot in the other's prefix.

The place of the edit says more: if it lies behind the left pivot, the words are equal up to
that pivot's end; if not, they are equal from the right pivot on. So the pivots are indexed
with all that lies before or behind them, which also fixes their position from that end, and
meet prefix bigrams of words whose length differs by at most one. What then meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.tables import drop_written, in_batches, key_and_text, written

LEAST_LETTERS, LEAST_COUNT = 5, 3
HELD_WORDS = 200_000
COUNTERS = 1 << 18  # for how many words share a beginning or an end
DAMAGED = 97  # one in so many (document, word) pairs loses a letter
# Fixed value: words are runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def damaged(word: bytes, mark: int) -> bytes:
    """The word without the code point that ``mark`` names."""
    letters = word.decode()
    at = mark % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of (doc_id, text), after the deletions, of at least ``LEAST_LETTERS`` letters.

    Only one in ``DAMAGED`` words of a document is changed, so a document's words are counted
    first and then each distinct one is tried. Tasks count before they shuffle.
    """

    def run(batches):
        held: Counter = Counter()

        def out():
            words = [(w.decode(), n) for w, n in held.items()]
            words = [(w, n) for w, n in words if len(w) >= LEAST_LETTERS]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"]
            )

        crc32 = zlib.crc32
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(WORD.findall(text.encode().lower()))
                begin = crc32(f"{'' if key is None else key}:".encode())
                moved = [(w, words[w]) for w in words if not crc32(w, begin) % DAMAGED]
                for word, _ in moved:
                    del words[word]
                for word, n in moved:
                    words[damaged(word, crc32(word, begin))] += n
                held.update(words)
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return in_batches(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many places of the words hold each bigram: at most the square of 90 letters rows."""
    grams = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    rows = words.select("word", grams).groupBy(F.substring("word", F.col("at"), F.lit(2)).alias("gram")).agg(F.count("*").alias("n"))
    return {r["gram"]: r["n"] for r in rows.collect()}


def part_counts(words: DataFrame) -> np.ndarray:
    """Counters, of a fixed number, of how many words share each beginning and end."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            at = [slot(side, part) for w in batch.column(0).to_pylist() for side, part in parts(w, range(len(w) - 1))]
            total += np.bincount(np.array(at, np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["slot", "n"])

    rows = in_batches(words.select("word"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[[r["slot"] for r in rows]] = [r["n"] for r in rows]
    return out


def parts(word: str, places) -> list[tuple[str, str]]:
    """Of each bigram place, all up to the bigram's end and all from its beginning."""
    return [x for k in places for x in (("l", word[: k + 2]), ("r", word[k:]))]


def slot(side: str, part: str) -> int:
    return xxhash.xxh3_64_intdigest(side + part) & (COUNTERS - 1)


def prefix_of(word: str, ranks: dict[str, int]) -> tuple[list[int], int]:
    """Places of the prefix bigrams and the rank of the last one."""
    own = [ranks[word[k : k + 2]] for k in range(len(word) - 1)]
    last = sorted(own)[2]
    return [k for k, r in enumerate(own) if r <= last], last


def pivots_of(word: str, places: list[int], counts: np.ndarray) -> tuple[int, int]:
    """Two disjoint places with the least to search: the left one's beginnings, the right one's ends.

    Dynamic programming from left to right: the cheapest left pivot that ends before each place.
    """
    best, pair = None, (places[0], places[-1])
    cheapest, left, k = None, None, 0
    for right in places:
        while k < len(places) and places[k] + 2 <= right:
            cost = int(counts[slot("l", word[: places[k] + 2])])
            if cheapest is None or cost < cheapest:
                cheapest, left = cost, places[k]
            k += 1
        if left is not None:
            cost = cheapest + int(counts[slot("r", word[right:])])
            if best is None or cost < best:
                best, pair = cost, (left, right)
    return pair


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of all words one inserted, deleted or replaced code point apart."""
    grams = gram_counts(words)
    ranks = {g: k for k, g in enumerate(sorted(grams, key=lambda g: (grams[g], g)))}
    sent = words.sparkSession.sparkContext.broadcast((ranks, part_counts(words)))

    def run(batches):
        ranks, counts = sent.value
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for word in batch.column(0).to_pylist():
                places, last = prefix_of(word, ranks)
                left, right = pivots_of(word, places, counts)
                for side, part in parts(word, places):
                    at = len(part) - 2 if side == "l" else len(word) - len(part)
                    is_pivot = at == (left if side == "l" else right)
                    key = xxhash.xxh3_64_intdigest(side + part) - (1 << 63)
                    for to, value in zip(rows, (key, word, len(word), last, is_pivot), strict=True):
                        to.append(value)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["key", "word", "letters", "last", "pivot"]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    index = written(in_batches(words.select("word"), run, "key long, word string, letters int, last int, pivot boolean"), "grams")
    x, y = index.where("pivot").alias("x"), index.alias("y")
    meets = (F.col("x.key") == F.col("y.key")) & (F.abs(F.col("x.letters") - F.col("y.letters")) <= 1)
    meets &= (F.col("x.last") <= F.col("y.last")) & (F.col("x.word") != F.col("y.word"))
    # a replaced letter or one more or less, tested beside each other before pairs are made distinct
    one = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    found = x.join(y, meets & one).select(F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("b")).distinct()
    found = written(found, "near")
    drop_written([index])
    return found


def roots(words: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by following two steps as one until none moves.

    A form is at least twice as frequent, so a path has at most as many steps as the greatest
    count has bits, and the rounds are few.
    """
    paths = written(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(paths.join(next_, "root", "left").select("word", "root", "further"), "roots")
        drop_written([paths])
        paths = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.where("further IS NOT NULL").isEmpty():
            return moved.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs ``LEAST_COUNT`` times or more.

    Words are runs of letters of whole texts, of at least ``LEAST_LETTERS`` code points, after
    one in ``DAMAGED`` of a document's distinct words has lost a letter named by a hash of the id
    and the word. A word's form is its most frequent near word (ties: the first in code-point
    order), if that is at least twice as frequent; its root is where following forms ends.
    Null and empty texts have no words; repeated rows are counted as often as they stand; a null
    id is written empty in the hash; other columns are not looked at; an empty table gives no rows.
    """
    words = written(word_counts(key_and_text(docs)).where(F.col("n") >= LEAST_COUNT), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    frequency = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # the least of (-n, word) is the most frequent, and of equally frequent ones the first
    about = both.join(frequency, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best")
    )
    known = words.join(about, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n")
    )
    fits = F.col("other_n") >= 2 * F.col("n")
    known = written(known.select("word", "n", "n_near", F.when(fits, F.col("other")).alias("form"), F.when(fits, F.col("other_n")).alias("form_n")), "forms")
    drop_written([words, pairs])
    return known.join(roots(known), "word", "left").withColumn("root", F.coalesce("root", "word"))
