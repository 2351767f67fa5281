"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of a text's (or a language's) most frequent n-grams in order. A
document is given the language whose profile is nearest by out-of-place distance: the sum,
over the document's n-grams, of the difference of the two ranks, or the profile's length
where the language lacks the n-gram.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegauge.llm.bpe import id_type
from codegauge.llm.tables import in_batches

PROFILE = 300
PIECE = 1 << 18  # characters looked at together
BITS = 21  # a code point
BLANK = 1  # stands for whatever is no letter
HELD = 1 << 20  # n-grams a task holds before it passes their counts on
UNKNOWN = "und"
# How far below its median a language's texts may score: in distances of the lower quartile, and at least this share of the median.
REACH, LEAST_REACH = 6.0, 0.5


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (n = 1 to 3) of the lower-cased text's words, with counts.

    Whatever is no letter separates words and counts as a blank at their ends. An n-gram is
    packed into one number, so that equal n-grams are equal everywhere and ties of counts
    have one order. Long texts are counted piece by piece.
    """
    found, text = [], text.lower()
    for k in range(0, len(text), PIECE):
        # two characters are shared with the piece before, so that no n-gram is cut
        code = np.frombuffer(text[max(0, k - 2) : k + PIECE].encode("utf-32-le", "replace"), np.uint32)
        code = np.where(letters()[code], code, BLANK).astype(np.int64)
        code = np.concatenate([[BLANK] * (k == 0), code, [BLANK] * (k + PIECE >= len(text))]).astype(np.int64)
        one = code[2 * (k > 0) :]
        two = code[:-1] << BITS | code[1:]
        three = (code[:-2] << 2 * BITS | code[1:-1] << BITS | code[2:])[code[1:-1] != BLANK]
        two = two[two != (BLANK << BITS | BLANK)] if k == 0 else two[1:][two[1:] != (BLANK << BITS | BLANK)]
        found.append(np.unique(np.concatenate([one[one != BLANK], two, three]), return_counts=True))
    return merged(found)


def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first; of equal counts the smaller key first."""
    if len(keys) > 4 * size:  # most can be left out before sorting
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's most frequent n-grams over all rows of (text, lang).

    Rows without text or language are left out. Counts are summed in the tasks before they
    are shuffled; the result, at most ``size`` n-grams per language, is the model.
    """

    def count(batches):
        held: dict[str, list] = {}
        size_ = 0

        def out():
            for lang, found in held.items():
                keys, n = merged(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())],
                    ["lang", "gram", "n"],
                )

        for batch in batches:
            new: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.setdefault(lang, []).append(grams(text))
            for lang, found in new.items():
                held[lang] = [merged([*held.get(lang, []), *found])]
            size_ = sum(len(f[0][0]) for f in held.values())
            if size_ > HELD:
                yield from out()
                held = {}
        yield from out()

    rows = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = in_batches(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for r in top.select("lang", "rank", "gram").collect():  # languages x size rows
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(p)] for lang, p in sorted(profiles.items())}


class Profiles:
    """The languages' ranks of every n-gram that any of them has."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.langs, self.size = list(profiles), size
        self.keys = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(profiles)), -1, np.int64)
        for k, p in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.keys, np.array(p, np.int64)), k] = np.arange(len(p))

    def guess(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 minus the distance as a share of the largest possible one.

        ``und`` and 0 for a null text, one without letters, or when no language was learned.
        Of equally near languages the first in the order of their names is taken.
        """
        scores = self.scores(text)
        if scores is None:
            return UNKNOWN, 0.0
        k = int(scores.argmax())
        return self.langs[k], float(scores[k])

    def scores(self, text: str | None) -> np.ndarray | None:
        """The score of every language, or nothing where there is none to give."""
        if not text or not self.langs:
            return None
        doc = ranked(*grams(text), self.size)
        if not len(doc):
            return None
        at = np.searchsorted(self.keys, doc)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == doc, at, len(self.keys))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(doc))[:, None])).sum(0)
        return 1.0 - away / (self.size * len(doc))


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    Other columns are not looked at; repeated rows are answered one by one.
    """

    def run(batches):
        model = Profiles(profiles, size)
        for batch in batches:
            got = [model.guess(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type(docs)}, lang_pred string, score double")


def learn_bounds(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> dict[str, float]:
    """The least score of a text of each language, from all rows of (text, lang).

    Every labelled text is scored by its own language's profile. The bound lies ``REACH``
    distances from median to lower quartile below the median, so up to a quarter of wrongly
    labelled texts moves it little; equal scores count once, so that copies do not either.
    """

    def run(batches):
        model = Profiles(profiles, size)
        place = {lang: k for k, lang in enumerate(model.langs)}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            found = [(g, model.scores(t)) for t, g in zip(batch.column(0).to_pylist(), langs, strict=True) if g in place]
            found = [(g, float(s[place[g]])) for g, s in found if s is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"]
            )

    rows = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    scores = in_batches(rows, run, "lang string, score double").distinct()
    quart = F.percentile_approx("score", F.array(F.lit(0.25), F.lit(0.5)))
    return {
        r["lang"]: r["q"][1] - max(REACH * (r["q"][1] - r["q"][0]), LEAST_REACH * r["q"][1])
        for r in scores.groupBy("lang").agg(quart.alias("q")).collect()  # one row per language
    }


def of_known_language(
    docs: DataFrame, profiles: dict[str, list[int]], least: float | dict[str, float], size: int = PROFILE
) -> DataFrame:
    """The documents, with all their columns, whose language is found with at least the given score.

    ``least`` is one score or a score per language. Null texts and texts without letters go.
    """
    # The text is read from its row, so that it is sent to the workers once.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = [c.lower() for c in docs.columns].index("text")
    bound = lambda lang: least[lang] if isinstance(least, dict) else least

    def run(batches):
        model = Profiles(profiles, size)
        for batch in batches:
            got = [model.guess(t) for t in batch.column(0).field(place).to_pylist()]
            good = pa.array([lang != UNKNOWN and score >= bound(lang) for lang, score in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["row"]).filter(good)

    return in_batches(rows, run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
