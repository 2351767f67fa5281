"""Packing of documents into sequences as a cutting-stock problem.

The lengths of all pieces are a histogram of at most ``SEQUENCE`` entries, whatever the
size of the corpus. A linear program over patterns (how many pieces of which length share
a sequence) starts with best-fit patterns and is solved by column generation: a knapsack by
dynamic programming finds the pattern that the current prices make most profitable. Rounded
patterns, and best fit for the pieces that rounding leaves, give every length a list of
slots; the r-th piece of a length takes the r-th slot.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegauge.llm.bpe import byte_bpe, id_type, vocabulary
from codegauge.llm.tables import forget, in_batches, key_and_text, written

SEQUENCE = 2048
END = 1
CHUNK = 20_000  # pieces of one length that are ranked together
GAP = 1e-3  # the program ends this near to the fewest sequences that its prices prove
STALLED = 100  # rounds in which the program may stand still
ROUND_UP = 0.8  # a pattern with this fraction left over is used once more
CHECKED = 200  # rounds after which the inverse is tested


def cut(docs: DataFrame, sequence: int = SEQUENCE, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """Pieces of every document: (doc_id, start, length, ids_crc32, doc_tokens).

    A document is the ids of its whole text (null: empty) and the end id. It is cut after
    every ``sequence`` ids; what is left is its last piece.
    """
    end = END.to_bytes(4, "little")

    def run(batches):
        forget(byte_bpe)
        coder = byte_bpe(path or vocabulary(name))
        for batch in batches:
            # all ids of the batch after one another, and where each piece lies in them
            coded = coder.encode_batch(batch.column(1).to_pylist())
            flat = memoryview(b"".join([x for ids in coded for x in (ids, end)]))
            tokens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4 + 1
            pieces = -(-tokens // sequence)
            doc = np.repeat(np.arange(len(coded)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
            length = np.minimum(tokens[doc] - start, sequence)
            lo = 4 * ((np.cumsum(tokens) - tokens)[doc] + start)
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = f"doc_id {id_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long"
    return in_batches(key_and_text(docs), run, schema)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of total size at most ``room``: unbounded knapsack over sizes."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        n = int(np.searchsorted(sizes, w, side="right"))
        value[w] = value[w - 1]
        if n:
            tried = value[w - sizes[:n]] + prices[:n]
            k = int(tried.argmax())
            if tried[k] > value[w]:
                value[w], last[w] = tried[k], k
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= int(sizes[last[w]])
    return float(value[room]), pattern


def times_vector(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product without the threads that a BLAS would start beside the driver's."""
    return (matrix * vector).sum(1)


def inverted(basis: np.ndarray, demand: np.ndarray) -> np.ndarray | None:
    """The basis' inverse, or None where it has none that solves for the demand."""
    try:
        inverse = np.linalg.inv(basis)
    except np.linalg.LinAlgError:
        return None
    return inverse if np.allclose(times_vector(basis, times_vector(inverse, demand)), demand, rtol=1e-6) else None


def start_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit patterns that each use up one size (a column each), and how often each is used."""
    m = len(sizes)
    basis, used, rest = np.zeros((m, m)), np.zeros(m), demand.copy()
    while (rest > 0).any():
        pattern = fullest({int(k): int(np.ceil(rest[k])) for k in np.flatnonzero(rest > 0)}, sizes, room)
        times = np.where(pattern > 0, rest / np.maximum(pattern, 1), np.inf)
        out = int(times.argmin())
        basis[:, out], used[out] = pattern, times[out]
        rest -= times[out] * pattern
        rest[out] = 0
        rest[rest < 1e-9 * demand] = 0
    for k in np.flatnonzero(basis.sum(0) == 0):
        basis[k, k] = room // sizes[k]
    return basis, used


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often the linear program uses them (fractions).

    Revised simplex for: least number of sequences such that every size is covered. The basis
    has one pattern per size, so the result is bounded by the number of sizes. It starts with
    best-fit patterns that each use up one size. Every round prices columns: the knapsack finds
    the pattern that the prices value most, and the prices by that value prove a least number of
    sequences. It ends when no pattern is worth more than a sequence or when the program is within
    ``GAP`` of the number proved; and with the cover so far where ``STALLED`` rounds brought nothing,
    as degenerate steps can, or where the start cannot be inverted in floating point. ``rounds`` collects the program's value before each round.
    """
    m = len(sizes)
    basis, used = start_basis(sizes, demand, room)
    inverse: np.ndarray | None = None
    even = sizes / room  # the prices at which every full sequence is worth one
    proved, least, k, since = 0.0, np.inf, 0, 0
    while since < STALLED:
        k += 1
        if rounds is not None:
            rounds.append(float(used.sum()))
        since = 0 if used.sum() < least * (1 - GAP / 10) else since + 1
        least = min(least, float(used.sum()))
        prices = even if inverse is None else inverse.sum(0)  # every pattern costs one sequence
        # steadied prices find full patterns soon; the program's own have the last word
        for share in (1.0,) if inverse is None else (0.95, 0.7, 0.0):
            tried = np.maximum(share * even + (1 - share) * prices, 0)
            worth, pattern = best_pattern(sizes, tried, room)
            proved = max(proved, float(demand @ tried) / max(worth, 1e-9))  # these prices by their best pattern's worth
            pattern = np.where(prices > 0, pattern, 0)
            if worth_it := prices @ pattern > 1 + 1e-6:
                break
        if used.sum() <= (1 + GAP) * proved or np.ceil(used.sum() - 1e-6) <= np.ceil(proved - 1e-6):
            break  # no program has noticeably fewer sequences, or none at all by whole ones
        if inverse is None:  # even prices proved too little, so the program's own are needed
            inverse = inverted(basis, demand)
            if inverse is None:
                break  # too many small steps follow from one another to be solved for
            continue
        if not worth_it:
            break
        step = times_vector(inverse, pattern)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        at = np.flatnonzero(step)
        inverse[at] -= step[at, None] * row
        inverse[out] = row
        used = np.where(np.arange(m) == out, ratio[out], used - ratio[out] * step)
        if k % CHECKED == 0 and (np.abs(times_vector(basis, used) - demand) > 1e-6 * demand.max()).any():
            fresh = inverted(basis, demand)
            if fresh is None:
                break
            inverse, used = fresh, times_vector(fresh, demand)
    return basis.T.round().astype(np.int64), np.maximum(used, 0)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, rounds: list | None = None) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each length in one) covering the histogram of lengths exactly.

    The linear program decides: whole times of its patterns first, then its patterns once more,
    those with the largest fraction first, as long as all their pieces are still to be placed.
    Best fit, largest first, takes the pieces that rounding leaves. Pieces as long as a sequence
    have only one pattern.
    """
    left = Counter({c: n for c, n in histogram.items() if n})
    rows: list[tuple[int, dict[int, int]]] = []
    if sequence in left:
        rows.append((left.pop(sequence), {sequence: 1}))
    if not left:
        return rows
    sizes = np.array(sorted(left), np.int64)
    demand = np.array([left[int(s)] for s in sizes], float)
    unit = int(np.gcd.reduce(sizes))
    patterns, used = column_generation(sizes // unit, demand, sequence // unit, rounds)
    order = np.argsort(-(used - np.floor(used)), kind="stable")
    for k, times in [*((k, int(used[k] + 1e-6)) for k in range(len(sizes))), *((int(k), 1) for k in order if used[k] % 1 >= ROUND_UP)]:
        pieces = {int(s): int(a) for s, a in zip(sizes, patterns[k], strict=True) if a}
        times = min([times, *(left[s] // a for s, a in pieces.items())])
        if times > 0 and pieces:
            rows.append((times, pieces))
            for s, a in pieces.items():
                left[s] -= times * a
    return rows + best_fit(Counter({s: n for s, n in left.items() if n}), sequence)


def fullest(left: dict[int, int], sizes: np.ndarray, room: int) -> np.ndarray:
    """The largest size that is left, and those that leave the least room beside it."""
    order = sorted(left, reverse=True)  # sizes ascend
    pattern = np.zeros(len(sizes), np.int64)
    pattern[order[0]] = 1
    start = int(sizes[order[0]])
    order = [order[0], *(k for k in order[1:] if sizes[k] <= room - start)]
    reach = np.full(room + 1, -2)  # the size that first reaches a sum
    reach[start] = -1
    for k in order:
        s = int(sizes[k])
        for _ in range(min(left[k] - (k == order[0]), (room - start) // s)):
            now = np.flatnonzero(reach[: room + 1 - s] != -2)
            new = now[reach[now + s] == -2] + s
            reach[new] = k
            if not len(new) or reach[room] != -2:
                break
        if reach[room] != -2:
            break
    w = int(np.flatnonzero(reach != -2)[-1])
    while reach[w] >= 0:
        pattern[reach[w]] += 1
        w -= int(sizes[reach[w]])
    return pattern


def best_fit(left: Counter, sequence: int) -> list[tuple[int, dict[int, int]]]:
    """Sequences for the rest, each filled as far as the pieces that are left can."""
    sizes = np.array(sorted(left), np.int64)
    rows = []
    while left:
        pattern = fullest({k: left[int(s)] for k, s in enumerate(sizes) if left[int(s)]}, sizes, sequence)
        pieces = {int(s): int(a) for s, a in zip(sizes, pattern, strict=True) if a}
        times = min(left[s] // a for s, a in pieces.items())
        rows.append((times, pieces))
        left -= Counter({s: times * a for s, a in pieces.items()})
    return rows


class Slots:
    """Where the r-th piece of each class goes."""

    def __init__(self, rows: list[tuple[int, dict[int, int]]]) -> None:
        self.by_class: dict[int, tuple[np.ndarray, ...]] = {}
        found: dict[int, list] = {}
        base = 0
        for times, pieces in rows:
            at, tokens = 0, sum(c * a for c, a in pieces.items())
            for c in sorted(pieces, reverse=True):
                found.setdefault(c, []).append((times * pieces[c], base, pieces[c], at, tokens))
                at += pieces[c] * c
            base += times
        for c, rows_ in found.items():
            n, *places = (np.array(x, np.int64) for x in zip(*rows_, strict=True))
            self.by_class[c] = (np.cumsum(n) - n, *places)
        self.sequences = base

    def place(self, c: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset in it and its tokens, of the pieces with these ranks (from 0)."""
        first, base, each, at, tokens = self.by_class[c]
        k = np.searchsorted(first, ranks, side="right") - 1
        r = ranks - first[k]
        return base[k] + r // each[k], at[k] + r % each[k] * c, tokens[k]


def pack(docs: DataFrame, sequence: int = SEQUENCE, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """Packs all documents; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens. Sequences are numbered from 0 without gaps; the pieces of one fill it
    gapless from 0. Every row of the table is a document, repeated rows too; a null text is an
    empty one with the end id alone. An empty table gives no rows.
    """
    pieces = written(cut(docs, sequence, name, path), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `sequence` rows
    slots = Slots(plan(histogram, sequence))
    # rank within a length: one may hold most pieces, so it is ranked in chunks
    chunks = max(1, -(-max(histogram.values(), default=0) // CHUNK))
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)))
    sizes = chunked.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    ranked = chunked.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "chunk"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("first", "chunk")
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            ranks = batch.column(5).to_numpy()
            seq, at, tokens = (np.zeros(len(lengths), np.int64) for _ in range(3))
            for c in np.unique(lengths):
                here = lengths == c
                seq[here], at[here], tokens[here] = slots.place(int(c), ranks[here])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(seq), pa.array(at), pa.array(tokens)], [*kept, "sequence_id", "offset", "sequence_tokens"]
            )

    schema = f"doc_id {id_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
    return in_batches(ranked.select(*kept, "rank"), run, schema)
