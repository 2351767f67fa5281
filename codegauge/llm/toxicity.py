"""Toxicity scores of whole texts by a network trained on the labelled ones."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.llm import gated
from codegauge.llm.bpe import id_type
from codegauge.llm.tables import in_batches, key_and_text

TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 3000  # texts that the network is trained on
SAMPLE_CHARS = 40_000  # of each; a longer one is cut at a place drawn by its id
THRESHOLD = 0.3


def sample(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column]) -> DataFrame:
    """(mark, text, toxic) of at most ``TOXIC_SAMPLE`` + ``CLEAN_SAMPLE`` labelled documents.

    Ids are drawn from the labels alone, first by a hash; only they, a bounded number, are
    joined to the texts. An id with both labels counts as toxic, null labels do not count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mark = F.xxhash64("doc_id")
    draw = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(mark, "doc_id").limit(n)
    ids = draw(1, TOXIC_SAMPLE).unionByName(draw(0, CLEAN_SAMPLE))
    start = F.pmod(F.shiftright(mark, 20), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    part = F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS))
    return key_and_text(docs).join(F.broadcast(ids), "doc_id").select(mark.alias("mark"), part.alias("text"), "toxic")


def train(rows: DataFrame) -> bytes | None:
    """A network trained in one task on the bounded sample, as bytes."""

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        if rows:
            net = gated.fit([gated.tokens(r[1]) for r in rows], [int(r[2] > 0) for r in rows], THRESHOLD)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    got = in_batches(rows.repartition(1), run, "net binary").collect()
    return got[0]["net"] if got else None


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Labels are learned only from ids for which ``held_out`` is false; a score depends on the
    text alone. A null or empty text scores next to 0. Without labels of both kinds the score
    is the share of toxic ones (0 without any). Repeated rows are answered one by one.
    """
    packed = train(sample(docs, labels, held_out))
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        net = pickle.loads(sent.value) if sent.value else None
        known: dict = {}
        for batch in batches:
            texts = [gated.tokens(t) for t in batch.column(1).to_pylist()]
            got = gated.scores(net, texts, known) if net else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    scored = in_batches(key_and_text(docs), run, f"doc_id {id_type(docs)}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
