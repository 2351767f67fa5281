"""The registered queries that the other tests do not run as such."""

import hashlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from codegauge.llm.bpe import vocabulary
from codegauge.llm.queries import QUERIES
from tests.llm.test_similar import slow_groups


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_byte_bpe(spark, sf_dir, texts):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for r in QUERIES["op9_byte_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_ngram_jaccard(spark, sf_dir, texts):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op6_ngram_jaccard"](spark, sf_dir).collect())
    assert got == slow_groups(sorted(texts.items()), 3, 90)


def test_fingerprints(spark, sf_dir, texts):
    rows = QUERIES["op5_fingerprints"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_chars"] for r in rows} == {k: len(t) for k, t in texts.items()}
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert np.median([r["near_edited"] for r in rows]) > np.median([r["near_next"] for r in rows])


def test_toxicity(spark, sf_dir, texts):
    rows = QUERIES["op2_toxicity"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
