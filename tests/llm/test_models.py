"""Models: gradients, causality, learning, and the queries that apply them."""

import math
import pickle
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge.llm import attention, gated, lm
from codegauge.llm.attention import STRIDE, gradients, log_scores, start, windows
from codegauge.llm.queries import QUERIES
from codegauge.llm.tables import fold_of
from codegauge.llm.toxicity import toxicity


def small_model(seed=1, ids=40):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, ids, n) for n in (30, 7, 1, 90, 60)]
    texts = [np.concatenate([[ids], t, [ids]]) for t in texts]
    counts = Counter(np.concatenate([t[1:] for t in texts]).tolist())
    counts.pop(3, None)  # an id that only the rare class holds
    return start(texts, counts, ids + 1), texts


def scored(w, texts):
    sizes = np.array([len(t) - 1 for t in texts])
    return np.split(log_scores(w, w.tables(), np.concatenate(texts), sizes), np.cumsum(sizes)[:-1])


def test_windows_cover_every_position_once():
    sizes = np.array([1, STRIDE, STRIDE + 1, 5 * STRIDE - 1])
    first, base = windows(sizes)
    covered = Counter()
    ends = np.cumsum(sizes)
    for f, b in zip(first, base, strict=True):
        end = ends[np.searchsorted(ends, f, side="right")]
        covered.update(range(f, min(f + STRIDE, end)))
        assert b <= f
    assert covered == Counter(range(sizes.sum()))


def test_probabilities_sum_to_one():
    w, texts = small_model()
    prefix = texts[3][:60]
    total = sum(math.exp(scored(w, [np.append(prefix, k)])[0][-1]) for k in range(41))
    assert math.isclose(total, 1, rel_tol=1e-3)


def test_scores_depend_on_what_came_before_only():
    w, texts = small_model()
    text = texts[3]
    changed = text.copy()
    changed[70:] = (changed[70:] + 5) % 40
    a, b = scored(w, [text])[0], scored(w, [changed])[0]
    assert np.allclose(a[:69], b[:69], atol=1e-5) and not np.allclose(a[69:], b[69:], atol=1e-5)
    alone, among = scored(w, [text])[0], scored(w, texts)[3]
    assert np.allclose(alone, among, atol=1e-5)
    sizes = np.array([len(t) - 1 for t in texts])
    t = w.tables()
    assert np.allclose(log_scores(w, t, np.concatenate(texts), sizes, 2), log_scores(w, t, np.concatenate(texts), sizes), atol=1e-5)


def test_gradients_of_the_attention_model():
    w, texts = small_model()
    names = ["embed", "query", "key", "value", "bias", "out_class", "out_token"]
    for n in names:
        setattr(w, n, getattr(w, n).astype(np.float64))
    rng = np.random.default_rng(2)
    w.out_token[w.filled.nonzero()[0], 0, w.filled.nonzero()[1]] += rng.standard_normal(int(w.filled.sum())) * 0.1
    sizes = np.array([len(t) - 1 for t in texts])
    ids = np.concatenate(texts)
    source = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
    rows, goal = w.index[ids[source]], w.index[ids[source + 1]]
    first, base = windows(sizes)
    ends = np.repeat(np.cumsum(sizes), -(-sizes // STRIDE))

    def loss():
        t = w.tables()
        t = {k: v.astype(np.float64) if isinstance(v, np.ndarray) else v for k, v in t.items()}
        got = log_scores(w, t, ids, sizes).astype(np.float64)
        rare = w.of_class[goal] == attention.CLASSES
        got[rare] -= w.rare[ids[source + 1][rare]]  # not trained
        return -got.mean()

    grads = gradients(w, rows, goal, first, base, ends)
    for name, grad in zip(names, grads, strict=True):
        array = getattr(w, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in array.shape)
            if name == "out_token" and not w.filled[at[0], at[2]]:
                continue
            old = array[at]
            step = 1e-2
            array[at] = old + step
            up = loss()
            array[at] = old - step
            down = loss()
            array[at] = old
            assert math.isclose((up - down) / (2 * step), grad[at], rel_tol=0.05, abs_tol=3e-4), (name, at)


def test_gradients_of_the_gated_network():
    rng = np.random.default_rng(3)
    texts = [[b"w%d" % k for k in rng.integers(0, 12, n)] for n in (5, 64, 30, 1)]
    net = gated.start([b"w%d" % k for k in range(8)], 0.5)
    for name in ("word", "char", "into", "back", "attend", "weigh", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    batch = gated.batch_of(net, texts, [(k, 0, len(t)) for k, t in enumerate(texts)], {})
    goal, weight = np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 1.0])

    def loss():
        p = gated.sigmoid(gated.forward(net, batch).astype(np.float64))
        return -((goal * np.log(p) + (1 - goal) * np.log(1 - p)) * weight).sum() / weight.sum()

    grads = gated.gradients(net, batch, goal, weight)
    for name, grad in zip(("word", "char", "into", "back", "attend", "weigh", "out"), grads, strict=True):
        array = getattr(net, name)
        busy = np.argwhere(np.abs(grad) > 1e-4)
        for at in map(tuple, busy[rng.permutation(len(busy))[:6]]):
            old = array[at]
            array[at] = old + 1e-3
            up = loss()
            array[at] = old - 1e-3
            down = loss()
            array[at] = old
            assert math.isclose((up - down) / 2e-3, grad[at], rel_tol=0.05, abs_tol=2e-4), (name, at)


def test_gated_windows_overlap_and_cover():
    for n in (1, 5, 64, 65, 200, 1000):
        spans = gated.windows(n)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b - a <= gated.WINDOW for a, b in spans)
        assert all(y[0] < x[1] for x, y in zip(spans, spans[1:], strict=False))


def test_every_byte_of_a_long_word_is_read():
    assert gated.tokens("(A) " + "b" * 48) == [b"a", b"b" * 48]
    for n in (49, 63, 64, 65, 1000):
        word = "".join(chr(0x4E00 + 7 * k) for k in range(n)) + "x" * (n % 5)
        read = gated.tokens(word)
        assert all(len(p) <= gated.LONG for p in read)
        text = word.encode()
        for k in range(len(text) - 15):
            assert any(text[k : k + 16] in p for p in read)


def test_toxic_word_inside_a_long_unspaced_text():
    rng = np.random.default_rng(6)
    texts, marks = [], []
    for k in range(500):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        if k % 4 == 0:
            words[int(rng.integers(20, 40))] = "scoundrel"
        texts.append(gated.tokens("_".join(words)))
        marks.append(int(k % 4 == 0))
    net = gated.fit(texts[:400], marks[:400])
    got = gated.scores(net, texts[400:], {}) >= 0.3
    assert np.mean(got == (np.array(marks[400:]) == 1)) > 0.95


def slow_base(rows, folds=10):
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts, total = Counter(), 0
    for key, text in rows:
        if zlib.crc32(str(key).encode()) % folds:
            counts.update(words(text))
            total += len(words(text))
    scale = math.log10(total + 0.1 * (len(counts) + 1))
    out = {}
    for key, text in rows:
        w = words(text)
        out[key] = (len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10(counts[x] + 0.1) - scale for x in w))
    return out


def test_base_scores_equal_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 15)
    monkeypatch.setattr(lm, "HELD_WORDS", 100)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"W{x}" for x in rng.zipf(1.5, 60))) for k in range(80)] + [(900, None), (901, ""), (902, "a " * 30000), (903, "x" * 5000)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in rows], "doc_id long, text string, score double")
    got = lm.score(docs, fold_of(F.col("doc_id"), 10) != 0, steps=5).collect()
    want = slow_base(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.score(docs, F.lit(False)).collect()
    assert len(got) == 3 and {r["base_score"] for r in got} == {0.0} and {r["n_known"] for r in got} == {0}
    assert lm.score(docs.limit(0), F.lit(True)).collect() == []


def test_lm_query_beats_the_base_on_held_out_texts(spark, sf_dir):
    folder = f"{sf_dir}/../sf0.01"
    rows = QUERIES["op1_lm_scoring"](spark, folder).collect()
    want = slow_base(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    for r in rows:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert math.isclose(r["base_score"], want[r["doc_id"]][3], rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_toxicity_is_learned_from_labels(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        toxic = k % 4 == 0
        if toxic:
            words[int(rng.integers(0, 40))] = "scoundrel"
        rows.append((k, " ".join(words), int(toxic)))
        labels.append((k, int(toxic)))
    rows += [(1000, None, 0), (1001, "", 0), (1002, "w1 " * 20000 + "scoundrel", 0), (3, rows[3][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    held = lambda key: fold_of(key, 4) == 2
    got = toxicity(docs, marks, held).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    test = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([by_id[k] == int(k % 4 == 0) for k in test]) > 0.95
    assert by_id[1000] == by_id[1001] == 0 and by_id[1002] == 1
    none = toxicity(docs, marks.limit(0), held).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity(docs.limit(0), marks, held).collect() == []


@pytest.mark.parametrize("kind", [0, 1])
def test_labels_of_one_kind(spark, kind):
    docs = spark.createDataFrame([(k, f"w{k}") for k in range(8)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", f"{kind} AS toxic")
    assert {r["score"] for r in toxicity(docs, marks, lambda key: F.lit(False)).collect()} == {float(kind)}


def test_weights_come_from_all_training_texts(spark, monkeypatch):
    for name, value in {"FIRST_DOCS": 4, "SAMPLE_DOCS": 4, "PART_DOCS": 10}.items():
        monkeypatch.setattr(lm, name, value, raising=False)
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 30, 80))) for k in range(40)]
    counts = lm.subword_counts(lm.word_counts(spark.createDataFrame(rows, "doc_id long, text string")), "byte_bpe_50k.json", None)

    def weights(rows, parts):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        w = pickle.loads(lm.train(docs, counts, "byte_bpe_50k.json", None, steps=3))
        return np.concatenate([getattr(w, n).ravel() for n in ("embed", "query", "key", "value", "bias", "out_class", "out_token")])

    plain = weights(rows, 1)
    assert np.array_equal(plain, weights(rows[::-1], 5))
    for k in range(20, 26):  # at most four of the texts are looked at before all are learned
        changed = [(i, " ".join(t.split()[::-1]) if i == k else t) for i, t in rows]
        assert not np.array_equal(plain, weights(changed, 1))


def test_words_of_windows_are_numbered_with_one_look_each():
    class Word(bytes):
        looks = 0

        def __hash__(self):
            Word.looks += 1
            return bytes.__hash__(self)

    words = [Word(b"w%d" % (k % 7)) for k in range(600)]
    spans = [(0, a, b) for a, b in gated.windows(600)]
    net = gated.start([b"w1", b"w3"], 0.5)
    batch = gated.batch_of(net, [words], spans, known := {})
    places = sum(b - a for _, a, b in spans)
    assert Word.looks < 1.5 * places
    order = list(dict.fromkeys(bytes(w) for w in words))
    assert [order[k] for k in batch.places[3][batch.places[3] >= 0]] == words[spans[3][1] : spans[3][2]]
    assert batch.rows.tolist() == [net.words.get(w, 0) for w in order]
    assert np.split(batch.grams, batch.cuts[1:])[5].tolist() == gated.grams(order[5]) and len(known) == 7
    empty = gated.batch_of(net, [[]], [(0, 0, 0)], {})
    assert (empty.places == -1).all() and len(empty.rows) == len(empty.grams) == 0
