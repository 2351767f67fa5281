"""URL rules, language profiles and fingerprints against plain versions."""

import math
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

from codegauge.llm import digest, langid
from codegauge.llm.queries import BLOCKED_WORDS, HOST_RULES, QUERIES, SQL
from codegauge.llm.urlrules import UrlRule, host_rule, judge_urls, word_rule
from tools.check import compare

URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://x.com", "http://x.com/", "https://Example.COM/en/a?b#c", "http://notexample.com/en/",
    "http://www.example.com/en/", "http://a.www.example.com/en/x", "http://example.com/EN/x", "http://b.net/es/", "http://net/fr/1", "http://b.net/esx/",
    "http://b.net?x=/es/", "http://b.org#/a", "ftp://a://b.com/x", "http://ads.b.org/x", "http://b.org/x/banner", "http://b.org/banners/x", "http://é.com/ü",
    "http://user@b.com:80/", "://com/", "http://b.com\n/x",
]


def slow_judge(url, rules, words):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group() if rest else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    hit = any(re.search(rf"(?:^|[./]){w}(?:[./]|$)", host + path) for w in words)
    return host, path, None, "block" if hit else "allow"


def test_url_rules(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = [host_rule(*r) for r in HOST_RULES] + [word_rule(w) for w in BLOCKED_WORDS]
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in judge_urls(pages, rules).collect()}
    assert got == {k: slow_judge(u, HOST_RULES, BLOCKED_WORDS) for k, u, _ in rows}
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        judge_urls(pages, [UrlRule("all", "block", ".*", (), 1)])


def test_url_query_and_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    frame = QUERIES["op4_url_filters"](spark, sf_dir)
    cursor = db.execute(SQL["op4_url_filters"])
    assert compare(frame.columns, [tuple(r) for r in frame.collect()], [d[0] for d in cursor.description], cursor.fetchall()) is None


def slow_grams(text):
    counts = Counter()
    code = [ord(c) if c.isalpha() else 1 for c in text.lower()]
    code = [1, *code, 1]
    for k, c in enumerate(code):
        if 0 < k < len(code) - 1 and c != 1:
            counts[c] += 1
            counts[code[k - 1] << 42 | c << 21 | code[k + 1]] += 1
        if k and (c != 1 or code[k - 1] != 1):
            counts[code[k - 1] << 21 | c] += 1
    return counts


@pytest.mark.parametrize("text", ["", "a", "Été à la plage, ça va?", "  12 -- ", "İstanbul ΣΑΣ", "ab " * 50, "x" * 40 + "  y"])
def test_grams(text, monkeypatch):
    for piece in (1 << 18, 7, 3):
        monkeypatch.setattr(langid, "PIECE", piece)
        keys, counts = langid.grams(text)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == slow_grams(text)


def test_ranking_breaks_ties_by_key():
    rng = np.random.default_rng(1)
    keys, counts = np.arange(5000), rng.integers(1, 20, 5000)
    want = sorted(range(5000), key=lambda k: (-counts[k], k))[:300]
    assert langid.ranked(keys, counts, 300).tolist() == want


def test_language_profiles_equal_a_plain_count(spark):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "fr"), ("der hund", None), ("the end", "en")]
    got = langid.learn_profiles(spark.createDataFrame(rows, "text string, lang string"), 20)
    for lang in ("en", "fr"):
        counts = sum((slow_grams(t) for t, g in rows if t and g == lang), Counter())
        assert got[lang] == sorted(counts, key=lambda k: (-counts[k], k))[:20]
    assert set(got) == {"en", "fr"}


def test_language_query(spark, sf_dir):
    rows = QUERIES["op10_language_id"](spark, f"{sf_dir}/../sf0.01").collect()
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/../sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "123 !", "z"), (3, "the cat", None), (None, "the cat", None), (5, "the cat " * 60000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    profiles = langid.learn_profiles(spark.createDataFrame([("the cat sat", "en")], "text string, lang string"))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, profiles).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (3, "en"), (None, "en"), (5, "en")], key=str)
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    kept = langid.of_known_language(docs, profiles, 0.15)
    assert kept.columns == docs.columns and kept.count() == 3


def test_entropy_levels():
    rng = random.Random(4)
    text = np.frombuffer(bytes(rng.choices(b"abcdefgh ", k=400)) + b"z" * 100, np.uint8)
    want = []
    for k in range(len(text) - digest.WINDOW + 1):
        mass = sum(int(digest._MASS[c]) for c in Counter(text[k : k + digest.WINDOW].tolist()).values())
        want.append((digest._FULL - mass) * digest.LEVELS // digest._FULL)
    assert digest.entropies(text).tolist() == want
    assert len(digest.entropies(text[:10])) == 0


def slow_features(text, rarity):
    """Windows that are the first rarest of at least VOTES neighbourhoods."""
    level = digest.entropies(np.frombuffer(text, np.uint8))
    votes = Counter()
    for k in range(len(level)):
        votes[min(range(k, min(len(level), k + digest.WINDOW)), key=lambda j: (rarity[level[j]], j))] += 1
    return sorted(k for k, v in votes.items() if v >= digest.VOTES)


def test_features_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"etaoin shrdlu", k=n)) for n in (0, 5, 63, 64, 65, 200, 900, 3000)]
    rarity = np.array(rng.sample(range(digest.LEVELS + 1), digest.LEVELS + 1))
    for piece in (1 << 17, 700):
        monkeypatch.setattr(digest, "PIECE", piece)
        buffer, ends = digest.joined(texts)
        got = digest.features(buffer, ends, rarity).tolist()
        want = [at + int(e) - len(t) for t, e in zip(texts, ends, strict=True) for at in slow_features(t, rarity)]
        assert got == want
        both = digest.fingerprints(texts, rarity)
        for t, chain in zip(texts, both, strict=True):
            assert (digest.fingerprints([t], rarity)[0] == chain).all()


def test_likeness():
    rng = random.Random(8)
    rarity = np.arange(digest.LEVELS + 1)
    a, b = (bytes(rng.choices(b"etaoin shrdlucmfw", k=40000)) for _ in range(2))
    x, half, y, none = digest.fingerprints([a, a[:20000] + b[:20000], b, b""], rarity)
    assert digest.likeness(x, x) == digest.likeness(none, none) == 1.0 and digest.likeness(x, none) == 0.0
    assert 0.3 < digest.likeness(x, half) < 0.7 and digest.likeness(x, y) < 0.2
    assert (digest.chain_of(digest.shown(x)) == x).all() and len(x) > 2


def test_edited_documents(spark, monkeypatch):
    import hashlib

    rng = random.Random(9)
    texts = {k * 3: "".join(rng.choices("abc é\n日", k=rng.randint(0, 300))) for k in range(1300)} | {5: None, 7: "x" * 100000}
    rows = [(k, t, "f") for k, t in texts.items()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in digest.edited_likeness(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        own, other = texts[k] or "", texts[after] or ""
        edited = own[: len(own) - len(own) // 2] + other[: len(own) // 2]
        r = got[k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r["near_next"], digest.likeness(digest.chain_of(r["fingerprint"]), digest.chain_of(got[after]["fingerprint"])))
        assert 0 <= r["near_edited"] <= 1
    again = digest.fingerprint_table(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in again} == {k: r["fingerprint"] for k, r in got.items()}


def test_edited_documents_in_many_buckets(spark, monkeypatch):
    rows = [(k, f"text {k * k}" * (k % 9)) for k in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    few = sorted(digest.edited_likeness(docs).collect())
    monkeypatch.setattr(digest, "BUCKET_ROWS", 2)
    assert sorted(digest.edited_likeness(docs).collect()) == few


def test_edited_documents_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    row = digest.edited_likeness(docs).collect()
    assert len(row) == 1 and row[0]["near_next"] == 1.0
    assert digest.edited_likeness(docs.limit(0)).collect() == []
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert digest.edited_likeness(ties).count() == 4


assert sys.maxunicode >> 21 == 0
