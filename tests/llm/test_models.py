import itertools
import math
import pathlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bondflow.llm import monotone, ngrams, quality, urlfilter

SF = "/root/testdata/sf0.01"


def test_monotone_sequences(tmp_path):
    draw = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1), (5, 6), (3000, 1 << 20), (1000, 1 << 61)):
        values = np.unique(draw.integers(0, top, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        path = str(tmp_path / f"m{n}")
        monotone.build(path, values, top)
        m = monotone.Monotone(path)
        assert (m.value(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, draw.integers(0, top, 50, dtype=np.uint64)])
        place = {int(v): i for i, v in enumerate(values)}
        assert m.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


@pytest.mark.parametrize("parts", [1 << 24, 4000])
def test_scores_are_those_of_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(ngrams, "PART_1", parts)
    monkeypatch.setattr(ngrams, "PART_2", parts)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(900_001, None), (900_002, ""), (900_003, "new"), (900_003, "new"), (None, "the of")]
    got = ngrams.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, b, texts = Counter(), Counter(), 0
    for i, t in rows:
        if i is not None and not held(i):
            w = words(t)
            c.update(w)
            b.update(zip(["<s>"] + w[:-1], w, strict=True))
            texts += 1
    n, v, mu = sum(c.values()), len(c), 400.0
    expected = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((b[p, x] + mu * (c[x] + 1) / (n + v + 1)) / ((texts if p == "<s>" else c[p]) + mu)) for p, x in zip(["<s>"] + w[:-1], w, strict=True))
        expected.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, base, score))
    order = lambda r: (r[0] is None, r[0] or 0)
    for g, e in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9) and abs(g[6] - e[6]) <= 0.02 * e[2]


def test_parts_of_the_trie_are_ranges_of_contexts(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "PART_2", 300)
    texts = [(f"hot w{i} hot x{i % 7} y{i}",) for i in range(200)] + [(None,), ("é " * 30_000,)]
    model = ngrams.fit(spark.createDataFrame(texts, "text string"))
    ranges = sorted(tuple(np.load(p).tolist()) for p in pathlib.Path(model.path).glob("contexts-*.npy"))
    assert sum(b - a + 1 for a, b in ranges) <= model.words + len(ranges)
    hot = ngrams.Trie(model).numbers(ngrams.batch_tokens(pa.array(["hot"]))[0][:1])[0][0]
    assert sum(a <= hot <= b for a, b in ranges) > 1  # a frequent word's successors are cut
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ranges))


def test_scores_without_training_rows(spark):
    out = ngrams.report(spark.createDataFrame([(None, "a")], "doc_id bigint, text string")).first()
    assert (out["n_known"], out["train_tokens"], out["base_score"], out["score"]) == (0, 0, 0.0, 0.0)
    assert ngrams.report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.report(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    good = [r["kept"] for r in out if r["quality"] == 1 and not r["toxic"]]
    bad = [r["kept"] for r in out if r["quality"] == 0 or r["toxic"]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (1, "a", "s", "en", 1), (None, "", "s", "de", 2)], "doc_id bigint, text string, source string, lang string, bad int")
    labels = spark.createDataFrame([(1, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    assert quality.report(docs, labels).where("kept").count() == 3
    assert quality.report(docs.limit(0), labels.limit(0)).count() == 0


def level_rows(rates, pages, seed=1):
    """Rows of sites with true rates, one section each."""
    draw = np.random.default_rng(seed)
    return [(f"s{i}", "a", 1, int(x)) for i, r in enumerate(rates) for x in draw.random(pages) < r]


@pytest.mark.parametrize(("pages", "low", "high"), [(5, 0.235, 0.255), (40, 0.196, 0.304), (200, 0.165, 0.335)])
def test_levels_shrink_sites_by_their_size(spark, pages, low, high):
    rates = [0.15, 0.35] * (1000 if pages == 5 else 100)
    rows = level_rows(rates, pages) + [("new", "a", 0, 0), ("s1", "empty", 0, 0), ("s1", None, 0, 0), (None, "a", 0, 0)]
    df = spark.createDataFrame(rows, "site string, section string, own_n int, own_bad int")
    got = quality.levels(df).groupBy("site", "section").agg(F.avg("section_bad").alias("m"), F.first("all_bad").alias("all")).collect()
    by = {(r["site"], r["section"]): r["m"] for r in got}
    means = [np.mean([by[f"s{i}", "a"] for i in range(k, len(rates), 2)]) for k in (0, 1)]
    assert means[0] < low and means[1] > high
    assert by["new", "a"] == by[None, "a"] == pytest.approx(got[0]["all"])
    assert by["s1", "empty"] == by["s1", None]  # both take what the site's other section says


def test_levels_leave_own_labels_out(spark):
    rows = [("x", "a", 1, 1), ("x", "a", 1, 0), ("y", "a", 1, 0), ("y", "a", 1, 0), ("y", "b", 0, 0)]
    got = quality.levels(spark.createDataFrame(rows, "site string, section string, own_n int, own_bad int")).orderBy("site", "section", "own_bad").collect()
    assert got[0]["section_bad"] > got[1]["section_bad"]  # the good page sees the bad one, not the other way round
    assert got[2]["site_bad"] == got[3]["site_bad"]


def test_a_bad_site_moves_the_verdict_on_a_neutral_text(spark):
    draw = np.random.default_rng(3)
    say = lambda bad: " ".join(draw.choice(["spam", "buy", "now"] if bad else ["the", "calm", "sea"]) if draw.random() < 0.25 else draw.choice(["one", "two", "six"]) for _ in range(30))
    docs, labels = [], []
    for i in range(1200):
        site = i % 12
        bad = bool(draw.random() < (0.8 if site < 3 else 0.1))
        docs.append((i, say(bad), f"site{site}", "en"))
        labels.append((i, int(not bad), 0))
    docs += [(5000, "one two six", "site0", "en"), (5001, "one two six", "site9", "en"), (5002, "one two six", "unseen", "en")]
    got = {r["doc_id"]: r for r in quality.report(spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got[5000]["text_bad"] == got[5001]["text_bad"]
    assert got[5000]["section_bad"] > 0.6 > 0.25 > got[5001]["section_bad"]
    assert got[5000]["score"] < got[5002]["score"] < got[5001]["score"]


def test_site_posteriors_do_not_harm_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.report(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    bad = np.array([r["quality"] == 0 or r["toxic"] == 1 for r in out])
    loss = lambda p: -np.log(np.clip(np.where(bad, p, 1 - p), 1e-6, 1)).mean()
    assert loss(np.array([1 - r["score"] for r in out])) <= loss(np.array([r["text_bad"] for r in out])) + 0.01


def test_urls(spark):
    urls = ["http://WWW.example.com/en/1?x", "https://example.com/en", "http://a.net/es/", "ftp://anet/es/", "no scheme", None, "x://net/fr/a#b/c", "http://h.com", "http://u@H.com:80/#f", "a://b://c/d", "http://example.com?/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id bigint, url string").selectExpr("*", "1 as host")
    labels = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:5] for r in urlfilter.report(pages, labels).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en", "com/", "allow")
    assert got[2] == ("a.net", "/es/", "net/es/", "block")
    assert got[3][:3] == ("anet", "/es/", None)
    assert got[4][:3] == got[5][:3] == ("", "", None)
    assert got[6] == ("net", "/fr/a", "net/fr/", "block")
    assert got[7][:3] == ("h.com", "", None) and got[8][:3] == ("u@h.com:80", "/", None)
    assert got[9][:3] == ("b:", "//c/d", None) and got[10][:2] == ("example.com", "")
    assert urlfilter.report(pages.limit(0), labels.limit(0)).count() == 0


def test_a_bad_host_is_blocked_and_a_sparse_one_is_not(spark):
    urls = [(i, "http://bad.org/") for i in range(60)] + [(100 + i, f"http://h{i % 30}.org/") for i in range(600)] + [(999, "http://new.org/")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    seen = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, int(i % 10 == 0)) for i in range(600)] + [(999, 1)], "page_id bigint, bad int")
    got = {r["host"]: r["verdict"] for r in urlfilter.judge(pages, seen).collect()}
    assert got["bad.org"] == "block" and got["new.org"] == "allow" and got["h1.org"] == "allow"
