import random
import re

import numpy as np
import pytest

from bondflow.llm import minhash
from bondflow.llm.components import components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, n):
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(sets[i]), least[find(i)], least[find(i)] == key) for i, (key, _) in enumerate(docs))


@pytest.mark.parametrize("words", [4, 5])
def test_groups_are_those_of_brute_force(spark, words):
    draw = random.Random(words)
    docs = []
    for _ in range(12):
        base = [str(draw.randrange(10**6)) for _ in range(draw.choice([1, 3, 5, 40, 120]))]
        for _ in range(draw.choice([1, 4, 25])):
            text = [str(draw.randrange(10**6)) if draw.random() < draw.choice([0, 0.01, 0.03, 0.08]) else w for w in base]
            docs.append((1000 - len(docs), draw.choice([" ", "\n"]).join(text)))
    docs += [(2000, None), (2001, ""), (2002, " \t"), (2003, "Word"), (2004, "wORD"), (2005, "long " * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, minhash.groups(df, words=words).collect())) == brute(docs, words)


def test_chains_across_a_hot_bucket_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_BROADCAST", 0)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    draw = random.Random(9)
    text, docs = [str(draw.randrange(10**6)) for _ in range(150)], []
    for i in range(60):  # each a small step from the one before, so the ends differ widely
        text = list(text)
        text[draw.randrange(150)] = str(draw.randrange(10**6))
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, minhash.groups(df, words=4).collect())) == brute(docs, 4)


def test_deduplicate_keeps_columns(spark):
    same = "a b c d e f g h"
    df = spark.createDataFrame([(2, same, "x"), (1, same, "y"), (3, None, "z"), (None, same, "w")], "doc_id bigint, text string, component_id string")
    out = minhash.deduplicate(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    assert minhash.groups(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)}


def test_bands_miss_as_few_pairs_as_independent_ones():
    pairs, both, own = 12_000, 28, 6  # similarity 0.7, where misses are frequent enough to be counted
    x = np.random.default_rng(1).integers(0, 1 << 64, (pairs, both + 2 * own), dtype=np.uint64)
    one, two = x[:, : both + own], np.concatenate([x[:, :both], x[:, both + own :]], axis=1)
    shared = (minhash.band_keys(minhash.minima(list(one))) == minhash.band_keys(minhash.minima(list(two)))).any(axis=1)
    expected = pairs * (1 - 0.7**7) ** 64
    assert (~shared).sum() < expected + 5 * expected**0.5
