import random
import re

import pytest

from bondflow.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=13):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for key, text in docs:
        w = words(text)
        hit, met = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    met |= found
                    hit[i : i + n] = [True] * n
        out.append((key, len(w), sum(hit), sorted(met)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_words", [1000, 0])
def test_hits_are_those_of_brute_force(spark, most_words):
    draw = random.Random(3)
    word = lambda: draw.choice("abcdef") + draw.choice("xyz")
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 12, 13, 20, 30])))) for i in range(12)] + [(12, None), (13, "..."), (14, "One two"), (15, "one TWO"), (None, "a b")]
    docs = []
    for k in range(40):
        text = [word() for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            own = (items[draw.randrange(12)][1] or "").upper().split()
            at = draw.randrange(len(text) + 1)
            text[at:at] = own[draw.randrange(3) :]
        docs.append((k, ", ".join(text)))
    docs += [(100, None), (101, ""), (102, "one two"), (102, "one two"), (None, "one two"), (103, "é" * 5000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.hits(d, b, most_words=most_words).collect()
    expected = brute(docs, [i for i in items if i[0] is not None])
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == expected


def test_clean_keeps_all_columns_and_rows_without_hits(spark):
    item = " ".join(f"w{i}" for i in range(13))
    d = spark.createDataFrame([(1, item, "a"), (2, "fine", "b"), (2, "fine", "b"), (3, item + " x" * 300, "c"), (4, None, None)], "doc_id bigint, text string, n_words string")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = decontaminate.clean(d, b)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 2, 4]  # the share of hit words does not matter
    assert decontaminate.clean(d, b.limit(0)).count() == 5
    assert decontaminate.clean(d.limit(0), b).count() == 0


@pytest.mark.parametrize("most_words", [10**6, 0])
def test_items_without_an_id_hit_but_are_not_listed(spark, most_words):
    full, short = " ".join(f"w{i}" for i in range(13)), "one two"
    d = spark.createDataFrame([(1, full), (2, "a " + short), (3, "fine")], "doc_id bigint, text string")
    b = spark.createDataFrame([(None, full), (None, short), (7, short), (None, None)], "item_id bigint, text string")
    got = decontaminate.hits(d, b, most_words=most_words).collect()
    assert sorted((r["row"]["doc_id"], r["n_hit"], r["items"]) for r in got) == [(1, 13, []), (2, 2, ["7"]), (3, 0, [])]
    rows = decontaminate.report(d, b, most_words=most_words).collect()
    assert sorted((r["doc_id"], r["n_items"], r["contaminated"]) for r in rows) == [(1, 0, True), (2, 1, True), (3, 0, False)]
