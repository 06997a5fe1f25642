import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bondflow.llm import winnowing
from bondflow.llm.winnowing import CUTS, FAR, SHORT, WINDOW, K


def units(text):
    """Units by a scan of each run."""
    out = []
    for run in re.findall(r"\S+", text):
        while run:
            cut = next((i for i, c in enumerate(run[: FAR + 1]) if c in CUTS), None)
            n = len(run) if len(run) <= SHORT else 1 if cut is None else cut + 1
            out.append(run[:n])
            run = run[n:]
    return out


def chosen(hashes):
    """Places of the least hash of every window, the rightmost of equal ones."""
    found = set()
    for i in range(max(1, len(hashes) - WINDOW + 1) if hashes else 0):
        part = hashes[i : i + WINDOW]
        found.add(i + max(j for j, h in enumerate(part) if h == min(part)))
    return sorted(found)


def selections(spark, texts):
    """Of each text what the operator selects, and what brute force over the same unit hashes does."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: list(zip(r["s"]["places"], r["s"]["hashes"], strict=True)) for r in winnowing.with_selected(df, "text", "s").collect()}
    cut = [units(t) for t in texts]
    flat = spark.createDataFrame([(i, u) for i, u in enumerate(cut)], "i int, u array<string>").withColumn("u", F.transform("u", lambda x: F.xxhash64(x)))
    two = lambda c, d: F.transform(F.sequence(F.lit(0), F.size(c) - d - 1), lambda i: F.xxhash64(F.get(c, i), F.get(c, i + d)))
    long = flat.where(F.size("u") >= K).withColumn("two", two("u", 1)).select("i", two("two", 2).alias("g"))
    short = flat.where(F.size("u") < K).select("i", F.when(F.size("u") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("u"))).alias("g"))
    grams = {r["i"]: r["g"] for r in long.union(short).collect()}
    return got, {i: [(p, grams[i][p]) for p in chosen(grams[i])] for i in range(len(texts))}


def test_selected_are_the_rightmost_least_of_each_window(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("abc") for _ in range(n)) for n in (0, 1, 3, 4, 14, 15, 16, 60, 300)]  # few words: ties
    texts += [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 40) for _ in range(200)), "x y " * 50, "z" * 500, "", " \n\t "]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "中文字" * 40, "あいうえお" * 30, base64.b64encode(draw.randbytes(900)).decode(), "é" * 23 + " " + "ß" * 25]
    got, expected = selections(spark, texts)
    assert got == expected
    assert got[10][-1][0] > 80 and len(got[10]) < 100


def test_shared_passages_share_a_hash_wherever_they_stand(spark):
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    pairs = []
    for _ in range(20):
        prose = " ".join(some(letters, draw.randrange(1, 9)) for _ in range(WINDOW + K - 1))
        pairs.append((prose, f"{some(letters, 5)} {prose} x", f"{some(letters, 70)} a b c {prose} {some(letters, 30)}"))
        for alphabet, n in ((letters, 300), (letters + letters.upper() + "0123456789+/", 400), ("กขคงจฉชซ", WINDOW + K + SHORT), ("中文字汉语", WINDOW + K + SHORT)):
            block = some(alphabet, n)
            pairs.append((block, some(alphabet, draw.randrange(30, 99)) + block + some(alphabet, 40), some(alphabet, draw.randrange(30, 99)) + block))
    block = some(letters, 4000)
    pairs.append((block, block, "q" + block))
    pairs.append((block, some("xyz", 500) + block, block + some("qrs", 90)))
    df = spark.createDataFrame([(i, *p[1:]) for i, p in enumerate(pairs)], "i int, a string, b string")
    df = winnowing.with_selected(winnowing.with_selected(df, "a", "s"), "b", "t")
    rows = df.select("i", F.size(F.array_intersect(winnowing.hashes(F.col("s")), winnowing.hashes(F.col("t")))).alias("n")).collect()
    assert [pairs[r["i"]][0] for r in rows if not r["n"]] == []


def expected_edits(rows, order):
    out = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        q = len(t) // 4
        out.append((str(i), len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("rows_a_range", [16_384, 3, 1])
def test_fingerprints(spark, rows_a_range):
    body = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(body)), (2, " ".join(["x"] + body[50:90] + ["y"])), (3, None), (4, ""), (5, "é"), (5, "é"), (6, "中文" * 30), (None, "n u l l"), (7, "z" * 100_000)]
    rows += [(8, f"many {i} rows of one id") for i in range(40)] + [(None, f"null {i}") for i in range(30)] + [(i, f"text {i} " * 9) for i in range(9, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as range", "1 as h", "2 as id")
    got = winnowing.fingerprints(docs, rows_a_range=rows_a_range).collect()
    h = {r["t"]: r["h"] for r in docs.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1] or ""], r[1] or ""))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == expected_edits(rows, order)
    one, two = (set(x.split(":")[1] for x in next(r for r in got if r["doc_id"] == k)["fingerprint"].split()) for k in (1, 2))
    assert one & two
    r = next(r for r in got if r["doc_id"] == 1)
    a, b, c = (set(x.split(":")[1] for x in t.split()) for t in (r["fingerprint"], r["edited_fingerprint"], next(r for r in got if r["doc_id"] == 2)["fingerprint"]))
    assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"] == pytest.approx(len(a & c) / len(a | c))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert winnowing.fingerprints(docs.limit(0)).count() == 0
    assert winnowing.fingerprints(docs).first()["near_next"] == 1
    with pytest.raises(TypeError, match="numbers"):
        winnowing.fingerprints(docs.selectExpr("'a' as doc_id", "text"))
