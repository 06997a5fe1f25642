import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bondflow.llm import linededup


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, least=20, least_docs=3):
    seen = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                seen.setdefault(k, []).append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in seen.items() if len(ids) >= least_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x)) is None or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("most_bits", "part_bits"), [(1 << 28, 1 << 24), (1 << 10, 1 << 24), (1 << 10, 1 << 17), (1 << 10, 1 << 14)])
def test_lines_are_those_of_brute_force(spark, most_bits, part_bits):
    draw = random.Random(5)
    pool = ["A line that is long enough %d" % i for i in range(12)] + ["short", "", "  \t", "Zeile mit Ümlaut und LÄNGE"]
    vary = lambda x: draw.choice(["", " ", "\t"]) + draw.choice([x, x.upper(), x]) + draw.choice(["", "\r", " "])
    docs = [(i, "\n".join(vary(draw.choice(pool)) if draw.random() < 0.5 else f"unique line number {draw.random()}" for _ in range(draw.randrange(8)))) for i in range(40)]
    docs += [(7, docs[7][1]), (None, pool[0]), (50, None), (51, ""), (52, "\n"), (53, "long " * 20_000 + "\n" + pool[1])]
    out = linededup.report(spark.createDataFrame(docs, "doc_id bigint, text string"), most_bits=most_bits, part_bits=part_bits).collect()
    assert sorted(map(tuple, out), key=str) == brute(docs)


def test_clean_and_empty_tables(spark):
    line = "this line is in all of the documents"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", 0, "x") for i in range(4)], "doc_id bigint, text string, n_chars bigint, gone string")
    out = {r["doc_id"]: r for r in linededup.clean(docs).collect()}
    assert out[3]["text"] == f"{line}\nown 3" and out[0]["text"] == "own 0" and out[0]["n_chars"] == 5
    assert linededup.clean(docs).columns == docs.columns
    assert linededup.report(docs.limit(0)).count() == 0


def test_repeats_within_a_document_do_not_count(spark):
    docs = spark.createDataFrame([(1, "\n".join(["the very same long line"] * 5)), (2, "the very same long line")], "doc_id bigint, text string")
    assert [r["n_dropped"] for r in linededup.report(docs).collect()] == [0, 0]


def test_filters_that_stay_in_their_tasks_suspect_repeats_and_few_others(spark):
    single, double = [(i,) for i in range(60_000)], [(-i,) for i in range(1, 2001)] * 2
    hashes = spark.createDataFrame(single + double + [(10**9,)] * 20_000, "i bigint").repartition(6).select(F.xxhash64("i").alias("h"), "i")
    got = {r["i"] for r in linededup.suspects_apart(hashes, 1 << 20, 1 << 17).distinct().collect()}
    assert got >= {-i for i in range(1, 2001)} | {10**9}
    assert len(got) < 2001 + 3000  # 17 bits a hash; two places a hash


def test_distinct_counts():
    blocks = [np.array(x, np.int64) for x in ([3, 1, 3], [], [1, 7], [9], [9])]
    got = [(h.tolist(), n.tolist()) for h, n in linededup.distinct(iter(blocks), 3)]
    assert got == [([1, 3, 7], [2, 2, 1]), ([9], [2])]
