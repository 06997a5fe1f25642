"""Molecules of groups: bonds that are never made unless they are printed."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bondflow import queries
from bondflow.operators import graph, naming, rates
from bondflow.plans.testdata import level

LISTS = pa.list_(pa.list_(pa.int32()))


def pairs(groups):
    return sorted({p for g in groups for p in itertools.combinations(sorted(g), 2)})


def drawn(draw, n):
    return [sorted(draw.sample(range(n), draw.randrange(2, n + 1))) for _ in range(draw.randrange(1, 6))]


def marks(groups):
    found = graph.marks(np.concatenate(groups), np.repeat(np.arange(len(groups)), list(map(len, groups))), np.zeros(len(groups), np.int64), 1)
    return [int(x[0]) % (1 << 64) for x in found]


def test_marks_are_sums_over_distinct_bonds():
    draw = random.Random(3)
    for _ in range(200):
        groups = drawn(draw, draw.randrange(2, 9))
        r = [[int(x) for x in graph.mixed(np.arange(9), seed)] for seed in (1, 2)]
        assert marks(groups) == [sum(2 * h[a] * h[b] for a, b in pairs(groups)) % (1 << 64) for h in r]
        assert marks(groups) == marks([list(p) for p in pairs(groups)])


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_pairs_are_distinct_and_in_order(most):
    draw = random.Random(4)
    for _ in range(50):
        groups = drawn(draw, 8)
        found = list(graph.pairs_of(pa.scalar(groups, LISTS), most))
        assert [(int(a), int(b)) for x, y in found for a, b in zip(x, y, strict=True)] == pairs(groups)


def test_groups_give_the_molecules_of_their_bonds(spark):
    draw = random.Random(5)
    rows = [(f, f"k{draw.randrange(4)}", a) for f in range(40) for a in range(7) for _ in range(draw.randrange(3))]
    atoms = spark.createDataFrame([(f, a) for f in range(40) for a in range(7)], "frame int, atom_id int")
    bonds = {(f, a, b, (a + b) % 3 + 1) for f in range(40) for k in range(4) for a, b in itertools.combinations(sorted({x for g, n, x in rows if (g, n) == (f, f"k{k}")}), 2)}
    groups = spark.createDataFrame([*rows, (0, None, 3)], "frame int, key string, atom_id int")
    shared = graph.shared_molecules(graph.shared_frames(atoms, groups))
    found = shared.select("mol_id", "atoms", graph.bonds_of(level)(F.col("groups")).alias("bonds"), "frames").collect()
    made = graph.molecules(graph.molecule_frames(atoms, spark.createDataFrame(sorted(bonds), "frame int, a int, b int, level int")))
    assert sorted(map(tuple, found)) == sorted(map(tuple, made.collect()))
    text = graph.printed(shared.select("mol_id", "groups"), level).collect()
    assert dict(map(tuple, text)) == {r[0]: r[1] for r in made.select("mol_id", graph.bond_text(F.col("bonds"))).collect()}
    assert graph.shared_frames(atoms, groups.where("false")).count() == 280


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A frame in which 30,000 users share an event's type: 450 million bonds."""
    path = str(tmp_path_factory.mktemp("crowd"))
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize(("name", "row"), [("formula", (1, "C10000H10000O10000")), ("display_formula", (1, "C10000H10000O10000")), ("hmm_viterbi", (1, "0")), ("presence_signal", (1, "1"))])
def test_a_crowd_makes_no_bonds(spark, crowd, name, row):
    assert [tuple(r) for r in queries.QUERIES[name](spark, crowd).collect()] == [row]


def shuffled(elements, bonds, seed):
    order = list(range(len(elements)))
    random.Random(seed).shuffle(order)
    out = [""] * len(order)
    for i, e in enumerate(elements):
        out[order[i]] = e
    return naming.canonical(out, [(order[a], order[b], o) for a, b, o in bonds])


def test_names_of_large_molecules_of_groups():
    draw = random.Random(6)
    groups = [sorted({*range(400 * k, 400 * k + 400), *draw.sample(range(2000), 20)}) for k in range(5)]  # atoms of one group are twins
    elements = ["CHO"[i % 3] for i in range(2000)]
    code = np.concatenate([a * 2000 + b for a, b in graph.pairs_of(pa.scalar(groups, LISTS))])
    bonds = [(c // 2000, c % 2000, (c // 2000 + c % 2000) % 3 + 1) for c in code.tolist()]
    name = shuffled(elements, bonds, 0)
    assert name == shuffled(elements, bonds, 1) and name.count("[") == 2000 and name.count("(") == len(bonds)
    assert name != shuffled(elements, bonds[1:], 0)


def test_arrays_name_as_dictionaries_do(monkeypatch):
    draw = random.Random(7)
    for _ in range(200):
        n = draw.randrange(1, 10)
        elements = [draw.choice("CH") for _ in range(n)]
        bonds = [(a, b, draw.choice([1, 2])) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.6]
        name = naming.canonical(elements, bonds)
        with monkeypatch.context() as m:
            m.setattr(naming, "SMALL", 0)
            assert naming.canonical(elements, bonds) == name


def test_rates_of_an_event_of_many_reactants(spark):
    many = 60_000  # their text, of 240 kB, was copied for each of them
    sides = "+".join([*["Aa"] * many, *(f"B{i}" for i in range(20_000))])
    species = spark.createDataFrame([(t, name, n) for t, n in ((0, 3), (1000, 5)) for name in ("Aa", "C", *(f"B{i}" for i in range(20_000)))], "timestep bigint, name string, n bigint")
    found = rates.rate_constants(species, spark.createDataFrame([(sides + "->C", 4), ("C->Aa", 2)], "reaction string, n bigint"), [10.0, 10.0, 10.0], 0.1)
    moles = 1000 * 1e-24 * rates.AVOGADRO
    logs = [80_000 * math.log(n / moles) for n in (3, 5)]
    expected = (math.log(4) - math.log(moles * 1000 * 0.1 * 1e-15) - max(logs) - math.log(sum(math.exp(x - max(logs)) for x in logs))) / math.log(10)
    got = {len(r["reaction"]): r["log10_k"] for r in found.collect()}
    assert got.keys() == {len(sides) + 3, 5} and math.isclose(got[len(sides) + 3], expected, rel_tol=1e-9)
