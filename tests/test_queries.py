"""Queries against DuckDB at the smallest scale, and counts known from an independent simulation."""

import glob
import itertools
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from bondflow import queries
from bondflow.plans.testdata import analysis

SF = "/root/testdata/sf0.001"
COUNTS = {"components": 1789, "molecule_dict": 26, "species_counts": 371, "atom_route": 59, "route_pairs": 44, "reaction_events": 22, "reactions_abcd": 12, "reactions_ab": 18}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    sql = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in sql.description]
    assert sorted(found.columns) == sorted(names)
    rows = found.collect()
    assert bag(found.columns, rows) == bag(names, sql.fetchall())
    if name in COUNTS:
        assert len(rows) == COUNTS[name]


def like(one, two, orders):
    """Whether two molecules (elements, bonds by pairs of places) are the same graph, by trying all maps."""
    (e1, b1), (e2, b2) = one, two
    if sorted(e1) != sorted(e2) or len(b1) != len(b2):
        return False
    value = lambda b, k: b.get(k) if orders else k in b
    for p in itertools.permutations(range(len(e1))):
        if all(e1[i] == e2[p[i]] for i in range(len(e1))) and all(value(b1, (i, j)) == value(b2, tuple(sorted((p[i], p[j])))) for i, j in itertools.combinations(range(len(e1)), 2)):
            return True
    return False


def test_names_and_isomer_groups_are_those_of_brute_force(spark):
    a = analysis(spark, SF)
    elements = {r["atom_id"]: r["element"] for r in a.atoms.collect()}
    found = {}
    for r in a.molecules.collect():
        place = {x: i for i, x in enumerate(r["atoms"])}
        found[r["mol_id"]] = ([elements[x] for x in r["atoms"]], {(place[x["a"]], place[x["b"]]): x["level"] for x in r["bonds"]})
    names = {r["mol_id"]: r["name"] for r in queries.QUERIES["species_name"](spark, SF).collect()}
    assert names.keys() == found.keys()
    for x, y in itertools.combinations(sorted(found), 2):
        assert (names[x] == names[y]) == like(found[x], found[y], True)
    for query, orders in (("isomer_groups", True), ("miso1_groups", False)):
        got = {r["mol_id"]: r for r in queries.QUERIES[query](spark, SF).collect()}
        for x in found:
            same = [y for y in found if like(found[x], found[y], orders)]
            assert (got[x]["representative"], got[x]["members"], got[x]["name"]) == (min(same), len(same), names[min(same)])


def test_species_search_is_that_of_brute_force(spark):
    rows = [(r["left_name"], r["right_name"], r["n"]) for r in analysis(spark, SF).reactions.collect()]
    rows.sort(key=lambda r: (r[2], r[:2]), reverse=True)
    met, first, front = ["C1H0O0"], [], ["C1H0O0"]
    while front and len(met) < 100:
        later = []
        for one in front:
            for r in [r for r in rows if r[0] == one and r[1] not in met][:2]:
                if len(met) < 100:
                    met.append(r[1])
                    later.append(r[1])
                    first.append(r)
        front = later
    expected = first + [r for r in rows if r not in first]
    assert [tuple(r) for r in queries.QUERIES["species_bfs"](spark, SF).orderBy("ord").collect()] == [(*r, i) for i, r in enumerate(expected, 1)]
    assert len(first) > 2


def test_every_query_has_sql_or_a_test_above():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"species_name", "isomer_groups", "miso1_groups", "species_bfs"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
