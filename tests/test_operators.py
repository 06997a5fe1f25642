import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bondflow.functions import names as fn
from bondflow.operators import events, graph, matrix, naming, network, occupancy, rates, report, signals


def test_cutoffs():
    assert graph.parse_cutoffs("H-O:1.5, O-H: 2.0,, C-C:1") == {("H", "O"): 2.0, ("C", "C"): 1.0}
    for bad in ("H-O", "HO:1", "H-O:x"):
        with pytest.raises(ValueError):
            graph.parse_cutoffs(bad)
    assert graph.cutoffs(["H", "O"], 1.0, {("H", "O"): 1.5})[("H", "O")] == 1.5


def test_water_has_two_bonds(spark):
    p = spark.createDataFrame([(0, 0, "H", 0.757, 0.586, 0.0), (0, 1, "H", -0.757, 0.586, 0.0), (0, 2, "O", 0.0, 0.0, 0.0)], "frame int, atom_id int, element string, x double, y double, z double")
    assert sorted(map(tuple, graph.distance_bonds(p, graph.cutoffs(["H", "O"])).collect())) == [(0, 0, 2, 1), (0, 1, 2, 1)]


@pytest.mark.parametrize("cell", [None, [[5.0, 0, 0], [0, 4.0, 0], [0, 0, 6.0]], [[5.0, 0, 0], [2.0, 4.0, 0], [-1.5, 1.0, 5.0]], [[2.0, 0, 0], [0, 2.0, 0], [0, 0, 2.0]]])
def test_distance_bonds_are_those_of_all_images(spark, cell):
    draw = np.random.default_rng(4)
    at = draw.random((40, 3)) * 9 - 2
    rows = [(0, i, "CHO"[i % 3], *map(float, at[i])) for i in range(40)]
    limits = graph.cutoffs(list("CHO"), 0.8)
    p = spark.createDataFrame(rows, "frame int, atom_id int, element string, x double, y double, z double")
    got = sorted((r["a"], r["b"]) for r in graph.distance_bonds(p, limits, cell).collect())
    if cell:
        own = p.withColumn("cell", F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in cell)))
        assert sorted((r["a"], r["b"]) for r in graph.distance_bonds(own, limits, "cell").collect()) == got
    m = np.array(cell, float) if cell else np.zeros((3, 3))
    reach = range(-8, 9) if cell else [0]
    images = np.array(list(itertools.product(reach, repeat=3))) @ m
    expected = [(i, j) for i, j in itertools.combinations(range(40), 2) if ((at[i] - at[j] + images) ** 2).sum(axis=1).min() < limits[tuple(sorted(("CHO"[i % 3], "CHO"[j % 3])))] ** 2]
    assert got == expected


def test_components(spark):
    chain = spark.createDataFrame([(0, i, i + 1, 1) for i in range(499)], "frame int, a int, b int, level int")
    atoms = spark.createDataFrame([(f, i) for f in (0, 1) for i in range(500)], "frame int, atom_id int")
    got = graph.molecule_frames(atoms, chain).collect()
    assert sorted(len(r["atoms"]) for r in got) == [1] * 500 + [500]
    big = next(r for r in got if len(r["atoms"]) == 500)
    assert big["atoms"] == list(range(500)) and [x["a"] for x in big["bonds"]] == list(range(499))


def test_same_atoms_with_another_order_are_another_molecule(spark):
    atoms = spark.createDataFrame([(f, i) for f in range(3) for i in (0, 1)], "frame int, atom_id int")
    bonds = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 2), (2, 0, 1, 1)], "frame int, a int, b int, level int")
    got = {r["mol_id"]: r["frames"] for r in graph.molecules(graph.molecule_frames(atoms, bonds)).collect()}
    assert got == {1: [0, 2], graph.PLACE + 1: [1]}


def test_viterbi_is_optimal_and_needs_long_runs():
    draw = np.random.default_rng(1)
    for _ in range(30):
        a = draw.random((2, 2)) + 0.05
        b = draw.random((2, 2)) + 0.05
        a, b = a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
        seen = draw.integers(0, 2, (1, 9))
        w = lambda path: signals.weight(0.5) + sum(signals.weight(b[s][o]) for s, o in zip(path, seen[0], strict=True)) + sum(signals.weight(a[x][y]) for x, y in itertools.pairwise(path))  # noqa: B023, E731
        best = max(map(w, itertools.product((0, 1), repeat=9)))
        assert w(signals.viterbi(seen, (0.5, 0.5), a, b)[0].tolist()) == best
    run = lambda first, n: np.array([[int(first <= i < first + n) for i in range(200)]])
    assert signals.viterbi(run(80, 34)).sum() == 0 and signals.viterbi(run(80, 35)).sum() == 35
    assert signals.viterbi(run(0, 17)).sum() == 0 and signals.viterbi(run(0, 18)).sum() == 18
    assert signals.viterbi(1 - run(80, 34)).sum() == 200


def test_conflict_marks_the_cells_that_overlap(spark):
    atoms = spark.createDataFrame([(1, [0, 1]), (2, [1, 2])], "mol_id bigint, atoms array<int>")
    on = spark.createDataFrame([(1, [0, 1]), (2, [1])], "mol_id bigint, frames array<int>")
    got = {(r["atom_id"], r["frame"]): (r["mol_id"], r["conflict"]) for r in occupancy.occupancy(atoms, on).collect()}
    assert got == {(0, 0): (1, False), (1, 0): (1, False), (0, 1): (1, False), (1, 1): (2, True), (2, 1): (2, False)}


def test_routes_skip_gaps(spark):
    rows = [(0, 0, 5), (0, 1, 5), (0, 4, 7), (0, 5, 5), (1, 2, 7)]
    occ = spark.createDataFrame([(*r, False) for r in rows], "atom_id int, frame int, mol_id bigint, conflict boolean")
    route = occupancy.routes(occ)
    assert sorted(map(tuple, route.collect())) == [(0, 0, 0, 0, 5), (0, 1, 2, 4, 7), (0, 2, 3, 5, 5), (1, 0, 0, 2, 7)]
    assert sorted(map(tuple, occupancy.transitions(route).collect())) == [(0, 5, 7), (0, 7, 5)]


def test_counted_keeps_the_least_atoms_repeats(spark):
    steps = spark.createDataFrame([(3, 1, 2), (3, 1, 2), (4, 1, 2), (5, 2, 1)], "atom_id int, left_mol bigint, right_mol bigint")
    assert sorted(map(tuple, occupancy.counted(steps).collect())) == [(1, 2, 2), (2, 1, 1)]
    assert sorted(map(tuple, occupancy.distinct_pairs(steps).collect())) == [(1, 2, 1), (2, 1, 1)]


def test_events(spark):
    names = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "A")], "mol_id bigint, name string")
    cells = [(i, 0, m) for i, m in enumerate([1, 1, 2, 2])] + [(i, 1, 3) for i in range(4)] + [(i, 2, 3) for i in range(3)]
    occ = spark.createDataFrame([(*c, False) for c in cells], "atom_id int, frame int, mol_id bigint, conflict boolean")
    found = events.matched(events.changed(occ, 3))
    assert [tuple(r) for r in events.named_events(found.where("clean"), names).collect()] == [(0, "A+B", "C")]
    swap = spark.createDataFrame([(0, 0, 1, False), (0, 1, 4, False)], "atom_id int, frame int, mol_id bigint, conflict boolean")
    assert events.named_events(events.matched(events.changed(swap, 2)), names).count() == 0


def test_events_against_brute_force(spark):
    draw = random.Random(8)
    for _ in range(3):
        cells = {(i, f): draw.choice([0, 0, *range(1, 9)]) for i in range(10) for f in range(6)}
        conflict = {c: draw.random() < 0.05 for c in cells}
        occ = spark.createDataFrame([(i, f, m, conflict[i, f]) for (i, f), m in cells.items() if m], "atom_id int, frame int, mol_id bigint, conflict boolean")
        names = {m: "ABC"[m % 3] for m in range(1, 9)}
        expected = Counter()
        for f in range(5):
            near: dict = {}
            for i in range(10):
                a, b = cells[i, f], cells[i, f + 1]
                if a != b:
                    near.setdefault(("l", a), set()).add(("r", b))
                    near.setdefault(("r", b), set()).add(("l", a))
                    for side, key, at in (("l", a, f), ("r", b, f + 1)):
                        if key and conflict[i, at]:
                            near[side, key].add(("bad",))
            seen: set = set()
            for start in list(near):
                if start in seen:
                    continue
                group, stack = set(), [start]
                while stack:
                    x = stack.pop()
                    if x not in group:
                        group.add(x)
                        stack += near.get(x, ())
                seen |= group
                if ("bad",) in group or ("l", 0) in group or ("r", 0) in group:
                    continue
                l, r = (Counter(names[x[1]] for x in group if x[0] == s) for s in "lr")
                if l - r and r - l:
                    expected[f, "+".join(sorted((l - r).elements())), "+".join(sorted((r - l).elements()))] += 1
        found = events.matched(events.changed(occ, 6)).where("clean")
        got = events.named_events(found, spark.createDataFrame(list(names.items()), "mol_id bigint, name string"))
        assert Counter(map(tuple, got.collect())) == expected


def test_brackets_and_formulas(spark):
    cases = {"[H]c(Cl)C([H])Cl": "[H][c]([Cl])[C]([H])[Cl]", "[CH]": "[CH]", "[C]": "[C]", "[Mo]": "[Mo]", "C": "[C]", "Na": "[Na]", "C_unknownSMILES_0": "C_unknownSMILES_0"}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r["name"]: r["b"] for r in df.withColumn("b", fn.bracket(df["name"], ["C", "H", "Cl", "Na", "Mo"])).collect()}
    assert got == cases
    shown = {"[C][C]([H])[C][C][C]": "C5H", "[H][c]" * 6: "C6H6", "[Ca][c][C][c][Ca][c]": "C4Ca2", "[H][c][c][c][c][c][c]": "C6H"}
    df = spark.createDataFrame([(k,) for k in shown], "name string")
    assert {r["name"]: r["d"] for r in df.withColumn("d", fn.display(df["name"])).collect()} == shown


def test_canonical_names_of_symmetric_molecules():
    import random

    def branched(order):  # C30H62: a chain of twelve with six isopropyl groups, atoms in the given order
        bonds = [(i, i + 1) for i in range(11)]
        for k in range(6):
            bonds += [(2 * k, 12 + 3 * k), (12 + 3 * k, 13 + 3 * k), (12 + 3 * k, 14 + 3 * k)]
        elements, n = ["C"] * 30, 30
        for c in range(30):
            for _ in range(4 - sum(c in b for b in bonds[:29])):
                bonds.append((c, n))
                elements.append("H")
                n += 1
        out = [""] * n
        for i, e in enumerate(elements):
            out[order[i]] = e
        return naming.canonical(out, [(order[a], order[b], 1) for a, b in bonds])

    names = set()
    for seed in range(3):
        order = list(range(92))
        random.Random(seed).shuffle(order)
        names.add(branched(order))
    assert len(names) == 1
    cube = [(a, a ^ b, 1) for a in range(128) for b in (1, 2, 4, 8, 16, 32, 64) if a < a ^ b]  # 645,120 automorphisms
    assert naming.canonical(["C"] * 128, cube) == naming.canonical(["C"] * 128, [(127 - a, 127 - b, o) for a, b, o in reversed(cube)])


def test_canonical_names_tell_structures_apart():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.randrange(1, 7)
        elements = [draw.choice("CH") for _ in range(n)]
        bonds = [(a, b, draw.choice([1, 2])) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]
        order = list(range(n))
        draw.shuffle(order)
        moved = [None] * n
        for i, j in enumerate(order):
            moved[j] = elements[i]
        assert naming.canonical(elements, bonds) == naming.canonical(moved, [(order[a], order[b], o) for a, b, o in bonds])
    ring, path = [(i, (i + 1) % 6, 1) for i in range(6)], [(0, 1, 1), (1, 2, 1), (2, 0, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1)]
    assert naming.canonical(["C"] * 6, ring) != naming.canonical(["C"] * 6, path)
    assert naming.canonical(["C", "C"], [(0, 1, 1)]) != naming.canonical(["C", "C"], [(0, 1, 2)])


def bracketed(name, elements):
    """Character by character: what stands outside brackets and is an element but hydrogen."""
    out, i = "", 0
    known = {x for e in elements if e != "H" for x in ((e, e.lower()) if len(e) == 1 else (e,))}
    while i < len(name):
        if name[i] == "[":
            end = name.index("]", i) + 1
            out, i = out + ("[H]" if name[i:end] == "[HH]" else name[i:end]), end
        else:
            n = 2 if name[i : i + 2] in known else 1
            out, i = out + (f"[{name[i : i + n]}]" if name[i : i + n] in known else name[i : i + n]), i + n
    return out


def test_brackets_of_real_names(spark):
    names = ["[CH3]", "[OH2]", "[HH]", "C[C@H](N)C(=O)O", "c1ccccc1Cl", "[13CH4]", "[Na+].[Cl-]", "CC(=O)Oc1ccccc1C(=O)O", "[H]O[H]", "O=[N+]([O-])c1ccc(Br)cc1", "ClCCl", "", "[nH]1cccc1", "C#N", "[H][C]([H])[H]"]
    elements = ["C", "H", "O", "N", "Cl", "Na"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["b"] for r in df.withColumn("b", fn.bracket(df["name"], elements)).collect()}
    assert got == {n: bracketed(n, elements) for n in names}
    assert got["[CH3]"] == "[CH3]" and got["[OH2]"] == "[OH2]" and got["[HH]"] == "[H]"
    assert {r["b"] for r in df.select(fn.bracket(df["name"], ["H"]).alias("b")).where("b like '%CCl%'").collect()} == {"ClCCl"}


def test_names_by_strategy(spark):
    molecules = spark.createDataFrame([(1, [0, 1], [(0, 1, 2)]), (2, [0, 1], [(0, 1, 1)]), (3, [1, 2], [(1, 2, 1)]), (4, [0, 2], [])], "mol_id bigint, atoms array<int>, bonds array<struct<a:int,b:int,level:int>>")
    atoms = spark.createDataFrame([(i, "C") for i in range(3)], "atom_id int, element string")
    named = lambda mode, miso: {r["mol_id"]: r["name"] for r in naming.species_names(molecules, atoms, mode, miso, ["C"]).collect()}
    full = named("smiles", 0)
    assert len(set(full.values())) == 3 and full[2] == full[3]
    assert named("smiles", 1) == named("graph", 0) == {1: full[1], 2: full[1], 3: full[1], 4: full[4]}
    assert set(named("smiles", 2).values()) == {full[1]} and set(named("formula", 0).values()) == {"C2"}
    with pytest.raises(ValueError):
        naming.species_names(molecules, atoms, "other")


def test_isomers(spark):
    molecules = spark.createDataFrame([(1, [0, 1], [(0, 1, 1)]), (2, [2, 3], [(2, 3, 1)]), (3, [0, 1], [(0, 1, 2)]), (4, [0], []), (5, [0, 1], [])], "mol_id bigint, atoms array<int>, bonds array<struct<a:int,b:int,level:int>>")
    atoms = spark.createDataFrame([(i, "C") for i in range(4)], "atom_id int, element string")
    groups = lambda m: {r["mol_id"]: r["representative"] for r in naming.isomers(molecules, atoms, m).collect()}
    assert groups(0) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert groups(1) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert groups(2) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}


REACTIONS = [("A", "B", 5), ("B", "C", 5), ("C", "A", 2), ("A", "D", 1), ("E", "A", 9)]


def test_matrix_orders_and_search(spark):
    r = spark.createDataFrame(REACTIONS, "left_name string, right_name string, n bigint")
    o = matrix.ordered(r)
    assert [x["left_name"] for x in o.orderBy("ord").collect()] == ["E", "B", "A", "C", "A"]
    assert {x["name"]: x["idx"] for x in matrix.ranked(o).collect()} == {"E": 1, "A": 2, "B": 3, "C": 4, "D": 5}
    assert {tuple(x) for x in matrix.cells(o, matrix.ranked(o, 3)).collect()} == {(1, 2, 9), (2, 3, 5)}
    c = matrix.centred(r, "A", 1).orderBy("ord").collect()
    assert [(x["left_name"], x["right_name"]) for x in c] == [("A", "B"), ("B", "C"), ("E", "A"), ("C", "A"), ("A", "D")]
    assert [tuple(x) for x in matrix.pivoted(o, matrix.ranked(o), 2).orderBy("name").collect()] == [("A", 0, 0), ("E", 0, 9)]


def test_report_and_network(spark):
    o = matrix.ordered(spark.createDataFrame(REACTIONS, "left_name string, right_name string, n bigint"))
    whole = report.as_json(o, spark.createDataFrame([("A+A->B", 3)], "reaction string, n bigint"))
    data = json.loads(whole)
    assert data["reactions"][0][0] == {"i": 1, "l": ["E"], "r": ["A"], "n": 9}
    assert data["reactionsabcd"] == [{"i": 1, "l": ["A", "A"], "r": ["B"], "n": 3}]
    assert data["linkreac"]["A"] == ["E", "B", "C", "D"] and data["species"][0][0] == {"i": 1, "s": "E"}
    assert data["network"][0].count("<line") == 5 and "<html" not in report.as_html(whole)[:5]
    chosen = network.nodes(matrix.ranked(o), species=["D", "A", "E"], without=["D"])
    assert {(x["name"], x["node"]) for x in chosen.collect()} == {("A", 1), ("E", 2)}
    styled = network.styled(network.edges(o, chosen)).collect()
    assert [(x["left_name"], x["width"], x["red"], x["blue"]) for x in styled] == [("E", 6.0, 1.0, 0.0)]
    assert report.search_reactions(report.reactions(o), ["D"]).count() == 1 and report.search_species(report.species(o), []).count() == 5


def test_rates(spark):
    species = spark.createDataFrame([(0, "A", 2), (10, "A", 3), (0, "B", 1), (20, "A", 5), (20, "B", 2)], "timestep bigint, name string, n bigint")
    r = spark.createDataFrame([("A->B", 7), ("A+A+B->C", 3)], "reaction string, n bigint")
    got = {x["reaction"]: x["k"] for x in rates.rate_constants(species, r, [10.0, 10.0, 10.0], 0.5).collect()}
    moles, span = 1000 * 1e-24 * rates.AVOGADRO, 10 * 0.5e-15
    assert got["A->B"] == pytest.approx(7 / (moles * span * (10 / moles)))
    c = (2 / moles) ** 2 * (1 / moles) + (5 / moles) ** 2 * (2 / moles)
    assert math.isclose(got["A+A+B->C"], 3 / (moles * span * c), rel_tol=1e-9)
    many = spark.createDataFrame([(t, "A", 2) for t in (0, 10)] + [(20, "C", 1)], "timestep bigint, name string, n bigint")
    events_ = spark.createDataFrame([("+".join(["A"] * 124) + "->B", 1), ("A+C->B", 4)], "reaction string, n bigint")
    got = {x["n"]: x for x in rates.rate_constants(many, events_, [10.0, 10.0, 10.0], 0.5).withColumn("n", F.length("reaction")).collect()}
    assert got[250]["log10_k"] == pytest.approx(-math.log10(moles * span * 2) - 124 * math.log10(2 / moles))  # the product itself is below the least double
    assert got[6]["k"] == got[6]["log10_k"] == math.inf  # A and C are never there together
    assert rates.volume([[2.0, 0, 0], [1, 3, 0], [0, 0, 4]]) == 24
    with pytest.raises(KeyError):
        rates.rate_constants(species, spark.createDataFrame([("Z->A", 1)], "reaction string, n bigint"), [1, 1, 1], 1.0)
