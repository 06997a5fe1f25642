"""Canonical names of molecules and groups of isomers.

A name is a linear text of the molecule's graph that does not depend on atom numbers:
atoms are coloured by element and refined by their neighbours' colours and bond orders;
ties are tried one by one and the least text is taken. Two orders that give the same text
show an automorphism; ties that it maps to tried ones, and the rest of a branch that it maps
to a finished one, are left out, so the search ends with the least text for any molecule.
Names are made once for each distinct molecule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondflow.functions import names as formulas
from bondflow.operators import graph

#: Signs of bond orders in names
SIGNS = {1: "", 2: "=", 3: "#", 12: ":"}
#: Atoms up to which a molecule is searched in dictionaries, beyond it in arrays
SMALL = 48


class _Small:
    """A molecule's graph as dictionaries: near[i] has the order of each neighbour's bond."""

    def __init__(self, elements: list[str], bonds: Iterable[tuple[int, int, int]]) -> None:
        self.elements, self.near = elements, [{} for _ in elements]
        for a, b, o in bonds:
            self.near[a][b] = self.near[b][a] = o
        kinds: dict[tuple, int] = {}
        self.twin = [kinds.setdefault((None, frozenset(x.items())), i) for i, x in enumerate(self.near)]
        for o in {o for x in self.near for o in x.values()}:  # bonded twins: the same neighbours, each other aside
            for i, x in enumerate(self.near):
                first = kinds.setdefault((o, frozenset([*x.items(), (i, o)])), i)
                self.twin[i] = first if first != i else self.twin[i]

    def refined(self, colours: list[int]) -> list[int]:
        while True:
            keys = [(c, tuple(sorted((o, colours[j]) for j, o in self.near[i].items()))) for i, c in enumerate(colours)]
            order = {k: r for r, k in enumerate(sorted(set(keys)))}
            new = [order[k] for k in keys]
            if len(order) == len(set(colours)):
                return new
            colours = new

    def text(self, order: list[int]) -> str:
        """Atoms in order in brackets, each followed by its bonds to earlier atoms."""
        place = {atom: i for i, atom in enumerate(order)}
        parts = []
        for i, atom in enumerate(order):
            back = sorted((place[j], o) for j, o in self.near[atom].items() if place[j] < i)
            parts.append(f"[{self.elements[atom]}]" + "".join(f"({SIGNS.get(o, f'~{o}')}{i - p})" for p, o in back))
        return "".join(parts)


class _Large:
    """The same of many atoms, as arrays; colours and texts are those of _Small. Twins are told by 128 bits of hash."""

    def __init__(self, elements: list[str], a: np.ndarray, b: np.ndarray, o: np.ndarray) -> None:
        n = len(elements)
        self.elements = elements
        self.orders, kind = np.unique(o, return_inverse=True)
        row, col, kind = np.concatenate([a, b]).astype(np.int64), np.concatenate([b, a]).astype(np.int64), np.concatenate([kind, kind])
        by = np.argsort(row, kind="stable")
        self.row, self.col, self.kind = row[by], col[by], kind[by]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        k = len(self.orders)
        marks = [graph.mixed(np.arange(n * k), seed) for seed in (1, 2)]
        sums = [np.zeros(n, np.uint64) for _ in marks]
        for s, m in zip(sums, marks, strict=True):
            np.add.at(s, self.row, m[self.col * k + self.kind])
        self.twin = list(range(n))
        for own in (None, *range(k)):
            one, two = (s if own is None else s + m[np.arange(n) * k + own] for s, m in zip(sums, marks, strict=True))
            first: dict[tuple[int, int], int] = {}
            for i, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if (head := first.setdefault(key, i)) != i:
                    self.twin[i] = head

    def refined(self, colours: list[int]) -> list[int]:
        was = np.asarray(colours, np.int64)
        while True:
            width = int(was.max()) + 1
            wide = width * max(1, len(self.orders))
            near = np.sort(self.row * wide + self.kind * width + was[self.col]) - self.row * wide
            text = near.astype(">u4").tobytes() if wide < 1 << 32 else near.astype(">u8").tobytes()  # compared as the lists of numbers are
            size = len(text) // len(near) if len(near) else 0
            at = (self.at * size).tolist()
            keys = [(c, text[i:j]) for c, i, j in zip(was.tolist(), at, at[1:], strict=False)]
            order = {k: r for r, k in enumerate(sorted(set(keys)))}
            new = np.array([order[k] for k in keys], np.int64)
            if len(order) == len(np.unique(was)):
                return new.tolist()
            was = new

    def text(self, order: list[int]) -> str:
        n = len(order)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        own, other = place[self.row], place[self.col]
        back = other < own
        own, other, kind = own[back], other[back], self.kind[back]
        by = np.argsort(own * n + other)
        code, which = np.unique((kind * n + own - other)[by], return_inverse=True)
        signs = [SIGNS.get(x, f"~{x}") for x in self.orders.tolist()]
        words = [f"({signs[c // n]}{c % n})" for c in code.tolist()]
        parts = np.empty(n + len(own), object)
        counts = np.bincount(own, minlength=n)
        heads = np.arange(n) + np.cumsum(counts) - counts
        parts[heads] = [f"[{self.elements[i]}]" for i in order]
        rest = np.ones(len(parts), bool)
        rest[heads] = False
        parts[rest] = np.array([*words, ""], object)[which]
        return "".join(parts)


def canonical(elements: list[str], bonds: list[tuple[int, int, int]]) -> str:
    """The name of a molecule of atoms 0..n-1."""
    if len(elements) <= SMALL:
        return _small(tuple(elements), tuple(map(tuple, bonds)))
    return _least(elements, _Large(elements, *np.array(bonds, np.int64).reshape(-1, 3).T))


@lru_cache(1 << 16)
def _small(elements: tuple[str, ...], bonds: tuple[tuple[int, int, int], ...]) -> str:
    return _least(list(elements), _Small(list(elements), bonds))


def _least(elements: list[str], molecule: _Small | _Large) -> str:
    """The least text of a search's leaves."""
    first = {e: i for i, e in enumerate(sorted(set(elements)))}
    path: list[int] = []  # the atoms set apart so far
    frames = [_frame(molecule.refined([first[e] for e in elements]), molecule.twin)] if elements else []
    known: list[tuple[str, list[int], list[int]]] = []  # text, order and path of the first leaf and of the least
    same: list[list[int]] = []  # automorphisms
    while frames:
        colours, tied, tried = frames[-1]
        if not tied:
            order = sorted(range(len(elements)), key=lambda i: colours[i])
            text = molecule.text(order)
            like = next((k for k in known if k[0] == text), None)
            if like is None:
                known = [known[0], min(known[-1], (text, order, list(path)))] if known else [(text, order, list(path))]
                depth = len(path) - 1
            else:  # the branch where the paths part is a copy of a finished one
                same.append([b for _, b in sorted(zip(like[1], order, strict=True))])
                depth = next(d for d, (a, b) in enumerate(zip(like[2], path, strict=True)) if a != b)
        else:
            done = _reached(tried, [g for g in same if all(g[i] == i for i in path)])
            one = next((i for i in tied if i not in done), None)
            if one is not None:
                tried.append(one)
                path.append(one)
                frames.append(_frame(molecule.refined([2 * c + (j != one) for j, c in enumerate(colours)]), molecule.twin))
                continue
            depth = len(path) - 1
        del frames[depth + 1 :], path[max(depth, 0) :]
    return known[-1][0] if known else ""


def _frame(colours: list[int], twin: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Colours, the tied atoms to try (none if only twins are tied), and those that were tried.

    Twins have the same neighbours, so their order doesn't show in a text: one of each kind is tried, and a
    colour of one kind of twins alone is not parted at all.
    """
    groups: dict[int, list[int]] = {}
    for i, c in enumerate(colours):
        groups.setdefault(c, []).append(i)
    for _, g in sorted(groups.items()):
        if len(g) > 1:
            kinds: dict[int, int] = {}
            for i in g:
                kinds.setdefault(twin[i], i)
            if len(kinds) > 1:
                return colours, list(kinds.values()), []
    return colours, [], []


def _reached(atoms: list[int], same: list[list[int]]) -> set[int]:
    """The atoms and all that automorphisms make of them."""
    done, new = set(atoms), list(atoms)
    while new:
        i = new.pop()
        for g in same:
            if g[i] not in done:
                done.add(g[i])
                new.append(g[i])
    return done


def named(molecules: DataFrame, atoms: DataFrame, orders: bool = True, level: Callable | None = None) -> DataFrame:
    """(mol_id, name): canonical names, of bond orders too or of bonds alone. Molecules have bonds, or groups whose bonds' orders level() makes."""
    return several_named(molecules, atoms, {"name": orders}, level)


def several_named(molecules: DataFrame, atoms: DataFrame, wanted: dict[str, bool], level: Callable | None = None) -> DataFrame:
    """(mol_id, *wanted): as named(), several names made in one pass.

    Bonds stay out of the shuffle of atoms, so none is copied for every atom.
    """
    body = "groups" if level else "bonds"
    with_elements = molecules.select("mol_id", F.posexplode("atoms").alias("i", "atom_id")).join(atoms.select("atom_id", "element"), "atom_id")
    packed = with_elements.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("i", "atom_id", "element"))).alias("atoms"))
    packed = packed.select("mol_id", F.col("atoms.atom_id").alias("ids"), F.col("atoms.element").alias("elements")).join(molecules.select("mol_id", body), "mol_id")

    def bonds_of(row: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if level:
            found = list(zip(*graph.pairs_of(row), strict=True)) or [(np.zeros(0, np.int64),)] * 2
            a, b = map(np.concatenate, found)
            return a, b, level(a, b)
        return tuple(row.values.field(c).to_numpy() for c in ("a", "b", "level"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, out, held = 0, [], 0
            for i in range(batch.num_rows):
                ids, elements = batch.column("ids")[i].values.to_numpy(), batch.column("elements")[i].values.to_pylist()
                a, b, o = bonds_of(batch.column(body)[i])
                by = np.argsort(ids)
                a, b = (by[np.searchsorted(ids, x, sorter=by)] for x in (a, b))
                out.append([_canonical(elements, a, b, o if full else np.ones(len(a), np.int64)) for full in wanted.values()])
                held += sum(map(len, out[-1]))
                if held > graph.TEXT or i + 1 == batch.num_rows:
                    columns = [pa.array(x, pa.string()) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("mol_id").slice(first, len(out)), *columns], names=["mol_id", *wanted])
                    first, out, held = i + 1, [], 0

    return packed.mapInArrow(run, ", ".join(["mol_id bigint", *(f"{c} string" for c in wanted)]))


def _canonical(elements: list[str], a: np.ndarray, b: np.ndarray, o: np.ndarray) -> str:
    if len(elements) <= SMALL:
        return _small(tuple(elements), tuple(zip(a.tolist(), b.tolist(), o.tolist(), strict=True)))
    return _least(elements, _Large(elements, a, b, o))


def bare(molecules: DataFrame, atoms: DataFrame, elements: list[str]) -> DataFrame:
    """(mol_id, name): the atoms of a name alone, in brackets, for what looks at atoms only."""
    counts = counted(molecules, atoms, elements)
    return counts.select("mol_id", F.concat(*(F.expr(f"repeat('[{e}]', cast(n{i} as int))") for i, e in enumerate(elements))).alias("name"))


def counted(molecules: DataFrame, atoms: DataFrame, elements: list[str]) -> DataFrame:
    """(mol_id, n0, n1, ...): how many atoms of each element."""
    rows = molecules.select("mol_id", F.explode("atoms").alias("atom_id")).join(atoms.select("atom_id", "element"), "atom_id")
    return rows.groupBy("mol_id").agg(*(F.count_if(F.col("element") == e).alias(f"n{i}") for i, e in enumerate(elements)))


def formula_names(molecules: DataFrame, atoms: DataFrame, elements: list[str] | None = None) -> DataFrame:
    """(mol_id, name): formulas with elements in the given order, or that of the alphabet."""
    elements = elements or sorted(r["element"] for r in atoms.select("element").distinct().collect())
    return counted(molecules, atoms, elements).select("mol_id", formulas.formula({e: F.col(f"n{i}") for i, e in enumerate(elements)}).alias("name"))


def groups(labels: DataFrame) -> DataFrame:
    """(mol_id, label, representative, members) of (mol_id, label): a group's first molecule stands for it."""
    keyed = labels.select("mol_id", "label", F.xxhash64("label").alias("one"), F.xxhash64(F.lit(1), "label").alias("two"))  # texts may be long
    heads = keyed.groupBy("one", "two").agg(F.min("mol_id").alias("representative"), F.count("*").alias("members"))
    return keyed.join(heads, ["one", "two"]).select("mol_id", "label", "representative", "members")


def isomers(molecules: DataFrame, atoms: DataFrame, miso: int = 0, elements: list[str] | None = None, level: Callable | None = None) -> DataFrame:
    """Groups of equal molecules, (mol_id, label, representative, members): by full structure (0), without bond orders (1), by formula (2)."""
    if miso not in (0, 1, 2):
        raise ValueError(f"miso is 0, 1 or 2, not {miso}")
    labels = formula_names(molecules, atoms, elements) if miso == 2 else named(molecules, atoms, miso == 0, level)
    return groups(labels.withColumnRenamed("name", "label"))


def species_names(molecules: DataFrame, atoms: DataFrame, mode: str = "smiles", miso: int = 0, elements: list[str] | None = None, level: Callable | None = None) -> DataFrame:
    """(mol_id, name) by a strategy of naming.

    "formula": the formula. "smiles": the canonical name; with miso 1 or 2, molecules that
    differ in bond orders or in bonds alone share the name of the first of them. "graph": the
    name of the first isomorphic molecule, bond orders never being compared.
    """
    if mode not in ("formula", "smiles", "graph"):
        raise ValueError(f"names are by formula, smiles or graph, not {mode!r}")
    if mode == "formula":
        return formula_names(molecules, atoms, elements)
    full = named(molecules, atoms, level=level)
    if mode == "smiles" and not miso:
        return full
    return representative_names(full, isomers(molecules, atoms, max(miso, 1), elements, level))


def representative_names(full: DataFrame, grouped: DataFrame) -> DataFrame:
    """(mol_id, name): each molecule's name is that of its group's representative."""
    first = full.select(F.col("mol_id").alias("representative"), "name")
    return grouped.select("mol_id", "representative").join(first, "representative").select("mol_id", "name")
