"""Formulas and bracket notation.

A name is read as a sequence of parts: bracketed atoms, bare element symbols, and single
other characters (bonds, ring numbers, branches). Both functions work on these parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An atom in brackets, with whatever else they hold
BRACKETED = r"\[[^\]]*\]"


def formula(counts: dict[str, Column]) -> Column:
    """Element and count in the given order, zeros kept: C0H2O1."""
    return F.concat(*(x for e, n in counts.items() for x in (F.lit(e), n.cast("string"))))


def symbols(elements: list[str]) -> list[str]:
    """What stands for an element outside brackets, longest first: its symbol and, for one letter, the lower case of aromatic atoms. Hydrogen never stands bare."""
    bare = {s for e in elements if e != "H" for s in ((e, e.lower()) if len(e) == 1 else (e,))}
    return sorted(bare, key=lambda s: (-len(s), s))


def bracket(name: Column, elements: list[str]) -> Column:
    """The name with bare atoms in brackets, a molecule of hydrogen's [HH] being [H]; names of unknown structure stay as they are."""
    bare = "|".join(symbols(elements))
    part = rf"{BRACKETED}|{bare}|." if bare else rf"{BRACKETED}|."
    one = lambda p: F.when(p.rlike(f"^({bare or '$.'})$"), F.concat(F.lit("["), p, F.lit("]"))).when(p == "[HH]", F.lit("[H]")).otherwise(p)
    parts = F.regexp_extract_all(name, F.lit(part), F.lit(0))
    return F.when(name.contains("_unknownSMILES"), name).otherwise(F.array_join(F.transform(parts, one), ""))


def display(name: Column) -> Column:
    """The formula shown for a bracketed name: plain atoms counted, in order of the alphabet, a count of 1 left out."""
    parts = F.regexp_extract_all(name, F.lit(BRACKETED), F.lit(0))
    atoms = F.transform(F.filter(parts, lambda p: p.rlike("^.[A-Za-z][a-z]?.$")), lambda p: F.initcap(F.btrim(p, F.lit("[]"))))
    number = lambda e: F.size(F.filter(atoms, lambda a: a == e))
    written = lambda e: F.concat(e, F.when(number(e) > 1, number(e).cast("string")).otherwise(F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(atoms)), written), "")
