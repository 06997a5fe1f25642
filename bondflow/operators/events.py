"""Reaction events between adjacent frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bondflow.operators.graph import labels


def changed(occupied: DataFrame, steps: int) -> DataFrame:
    """(frame, atom_id, left_mol, right_mol, bad): atoms whose molecule differs in the next of the frames 0 to steps - 1.

    An empty cell is molecule 0. A change is bad if either side is empty or in conflict. Only
    occupied cells are looked at: one whose neighbour in time is missing has changed from or
    to emptiness, and changes from emptiness to itself don't exist.
    """
    own = Window.partitionBy("atom_id").orderBy("frame")
    near = {"before": F.lag("frame"), "next": F.lead("frame"), "next_mol": F.lead("mol_id"), "next_conflict": F.lead("conflict")}
    cells = occupied.select("atom_id", "frame", "mol_id", "conflict", *(f.over(own).alias(c) for c, f in near.items()))
    follows = F.coalesce(F.col("next") == F.col("frame") + 1, F.lit(False))
    one = lambda frame, left, right, bad: F.struct(frame.alias("frame"), left.cast("bigint").alias("left_mol"), right.cast("bigint").alias("right_mol"), bad.alias("bad"))
    begins = F.when((F.col("frame") > 0) & ~F.coalesce(F.col("before") == F.col("frame") - 1, F.lit(False)), one(F.col("frame") - 1, F.lit(0), F.col("mol_id"), F.lit(True)))
    ends = F.when(~follows & (F.col("frame") < steps - 1), one(F.col("frame"), F.col("mol_id"), F.lit(0), F.lit(True)))
    goes = F.when(follows & (F.col("next_mol") != F.col("mol_id")), one(F.col("frame"), F.col("mol_id"), F.col("next_mol"), F.col("conflict") | F.col("next_conflict")))
    found = cells.select("atom_id", F.explode(F.array_compact(F.array(begins, ends, goes))).alias("x"))
    return found.select("x.frame", "atom_id", "x.left_mol", "x.right_mol", "x.bad")


def matched(changes: DataFrame) -> DataFrame:
    """(frame, component, left, right, clean): molecules before and after that share changed atoms, as components.

    A component that touches an empty cell or a conflict is not clean; emptiness itself
    links nothing, so it does not gather a frame's changes in one component.
    """
    edges = changes.groupBy("frame", "left_mol", "right_mol").agg(F.max("bad").alias("bad"))

    def run(table: pa.Table) -> pa.Table:
        frame = table.column("frame")[0].as_py()
        l, r, bad = (table.column(c).to_numpy() for c in ("left_mol", "right_mol", "bad"))
        left, il = np.unique(l, return_inverse=True)
        right, ir = np.unique(r, return_inverse=True)
        real = (l != 0) & (r != 0)
        own = labels(len(left) + len(right), il[real], len(left) + ir[real])
        dirty = np.zeros(len(own), bool)
        dirty[own[il[bad]]] = True
        dirty[own[len(left) + ir[bad]]] = True
        out = {}
        for side, mols, base in ((0, left, 0), (1, right, len(left))):
            for i, m in enumerate(mols.tolist()):
                if m:
                    out.setdefault(int(own[base + i]), ([], []))[side].append(m)
        rows = sorted((min(a + b), a, b, not dirty[c]) for c, (a, b) in out.items())
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)]
        return pa.table([pa.array([frame] * len(rows), pa.int32()), *columns], names=["frame", "component", "left", "right", "clean"])

    return edges.groupBy("frame").applyInArrow(run, "frame int, component bigint, left array<bigint>, right array<bigint>, clean boolean")


def named_events(components: DataFrame, names: DataFrame) -> DataFrame:
    """(frame, reactant, product): names on each side that the other lacks, counted, joined by `+`; both sides must keep some."""
    side = lambda c, s: F.transform(F.col(c), lambda m: F.struct(m.alias("mol_id"), F.lit(s).alias("sign")))
    rows = components.select("frame", "component", F.explode(F.concat(side("left", 1), side("right", -1))).alias("x")).select("frame", "component", "x.*")
    net = rows.join(names.select("mol_id", "name"), "mol_id").groupBy("frame", "component", "name").agg(F.sum("sign").cast("int").alias("net")).where("net <> 0")
    text = lambda wanted, n: F.array_join(F.array_sort(F.flatten(F.collect_list(F.when(wanted, F.array_repeat("name", n))))), "+")
    both = net.groupBy("frame", "component").agg(text(F.col("net") > 0, F.col("net")).alias("reactant"), text(F.col("net") < 0, -F.col("net")).alias("product"))
    return both.where("reactant <> '' and product <> ''").select("frame", "reactant", "product")


def frequencies(events: DataFrame) -> DataFrame:
    """(reaction, n)."""
    return events.groupBy(F.concat_ws("->", "reactant", "product").alias("reaction")).agg(F.count("*").alias("n"))
