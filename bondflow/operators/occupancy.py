"""Which molecule each atom is in over time, its route, and the transitions between molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def occupancy(atoms_of: DataFrame, on: DataFrame) -> DataFrame:
    """(atom_id, frame, mol_id, conflict) from (mol_id, atoms) and (mol_id, frames).

    The greatest id wins where several molecules claim an atom, which then is a conflict.
    """
    cells = atoms_of.join(on.select("mol_id", F.col("frames").alias("on")), "mol_id").select("mol_id", F.explode("atoms").alias("atom_id"), "on").select("mol_id", "atom_id", F.explode("on").alias("frame"))
    return cells.groupBy("atom_id", "frame").agg(F.max("mol_id").alias("mol_id"), (F.count("*") > 1).alias("conflict"))


def parts(frames: DataFrame, split: int) -> DataFrame:
    """(frame, part): the frames in `split` runs of nearly equal length, longer ones first."""
    return frames.select("frame", (F.ntile(split).over(Window.orderBy("frame")) - 1).alias("part"))


def routes(occupied: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, atom_id, seq, time, frame, mol_id): each atom's molecules without repeats; time counts the atom's occupied frames."""
    own = Window.partitionBy(*by, "atom_id").orderBy("frame")
    timed = occupied.withColumn("time", F.row_number().over(own) - 1).withColumn("before", F.lag("mol_id").over(own))
    kept = timed.where("before is null or before <> mol_id")
    return kept.select(*by, "atom_id", (F.row_number().over(own) - 1).alias("seq"), "time", "frame", "mol_id")


def transitions(route: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, atom_id, left_mol, right_mol) of each step of a route."""
    own = Window.partitionBy(*by, "atom_id").orderBy("seq")
    return route.select(*by, "atom_id", F.col("mol_id").alias("left_mol"), F.lead("mol_id").over(own).alias("right_mol")).where("right_mol is not null")


def counted(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, left_mol, right_mol, cnt): of the atoms that show a pair, the least one's occurrences."""
    keys = [*by, "left_mol", "right_mol"]
    each = steps.groupBy(*keys, "atom_id").agg(F.count("*").alias("cnt"))
    return each.groupBy(*keys).agg(F.min_by("cnt", "atom_id").alias("cnt"))


def distinct_pairs(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, left_mol, right_mol, cnt): each pair once."""
    return steps.select(*by, "left_mol", "right_mol").distinct().withColumn("cnt", F.lit(1).cast("bigint"))


def reactions(pairs: DataFrame, names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, left_name, right_name, n) of pairs whose names differ."""
    left = names.select(F.col("mol_id").alias("left_mol"), F.col("name").alias("left_name"))
    right = names.select(F.col("mol_id").alias("right_mol"), F.col("name").alias("right_name"))
    named = pairs.join(left, "left_mol").join(right, "right_mol").where("left_name <> right_name")
    return named.groupBy(*by, "left_name", "right_name").agg(F.sum("cnt").cast("bigint").alias("n"))
