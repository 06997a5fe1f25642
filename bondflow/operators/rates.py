"""Rate constants from species' numbers over time and reactions' occurrences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AVOGADRO = 6.02214076e23


def volume(cell: list) -> float:
    """Volume in cubic angstrom of a cell of 3 lengths, 9 numbers, or 3 x 3 numbers."""
    flat = [float(v) for row in cell for v in (row if isinstance(row, (list, tuple)) else [row])]
    if len(flat) == 3:
        return abs(flat[0] * flat[1] * flat[2])
    if len(flat) != 9:
        raise ValueError("a cell has 3 or 9 numbers")
    a, b, c, d, e, f, g, h, i = flat
    return abs(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))


def rate_constants(species: DataFrame, reactions: DataFrame, cell: list, timestep: float) -> DataFrame:
    """(reaction, k, log10_k) of reactions (reaction, n) from species (timestep, name, n); timestep in femtoseconds a step.

    k = n / (V NA dt * sum over time of the product over reactants of (count / (V NA))^order).
    Products and the sum are taken in logarithms (the greatest term factored out), so events
    of hundreds of reactants don't underflow; k itself may then be infinite where log10_k is not.
    Times at which a reactant is absent add nothing; where no time has all reactants both are
    infinite. A reactant that never occurs is an error.
    """
    times = [r[0] for r in species.select("timestep").distinct().orderBy("timestep").limit(2).collect()]
    if len(times) < 2:
        raise ValueError("two times are needed")
    moles = volume(cell) * 1e-24 * AVOGADRO
    span = (times[1] - times[0]) * timestep * 1e-15
    # a reaction's text may name a hundred thousand reactants: rows of reactants hold 128 bits of its hash instead
    keyed = reactions.select(F.xxhash64("reaction", "n").alias("one"), F.xxhash64("n", F.lit(1), "reaction").alias("two"), "reaction", "n")
    sides = keyed.select("one", "two", F.explode(F.split(F.substring_index("reaction", "->", 1), r"\+")).alias("name"))
    needs = sides.groupBy("one", "two", "name").agg(F.count("*").alias("order"))
    missing = needs.join(species.select("name").distinct(), "name", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0]["name"])
    wanted = needs.groupBy("one", "two").agg(F.count("*").alias("reactants"))
    present = needs.join(species.where("n > 0").select("timestep", "name", F.col("n").alias("count")), "name")
    logs = present.groupBy("one", "two", "timestep").agg(F.sum(F.col("order") * F.ln(F.col("count") / moles)).alias("log"), F.count("*").alias("have"))
    whole = logs.join(wanted, ["one", "two"]).where("have = reactants").select("one", "two", "log")
    most = whole.groupBy("one", "two").agg(F.max("log").alias("most"))
    sums = whole.join(most, ["one", "two"]).groupBy("one", "two", "most").agg(F.sum(F.exp(F.col("log") - F.col("most"))).alias("rest"))
    log_k = F.coalesce(F.ln("n") - math.log(moles * span) - F.col("most") - F.ln("rest"), F.lit(math.inf))
    return keyed.join(sums, ["one", "two"], "left").select("reaction", F.exp(log_k).alias("k"), (log_k / math.log(10)).alias("log10_k"))
