"""The text tables that analyses write, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_species(lines: DataFrame) -> DataFrame:
    """(timestep, name, n) from lines `Timestep t: name n name n ...`."""
    part = F.regexp_extract("value", r"^Timestep\s+(\S+):\s*(.*)$", 2)
    words = F.filter(F.split(part, r"\s+"), lambda w: w != "")
    rows = lines.where(F.col("value").startswith("Timestep")).select(F.regexp_extract("value", r"^Timestep\s+(\S+):", 1).cast("bigint").alias("timestep"), words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 2).cast("int") - 1), lambda i: F.struct(F.get("w", 2 * i).alias("name"), F.get("w", 2 * i + 1).cast("bigint").alias("n")))
    return rows.where(F.size("w") > 1).select("timestep", F.explode(pairs).alias("x")).select("timestep", "x.*")


def dense(species: DataFrame) -> DataFrame:
    """(timestep, name, n) with zeros for every name and time of the table: times are joined to names, both distinct."""
    times, names = species.select("timestep").distinct(), species.select("name").distinct()
    grid = times.join(names.withColumn("_all", F.lit(1)), F.col("_all") == 1)
    return grid.join(species, ["timestep", "name"], "left").select("timestep", "name", F.coalesce("n", F.lit(0)).alias("n"))


def read_species(spark: SparkSession, path: str) -> DataFrame:
    return dense(parse_species(spark.read.text(path)))


def parse_reactions(lines: DataFrame) -> DataFrame:
    """(reaction, n, side, name, count) from lines `n left->right` with sides joined by `+`."""
    rows = lines.select(F.regexp_extract("value", r"^(\d+)\s+(.*)$", 1).try_cast("bigint").alias("n"), F.regexp_extract("value", r"^(\d+)\s+(.*)$", 2).alias("reaction")).where("n is not null")
    sides = F.split("reaction", "->")
    both = F.array(*(F.struct(F.lit(s).alias("side"), F.split(sides[i], r"\+").alias("names")) for i, s in enumerate(("left", "right"))))
    flat = rows.select("n", "reaction", F.explode(both).alias("x")).select("n", "reaction", "x.side", F.explode("x.names").alias("name"))
    return flat.groupBy("reaction", "n", "side", "name").agg(F.count("*").alias("count"))


def read_reactions(spark: SparkSession, path: str) -> DataFrame:
    return parse_reactions(spark.read.text(path))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(left_name, right_name, n): the non-zero cells of a space-separated matrix with names on both edges."""
    table = spark.read.csv(path, sep=" ", header=True)
    first, rest = table.columns[0], table.columns[1:]
    cells = F.array(*(F.struct(F.lit(c).alias("right_name"), F.col(f"`{c}`").cast("bigint").alias("n")) for c in rest))
    return table.select(F.col(f"`{first}`").alias("left_name"), F.explode(cells).alias("x")).select("left_name", "x.*").where("n <> 0")


def reaction_line(n: Column, left: Column, right: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), left, F.lit("->"), right)
