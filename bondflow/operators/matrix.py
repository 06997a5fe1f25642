"""Orders, ranks and matrices of A -> B reactions; all work on the table of distinct reactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(reactions: DataFrame) -> DataFrame:
    """Adds ord, from 1: by count, then names, all descending."""
    return reactions.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("left_name"), F.desc("right_name"))))


def centred(reactions: DataFrame, centre: str, each: int = 2, size: int = 100) -> DataFrame:
    """ordered(), with the reactions first by which a search from `centre` finds new species.

    Of each species of the last round, up to `each` products not met before are taken, in
    order, until there are `size` species. The search runs on the driver over distinct
    reactions.
    """
    rows = [(r["left_name"], r["right_name"], r["n"]) for r in ordered(reactions).orderBy("ord").toLocalIterator()]
    by_left: dict[str, list] = {}
    for r in rows:
        by_left.setdefault(r[0], []).append(r)
    met, found, front = {centre}, [], [centre]
    while front and len(met) < size:
        later = []
        for spec in front:
            new = [r for r in by_left.get(spec, []) if r[1] not in met][:each]
            for r in new[: max(0, size - len(met))]:
                met.add(r[1])
                later.append(r[1])
                found.append(r)
        front = later
    first = set(found)
    out = [(*r, i) for i, r in enumerate(found + [r for r in rows if r not in first], 1)]
    return reactions.sparkSession.createDataFrame(out, "left_name string, right_name string, n bigint, ord int")


def ranked(ordered_: DataFrame, most: int | None = None) -> DataFrame:
    """(name, idx): species from 1 in the order they first appear in, left before right."""
    seen = ordered_.select(F.posexplode(F.array("left_name", "right_name")).alias("side", "name"), "ord").groupBy("name").agg(F.min(F.col("ord") * 2 + F.col("side")).alias("first"))
    out = seen.select("name", F.row_number().over(Window.orderBy("first")).alias("idx"))
    return out.where(F.col("idx") <= most) if most else out


def cells(reactions: DataFrame, ranks: DataFrame) -> DataFrame:
    """(i, j, n): the matrix's non-zero cells; reactions of species beyond the ranks are left out."""
    left, right = (ranks.select(F.col("name").alias(f"{s}_name"), F.col("idx").alias(k)) for s, k in (("left", "i"), ("right", "j")))
    return reactions.join(left, "left_name").join(right, "right_name").select("i", "j", "n")


def pivoted(reactions: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """(name, s1..s_size): a row for each of the first species."""
    few = ranks.where(F.col("idx") <= size)
    grid = cells(reactions, few).groupBy("i").pivot("j", list(range(1, size + 1))).agg(F.sum("n"))
    named = few.join(grid, few["idx"] == grid["i"], "left")
    return named.select("name", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"s{k}") for k in range(1, size + 1)))
