"""The reaction network: nodes, edges, their style, layout and drawing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nodes(ranks: DataFrame, most: int = 20, species: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """(name, node): the first species, or those given, less the filtered ones; nodes count from 1."""
    if species:
        order = F.create_map(*(x for i, s in enumerate(species) for x in (F.lit(s), F.lit(i))))
        chosen = ranks.where(F.col("name").isin(species)).withColumn("idx", order[F.col("name")])
    else:
        chosen = ranks.where(F.col("idx") <= most)
    if without:
        chosen = chosen.where(~F.col("name").isin(without))
    return chosen.select("name", F.row_number().over(Window.orderBy("idx")).alias("node"))


def edges(reactions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(left_name, right_name, n) between chosen nodes."""
    one = chosen.select(F.col("name").alias("left_name"))
    two = chosen.select(F.col("name").alias("right_name"))
    return reactions.where("n > 0 and left_name <> right_name").join(one, "left_name", "left_semi").join(two, "right_name", "left_semi").select("left_name", "right_name", "n")


# fixed values: the line's width and its step, and the colours' ends
def styled(edges_: DataFrame, width: float = 3.0, start: tuple = (0.0, 0.0, 1.0), end: tuple = (1.0, 0.0, 0.0)) -> DataFrame:
    """Adds weight ln(n + 1), its share of the largest, a line width and a colour between start and end."""
    weight = F.log1p(F.col("n"))
    share = weight / F.max(weight).over(Window.partitionBy())
    out = edges_.withColumn("weight", weight).withColumn("share", share)
    out = out.withColumn("width", F.col("share") * width * F.when(F.col("share") > 0.7, 2.0).otherwise(0.5))
    return out.withColumns({c: F.lit(a) + F.col("share") * (b - a) for c, a, b in zip(("red", "green", "blue"), start, end, strict=True)})


def layout(n: int, links: list[tuple[int, int]], pull: float | None = None, rounds: int = 60, seed: int = 0) -> np.ndarray:
    """Places of n nodes by Fruchterman and Reingold's forces; for drawings of some tens of nodes."""
    at = np.random.default_rng(seed).random((n, 2))
    if n < 2:
        return at
    pull = pull or 1 / math.sqrt(n)
    near = np.zeros((n, n))
    for a, b in links:
        near[a, b] = near[b, a] = 1
    for heat in np.linspace(0.1, 0.002, rounds):
        gap = at[:, None] - at[None]
        far = np.maximum(np.sqrt((gap**2).sum(axis=2)), 0.01)
        step = (gap * (pull**2 / far**2 - near * far / pull)[:, :, None]).sum(axis=1)
        at = at + step / np.maximum(np.sqrt((step**2).sum(axis=1)), 0.01)[:, None] * heat
    low, high = at.min(axis=0), at.max(axis=0)
    return (at - low) / np.maximum(high - low, 1e-9)


def svg(names: list[str], links: list[dict], size: int = 600, seed: int = 0) -> str:
    """A drawing of the network; links have left_name, right_name, width, red, green and blue."""
    from xml.sax.saxutils import escape

    place = {s: i for i, s in enumerate(names)}
    at = layout(len(names), [(place[x["left_name"]], place[x["right_name"]]) for x in links], seed=seed) * (size - 100) + 50
    lines = []
    for x in links:
        (x1, y1), (x2, y2) = at[place[x["left_name"]]], at[place[x["right_name"]]]
        colour = "#" + "".join(f"{round(255 * x[c]):02x}" for c in ("red", "green", "blue"))
        lines.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="{colour}" stroke-width="{x["width"]:.2f}" marker-end="url(#to)"/>')
    texts = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="6"/><text x="{x + 8:.1f}" y="{y:.1f}">{escape(s)}</text>' for s, (x, y) in zip(names, at, strict=True)]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}"><defs><marker id="to" viewBox="0 0 8 8" refX="16" refY="4" markerWidth="5" markerHeight="5" orient="auto"><path d="M0 0 8 4 0 8z"/></marker></defs>'
    return head + "".join(lines + texts) + "</svg>"
