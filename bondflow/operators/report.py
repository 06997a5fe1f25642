"""The report: reactions, species, links between species, and searches in them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bondflow.operators import matrix, network


def reactions(ordered: DataFrame) -> DataFrame:
    """(i, l, r, n): sides as arrays of species."""
    return ordered.select(F.col("ord").alias("i"), F.split("left_name", r"\+").alias("l"), F.split("right_name", r"\+").alias("r"), "n")


def species(ordered: DataFrame) -> DataFrame:
    """(i, s) in the order species first appear."""
    return matrix.ranked(ordered).select(F.col("idx").alias("i"), F.col("name").alias("s"))


def links(ordered: DataFrame, most: int = 6) -> DataFrame:
    """(start, end, pos): the first distinct neighbours of each species, in the order of reactions, of either direction."""
    one = ordered.select(F.col("left_name").alias("start"), F.col("right_name").alias("end"), (F.col("ord") * 2).alias("at"))
    two = ordered.select(F.col("right_name").alias("start"), F.col("left_name").alias("end"), (F.col("ord") * 2 + 1).alias("at"))
    first = one.unionByName(two).groupBy("start", "end").agg(F.min("at").alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("start").orderBy("at"))).where(F.col("pos") <= most).select("start", "end", "pos")


def search_species(listed: DataFrame, selection: list[str]) -> DataFrame:
    """Species of the selection; all if it is empty."""
    return listed.where(F.col("s").isin(selection)) if selection else listed


def search_reactions(listed: DataFrame, selection: list[str]) -> DataFrame:
    """Reactions with a species of the selection on either side; all if it is empty."""
    return listed.where(F.arrays_overlap(F.concat("l", "r"), F.array(*map(F.lit, selection)))) if selection else listed


def neighbourhood(linked: DataFrame, shown: list[str], name: str) -> list[str]:
    """The species shown once `name` has been expanded: its links of links() are added, each once, after those shown."""
    near = [r["end"] for r in linked.where(F.col("start") == name).orderBy("pos").collect()]  # as many as links() has of one species
    return list(dict.fromkeys([*shown, name, *near]))


def choices(listed: DataFrame, most: int = 65_536) -> DataFrame:
    """The species offered for selection: the first ones of species()."""
    return listed.where(F.col("i") <= most)


def drawing(ordered: DataFrame, most: int = 20, chosen: list[str] | None = None, without: list[str] | None = None, **style) -> str:
    """The network of the first species, or of those chosen, as SVG."""
    own = network.nodes(matrix.ranked(ordered), most, chosen, without)
    drawn = [r.asDict() for r in network.styled(network.edges(ordered, own), **style).collect()]
    return network.svg([r["name"] for r in own.orderBy("node").collect()], drawn)


def as_json(ordered: DataFrame | list[DataFrame], events: DataFrame | None = None, most: int = 20, **drawn) -> str:
    """The whole report as JSON, from tables of distinct reactions: over all time or, as a list, that and each part of a split. Links are those of all time."""
    rows = lambda df, key: [json.loads(r[0]) for r in df.orderBy(key).select(F.to_json(F.struct(*(c for c in df.columns)))).collect()]
    orders = ordered if isinstance(ordered, list) else [ordered]
    near: dict[str, list[str]] = {}
    for r in links(orders[0]).orderBy("start", "pos").collect():
        near.setdefault(r["start"], []).append(r["end"])
    out = {
        "network": [drawing(o, most, **drawn) for o in orders],
        "species": [rows(species(o), "i") for o in orders],
        "reactions": [rows(reactions(o), "i") for o in orders],
        "linkreac": near,
        "speciesshownum": 30,
        "reactionsshownum": 20,
    }
    if events is not None:
        numbered = events.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), "reaction")))
        sides = F.split("reaction", "->")
        out["reactionsabcd"] = rows(reactions(numbered.select("ord", sides[0].alias("left_name"), sides[1].alias("right_name"), "n")), "i")
    return json.dumps(out, separators=(",", ":"))


def as_html(report: str, title: str = "Reaction network") -> str:
    """A page that shows the report's network, reactions and species, without scripts from elsewhere."""
    from html import escape

    data = json.loads(report)
    row = lambda r: f"<tr><td>{r['i']}</td><td>{escape(' + '.join(r['l']))} &rarr; {escape(' + '.join(r['r']))}</td><td>{r['n']}</td></tr>"
    tables = "".join(f"<h2>{head}</h2><table>{''.join(map(row, data[key][0] if key == 'reactions' else data.get(key, [])))}</table>" for head, key in (("Reactions", "reactions"), ("Events", "reactionsabcd")))
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>{data['network'][0]}{tables}<script type='application/json' id='report'>{report.replace('</', '<\\/')}</script>"
