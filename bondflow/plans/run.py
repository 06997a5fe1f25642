"""From trajectory files to all results: options, the analysis of files, and its sinks.

Results are folders named after the first input, in Spark's way: their part files in order
make up the text. Small reports (table, drawing, JSON, page) have a single part.
"""

from __future__ import annotations

import importlib.util
import warnings
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bondflow.operators import events, graph, matrix, report, signals
from bondflow.plans.analysis import Analysis
from bondflow.sources import download, text, trajectory

SUFFIXES = ("moname", "molecules.csv", "route", "reaction", "table", "svg", "species", "html", "json", "reactionabcd", "reactionevent.csv")


@dataclass
class Options:
    """What a run is given; only the first three have no default."""

    inputfiletype: str
    inputfilename: list[str] | str
    atomname: list[str]
    runHMM: bool = True
    miso: int = 0
    SMILES: bool = True
    pbc: bool = True
    cell: list | None = None
    selectatoms: list[str] | None = None
    stepinterval: int = 1
    split: int = 1
    p: tuple = signals.P
    a: tuple = signals.A
    b: tuple = signals.B
    printfiltersignal: bool = False
    printmoleculetime: bool = False
    moleculeframes: list[int] | int | None = None
    moleculetimesteps: list[int] | int | None = None
    printreactionevent: bool = False
    needprintspecies: bool = True
    maxspecies: int = 20
    species: list[str] | None = None
    speciesfilter: list[str] = field(default_factory=list)
    speciescenter: str | None = None
    n_searchspecies: int = 2
    matrix_size: int = 100
    use_ase: bool = False
    ase_cutoff_mult: float = 1.2
    custom_cutoffs: str | dict | None = None
    urls: list[dict] = field(default_factory=list)
    output: str | None = None  # the results' common path; the first input's by default

    def __post_init__(self) -> None:
        if isinstance(self.inputfilename, str):
            self.inputfilename = [self.inputfilename]
        one = lambda x: None if x is None or x == [] else [int(v) for v in (x if isinstance(x, (list, tuple)) else [x])]
        self.moleculeframes, self.moleculetimesteps = one(self.moleculeframes), one(self.moleculetimesteps)
        if self.moleculeframes or self.moleculetimesteps:
            self.printmoleculetime = True
        if not self.use_ase and (self.ase_cutoff_mult != 1.2 or self.custom_cutoffs):
            warnings.warn("cutoffs are given: bonds are found by distance", stacklevel=3)
            self.use_ase = True
        if isinstance(self.custom_cutoffs, str):
            self.custom_cutoffs = graph.parse_cutoffs(self.custom_cutoffs)
        self.cell = cell_rows(self.cell)
        self.output = self.output or self.inputfilename[0]

    @classmethod
    def of(cls, **given) -> Options:
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**given)


def cell_rows(cell: list | None) -> list[list[float]] | None:
    """A cell given as 3 lengths, 9 numbers or 3 rows, as rows."""
    if cell is None:
        return None
    flat = [float(v) for row in cell for v in (row if isinstance(row, (list, tuple)) else [row])]
    if len(flat) == 3:
        return [[flat[i] if i == j else 0.0 for j in range(3)] for i in range(3)]
    if len(flat) != 9:
        raise ValueError("a cell has 3 or 9 numbers")
    return [flat[0:3], flat[3:6], flat[6:9]]


def positions_bonds(rows: DataFrame, options: Options) -> DataFrame:
    """bonds of positions: by distance if asked for or where Open Babel is missing, else with perceived orders."""
    if options.pbc and options.cell:
        rows = rows.withColumn("cell", F.array(*(F.array(*map(F.lit, r)) for r in options.cell)))
    if not options.use_ase:
        if importlib.util.find_spec("openbabel"):
            return graph.perceived_bonds(rows, options.pbc)
        warnings.warn("Open Babel is not installed: bonds are found by distance, all of order 1", stacklevel=3)
    limits = graph.cutoffs(sorted(set(options.atomname)), options.ase_cutoff_mult, options.custom_cutoffs)
    return graph.distance_bonds(rows, limits, "cell" if options.pbc else None)


def analyse(spark: SparkSession, options: Options, folder: str | None = None) -> Analysis:
    """The analysis of trajectory files; with a folder, tables that several results need are written there once."""
    if options.urls:
        download.fetch_all(options.urls)
    rows = trajectory.load(spark, options.inputfiletype, options.inputfilename, atomname=options.atomname, stepinterval=options.stepinterval, pbc=str(options.pbc).lower(), cell=options.cell)
    if folder:  # the files are read once
        rows.write.mode("overwrite").parquet(f"{folder}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    frames = rows.select("frame", "timestep").distinct()
    atoms = rows.where("frame = 0").select("atom_id", "element").distinct()
    if "level" in rows.columns:
        bonds = rows.where("b is not null").select("frame", F.least("atom_id", "b").alias("a"), F.greatest("atom_id", "b").alias("b"), "level")
    else:
        bonds = positions_bonds(rows, options)
    names = "smiles" if options.SMILES else "graph"
    return Analysis(
        frames, atoms, rows.select("frame", "atom_id"), bonds, options.atomname, hmm=options.runHMM, split=options.split, select=options.selectatoms,
        p=options.p, a=options.a, b=options.b, naming=names, miso=options.miso, filtered=not options.printfiltersignal, folder=folder,
    )


def write_lines(lines: DataFrame, path: str, *order: Column | str, header: str | None = None) -> None:
    """The column `line` as text in an order; Spark sorts by ranges, so part files follow each other."""
    out = lines.orderBy(*order).select("line") if order else lines.select("line").coalesce(1)
    if header is not None:
        first = lines.sparkSession.createDataFrame([(header,)], "line string")
        out = first.union(out)
    out.write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text_: str, path: str) -> None:
    spark.createDataFrame([(text_,)], "line string").coalesce(1).write.mode("overwrite").text(path)


def quoted(*columns: Column) -> Column:
    """A CSV line; fields that need it are quoted."""
    one = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(one(F.coalesce(c.cast("string"), F.lit(""))) for c in columns))


def matrix_text(ordered: DataFrame, size: int) -> str:
    """A reaction matrix of at most `size` species: cells separated by spaces, rows and columns named."""
    ranks = matrix.ranked(ordered, size)
    names = [r["name"] for r in ranks.orderBy("idx").collect()]  # `size` at most
    cells = matrix.cells(ordered, ranks).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "n"))).alias("row"))
    full = ranks.join(cells, ranks["idx"] == cells["i"], "left")
    numbers = F.transform(F.sequence(F.lit(1), F.lit(max(len(names), 1))), lambda j: F.coalesce(F.try_element_at("row", j), F.lit(0)).cast("string"))
    rows = full.orderBy("idx").select(F.concat_ws(" ", "name", F.array_join(numbers, " "))).collect()
    return "\n".join([" ".join(["", *names]), *(r[0] for r in rows)])


def write_results(analysis: Analysis, options: Options, draw: bool = True, page: bool = True) -> dict[str, str]:
    """Writes all results that the options ask for and gives their paths by suffix."""
    spark = analysis.frames.sparkSession
    done: dict[str, str] = {}

    def path(suffix: str, part: int | None = None) -> str:
        done[suffix if part is None else f"{suffix}.{part}"] = out = f"{options.output}.{suffix}" + (f".{part}" if part is not None else "")
        return out

    a = analysis
    write_lines(a.name_lines(), path("moname"), "mol_id")
    write_lines(a.route_lines(), path("route"), "atom_id")
    orders = []
    for i, ordered in enumerate(a.orders):
        if options.speciescenter:
            ordered = matrix.centred(ordered, options.speciescenter, options.n_searchspecies, options.matrix_size)
        ordered = a._once(f"ordered-{i}", ordered)
        orders.append(ordered)
        part = i - 1 if i else None
        write_lines(ordered.select("ord", text.reaction_line(F.col("n"), F.col("left_name"), F.col("right_name")).alias("line")), path("reaction", part), "ord")
        write_text(spark, matrix_text(ordered, options.matrix_size), path("table", part))
        if part is not None:
            write_lines(a.route_lines(part), path("route", part), "atom_id")
    if options.needprintspecies:
        write_lines(a.species_lines(), path("species"), "frame")
    if options.printmoleculetime:
        rows = a.timeline(options.moleculeframes, options.moleculetimesteps)
        write_lines(rows.select("*", quoted(*(F.col(c) for c in rows.columns)).alias("line")), path("molecules.csv"), "timestep", "species", "atom_ids", header="Timestep,Species,AtomIDs,BondIDs")
    happened = a._once("events", a.events)
    if options.printreactionevent:
        write_lines(happened.select("*", quoted(F.col("frame"), F.col("reactant"), F.col("product")).alias("line")), path("reactionevent.csv"), "frame", "reactant", "product", header="Timestep_Index,Reactant,Product")
    counted = a._once("frequencies", events.frequencies(happened))
    write_lines(counted.select("*", F.concat_ws(" ", "n", "reaction").alias("line")), path("reactionabcd"), F.desc("n"), "reaction")
    style = {"chosen": options.species, "without": options.speciesfilter}
    if draw:
        for i, ordered in enumerate(orders):
            write_text(spark, report.drawing(ordered, options.maxspecies, **style), path("svg", i - 1 if i else None))
    if page:
        whole = report.as_json(orders, counted, options.maxspecies, **style)
        write_text(spark, whole, path("json"))
        write_text(spark, report.as_html(whole), path("html"))
    return done


def run(spark: SparkSession, draw: bool = True, page: bool = True, **given) -> dict[str, str]:
    """Reads, analyses and writes; gives the results' paths by suffix. Tables shared by several results stay in `<output>.work` until the end."""
    options = Options.of(**given)
    folder = f"{options.output}.work"
    try:
        return write_results(analyse(spark, options, folder), options, draw, page)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
