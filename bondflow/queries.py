"""The reference operators' queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondflow.functions import names as fn
from bondflow.operators import events, graph, matrix, naming, network, occupancy, rates, report, signals
from bondflow.oracles import CELL, LIMIT, SELECTION, SPLIT, chain
from bondflow.plans.testdata import ELEMENTS, analysis, frame_file, positions, shared_folder, written
from bondflow.sources import text, trajectory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, what: str) -> str:
    """A new one in the session's shared folder, for tables that a query reads several times."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def ints(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


# sources, through text made of table columns


@query("SELECT DISTINCT CAST(greatest(1, round_even(l_discount * 30, 0)) AS INTEGER) AS level, l_discount AS bond_order FROM lineitem")
def scan_bond_rounding(spark, sf_dir):
    """Each distinct order as the bond of a pair of atoms in a connection table, read back."""
    orders = [r[0] for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_discount").distinct().orderBy("l_discount").collect()]
    lines = [f"# Timestep 0\n# Number of particles {2 * len(orders)}"]
    for i, order in enumerate(orders):
        lines += [f"{own} 1 1 {other} 0 {float(order) * 30!r} 1.0 0 0" for own, other in ((2 * i + 1, 2 * i + 2), (2 * i + 2, 2 * i + 1))]
    path = written(spark.createDataFrame([(0, "\n".join(lines))], "i int, line string"), "i")
    pairs = spark.createDataFrame([(2 * i, o) for i, o in enumerate(orders)], "atom_id int, bond_order double")
    return trajectory.load(spark, "bond", [path], atomname=["C"]).join(pairs, "atom_id").select("level", "bond_order")


@query("""WITH p AS (SELECT p_partkey, p_size * 1.0 AS lo, p_size * 1.0 + p_retailprice AS hi, (p_size % 7 - 3) * 0.5 AS xy, (p_size % 5 - 2) * 0.25 AS xz, (p_size % 3 - 1) * 1.0 AS yz FROM part)
SELECT p_partkey, round((hi - greatest(0, xy, xz, xy + xz)) - (lo - least(0, xy, xz, xy + xz)), 6) AS lx, round((hi - greatest(0, yz)) - (lo - least(0, yz)), 6) AS ly, round(hi - lo, 6) AS lz FROM p""")
def scan_dump_cell(spark, sf_dir):
    """Each part's box as a frame of a dump, read back."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    lo = F.col("p_size") * 1.0
    hi = lo + F.col("p_retailprice")
    tilts = (F.col("p_size") % 7 - 3) * 0.5, (F.col("p_size") % 5 - 2) * 0.25, (F.col("p_size") % 3 - 1) * 1.0
    box = F.concat_ws("\n", *(F.concat_ws(" ", lo, hi, t) for t in tilts))
    line = F.concat(F.lit("ITEM: TIMESTEP\n"), F.col("p_partkey"), F.lit("\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n"), box, F.lit("\nITEM: ATOMS y x type id z\n0 0 1 1 0"))
    rows = trajectory.load(spark, "dump", [written(p.select("p_partkey", line.alias("line")), "p_partkey")], atomname=["C"])
    return rows.select(F.col("timestep").alias("p_partkey"), *(F.round(F.col("cell")[i][i], 6).alias(c) for i, c in enumerate(("lx", "ly", "lz"))))


@query(chain("SELECT CAST(p AS INTEGER) AS file_ord, CAST(row_number() OVER (ORDER BY p, frame) - 1 AS INTEGER) AS frame, timestep FROM (SELECT 0 AS p, * FROM frames UNION ALL SELECT 1, * FROM frames)"))
def scan_concat(spark, sf_dir):
    """The frames in a file that is read twice over."""
    a = analysis(spark, sf_dir)
    path = frame_file(a.frames)
    rows = trajectory.load(spark, "dump", [path, path], atomname=["C"])
    return rows.select(F.floor(F.col("frame") / a.steps).cast("int").alias("file_ord"), "frame", "timestep")


@query(chain("SELECT CAST(dense_rank() OVER (ORDER BY frame) - 1 AS INTEGER) AS frame, timestep FROM frames WHERE frame % 7 = 0"))
def frame_stride(spark, sf_dir):
    return trajectory.load(spark, "dump", [frame_file(analysis(spark, sf_dir).frames)], atomname=["C"], stepinterval=7).select("frame", "timestep")


def species_lines(a) -> DataFrame:
    line = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "n"))), " ")
    return a.species.groupBy("timestep").agg(line.alias("l")).select(F.concat(F.lit("Timestep "), F.col("timestep"), F.lit(": "), F.col("l")).alias("value"))


@query(chain("SELECT timestep, name, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM frames CROSS JOIN (SELECT DISTINCT name FROM species) LEFT JOIN (SELECT timestep, name, n FROM species) s USING (timestep, name)"))
def species_dense(spark, sf_dir):
    return text.dense(text.parse_species(species_lines(analysis(spark, sf_dir))))


@query(chain("""SELECT reaction, n, 'left' AS side, name, count(*) AS count FROM abcd, unnest(string_split(split_part(reaction, '->', 1), '+')) t(name) GROUP BY ALL
UNION ALL SELECT reaction, n, 'right', name, count(*) FROM abcd, unnest(string_split(split_part(reaction, '->', 2), '+')) t(name) GROUP BY ALL"""))
def reaction_parse(spark, sf_dir):
    found = events.frequencies(analysis(spark, sf_dir).events)
    return text.parse_reactions(found.select(F.concat_ws(" ", "n", "reaction").alias("value")))


# bonds and molecules


@query("SELECT p_partkey, CASE WHEN p_size % 8 = 5 THEN 12 ELSE p_size % 8 END AS level FROM part")
def bond_order_remap(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", graph.aromatic(F.col("p_size") % 8).alias("level"))


def _pair_sql(distance: str) -> str:
    limits = graph.cutoffs(ELEMENTS, 0.25, {("C", "O"): 0.5})
    case = " ".join(f"WHEN least(x.e, y.e) = '{a}' AND greatest(x.e, y.e) = '{b}' THEN {d!r}" for (a, b), d in limits.items())
    return f"""WITH p AS (SELECT label AS frame, CAST(vec_id AS INTEGER) AS i, CASE vec_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'H' ELSE 'O' END AS e,
  embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)
SELECT x.frame, x.i AS a, y.i AS b, 1 AS level FROM p x JOIN p y ON x.frame = y.frame AND x.i < y.i WHERE {distance} < power(CASE {case} END, 2)"""


@query(_pair_sql("power(x.x - y.x, 2) + power(x.y - y.y, 2) + power(x.z - y.z, 2)"))
def distance_bonds(spark, sf_dir):
    return graph.distance_bonds(positions(spark, sf_dir), graph.cutoffs(ELEMENTS, 0.25, {("C", "O"): 0.5}))


@query(_pair_sql(" + ".join(f"power(x.{c} - y.{c} - 4.0 * round((x.{c} - y.{c}) / 4.0), 2)" for c in "xyz")))
def distance_bonds_pbc(spark, sf_dir):
    cell = [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]
    return graph.distance_bonds(positions(spark, sf_dir), graph.cutoffs(ELEMENTS, 0.25, {("C", "O"): 0.5}), cell)


@query("""WITH t AS (SELECT least(substr(p_brand, -1), substr(p_type, 1, 1)) AS one, greatest(substr(p_brand, -1), substr(p_type, 1, 1)) AS two, p_partkey, p_size * 0.1 AS d FROM part)
SELECT one, two, round(CAST(arg_max(d, p_partkey) AS DOUBLE), 6) AS distance FROM t GROUP BY ALL""")
def parse_cutoffs(spark, sf_dir):
    """The text of an option, made of all parts: it is parsed on the driver, where options are."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat(F.substring("p_brand", -1, 1), F.lit("-"), F.substring("p_type", 1, 1), F.lit(":"), F.col("p_size") * 0.1)
    given = ", ".join(r[0] for r in part.orderBy("p_partkey").select(line).toLocalIterator())
    return spark.createDataFrame([(*pair, round(d, 6)) for pair, d in graph.parse_cutoffs(given).items()], "one string, two string, distance double")


@query(chain("SELECT frame, atoms, bonds FROM mf"))
def components(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.printed(a.molecule_frames, "frame", ints("atoms").alias("atoms"))


@query(chain("SELECT mol_id, atoms, bonds, frames FROM mol"))
def molecule_dict(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.printed(a.molecules, "mol_id", ints("atoms").alias("atoms"), ints("frames").alias("frames"))


@query(chain("SELECT (SELECT count(*) FROM atoms) AS atoms, (SELECT count(*) FROM frames) AS frames, (SELECT count(*) FROM mol) AS molecules"))
def trajectory_summary(spark, sf_dir):
    a = analysis(spark, sf_dir)
    tables = {"atoms": a.atoms, "frames": a.frames, "molecules": a.molecules}
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    return each[0].union(each[1]).union(each[2]).agg(*(F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in tables))


# signals


@query(chain("SELECT mol_id, string_agg(CAST(CAST(p.frame IS NOT NULL AS INTEGER) AS VARCHAR), '' ORDER BY f.frame) AS signal FROM mol CROSS JOIN frames f LEFT JOIN pres p USING (mol_id, frame) GROUP BY mol_id"))
def presence_signal(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.molecules.select("mol_id", F.array_join(signals.signal(F.col("frames"), a.steps).cast("array<string>"), "").alias("signal"))


@query(chain("SELECT mol_id, frames FROM (SELECT mol_id, coalesce(string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) FILTER (WHERE state = 1), '') AS frames FROM decoded GROUP BY mol_id)", hmm=True))
def hmm_viterbi(spark, sf_dir):
    return analysis(spark, sf_dir).decoded.select("mol_id", ints("frames").alias("frames"))


@query(chain("SELECT DISTINCT mol_id FROM decoded WHERE state = 1", hmm=True))
def hmm_survivors(spark, sf_dir):
    return signals.survivors(analysis(spark, sf_dir).decoded).select("mol_id")


# names


@query()
def species_name(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return naming.named(a.molecules, a.atoms, level=a.level)


#: Names written of a part's columns, with bare, bracketed and aromatic atoms
WRITTEN = """concat(elt(p_size % 4 + 1, 'C', '[CH3]', 'c1', '[HH]'), '(', elt(p_partkey % 5 + 1, 'O', 'Cl', '[13C]', 'N', '[O-]'), ')', elt(p_size % 3 + 1, '=C', 'n1', '[H]'), if(p_partkey % 11 = 0, '_unknownSMILES_1', ''))"""
WRITTEN_SQL = """concat(['C', '[CH3]', 'c1', '[HH]'][p_size % 4 + 1], '(', ['O', 'Cl', '[13C]', 'N', '[O-]'][p_partkey % 5 + 1], ')', ['=C', 'n1', '[H]'][p_size % 3 + 1], CASE WHEN p_partkey % 11 = 0 THEN '_unknownSMILES_1' ELSE '' END)"""


@query(rf"""WITH w AS (SELECT p_partkey, {WRITTEN_SQL} AS s FROM part)
SELECT p_partkey, CASE WHEN contains(s, '_unknownSMILES') THEN s ELSE array_to_string(list_transform(regexp_extract_all(s, '\[[^\]]*\]|Cl|[CONcon]|.'), lambda p: CASE WHEN regexp_full_match(p, 'Cl|[CONcon]') THEN '[' || p || ']' WHEN p = '[HH]' THEN '[H]' ELSE p END), '') END AS name FROM w""")
def smiles_bracket(spark, sf_dir):
    written = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(WRITTEN).alias("name"))
    return written.select("p_partkey", fn.bracket(F.col("name"), ["C", "H", "O", "N", "Cl"]).alias("name"))


def _isomers(spark, sf_dir, miso: int) -> DataFrame:
    """Groups with the name of the first molecule of each."""
    a = analysis(spark, sf_dir, folder=_folder(spark, "isomers"))
    wanted = {"label": True} if miso == 0 else {"label": False, "name": True}
    found = a._once("found", naming.several_named(a.molecules, a.atoms, wanted, a.level))
    groups = naming.groups(found.select("mol_id", "label"))
    if miso == 0:  # the label is the name
        return groups.withColumn("name", F.col("label"))
    names = found.select(F.col("mol_id").alias("representative"), "name")
    return groups.join(names, "representative").select("mol_id", "label", "representative", "members", "name")


@query()
def isomer_groups(spark, sf_dir):
    return _isomers(spark, sf_dir, 0)


@query()
def miso1_groups(spark, sf_dir):
    return _isomers(spark, sf_dir, 1)


@query(chain("SELECT mol_id, name AS label, min(mol_id) OVER (PARTITION BY name) AS representative, count(*) OVER (PARTITION BY name) AS members FROM named"))
def miso2_groups(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return naming.isomers(a.molecules, a.atoms, 2, ELEMENTS)


@query(chain("SELECT mol_id, name FROM named"))
def formula(spark, sf_dir):
    return analysis(spark, sf_dir).names


@query(chain("SELECT mol_id, " + " || ".join(f"CASE WHEN n{e} = 0 THEN '' WHEN n{e} = 1 THEN '{e}' ELSE '{e}' || n{e} END" for e in ELEMENTS) + " AS formula FROM counts"))
def display_formula(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return naming.bare(a.molecules, a.atoms, a.elements).select("mol_id", fn.display(F.col("name")).alias("formula"))


# occupancy, routes and A -> B


@query(chain("SELECT atom_id, frame, mol_id, conflict FROM occ"))
def occupancy_(spark, sf_dir):
    return analysis(spark, sf_dir).occupied


#: A model that fills gaps but keeps short molecules, so that some claim the same atom
MILD = {"a": ((0.6, 0.4), (0.1, 0.9)), "b": ((0.95, 0.05), (0.3, 0.7))}


@query(chain("SELECT atom_id, frame, mol_id, conflict FROM hocc", hmm=MILD))
def occupancy_conflict(spark, sf_dir):
    return analysis(spark, sf_dir, hmm=True, **MILD).occupied


@query(chain("SELECT atom_id, seq, time, frame, mol_id FROM route"))
def atom_route(spark, sf_dir):
    return analysis(spark, sf_dir).routes


@query(chain("SELECT atom_id, left_mol, right_mol FROM trans"))
def route_pairs(spark, sf_dir):
    return analysis(spark, sf_dir).steps_taken


@query(chain("SELECT atom_id, left_mol, right_mol FROM trans WHERE atom_id % 3 = 0"))
def route_pairs_select(spark, sf_dir):
    return analysis(spark, sf_dir, select=["C"]).steps_taken


@query(chain("SELECT left_mol, right_mol, cnt FROM pairs"))
def transition_counts_nohmm(spark, sf_dir):
    return analysis(spark, sf_dir).pairs


@query(chain("SELECT DISTINCT left_mol, right_mol, CAST(1 AS BIGINT) AS cnt FROM trans"))
def transition_counts_hmm(spark, sf_dir):
    return occupancy.distinct_pairs(analysis(spark, sf_dir).steps_taken)


@query(chain("""SELECT part, left_name, right_name, CAST(sum(cnt) AS BIGINT) AS n FROM (
  SELECT part, l.name AS left_name, r.name AS right_name, cnt FROM (
    SELECT part, left_mol, right_mol, arg_min(cnt, atom_id) AS cnt FROM (SELECT part, left_mol, right_mol, atom_id, count(*) AS cnt FROM strans GROUP BY ALL) GROUP BY ALL
  ) JOIN named l ON l.mol_id = left_mol JOIN named r ON r.mol_id = right_mol) WHERE left_name <> right_name GROUP BY ALL"""))
def split_reactions(spark, sf_dir):
    return analysis(spark, sf_dir, split=SPLIT).split_reactions


@query(chain("SELECT left_name, right_name, n FROM ab"))
def reactions_ab(spark, sf_dir):
    return analysis(spark, sf_dir).reactions


# A + B -> C + D


@query(chain("SELECT frame, atom_id, left_mol, right_mol FROM changed"))
def changed_atoms(spark, sf_dir):
    return analysis(spark, sf_dir).changes.select("frame", "atom_id", "left_mol", "right_mol")


@query(chain("SELECT frame, component, left_mols, right_mols FROM bip"))
def reaction_components(spark, sf_dir):
    return analysis(spark, sf_dir).matched.select("frame", "component", ints("left").alias("left_mols"), ints("right").alias("right_mols"))


@query(chain("SELECT frame, component, left_mols, right_mols FROM hbip WHERE NOT bad", hmm=MILD))
def reaction_components_clean(spark, sf_dir):
    return analysis(spark, sf_dir, hmm=True, **MILD).matched.where("clean").select("frame", "component", ints("left").alias("left_mols"), ints("right").alias("right_mols"))


@query(chain("SELECT frame, reactant, product FROM evs"))
def reaction_events(spark, sf_dir):
    return analysis(spark, sf_dir).events


@query(chain("SELECT reaction, n FROM abcd"))
def reactions_abcd(spark, sf_dir):
    return events.frequencies(analysis(spark, sf_dir).events)


# matrix and outputs


@query(chain("SELECT ord, left_name, right_name, n FROM ordered"))
def reactions_sorted(spark, sf_dir):
    return analysis(spark, sf_dir).ordered.select("ord", "left_name", "right_name", "n")


@query()
def species_bfs(spark, sf_dir):
    return matrix.centred(analysis(spark, sf_dir).reactions, "C1H0O0", 2, 100)


@query(chain("SELECT name, idx FROM ranked"))
def species_rank(spark, sf_dir):
    return matrix.ranked(analysis(spark, sf_dir).ordered, 100)


@query(chain("SELECT l.idx AS i, r.idx AS j, n FROM ordered JOIN ranked l ON l.name = left_name JOIN ranked r ON r.name = right_name"))
def reaction_matrix(spark, sf_dir):
    o = analysis(spark, sf_dir).ordered
    return matrix.cells(o, matrix.ranked(o, 100))


@query(chain("SELECT l.name, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE r.idx = {k}), 0) AS BIGINT) AS s{k}" for k in range(1, 6)) + " FROM ranked l LEFT JOIN ordered ON l.name = left_name LEFT JOIN ranked r ON r.name = right_name WHERE l.idx <= 5 GROUP BY l.name"))
def reaction_pivot(spark, sf_dir):
    o = analysis(spark, sf_dir).ordered
    return matrix.pivoted(o, matrix.ranked(o, 100), 5)


@query(chain("SELECT frame, timestep, name, n FROM species"))
def species_counts(spark, sf_dir):
    return analysis(spark, sf_dir).species


@query(chain("SELECT timestep, species, atom_ids, bond_ids FROM timeline"))
def molecule_timeline(spark, sf_dir):
    return analysis(spark, sf_dir).timeline()


@query(chain("SELECT timestep, species, atom_ids, bond_ids FROM timeline WHERE timestep IN (3000, 7000) AND frame IN (1, 3, 7, 9)"))
def molecule_timeline_filtered(spark, sf_dir):
    return analysis(spark, sf_dir).timeline(frames=[1, 3, 7, 9], timesteps=[3000, 7000])


@query(chain("SELECT mol_id, concat_ws(' ', name, replace(atoms, ',', ';'), replace(bonds, '-', ',')) AS line FROM mol JOIN named USING (mol_id)"))
def molecule_names(spark, sf_dir):
    return analysis(spark, sf_dir).name_lines()


@query(chain("SELECT atom_id, 'Atom ' || (atom_id + 1) || ' ' || element || ': ' || string_agg(time || ' ' || name, ' -> ' ORDER BY time) AS line FROM route JOIN named USING (mol_id) JOIN atoms USING (atom_id) GROUP BY atom_id, element"))
def atom_route_text(spark, sf_dir):
    return analysis(spark, sf_dir).route_lines()


# network, report and rates


@query(chain("SELECT name, idx AS node FROM ranked WHERE idx <= 20"))
def network_nodes(spark, sf_dir):
    return network.nodes(matrix.ranked(analysis(spark, sf_dir).ordered), 20)


@query(chain("SELECT name, CAST(row_number() OVER (ORDER BY idx) AS INTEGER) AS node FROM ranked WHERE idx <= 20 AND name NOT IN ('C1H0O0', 'C0H0O1')"))
def network_nodes_filtered(spark, sf_dir):
    return network.nodes(matrix.ranked(analysis(spark, sf_dir).ordered), 20, without=["C1H0O0", "C0H0O1"])


EDGES = "SELECT left_name, right_name, n FROM ordered WHERE left_name IN (SELECT name FROM ranked WHERE idx <= 20) AND right_name IN (SELECT name FROM ranked WHERE idx <= 20)"


@query(chain(EDGES))
def network_edges(spark, sf_dir):
    o = analysis(spark, sf_dir).ordered
    return network.edges(o, network.nodes(matrix.ranked(o), 20))


@query(chain(f"WITH e AS ({EDGES}), w AS (SELECT *, ln(n + 1) AS weight, ln(n + 1) / max(ln(n + 1)) OVER () AS share FROM e) SELECT left_name, right_name, n, round(weight, 6) AS weight, round(share * 3.0 * CASE WHEN share > 0.7 THEN 2 ELSE 0.5 END, 6) AS width, round(share, 6) AS red FROM w"))
def network_edge_style(spark, sf_dir):
    o = analysis(spark, sf_dir).ordered
    styled = network.styled(network.edges(o, network.nodes(matrix.ranked(o), 20)))
    return styled.select("left_name", "right_name", "n", *(F.round(c, 6).alias(c) for c in ("weight", "width", "red")))


@query(chain("""SELECT ord AS i, '["' || left_name || '"]' AS l, '["' || right_name || '"]' AS r, n FROM ordered"""))
def report_reactions(spark, sf_dir):
    return report.reactions(analysis(spark, sf_dir).ordered).select("i", F.to_json("l").alias("l"), F.to_json("r").alias("r"), "n")


@query(chain("SELECT idx AS i, name AS s FROM ranked_all"))
def report_species(spark, sf_dir):
    return report.species(analysis(spark, sf_dir).ordered)


@query(chain("""SELECT start, "end", pos FROM (SELECT start, "end", CAST(row_number() OVER (PARTITION BY start ORDER BY place) AS INTEGER) AS pos FROM (
  SELECT start, "end", min(place) AS place FROM (SELECT left_name AS start, right_name AS "end", ord * 2 AS place FROM ordered UNION ALL SELECT right_name, left_name, ord * 2 + 1 FROM ordered) GROUP BY ALL)) WHERE pos <= 6"""))
def link_top6(spark, sf_dir):
    return report.links(analysis(spark, sf_dir).ordered)


@query(chain(f"SELECT idx AS i, name AS s FROM ranked_all WHERE name IN {SELECTION!r}"))
def search_species(spark, sf_dir):
    return report.search_species(report.species(analysis(spark, sf_dir).ordered), list(SELECTION))


@query(chain(f"SELECT ord AS i, left_name AS l, right_name AS r, n FROM ordered WHERE left_name IN {SELECTION!r} OR right_name IN {SELECTION!r}"))
def search_reactions(spark, sf_dir):
    found = report.search_reactions(report.reactions(analysis(spark, sf_dir).ordered), list(SELECTION))
    return found.select("i", F.array_join("l", "+").alias("l"), F.array_join("r", "+").alias("r"), "n")


@query(chain(f"""WITH need AS (SELECT reaction, n, name, count(*) AS o FROM abcd, unnest(string_split(split_part(reaction, '->', 1), '+')) t(name) GROUP BY ALL),
kinds AS (SELECT reaction, count(*) AS kinds FROM need GROUP BY ALL),
terms AS (SELECT reaction, need.n, s.frame, sum(o * ln(s.n / {LIMIT})) AS c, count(*) AS have FROM need JOIN species s USING (name) GROUP BY ALL),
whole AS (SELECT reaction, n, c, max(c) OVER (PARTITION BY reaction) AS most FROM terms JOIN kinds USING (reaction) WHERE have = kinds) SELECT reaction, round((ln(n / ({LIMIT} * (1000 * 0.1 * 1e-15))) - most - ln(sum(exp(c - most)))) / ln(10), 6) AS log_k FROM whole GROUP BY reaction, n, most"""))
def rate_constants(spark, sf_dir):
    """Molecules, names, species and reactions are read several times: they are written once."""
    a = analysis(spark, sf_dir, folder=_folder(spark, "rates"))
    found = rates.rate_constants(a._once("species", a.species), a._once("frequencies", events.frequencies(a.events)), CELL, 0.1)
    return found.select("reaction", F.round("log10_k", 6).alias("log_k"))


QUERIES["occupancy"] = QUERIES.pop("occupancy_")
ORACLES["occupancy"] = ORACLES.pop("occupancy_")
