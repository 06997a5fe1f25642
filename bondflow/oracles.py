"""SQL for DuckDB: the analysis of the events adapter as one chain of common table expressions."""

from __future__ import annotations

from bondflow.operators import rates, signals

SPLIT = 10
CELL = [37.601, 37.601, 37.601]
LIMIT = repr(rates.volume(CELL) * 1e-24 * rates.AVOGADRO)
SELECTION = ("C1H0O0", "C0H1O1", "C1H1O0")


def _bipartite(name: str, changed: str) -> str:
    return f"""
{name}e AS (SELECT DISTINCT frame, left_mol AS l, right_mol AS r FROM {changed} WHERE left_mol <> 0 AND right_mol <> 0),
{name}s AS (SELECT frame, 'L' || l AS a, 'R' || r AS b FROM {name}e UNION ALL SELECT frame, 'R' || r, 'L' || l FROM {name}e),
{name}n AS (SELECT DISTINCT frame, 'L' || left_mol AS node, left_mol AS mol FROM {changed} WHERE left_mol <> 0 UNION SELECT DISTINCT frame, 'R' || right_mol, right_mol FROM {changed} WHERE right_mol <> 0),
{name}r(frame, node, r) AS (SELECT frame, node, node FROM {name}n UNION SELECT x.frame, x.node, s.b FROM {name}r x JOIN {name}s s ON s.frame = x.frame AND s.a = x.r),
{name}c AS (SELECT x.frame, x.node, min(n.mol) AS component, min(x.r) AS root FROM {name}r x JOIN {name}n n ON n.frame = x.frame AND n.node = x.r GROUP BY ALL),
{name}b AS (SELECT frame, 'L' || left_mol AS node FROM {changed} WHERE bad UNION SELECT frame, 'R' || right_mol FROM {changed} WHERE bad),
{name} AS (SELECT c.frame, c.component, c.root,
  coalesce(string_agg(substr(c.node, 2), ',' ORDER BY CAST(substr(c.node, 2) AS BIGINT)) FILTER (WHERE c.node LIKE 'L%'), '') AS left_mols,
  coalesce(string_agg(substr(c.node, 2), ',' ORDER BY CAST(substr(c.node, 2) AS BIGINT)) FILTER (WHERE c.node LIKE 'R%'), '') AS right_mols,
  bool_or(b.node IS NOT NULL) AS bad FROM {name}c c LEFT JOIN {name}b b ON b.frame = c.frame AND b.node = c.node GROUP BY c.frame, c.component, c.root)"""


def _routes(name: str, rows: str, by: str = "") -> str:
    return f"""
{name}0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by}atom_id ORDER BY frame) - 1 AS INTEGER) AS time, lag(mol_id) OVER (PARTITION BY {by}atom_id ORDER BY frame) AS before FROM {rows}),
{name} AS (SELECT {by}atom_id, CAST(row_number() OVER (PARTITION BY {by}atom_id ORDER BY frame) - 1 AS INTEGER) AS seq, time, frame, mol_id FROM {name}0 WHERE before IS NULL OR before <> mol_id),
{name}p AS (SELECT {by}atom_id, mol_id AS left_mol, lead(mol_id) OVER (PARTITION BY {by}atom_id ORDER BY seq) AS right_mol FROM {name})"""


BASE = f"""WITH RECURSIVE
ev AS (SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 21600000000) AS INTEGER) AS frame, CAST(user_id AS INTEGER) AS atom_id, event_type || props AS k FROM events),
frames AS (SELECT DISTINCT frame, CAST(frame AS BIGINT) * 1000 AS timestep FROM ev),
atoms AS (SELECT DISTINCT atom_id, CASE atom_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'H' ELSE 'O' END AS element FROM ev),
keys AS (SELECT DISTINCT frame, atom_id, k FROM ev),
bonds AS (SELECT DISTINCT x.frame, x.atom_id AS a, y.atom_id AS b, 1 + (x.atom_id + y.atom_id) % 3 AS level FROM keys x JOIN keys y ON x.frame = y.frame AND x.k = y.k AND x.atom_id < y.atom_id),
sym AS (SELECT frame, a, b FROM bonds UNION ALL SELECT frame, b, a FROM bonds),
reach(frame, atom_id, r) AS (SELECT frame, atom_id, atom_id FROM frames CROSS JOIN atoms UNION SELECT x.frame, x.atom_id, s.b FROM reach x JOIN sym s ON s.frame = x.frame AND s.a = x.r),
comp AS (SELECT frame, atom_id, min(r) AS component FROM reach GROUP BY ALL),
catoms AS (SELECT frame, component, string_agg(CAST(atom_id AS VARCHAR), ',' ORDER BY atom_id) AS atoms FROM comp GROUP BY ALL),
cbonds AS (SELECT c.frame, component, string_agg(a || '-' || b || '-' || level, ';' ORDER BY a, b) AS bonds FROM bonds x JOIN comp c ON c.frame = x.frame AND c.atom_id = x.a GROUP BY ALL),
mf AS (SELECT frame, component, atoms, coalesce(bonds, '') AS bonds FROM catoms LEFT JOIN cbonds USING (frame, component)),
mol AS (SELECT CAST(min(frame) AS BIGINT) * 4294967296 + component + 1 AS mol_id, atoms, bonds, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS frames FROM mf GROUP BY component, atoms, bonds),
pres AS (SELECT mol_id, frame FROM mf JOIN mol USING (atoms, bonds)),
matom AS (SELECT mol_id, CAST(a AS INTEGER) AS atom_id FROM mol, unnest(string_split(atoms, ',')) t(a)),
counts AS (SELECT mol_id, count(*) FILTER (WHERE element = 'C') AS nC, count(*) FILTER (WHERE element = 'H') AS nH, count(*) FILTER (WHERE element = 'O') AS nO FROM matom JOIN atoms USING (atom_id) GROUP BY mol_id),
named AS (SELECT mol_id, 'C' || nC || 'H' || nH || 'O' || nO AS name FROM counts),
species AS (SELECT frame, timestep, name, count(*) AS n FROM pres JOIN named USING (mol_id) JOIN frames USING (frame) GROUP BY ALL),
occ AS (SELECT atom_id, frame, max(mol_id) AS mol_id, count(*) > 1 AS conflict FROM matom JOIN pres USING (mol_id) GROUP BY ALL),
{_routes("route", "occ")},
trans AS (SELECT * FROM routep WHERE right_mol IS NOT NULL),
parts AS (SELECT frame, CAST(ntile({SPLIT}) OVER (ORDER BY frame) - 1 AS INTEGER) AS part FROM frames),
socc AS (SELECT part, occ.* FROM occ JOIN parts USING (frame)),
{_routes("sroute", "socc", "part, ")},
strans AS (SELECT * FROM sroutep WHERE right_mol IS NOT NULL),
pairs AS (SELECT left_mol, right_mol, arg_min(cnt, atom_id) AS cnt FROM (SELECT left_mol, right_mol, atom_id, count(*) AS cnt FROM trans GROUP BY ALL) GROUP BY ALL),
ab AS (SELECT l.name AS left_name, r.name AS right_name, CAST(sum(cnt) AS BIGINT) AS n FROM pairs JOIN named l ON l.mol_id = left_mol JOIN named r ON r.mol_id = right_mol WHERE l.name <> r.name GROUP BY ALL),
ordered AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, left_name DESC, right_name DESC) AS INTEGER) AS ord, * FROM ab),
ranked_all AS (SELECT name, CAST(row_number() OVER (ORDER BY min(place)) AS INTEGER) AS idx FROM (SELECT left_name AS name, ord * 2 AS place FROM ordered UNION ALL SELECT right_name, ord * 2 + 1 FROM ordered) GROUP BY name),
ranked AS (SELECT * FROM ranked_all WHERE idx <= 100),
changed AS (SELECT frame, atom_id, left_mol, right_mol, false AS bad FROM (SELECT frame, atom_id, mol_id AS left_mol, lead(mol_id) OVER (PARTITION BY atom_id ORDER BY frame) AS right_mol FROM occ) WHERE right_mol IS NOT NULL AND left_mol <> right_mol),
{_bipartite("bip", "changed")},
net AS (SELECT frame, root, name, sum(s) AS s FROM (
  SELECT frame, root, CAST(m AS BIGINT) AS mol_id, 1 AS s FROM bip, unnest(string_split(left_mols, ',')) t(m) WHERE NOT bad
  UNION ALL SELECT frame, root, CAST(m AS BIGINT), -1 FROM bip, unnest(string_split(right_mols, ',')) t(m) WHERE NOT bad) JOIN named USING (mol_id) GROUP BY ALL),
evs AS (SELECT frame, reactant, product FROM (SELECT frame, root,
  string_agg(rtrim(repeat(name || '+', CAST(s AS INTEGER)), '+'), '+' ORDER BY name) FILTER (WHERE s > 0) AS reactant,
  string_agg(rtrim(repeat(name || '+', CAST(-s AS INTEGER)), '+'), '+' ORDER BY name) FILTER (WHERE s < 0) AS product FROM net GROUP BY ALL) WHERE reactant IS NOT NULL AND product IS NOT NULL),
abcd AS (SELECT reactant || '->' || product AS reaction, count(*) AS n FROM evs GROUP BY ALL),
timeline AS (SELECT frame, timestep, name AS species, replace(atoms, ',', ';') AS atom_ids, bonds AS bond_ids FROM pres JOIN mol USING (mol_id) JOIN named USING (mol_id) JOIN frames USING (frame))
"""


def viterbi_sql(a: tuple = signals.A, b: tuple = signals.B) -> str:
    """Forward scores of both states with the choice each made, then states from the last frame back."""
    w = signals.weight
    a = [[w(x) for x in r] for r in a]
    e = [f"CASE WHEN o = 1 THEN {w(r[1])} ELSE {w(r[0])} END" for r in b]
    p = [w(x) for x in signals.P]
    return f""",
steps AS (SELECT count(*) AS n FROM frames),
obs AS (SELECT mol.mol_id, f.frame AS t, CAST(p.frame IS NOT NULL AS INTEGER) AS o FROM mol CROSS JOIN frames f LEFT JOIN pres p ON p.mol_id = mol.mol_id AND p.frame = f.frame),
fw(mol_id, t, v0, v1, b0, b1) AS (
  SELECT mol_id, t, CAST({p[0]} + {e[0]} AS BIGINT), CAST({p[1]} + {e[1]} AS BIGINT), 0, 0 FROM obs WHERE t = 0
  UNION ALL SELECT obs.mol_id, obs.t, CAST(greatest(v0 + {a[0][0]}, v1 + {a[1][0]}) + {e[0]} AS BIGINT), CAST(greatest(v0 + {a[0][1]}, v1 + {a[1][1]}) + {e[1]} AS BIGINT),
    CAST(v1 + {a[1][0]} > v0 + {a[0][0]} AS INTEGER), CAST(v1 + {a[1][1]} > v0 + {a[0][1]} AS INTEGER)
  FROM fw JOIN obs ON obs.mol_id = fw.mol_id AND obs.t = fw.t + 1),
bw(mol_id, t, state) AS (
  SELECT mol_id, t, CAST(v1 > v0 AS INTEGER) FROM fw, steps WHERE t = n - 1
  UNION ALL SELECT bw.mol_id, bw.t - 1, CASE WHEN bw.state = 1 THEN b1 ELSE b0 END FROM bw JOIN fw ON fw.mol_id = bw.mol_id AND fw.t = bw.t),
decoded AS (SELECT mol_id, t AS frame, state FROM bw WHERE t >= 0),
hocc AS (SELECT atom_id, frame, max(mol_id) AS mol_id, count(*) > 1 AS conflict FROM matom JOIN decoded USING (mol_id) WHERE state = 1 GROUP BY ALL),
hfull AS (SELECT a.atom_id, f.frame, coalesce(mol_id, 0) AS m, coalesce(conflict, false) AS c FROM atoms a CROSS JOIN frames f LEFT JOIN hocc h ON h.atom_id = a.atom_id AND h.frame = f.frame),
hlead AS (SELECT atom_id, frame, m AS left_mol, c, lead(m) OVER w AS right_mol, lead(c) OVER w AS c2 FROM hfull WINDOW w AS (PARTITION BY atom_id ORDER BY frame)),
hchanged AS (SELECT frame, atom_id, left_mol, right_mol, c OR c2 OR left_mol = 0 OR right_mol = 0 AS bad FROM hlead WHERE right_mol IS NOT NULL AND left_mol <> right_mol),
{_bipartite("hbip", "hchanged")}
"""


def chain(final: str, hmm: bool | dict = False) -> str:
    """The chain, with the HMM's part if asked for (perhaps with its own a and b), and a last query over it."""
    if final.startswith("WITH "):
        first, final = final[5:].split(") SELECT ", 1)
        # its own expressions join the chain
        first, final = f",\n{first})", f"SELECT {final}"
    else:
        first = ""
    return BASE + (viterbi_sql(**({} if hmm is True else hmm)) if hmm else "") + first + "\n" + final
