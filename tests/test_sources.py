import pytest

from bondflow.sources import text, trajectory

BOND = """# Timestep {t}
#
# Number of particles 3
#
# id type nb id_1...id_nb mol bo_1...bo_nb abo nlp q
 1 1 1 3 0 0.95 0.95 2.0 -0.04
 2 1 1 3 0 0.40 0.95 2.0 -0.04
 3 2 2 1 2 0 1.5 2.5 0.9 0.0 0.07
#
"""
DUMP = """ITEM: TIMESTEP
{t}
ITEM: NUMBER OF ATOMS
3
ITEM: BOX BOUNDS xy xz yz pp pp pp
0 11 1
0 10 0
0 10 0.5
ITEM: ATOMS x y z type q id
0 0 0 2 0.1 3
1 0.5 0 1 0.1 1
-1 0.5 0 1 0.1 2
"""


def write(path, *texts):
    path.write_text("".join(texts))
    return str(path)


def test_bond_files_stride_and_concatenation(spark, tmp_path):
    one = write(tmp_path / "a.bond", *(BOND.format(t=t) for t in range(0, 50, 10)))
    two = write(tmp_path / "b.bond", *(BOND.format(t=t) for t in (100, 110)), "# Timestep 120\n# Number of particles 3\n 1 1 0")
    rows = trajectory.load(spark, "bond", [one, two], atomname=["H", "O"], stepinterval=3, rangebytes=150).collect()
    assert sorted({(r["frame"], r["timestep"]) for r in rows}) == [(0, 0), (1, 30), (2, 110)]
    first = sorted((r["atom_id"], r["element"], r["b"], r["level"]) for r in rows if r["frame"] == 0)
    assert first == [(0, "H", 2, 1), (1, "H", 2, 1), (2, "O", 0, 2), (2, "O", 1, 2)]


def test_dump_columns_tilt_and_ids(spark, tmp_path):
    path = write(tmp_path / "a.dump", DUMP.format(t=5), DUMP.format(t=6), DUMP[:60])
    rows = trajectory.load(spark, "lammpsdumpfile", [path], atomname=["H", "O"]).collect()
    assert len(rows) == 6
    r = next(r for r in rows if r["frame"] == 1 and r["atom_id"] == 2)
    assert (r["timestep"], r["element"], r["x"], r["y"]) == (6, "O", 0.0, 0.0)
    assert r["cell"] == [[10.0, 0.0, 0.0], [1.0, 9.5, 0.0], [0.0, 0.5, 10.0]]
    bad = write(tmp_path / "b.dump", DUMP.format(t=5).replace(" 3\n1", " 7\n1"))
    with pytest.raises(Exception, match="ids must run"):
        trajectory.load(spark, "dump", [bad]).collect()


def test_xyz_and_extxyz(spark, tmp_path):
    body = "3\n{c}\nH 0.757 0.586 0\nH -0.757 0.586 0\nO 0 0 0\n"
    path = write(tmp_path / "a.xyz", body.format(c="x"), body.format(c=""), "3\nx\nH 0 0 0\n")
    rows = trajectory.load(spark, "xyz", [path], pbc="false").collect()
    assert sorted({(r["frame"], r["timestep"]) for r in rows}) == [(0, 0), (1, 1)] and len(rows) == 6
    with pytest.raises(Exception, match="cell is needed"):
        trajectory.load(spark, "xyz", [path]).collect()
    ext = write(tmp_path / "a.extxyz", body.format(c='Lattice="10 0 0 0 10 0 0 0 10"'), body.format(c='Lattice="9 0 0 0 9 0 0 0 9"'))
    rows = trajectory.load(spark, "extxyz", [ext]).collect()
    assert all(r["cell"] == [[10.0, 0, 0], [0, 10.0, 0], [0, 0, 10.0]] for r in rows)
    with pytest.raises(Exception, match="Lattice"):
        trajectory.load(spark, "extxyz", [path]).collect()
    with pytest.raises(ValueError, match="unknown type"):
        trajectory.load(spark, "nonsense", [path])


def test_text_tables(spark, tmp_path):
    species = write(tmp_path / "s", "Timestep 0: A 2 B 1\nTimestep 10: A 3\nTimestep 20: [H]OO 1\n")
    got = sorted((r["name"], r["timestep"], r["n"]) for r in text.read_species(spark, species).collect())
    assert got == [("A", 0, 2), ("A", 10, 3), ("A", 20, 0), ("B", 0, 1), ("B", 10, 0), ("B", 20, 0), ("[H]OO", 0, 0), ("[H]OO", 10, 0), ("[H]OO", 20, 1)]
    reactions = write(tmp_path / "r", "5 A+A+B->C\n2 C->A+B\n")
    got = {(r["reaction"], r["n"], r["side"], r["name"], r["count"]) for r in text.read_reactions(spark, reactions).collect()}
    assert got == {("A+A+B->C", 5, "left", "A", 2), ("A+A+B->C", 5, "left", "B", 1), ("A+A+B->C", 5, "right", "C", 1), ("C->A+B", 2, "left", "C", 1), ("C->A+B", 2, "right", "A", 1), ("C->A+B", 2, "right", "B", 1)}
    matrix = write(tmp_path / "m", ' A B\nA 0 3\nB 1 0\n')
    assert sorted(map(tuple, text.read_matrix(spark, matrix).collect())) == [("A", "B", 3), ("B", "A", 1)]


def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path):
    body = "2\n{c}\nH 0.7 {c} 0\nO 0 0 0\n"
    files = {
        "bond": [write(tmp_path / "a.bond", *(BOND.format(t=t) for t in range(7))), write(tmp_path / "b.bond", BOND.format(t=9))],
        "dump": [write(tmp_path / "a.dump", *(DUMP.format(t=t) for t in range(7))), write(tmp_path / "b.dump", DUMP.format(t=9), DUMP[:90])],
        "xyz": [write(tmp_path / "a.xyz", *(body.format(c=t) for t in range(7))), write(tmp_path / "b.xyz", body.format(c=9), "2\nx\nH 0 0 0\n")],
    }
    for kind, paths in files.items():
        for stride in (1, 3):
            read = lambda **o: sorted(map(str, trajectory.load(spark, kind, paths, pbc="false", stepinterval=stride, **o).collect()))  # noqa: E731, B023
            whole = read()
            assert len({x.split(",")[0] for x in whole}) == len(range(0, 8, stride))
            assert read(rangebytes=41) == read(rangebytes=97) == whole
    uri = "file://" + files["dump"][0]
    assert trajectory.load(spark, "dump", [uri]).count() == 21
