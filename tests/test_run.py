import glob
import hashlib
import json

import pytest

from bondflow import __main__ as cli
from bondflow.operators import graph, report
from bondflow.plans.run import Options, cell_rows, run
from bondflow.sources import download, text

#: frames of H2 + O -> H + OH -> H2 + O, and the orders of their bonds
FRAMES = [[(1, 2)], [(1, 2)], [(2, 3)], [(2, 3)], [(1, 2)], []]


def bond_file(path, frames):
    out = []
    for t, bonds in enumerate(frames):
        out.append(f"# Timestep {t * 10}\n#\n# Number of particles 3\n#\n")
        for i in (1, 2, 3):
            near = [b if a == i else a for a, b in bonds if i in (a, b)]
            out.append(f" {i} {2 if i == 3 else 1} {len(near)} {' '.join(map(str, near))} 0 {' '.join('1.0' for _ in near)} 1.0 0 0\n")
    path.write_text("".join(out))
    return str(path)


def lines(path):
    return [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f).read().splitlines()]


def test_a_run_over_bonds_writes_every_result(spark, tmp_path):
    at = bond_file(tmp_path / "a.bond", FRAMES)
    done = run(spark, inputfiletype="bond", inputfilename=at, atomname=["H", "O"], runHMM=False, split=2, printmoleculetime=True, moleculeframes=[0, 2], printreactionevent=True)
    h2, oh, h, o = "[H][H](1)", "[H][O](1)", "[H]", "[O]"
    assert lines(done["reactionevent.csv"]) == ["Timestep_Index,Reactant,Product", f"1,{h2}+{o},{h}+{oh}", f"3,{h}+{oh},{h2}+{o}", f"4,{h2},{h}+{h}"]
    assert lines(done["reactionabcd"]) == [f"1 {x}" for x in sorted((f"{h2}+{o}->{h}+{oh}", f"{h}+{oh}->{h2}+{o}", f"{h2}->{h}+{h}"))]
    assert lines(done["species"])[0] == f"Timestep 0: {h2} 1 {o} 1" and len(lines(done["species"])) == 6
    assert lines(done["moname"])[0].split()[1:] == ["0;1", "0,1,1"]
    assert lines(done["route"])[2] == f"Atom 3 O: 0 {o} -> 2 {oh} -> 4 {o}"
    assert lines(done["route.1"])[2] == f"Atom 3 O: 0 {oh} -> 1 {o}"
    expected = {(h2, h): 3, (h2, oh): 1, (h, h2): 1, (oh, h2): 1, (o, oh): 1, (oh, o): 1}
    found = [x.split(" ", 1) for x in lines(done["reaction"])]
    assert {tuple(r.split("->")): int(n) for n, r in found} == expected
    assert [n for n, _ in found] == sorted((n for n, _ in found), reverse=True)
    table = text.read_matrix(spark, done["table"])
    assert {(r["left_name"], r["right_name"]): r["n"] for r in table.collect()} == expected
    timeline = lines(done["molecules.csv"])
    assert timeline[0] == "Timestep,Species,AtomIDs,BondIDs" and [x.split(",")[0] for x in timeline[1:]] == ["0", "0", "20", "20"]
    data = json.loads("\n".join(lines(done["json"])))
    assert [len(data[k]) for k in ("network", "species", "reactions")] == [3, 3, 3]
    assert "<svg" in lines(done["svg"])[0] and "<svg" in lines(done["svg.0"])[0] and lines(done["html"])[0].startswith("<!DOCTYPE")
    assert not glob.glob(f"{at}.work")


def test_hmm_search_and_names_of_a_run(spark, tmp_path):
    at = bond_file(tmp_path / "b.bond", [FRAMES[0]] * 40 + [FRAMES[2]] * 2 + [FRAMES[0]] * 40)
    done = run(spark, draw=False, page=False, inputfiletype="bond", inputfilename=[at], atomname=["H", "O"], speciescenter="[O]", SMILES=False, needprintspecies=False)
    assert lines(done["reaction"]) == [] and "json" not in done and "species" not in done  # two frames are noise
    done = run(spark, draw=False, page=False, inputfiletype="bond", inputfilename=[at], atomname=["H", "O"], runHMM=False, speciescenter="[O]", output=str(tmp_path / "other"))
    assert lines(done["reaction"])[0].endswith(" [O]->[H][O](1)") and done["reaction"] == str(tmp_path / "other.reaction")


def test_a_run_over_positions(spark, tmp_path):
    frame = "3\nx\nH 0.757 0.586 {z}\nH -0.757 0.586 0\nO 0 0 0\n"
    (tmp_path / "a.xyz").write_text(frame.format(z=0) + frame.format(z=4.9) + frame.format(z=2.5))
    done = run(spark, inputfiletype="xyz", inputfilename=str(tmp_path / "a.xyz"), atomname=["H", "O"], cell=[5.0, 5.0, 5.0], runHMM=False, use_ase=True, page=False)
    assert [x.split(": ")[1].split()[1::2] for x in lines(done["species"])] == [["1"], ["1"], ["1", "1"]]  # the second is whole across the cell's edge
    assert sorted(lines(done["reactionabcd"])) == ["1 [H][H][O](2)(1)->[H]+[H][O](1)"]


def test_options():
    base = {"inputfiletype": "dump", "inputfilename": "a", "atomname": ["C"]}
    assert Options.of(**base, moleculeframes=0).printmoleculetime and Options.of(**base).output == "a"
    with pytest.warns(UserWarning, match="distance"):
        assert Options.of(**base, custom_cutoffs="C-C:1.5").custom_cutoffs == {("C", "C"): 1.5}
    with pytest.raises(TypeError, match="unknown"):
        Options.of(**base, other=1)
    assert cell_rows([1, 2, 3]) == cell_rows([[1, 0, 0], [0, 2, 0], [0, 0, 3]]) == cell_rows([1, 0, 0, 0, 2, 0, 0, 0, 3])
    with pytest.raises(ValueError, match="3 or 9"):
        cell_rows([1, 2])


def test_command_line():
    got = cli.options("-i a b -a C H --type dump --nohmm -c 1 2 3 --molecule-frame 0 2 --matrixa 0.9 0.1 0.1 0.9 --urls a http://x --split 2".split())
    assert got == {"inputfilename": ["a", "b"], "atomname": ["C", "H"], "inputfiletype": "dump", "runHMM": False, "cell": [1, 2, 3], "moleculeframes": [0, 2], "a": ((0.9, 0.1), (0.1, 0.9)), "urls": [{"fn": "a", "url": "http://x"}], "split": 2}
    Options.of(**{k: v for k, v in got.items() if k != "urls"})
    assert cli.options(["-i", "a", "-a", "C", "--dump"])["inputfiletype"] == "lammpsdumpfile"
    with pytest.raises(SystemExit):
        cli.options(["-i", "a"])


def test_files_are_fetched_once_and_checked(tmp_path):
    source = tmp_path / "source"
    source.write_text("abc")
    right = hashlib.sha256(b"abc").hexdigest()
    to, url = str(tmp_path / "to"), source.as_uri()
    assert download.fetch(to, [(tmp_path / "missing").as_uri(), url], right) == to and open(to).read() == "abc"
    source.write_text("changed")
    assert download.fetch_all([{"fn": to, "url": "file:///nowhere", "sha256": right}]) == [to]
    with pytest.raises(RuntimeError, match="wrong checksum"):
        download.fetch(str(tmp_path / "no"), [url], right)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["source", "to"]


def test_expanding_a_species(spark):
    linked = spark.createDataFrame([("A", "B", 1), ("A", "C", 2), ("B", "A", 1)], "start string, end string, pos int")
    assert report.neighbourhood(linked, ["X", "C"], "A") == ["X", "C", "A", "B"]
    assert report.choices(spark.createDataFrame([(1, "A"), (2, "B")], "i int, s string"), 1).count() == 1


def test_perceived_bonds_need_the_tool(spark):
    pytest.importorskip("openbabel")
    rows = spark.createDataFrame([(0, 0, "C", 0.0, 0.0, 0.0), (0, 1, "O", 1.2, 0.0, 0.0)], "frame int, atom_id int, element string, x double, y double, z double")
    assert graph.perceived_bonds(rows, periodic=False).count() == 1
