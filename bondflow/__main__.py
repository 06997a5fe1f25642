"""Command line: python -m bondflow --type dump -i a.dump b.dump -a C H O"""

from __future__ import annotations

import argparse
import sys

from bondflow.sources.trajectory import ALIASES

FLAGS = {"pbc": "--nopbc", "runHMM": "--nohmm", "printmoleculetime": "--show-molecule-time", "printreactionevent": "--reaction-event", "use_ase": "--use-ase"}
VALUES = {
    "miso": (int, None, "--miso"), "cell": (float, "+", "--cell", "-c"), "selectatoms": (str, "*", "--selectatoms", "-s"), "stepinterval": (int, None, "--stepinterval"), "split": (int, None, "--split"),
    "moleculeframes": (int, "+", "--molecule-frame"), "moleculetimesteps": (int, "+", "--molecule-timestep"), "maxspecies": (int, None, "--maxspecies"), "ase_cutoff_mult": (float, None, "--ase-cutoff-mult"), "custom_cutoffs": (str, None, "--ase-pair-cutoffs"),
    "a": (float, 4, "--matrixa"), "b": (float, 4, "--matrixb"), "output": (str, None, "--output", "-o"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="bondflow", description="Reaction networks from trajectories.")
    out.add_argument("-i", "--inputfilename", nargs="*", required=True, help="trajectory files, read one after another")
    out.add_argument("-a", "--atomname", nargs="*", required=True, help="elements by type number")
    kind = out.add_mutually_exclusive_group()
    kind.add_argument("--type", "-t", dest="inputfiletype", choices=sorted(ALIASES), default="lammpsbondfile")
    kind.add_argument("--dump", dest="inputfiletype", action="store_const", const="lammpsdumpfile", help="the same as --type dump")
    for name, flag in FLAGS.items():
        out.add_argument(flag, dest=name, action="store_false" if flag.startswith("--no") else "store_true", default=argparse.SUPPRESS)
    for name, (kind_, n, *flags) in VALUES.items():
        out.add_argument(*flags, dest=name, type=kind_, nargs=n, default=argparse.SUPPRESS)
    out.add_argument("-n", "-np", "--nproc", type=int, help="cores of a local session")
    out.add_argument("--urls", action="append", nargs=2, metavar=("FILE", "URL"), default=argparse.SUPPRESS, help="files to fetch first")
    return out


def options(argv: list[str]) -> dict:
    """The options of a run, as run() takes them."""
    given = vars(parser().parse_args(argv))
    given.pop("nproc")
    for c in "ab":
        if c in given:
            given[c] = (tuple(given[c][:2]), tuple(given[c][2:]))
    if "urls" in given:
        given["urls"] = [{"fn": fn, "url": url} for fn, url in given["urls"]]
    return given


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    given, cores = options(argv), parser().parse_args(argv).nproc
    from pyspark.sql import SparkSession

    from bondflow.plans.run import run

    builder = SparkSession.builder.appName("bondflow")
    if cores:
        builder = builder.master(f"local[{cores}]")
    for suffix, path in run(builder.getOrCreate(), **given).items():
        print(f"{suffix}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
