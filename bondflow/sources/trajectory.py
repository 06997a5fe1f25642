"""Trajectory files as Spark data sources.

`register(spark)` makes them known as `trajectory_bond`, `trajectory_dump`, `trajectory_xyz`
and `trajectory_extxyz`. Files are read in the order given. `load` cuts them into ranges of
bytes; a first pass of tasks counts what begins in each range (frame headers, or lines where
frames have no mark), so only a number a range reaches the driver and each range knows the
number of its first frame. A reading task takes the frames that begin in its range, to their
end, and skips those the stride leaves out. A frame that ends before its last line is dropped.
Read without `load`, a source counts by itself, on the driver.

Paths are local ones that all machines see, or URIs of a file system that pyarrow knows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELL = "cell array<array<double>>"
POSITIONS = f"frame int, timestep bigint, {CELL}, atom_id int, element string, x double, y double, z double"
BONDS = "frame int, timestep bigint, atom_id int, element string, b int, level int"
ALIASES = {"bond": "trajectory_bond", "lammpsbondfile": "trajectory_bond", "dump": "trajectory_dump", "lammpsdumpfile": "trajectory_dump", "xyz": "trajectory_xyz", "extxyz": "trajectory_extxyz"}
RANGE_BYTES = 64 << 20


@dataclass
class Run(InputPartition):
    path: str
    start: int
    end: int
    first: int  # how many headers, or lines, begin before start in all files (headers) or in this one (lines)
    base: int = 0  # frames in the files before this one
    settled: dict | None = None


def opened(path: str):
    """A file opened for bytes, to be sought in."""
    path = re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" not in path:
        return open(path, "rb")
    from io import BufferedReader

    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path)
    return BufferedReader(pa.PythonFile(system.open_input_file(own), "r"))  # for readline


def size_of(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, os.SEEK_END)


def lines_from(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin at `start` or later."""
    f.seek(max(start - 1, 0))
    at = start if not start else start - 1 + len(f.readline())
    while line := f.readline():
        yield at, line
        at += len(line)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        self.stride = int(options.get("stepinterval", 1))
        self.names = json.loads(options.get("atomname", "[]"))
        self.pbc = options.get("pbc", "true").lower() == "true"
        self.cell = json.loads(options["cell"]) if "cell" in options else None
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def counts(self, line: bytes) -> bool:
        """Whether a line counts for the numbering of frames."""
        raise NotImplementedError

    def numbered(self, ranges: list[tuple[str, int, int, int]]) -> list[Run]:
        """Runs of ranges (path, start, end, count), in order."""
        raise NotImplementedError

    def frames(self, f, run: Run) -> Iterator[tuple[int, list[bytes]]]:
        """(number, lines) of each whole frame that begins in a run; lines may be empty where the stride skips the frame."""
        raise NotImplementedError

    def rows(self, frame: int, lines: list[str], first: dict) -> Iterator[tuple]:
        raise NotImplementedError

    def first(self) -> dict:
        """What the first frame of the first file settles for all."""
        return {}

    def cut(self) -> list[tuple[str, int, int]]:
        return [(p, a, min(a + self.range_bytes, n)) for p in self.paths for n in (size_of(p),) for a in range(0, n, self.range_bytes)]

    def count(self, path: str, start: int, end: int) -> int:
        with opened(path) as f:
            n = 0
            for at, line in lines_from(f, start):
                if at >= end:
                    break
                n += self.counts(line)
            return n

    def partitions(self) -> list[Run]:
        settled = self.first()
        runs = self.numbered([tuple(r) for r in self.ranges] if self.ranges is not None else [(*r, self.count(*r)) for r in self.cut()])
        for run in runs:
            run.settled = settled
        return runs

    def read(self, partition: Run) -> Iterator[tuple]:
        with opened(partition.path) as f:
            for number, lines in self.frames(f, partition):
                if number % self.stride == 0:
                    yield from self.rows(number // self.stride, [x.decode() for x in lines], partition.settled)


class _Marked(_Reader):
    """Frames begin at lines with a mark."""

    mark = b""

    def counts(self, line):
        return line.startswith(self.mark)

    def numbered(self, ranges):
        out, before = [], 0
        for path, start, end, n in ranges:
            if n:
                out.append(Run(path, start, end, before))
            before += n
        return out

    def whole(self, lines: list[bytes]) -> list[bytes] | None:
        """The frame's lines without what follows them; None if some are missing."""
        raise NotImplementedError

    def frames(self, f, run):
        number, lines = run.first - 1, None
        for at, line in lines_from(f, run.start):
            if self.counts(line):
                if lines is not None and (own := self.whole(lines)) is not None:
                    yield number, own
                lines = None
                if at >= run.end:
                    return
                number, lines = number + 1, []
            if lines is not None and (number % self.stride == 0):
                lines.append(line)
        if lines is not None and (own := self.whole(lines)) is not None:
            yield number, own


class BondReader(_Marked):
    """Rows of a connection table with bond orders; a row for each end of a bond, and one without b for an atom without bonds."""

    mark = b"# Timestep"

    def whole(self, lines):
        atoms = next((int(x.split()[-1]) for x in lines if x.startswith(b"# Number of particles")), None)
        return lines if atoms is not None and sum(not x.startswith(b"#") and bool(x.strip()) for x in lines) >= atoms else None

    def rows(self, frame, lines, first):
        timestep = next(int(x.split()[-1]) for x in lines if x.startswith("# Timestep"))
        for line in lines:
            s = line.split()
            if not s or s[0].startswith("#"):
                continue
            atom, kind, n = int(s[0]) - 1, int(s[1]), int(s[2])
            element = self.names[kind - 1] if self.names else str(kind)
            for b, order in zip(s[3 : 3 + n], s[4 + n : 4 + 2 * n], strict=True):
                yield frame, timestep, atom, element, int(b) - 1, max(1, round(float(order)))
            if not n:
                yield frame, timestep, atom, element, None, None


def tilted(bounds: list[list[float]]) -> list[list[float]]:
    """Cell rows of a box given by its bounds (low, high, and tilt for triclinic boxes)."""
    (x0, x1, *xy), (y0, y1, *xz), (z0, z1, *yz) = bounds
    xy, xz, yz = (v[0] if v else 0.0 for v in (xy, xz, yz))
    corners = (0.0, xy, xz, xy + xz)
    lx = x1 - max(corners) - (x0 - min(corners))
    ly = y1 - max(0.0, yz) - (y0 - min(0.0, yz))
    return [[lx, 0.0, 0.0], [xy, ly, 0.0], [xz, yz, z1 - z0]]


class DumpReader(_Marked):
    """Positions with columns in the order that a frame's header names; ids run from 1 to N."""

    mark = b"ITEM: TIMESTEP"

    def whole(self, lines):
        atoms = next((int(lines[i + 1]) for i, x in enumerate(lines[:-1]) if x.startswith(b"ITEM: NUMBER OF ATOMS")), None)
        return lines[: atoms + 9] if atoms is not None and len(lines) >= atoms + 9 else None

    def rows(self, frame, lines, first):
        at = {line.split(":")[1].split()[0]: i for i, line in enumerate(lines) if line.startswith("ITEM:")}
        timestep = int(lines[at["TIMESTEP"] + 1])
        cell = tilted([[float(v) for v in lines[at["BOX"] + k].split()] for k in (1, 2, 3)])
        names = lines[at["ATOMS"]].split()[2:]
        place = [names.index(c) for c in ("id", "type", "x", "y", "z")]
        rows = sorted((int(s[place[0]]), int(s[place[1]]), *(float(s[p]) for p in place[2:])) for s in (x.split() for x in lines[at["ATOMS"] + 1 :]))
        if [r[0] for r in rows] != list(range(1, len(rows) + 1)):
            raise ValueError("atom ids must run from 1 to the number of atoms")
        for i, kind, x, y, z in rows:
            yield frame, timestep, cell, i - 1, self.names[kind - 1] if self.names else str(kind), x, y, z


class XyzReader(_Reader):
    """A count, a comment, and rows of symbol and position; the timestep is the frame. All frames have as many atoms as the first of all."""

    def first(self) -> dict:
        if self.pbc and self.cell is None:
            raise RuntimeError("a cell is needed with periodic boundaries")
        return {"cell": self.cell}

    def counts(self, line):
        return True

    def numbered(self, ranges):
        if not ranges:
            return []
        with opened(self.paths[0]) as f:
            self.lines = int(f.readline()) + 2
        out, path, before, base = [], None, 0, 0
        for own, start, end, n in ranges:
            if own != path:
                path, base, before = own, base + before // self.lines, 0
            out.append(Run(own, start, end, before, base))
            before += n
        return out

    def frames(self, f, run):
        with opened(self.paths[0]) as one:
            size = int(one.readline()) + 2
        line_number, lines, number = run.first, [], None
        for at, line in lines_from(f, run.start):
            if line_number % size == 0:
                if number is not None:
                    yield number, lines
                if at >= run.end or not line.strip():
                    return
                if int(line) + 2 != size:
                    raise ValueError("all frames must have as many atoms as the first")
                number, lines = run.base + line_number // size, []
            if number is not None:
                lines.append(line)
            line_number += 1
        if number is not None and len(lines) == size:
            yield number, lines

    def rows(self, frame, lines, first):
        for i, line in enumerate(lines[2:]):
            s = line.split()
            yield frame, frame, first["cell"], i, s[0], float(s[1]), float(s[2]), float(s[3])


class ExtxyzReader(XyzReader):
    """As xyz, with the first frame's Lattice for all frames."""

    def first(self) -> dict:
        with opened(self.paths[0]) as f:
            f.readline()
            found = re.search(r'Lattice="([^"]*)"', f.readline().decode())
        if not found or len(found[1].split()) != 9:
            raise RuntimeError("the first frame names no Lattice of 9 numbers")
        v = [float(x) for x in found[1].split()]
        return {"cell": [v[0:3], v[3:6], v[6:9]]}


def _source(label: str, reader_: type[_Reader], columns: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> _Reader:
            return reader_(dict(self.options))

    return Source


SOURCES = [_source("trajectory_bond", BondReader, BONDS), _source("trajectory_dump", DumpReader, POSITIONS), _source("trajectory_xyz", XyzReader, POSITIONS), _source("trajectory_extxyz", ExtxyzReader, POSITIONS)]


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)


READERS = {"trajectory_bond": BondReader, "trajectory_dump": DumpReader, "trajectory_xyz": XyzReader, "trajectory_extxyz": ExtxyzReader}


def load(spark: SparkSession, kind: str, paths: list[str], **options):
    """Rows of trajectory files of a kind or one of its aliases."""
    name = ALIASES.get(kind, kind)
    if name not in READERS:
        raise ValueError(f"unknown type {kind!r}")
    register(spark)
    text = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items() if v is not None} | {"paths": json.dumps(paths)}
    own = READERS[name]({k.lower(): v for k, v in text.items()})
    ranges = own.cut()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [own.count(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["i", "n"])

    if len(ranges) > 1:
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, path string, start bigint, end bigint")
        found = {r["i"]: r["n"] for r in table.repartition(len(ranges)).mapInArrow(count, "i int, n bigint").collect()}
        text["ranges"] = json.dumps([(*r, found[i]) for i, r in enumerate(ranges)])
    return spark.read.format(name).options(**text).load()
