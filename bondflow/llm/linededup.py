"""Line dedup over a corpus with two Bloom filters.

A text is split at \\n; a line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both
ends with A-Z lower-cased. Keys of at least `least_chars` code points found in at least
`least_docs` documents lose all their lines but those of the largest id holding them.

First every document emits a hash of each of its distinct keys. Tasks set the hashes in
a Bloom filter of keys seen once and, where that filter had them, in one of keys seen
twice; the filters are cut into slices, and tasks' slices are merged slice by slice (a bit
that two tasks' first filters share goes to the second). Only lines whose hash the second
filter has are shuffled: they are counted by full key, and the keeper is chosen. A filter
takes a bit for every `bytes_a_bit` of input, however large; a filter that is too full for
its input lets more lines through to the exact count and changes no result.

Filters of up to `most_bits` are sent to all tasks. Beyond that none is: hashes are dealt
by ranges of a mixed hash, each range with a pair of filters of `part_bits` that lives in one
task, and suspected hashes are written and joined with the lines. A task sends a hash once
however often it has it, so a hot line is a row a task; in the join Spark splits it.

Defined results: a null or empty text is one empty line. Every row counts as a document;
rows that repeat an id share its decisions, and a key whose documents all have null ids
keeps its lines, while a null id never keeps a line from a known one. Other columns pass
through `clean` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondflow.llm import shared, textops

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"
SLICES = 64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def keys(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """A row (id, line, h) for each distinct long key of each document."""
    lines = F.array_distinct(F.transform(F.split(text, "\n"), line_key))
    out = docs.select(F.col(key).alias("id"), F.explode(F.filter(lines, lambda x: F.length(x) >= least_chars)).alias("line"))
    return out.withColumn("h", F.xxhash64("line"))


def bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each hash: its slice, and two places in the slice's `size` bits."""
    h = hashes.view(np.uint64)
    return (h & np.uint64(SLICES - 1)).astype(np.int64), ((h >> np.uint64(6)) % np.uint64(size)).astype(np.int64), ((h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % size


def test(filters: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((filters[s, a >> 3] >> (a & 7)) & (filters[s, b >> 3] >> (b & 7)) & 1).astype(bool)


def put(filters: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    for place in (a, b):
        np.bitwise_or.at(filters, (s, place >> 3), (1 << (place & 7)).astype(np.uint8))


def add(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, size: int) -> None:
    """Sets hashes seen before in `twice`, the others in `once`."""
    distinct, n = np.unique(hashes, return_counts=True)
    s, a, b = bits(distinct, size)
    again = test(once, s, a, b) | (n > 1)
    put(twice, s[again], a[again], b[again])
    put(once, s, a, b)


def seen_twice(hashes: DataFrame, slice_bits: int) -> np.ndarray:
    """The filter of hashes seen at least twice: SLICES x slice_bits / 8 bytes."""

    @textops.lean
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((SLICES, slice_bits // 8), np.uint8) for _ in range(2))
        for batch in batches:
            add(once, twice, batch.column(0).to_numpy(), slice_bits)
        used = np.flatnonzero(once.any(axis=1))
        for s in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([once[s].tobytes()]), pa.array([twice[s].tobytes()])], names=["slice", "once", "twice"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(slice_bits // 8, np.uint8) for _ in range(2))
        for batch in batches:
            for o, t in zip(batch.column(1), batch.column(2), strict=True):
                other = np.frombuffer(o.as_py(), np.uint8)
                twice |= np.frombuffer(t.as_py(), np.uint8) | (once & other)
                once |= other
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([twice.tobytes()])], names=["slice", "twice"])

    parts = hashes.select("h").mapInArrow(fill, "slice int, once binary, twice binary")
    merged = parts.groupBy("slice").applyInArrow(merge, "slice int, twice binary")
    out = np.zeros((SLICES, slice_bits // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["twice"], np.uint8)
    return out


def seen_twice_apart(hashes: DataFrame, parts: int, part_bits: int) -> DataFrame:
    """(h): the hashes that a filter of hashes seen at least twice has, by `parts` pairs of filters of `part_bits`, none of which leaves its task."""
    slice_bits = max(8, part_bits // SLICES)

    @textops.lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in distinct(batch.column(0).to_numpy() for batch in batches):
            part = (textops.mix(h.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, n, part = h[order], n[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int64()), pa.array([h[a:b].tobytes()]), pa.array([(n[a:b] > 1).tobytes()])], names=["part", "h", "again"])

    def suspect(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((SLICES, slice_bits // 8), np.uint8) for _ in range(2))
        seen = []
        for batch in batches:
            for h, again in zip(batch.column(1), batch.column(2), strict=True):
                h, again = np.frombuffer(h.as_py(), np.int64), np.frombuffer(again.as_py(), bool)
                add(once, twice, np.concatenate([h, h[again]]), slice_bits)
                seen.append(h)
        h = np.unique(np.concatenate(seen))
        yield pa.RecordBatch.from_arrays([pa.array(h[test(twice, *bits(h, slice_bits))])], names=["h"])

    dealt = hashes.select("h").mapInArrow(deal, "part bigint, h binary, again binary")
    return dealt.groupBy("part").applyInArrow(suspect, "h bigint")


def distinct(blocks: Iterator[np.ndarray], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct hashes of blocks and how often they occur; again from the start whenever there are `most` of them."""
    h, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in blocks:
        h, back = np.unique(np.concatenate([h, block]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n, np.ones(len(block), np.int64)]), len(h)).astype(np.int64)
        if len(h) >= most:
            yield h, n
            h, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(h):
        yield h, n


def suspects_apart(found: DataFrame, wanted: int, part_bits: int) -> DataFrame:
    """The rows of found whose hash h a filter of `wanted` bits in all suspects."""
    twice, _ = shared.kept(seen_twice_apart(found, -(-wanted // part_bits), part_bits), "suspects")
    return found.join(twice, "h", "left_semi")


def repeated(docs: DataFrame, key: str, text: str, least_chars: int, least_docs: int, bytes_a_bit: float, most_bits: int, part_bits: int) -> DataFrame:
    """(id, line): the keys that each id loses."""
    wanted = max(1 << 20, int(shared.input_bytes(docs) / bytes_a_bit))
    found = keys(docs, key, text, least_chars)
    suspected = suspects_apart(found, wanted, part_bits).select("id", "line") if wanted > most_bits else suspects_sent(found, wanted)
    lines, _ = shared.kept(suspected, "lines")
    chosen = lines.groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where((F.col("n") >= least_docs) & F.col("keeper").isNotNull()).select("line", "keeper")
    chosen, _ = shared.kept(chosen, "chosen")  # written, so that Spark can split a hot line in the join
    return lines.join(chosen, "line").where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "line")


def suspects_sent(found: DataFrame, wanted: int) -> DataFrame:
    """(id, line) of the rows of found whose hash a filter of `wanted` bits, sent to all tasks, suspects."""
    slice_bits = 1 << int(np.ceil(np.log2(wanted / SLICES)))
    sent = found.sparkSession.sparkContext.broadcast(seen_twice(found, slice_bits))
    kind = found.schema["id"].dataType.simpleString()

    @textops.lean
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = sent.value
        for batch in batches:
            s, a, b = bits(batch.column(2).to_numpy(), slice_bits)
            yield batch.filter(pa.array(test(twice, s, a, b))).select([0, 1])

    return found.mapInArrow(suspects, f"id {kind}, line string")


def rewrite(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, bytes_a_bit: float = 8.0, most_bits: int = 1 << 28, part_bits: int = 1 << 24) -> DataFrame:
    """For each document: row (a struct of all its columns), kept_text, n_lines (before) and n_dropped."""
    gone = repeated(docs, key, text, least_chars, least_docs, bytes_a_bit, most_bits, part_bits)
    gone = gone.groupBy("id").agg(F.collect_set("line").alias("gone"))
    place = docs.columns.index(text)
    rows = docs.select(F.col(key).alias("_id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    joined = rows.join(gone.hint("shuffle_hash"), rows["_id"].eqNullSafe(gone["id"]), "left").select("row", "gone")
    strip, lower = STRIPPED, str.maketrans(UPPER, LOWER)

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = batch.column(0), []
            for t, g in zip(row.field(place), batch.column(1), strict=True):
                t, g = t.as_py() or "", set(g.as_py() or ())
                before = t.split("\n")
                after = [x for x in before if x.strip(strip).translate(lower) not in g] if g else before
                out.append(("\n".join(after), len(before), len(before) - len(after)))
            kept, n, dropped = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "kept_text", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, kept_text string, n_lines bigint, n_dropped bigint")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_lines, n_dropped and kept_sha256 of each document."""
    out = rewrite(docs.select(key, text), key, text, **options)
    return out.select(F.col("row").getField(key).alias(key), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars", **options) -> DataFrame:
    """The documents with repeated lines gone and, where there is such a column, the number of characters as it is now."""
    out = rewrite(docs, key, text, **options)
    now = {text: F.col("kept_text")} | ({chars: F.length("kept_text").cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    return out.select(*(now.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


#: DuckDB's equivalent of report() over documents. chr(9)..chr(13) and the space are stripped; the key's A-Z are lower-cased alone.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines
), rep AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT d.doc_id, d.i, d.line, rep.keeper IS NOT NULL AND rep.keeper <> d.doc_id AS gone FROM keyed d LEFT JOIN rep ON d.k = rep.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
