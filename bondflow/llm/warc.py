"""WARC archives: writing records, and reading them by boundary-chain verification.

Writing: one record a row, as text lines that end in the record's closing blank lines,
so Spark's own writer puts them in any file system. Of rows with equal payloads of at
least `least_bytes`, that with the largest id is a response; the others are revisits that
name it and carry no payload.

Reading: files are split at every occurrence of the magic `WARC/1.0\\r\\n`, also by tasks
that read parts of a file. Each piece is a candidate: its place in the file follows from
the lengths of the pieces before it, its successor's place from its header and
Content-Length. A piece may also begin inside a payload that holds the magic, so only
candidates that a chain from the file's start reaches are records: pointer jumping
doubles the length of the known chain each round, over (file, place, successor) rows
alone. A record whose payload held the magic spans several pieces; those are put
together again, all others are read where they lie.

Defined results: a null payload is an empty one, a null url gives no target; ids may
repeat (equal payloads and ids: every row with the largest id is a response), a row with
a null id revisits the largest known id. A chain ends at a candidate whose header is broken; what
follows it in that file is not reachable and is left out. An empty table writes no
record and reads none.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bondflow.llm import linededup, shared

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
#: What a revisit with the payload of another record is called
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def classify(rows: DataFrame, least_bytes: int = 1000, most_bits: int = 1 << 28) -> DataFrame:
    """Adds bytes, digest and original (the id that a revisit refers to, else null) to rows of (id, url, payload).

    A Bloom filter of digests that occur twice, a bit for 32 bytes of input, parts rows that
    may share their payload from the others: only the former are shuffled, with an exact
    join. Where the filter would have more than most_bits, which is what is sent to tasks
    at most, all digests are counted and all rows joined.
    """
    raw = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    rows = rows.withColumn("bytes", F.octet_length(raw).cast("bigint")).withColumn("digest", F.sha1(raw))
    hashed = F.when(F.col("bytes") >= least_bytes, F.xxhash64("digest"))
    wanted = max(1 << 20, shared.input_bytes(rows) // 32)
    found = rows.select(hashed.alias("h"), "id", "digest").where("h is not null")
    if wanted > most_bits:
        several = rows.join(repeats(found.select("id", "digest")), (rows["digest"] == F.col("of")) & (rows["bytes"] >= least_bytes), "left").drop("of")
        return several.withColumn("original", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")))
    slice_bits = 1 << int(wanted // linededup.SLICES).bit_length()
    sent = rows.sparkSession.sparkContext.broadcast(linededup.seen_twice(found, slice_bits))
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = sent.value
        for batch in batches:
            yield batch.filter(pa.array(linededup.test(twice, *linededup.bits(batch.column(0).to_numpy(), slice_bits)))).select([1, 2])

    maybe = found.mapInArrow(suspects, f"id {rows.schema['id'].dataType.simpleString()}, digest string")
    groups = repeats(maybe).withColumnRenamed("of", "digest")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = sent.value
        for batch in batches:
            h = pc.fill_null(batch.column(1), 0).to_numpy()
            maybe = linededup.test(twice, *linededup.bits(h, slice_bits)) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maybe)], names=["row", "maybe"])

    packed = rows.select(F.struct("id", "url", "payload", "bytes", "digest").alias("row"), hashed.alias("h"))
    flagged = packed.mapInArrow(flag, f"row {packed.schema['row'].dataType.simpleString()}, maybe boolean")
    alone = flagged.where(~F.col("maybe")).select("row.*").withColumn("original", F.lit(None).cast(rows.schema["id"].dataType))
    several = flagged.where("maybe").select("row.*").join(groups.hint("shuffle_hash"), "digest", "left")
    several = several.withColumn("original", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")))
    return several.unionByName(alone)


def repeats(rows: DataFrame) -> DataFrame:
    """(of, original): digests of several rows of (id, digest) and the largest id of each."""
    counted = rows.groupBy(F.col("digest").alias("of")).agg(F.count("*").alias("n"), F.max("id").alias("original"))
    return shared.kept(counted.where("n > 1 and original is not null").select("of", "original"), "repeats")[0]


def record(id_: Column, url: Column, payload: Column, size: Column, digest: Column, original: Column, date: str) -> Column:
    """The text of a record from its magic up to its closing blank lines; date as 2026-01-31T00:00:00Z."""
    revisit = original.isNotNull()
    length = F.when(revisit, F.lit(0)).otherwise(size)
    escaped = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda x: F.concat(F.lit("<urn:row:"), x.cast("string"), F.lit(">"))
    optional = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        optional(field("WARC-Record-ID", urn(id_))),
        field("WARC-Date", F.lit(date)),
        optional(field("WARC-Refers-To", urn(original))),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        optional(field("WARC-Target-URI", escaped)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        field("X-Payload-Length", size.cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.coalesce(payload, F.lit(""))),
    )


def write(df: DataFrame, path: str, id_: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 1000, most_records: int = 20_000, date: str | None = None) -> None:
    """Writes a record for each row to files under path; date: when the rows were fetched, now if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = classify(df.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload")), least_bytes)
    text = rows.select(record(*(F.col(c) for c in ("id", "url", "payload", "bytes", "digest", "original")), date).alias("value"))
    text.write.option("lineSep", GAP).option("maxRecordsPerFile", most_records).text(path)


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each piece between magics: file, part (start of the task's part), seq (order in the part), body, and the file's size."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    meta = F.col("_metadata")
    return text.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("part"), meta["file_size"].alias("file_size"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("body")
    )


def header_fields(body: Column) -> dict[str, Column]:
    """Header text and its fields from a piece."""
    head = F.substring_index(body.cast("string"), GAP, 1)
    value = lambda name: F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return {
        "head_bytes": F.octet_length(head).cast("bigint"),
        "length": value("Content-Length").try_cast("bigint"),
        "type": value("WARC-Type"),
        "record_id": value("WARC-Record-ID"),
        "refers_to": value("WARC-Refers-To"),
        "url": value("WARC-Target-URI"),
        "digest": value("WARC-Payload-Digest"),
        "payload_length": value("X-Payload-Length").try_cast("bigint"),
    }


CANDIDATE = ("head_bytes", "length", "type", "record_id", "refers_to", "url", "digest", "payload_length")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Pieces without their bodies: place and successor in the file, header fields, and, where the piece holds all of its payload, the payload's SHA-1."""
    all_ = pieces(spark, path)
    fields = header_fields(F.col("body"))
    own = F.expr("substring(body, int(head_bytes + 5), int(length))")
    rows = all_.select("*", F.octet_length("body").cast("bigint").alias("size"), *(c.alias(n) for n, c in fields.items()))
    rows = rows.withColumn("whole", (F.col("length") + F.col("head_bytes") + 8 <= F.col("size")))
    rows = rows.withColumn("sha1", F.when(F.col("whole"), F.sha1(own))).drop("body")
    rows, path = shared.kept(rows, "pieces")
    next_ = F.col("place") + len(MAGIC) + F.col("head_bytes") + 4 + F.col("length") + 4
    found, _ = shared.kept(placed(rows).select("file", "place", next_.alias("next"), "file_size", "size", "whole", "sha1", *CANDIDATE), "candidates")
    shared.delete(spark, path)
    return found


def placed(rows: DataFrame) -> DataFrame:
    """Rows of pieces (file, part, seq, size) with their place in the file: what the parts before and the pieces before in the part take up."""
    step = F.col("size") + len(MAGIC)
    parts = rows.groupBy("file", "part").agg(F.sum(step).alias("total"))
    parts = parts.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    before = F.coalesce(F.sum(step).over(Window.partitionBy("file", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", before).join(parts, ["file", "part"])
    return rows.withColumn("place", F.col("base") + F.col("inside") - len(MAGIC)).where("place >= 0")


def reachable(found: DataFrame) -> DataFrame:
    """(file, place) of the candidates on the chain from each file's start, by pointer jumping."""
    jump = found.where("next is not null").select("file", F.col("place").alias("at"), F.col("next").alias("to"))
    known = found.where("place = 0").select("file", "place").distinct()
    jump, old_jump = shared.kept(jump, "jump")
    known, old_known = shared.kept(known, "known")
    spark, n = found.sparkSession, known.count()
    while True:
        landed = known.join(jump, (known["file"] == jump["file"]) & (known["place"] == jump["at"])).select(known["file"], jump["to"].alias("place"))
        real = landed.join(found.select("file", "place"), ["file", "place"], "left_semi")
        new, new_path = shared.kept(known.union(real).distinct(), "known")
        shared.delete(spark, old_known)
        known, old_known = new, new_path
        more = known.count()
        if more == n:
            shared.delete(spark, old_jump)
            return known
        n = more
        b = jump.select(F.col("file").alias("file2"), F.col("at").alias("at2"), F.col("to").alias("to2"))
        longer = jump.join(b, (F.col("file") == F.col("file2")) & (F.col("to") == F.col("at2"))).select("file", "at", F.col("to2").alias("to"))
        new, new_path = shared.kept(longer, "jump")
        shared.delete(spark, old_jump)
        jump, old_jump = new, new_path


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under path: file, place, header fields, payload_sha1 of the block as read, and its payload (binary) if asked for."""
    found = candidates(spark, path)
    records = found.join(reachable(found), ["file", "place"])
    split = records.where(~F.col("whole"))
    if payloads or not split.isEmpty():
        bodies = _joined(spark, path, found, records if payloads else split).select("file", "place", F.col("payload"))
        records = records.join(bodies, ["file", "place"], "left").withColumn("sha1", F.when(F.col("whole"), F.col("sha1")).otherwise(F.sha1("payload")))
    return records.select("file", "place", "type", "record_id", "refers_to", "url", "digest", "length", "payload_length", F.col("sha1").alias("payload_sha1"), *(["payload"] if payloads else []))


def _joined(spark: SparkSession, path: str, found: DataFrame, records: DataFrame) -> DataFrame:
    """Payloads of records, put together from their pieces; a second read of the archives that hold them.

    Pieces are known by their place, which does not depend on how a read is cut into tasks. A
    piece belongs to the last record that begins at or before it in the file.
    """
    files = records.select("file").distinct()
    own = records.select("file", "place", F.struct(F.col("place").alias("record"), "head_bytes", "length", "next").alias("own"))
    marked = found.join(files, "file", "left_semi").select("file", "place").join(own, ["file", "place"], "left")
    so_far = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.select("file", "place", F.last("own", ignorenulls=True).over(so_far).alias("r")).select("file", "place", "r.*").where("place < next")
    bodies, _ = shared.kept(pieces(spark, path).join(files, "file", "left_semi").withColumn("size", F.octet_length("body").cast("bigint")), "bodies")
    parts = inside.join(placed(bodies).select("file", "place", "body"), ["file", "place"])
    magic = F.lit(MAGIC).cast("binary")
    whole = parts.groupBy("file", "record", "head_bytes", "length").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("pieces"))
    text = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, magic, x["body"]))
    return whole.withColumn("text", text).select("file", F.col("record").alias("place"), F.expr(f"substring(text, int({len(MAGIC)} + head_bytes + 5), int(length))").alias("payload"))


def round_trip(df: DataFrame, id_: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes df's records to the shared folder, reads them back, and gives id, payload_bytes, payload_digest, record_type and refers_to of each.

    Bytes and digest are those of the payload as read, of a revisit's those of the response it
    names. A response that differs from the digest in its header is an error, and so is a
    revisit that names no response with its digest. Columns other than the three are ignored.
    """
    spark = df.sparkSession
    path = shared.new_path(spark, "warc")
    write(df, path, id_, url, payload)
    kind = df.schema[id_].dataType
    number = lambda c: F.regexp_extract(c, r"^<urn:row:(.*)>$", 1).try_cast(kind)
    records, _ = shared.kept(read(spark, path, payloads=False).select("type", "record_id", "refers_to", "digest", "length", F.concat(F.lit("sha1:"), "payload_sha1").alias("found")), "records")
    wrong = lambda what: F.raise_error(F.lit(what)).cast(T.StringType())
    out = lambda length, digest: (number("record_id").alias(id_), length.alias("payload_bytes"), F.substring(digest, 6, 40).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    responses = records.where("type <> 'revisit'")
    own = responses.select(*out(F.col("length"), F.when(F.col("found") == F.col("digest"), F.col("found")).otherwise(wrong("a payload differs from its digest"))))
    revisits = records.where("type = 'revisit'").select("type", "record_id", "refers_to", "digest")
    named = revisits.select(F.col("refers_to").alias("named")).distinct()
    targets = responses.join(named, F.col("record_id") == F.col("named"), "left_semi").select(F.col("record_id").alias("target"), F.col("found").alias("target_digest"), F.col("length").alias("target_length")).distinct()
    met = revisits.join(targets, (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("target_digest")), "left")
    theirs = met.select(*out(F.col("target_length"), F.coalesce("target_digest", wrong("a revisit names no response with its digest"))))
    return own.unionByName(theirs)


#: DuckDB's equivalent of round_trip() over pages.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
