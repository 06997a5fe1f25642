"""Document fingerprints by winnowing, in DataFrame operations alone.

A text's units are its runs of non-spaces of up to `SHORT` characters. A longer run is cut by
its own content: after each of `CUTS`, and where none of them follows within `FAR` characters
after each character, so what stands before a shared passage does not move the cuts inside it.
Each `K` consecutive units have a 64-bit hash, made as runs of two units and runs of those
roll on, so neighbours share their halves. Of each `WINDOW` consecutive hashes the smallest is
selected, of equal ones the rightmost, and its place is kept.

Guarantee: two texts that share a passage with `WINDOW + K - 1` consecutive units of both
share a selected hash. Prose needs that many words. In a passage without spaces the cuts are
in step `FAR` characters after its start at the latest, units have up to `FAR + 1` characters,
and its last `SHORT` may be one unit; (WINDOW + K) * (FAR + 1) + SHORT characters
always suffice, in any script, and in letters of ASCII some 8 to a unit do. Scripts with none
of `CUTS` (Han, kana, Thai) have single characters as units in long runs: WINDOW + K + SHORT.
A text of fewer than K units has one hash of them all; one of fewer than WINDOW hashes selects
the smallest. Single characters throughout would cost several times the budget in SQL functions.

A fingerprint is a text of `place:hash` pairs in the order of places; likeness of two is
the Jaccard similarity of their sets of hashes, 1 if both are empty.

The next document in the order of ids comes from a window over ranges of ids of at most
`rows_a_range` rows or so, four or more to a shuffle partition: range ends are approximate quantiles, an id with more rows than a range
should hold is split further by a hash of the text, and the first document of the next range
stands in for the end of each range. Texts are shuffled once.

Defined results: a null text counts as empty; an empty one has an empty fingerprint. Ids are
numbers, or the call raises. Null ids come first; rows with equal ids follow each other in the
order of xxhash64 of their texts, then of the texts. A table of one row is its own next
document; an empty table gives an empty result. Columns other than key and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

K, WINDOW = 4, 12
SHORT, FAR, CUTS = 24, 63, "aeiouAEIOU"
UNITS = rf"\S{{1,{SHORT}}}+(?!\S)|[^\s{CUTS}]{{0,{FAR}}}+[{CUTS}]|\S"
ROWS_A_RANGE = 1 << 14


def _paired(values: Column, gap: int, combine) -> Column:
    """combine(value, the value `gap` places on) for each place; what lies beyond the end is null."""
    return F.zip_with(values, F.slice(values, gap + 1, F.greatest(F.size(values) - gap, F.lit(0))), combine)


def with_selected(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds a struct of two arrays, places and hashes, in the order of places."""
    least = lambda x, y: F.least(x, y)  # noqa: E731 (nulls don't count)
    df = df.withColumn("_h", F.transform(F.regexp_extract_all(F.col(text), F.lit(UNITS), F.lit(0)), lambda u: F.xxhash64(u)))
    n = F.size("_h")
    for step in (1, 2):  # hashes of 2, then of K = 4 units
        df = df.withColumn(f"_k{step}", _paired(F.col("_h" if step == 1 else "_k1"), step, lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("_g", F.when(n == 0, F.array().cast("array<bigint>")).when(n < K, F.array(F.xxhash64("_h"))).otherwise(F.slice("_k2", 1, n - K + 1)))
    df = df.drop("_h", "_k1", "_k2")
    df = df.withColumn("_w2", _paired(F.col("_g"), 1, least)).withColumn("_w4", _paired(F.col("_w2"), 2, least)).withColumn("_w8", _paired(F.col("_w4"), 4, least))
    m = F.size("_g")
    # of texts with fewer hashes than WINDOW, the one window starts at 0
    df = df.withColumn("_m", F.slice(_paired(F.col("_w8"), WINDOW - 8, least), 1, F.greatest(m - WINDOW + 1, F.least(m, F.lit(1))))).drop("_w2", "_w4", "_w8")
    # another hash is selected only where the window's least has just come in at its end, or has just left
    came = _at("_g", WINDOW - 1)
    moved = F.zip_with("_m", came, lambda least_, last: last <= least_)
    goes = F.zip_with("_m", F.slice("_g", 1, F.size("_m")), lambda least_, first: first == least_)
    # (no lambda holds a column that is used once: Catalyst would put its whole expression inside, to be made again for every element)
    either = F.zip_with("_moved", F.concat(F.array(F.lit(True)), F.slice("_goes", 1, F.greatest(F.size("_goes") - 1, F.lit(0)))), lambda x, y: x | y)
    starts = F.array_compact(F.transform(either, lambda x, s: F.when(x, s)))
    df = df.withColumn("_moved", moved).withColumn("_goes", goes).withColumn("_s", F.when(m == 0, F.array().cast("array<int>")).otherwise(starts))
    place = lambda s: F.when(s + WINDOW - 1 < m, F.when(F.get("_g", s + WINDOW - 1) == F.get("_m", s), s + WINDOW - 1)).otherwise(F.lit(None))
    rightmost = lambda s: F.coalesce(place(s), (s + F.size(F.slice("_g", s + 1, WINDOW)) - F.array_position(F.reverse(F.slice("_g", s + 1, WINDOW)), F.get("_m", s))).cast("int"))
    df = df.withColumn("_p", F.array_distinct(F.transform("_s", rightmost)))
    return df.withColumn(out, F.struct(F.col("_p").alias("places"), F.transform("_p", lambda p: F.get("_g", p)).alias("hashes"))).drop("_g", "_m", "_s", "_p", "_moved", "_goes")


def _at(values: str, ahead: int) -> Column:
    """The values from `ahead` places on."""
    return F.slice(F.col(values), ahead + 1, F.greatest(F.size(values) - ahead, F.lit(0)))


def hashes(selected: Column) -> Column:
    return F.array_distinct(selected.getField("hashes"))


def written(selected: Column) -> Column:
    """The fingerprint as text: `place:hash` pairs, places in decimal, hashes in hexadecimal."""
    pair = lambda place, h: F.concat(place.cast("string"), F.lit(":"), F.lower(F.hex(h)))
    return F.array_join(F.zip_with(selected.getField("places"), selected.getField("hashes"), pair), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def range_place(id_: Column, ends: list) -> Column:
    """How many of the sorted ends lie below an id: first among every so many of them, then inside that run."""
    if not ends:
        return F.lit(0)
    step = max(1, int(len(ends) ** 0.5))
    runs = [ends[i : i + step] for i in range(0, len(ends), step)]
    below = lambda a: F.size(F.filter(a, lambda e: e < id_))
    run = below(F.array(*(F.lit(r[-1]) for r in runs)))
    inside = F.get(F.array(*(F.array(*map(F.lit, r)) for r in runs)), run)
    return run * step + F.coalesce(F.when(inside.isNotNull(), below(inside)), F.lit(0))


def with_next(docs: DataFrame, rows_a_range: int) -> DataFrame:
    """Rows of (id, text, s), with next, a struct (text, s) of the row that follows in the order of ids, cyclically."""
    if not isinstance(docs.schema["id"].dataType, T.NumericType):
        raise TypeError("ids must be numbers")
    total, nulls = docs.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    rows_a_range = max(1, min(rows_a_range, total // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))  # several a partition even them out
    ranges = max(1, total // rows_a_range)
    ends = docs.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 8 * ranges)).first()[0] or []
    often = docs.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_a_range).collect() if total > 2 * rows_a_range else []  # fewer of them than ranges
    place = range_place(F.col("id"), sorted({*ends, *(r["id"] for r in often)}))
    slot = lambda n: F.lit(1).cast("bigint") + F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - max(1, int(n // rows_a_range).bit_length()))  # noqa: E731 (in the order of h)
    sub = F.lit(0).cast("bigint")
    for r in often:
        sub = F.when(F.col("id") == r["id"], slot(r["n"])).otherwise(sub)
    if nulls > 2 * rows_a_range:
        sub = F.when(F.col("id").isNull(), slot(nulls)).otherwise(sub)
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("range", F.struct(F.when(F.col("id").isNull(), F.lit(-1)).otherwise(place).alias("a"), sub.alias("b")))
    first = docs.groupBy("range").agg(F.min(F.struct("id", "h", "text")).alias("first"))
    all_ = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # as many rows as ranges
    after = first.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.first("first").over(all_)).getField("text").alias("text"))
    after = with_selected(after, "text", "s").select("range", F.struct("text", "s").alias("after"))
    inside = Window.partitionBy("range").orderBy("id", "h", "text")
    return docs.withColumn("next", F.lead(F.struct("text", "s")).over(inside)).join(after, "range").withColumn("next", F.coalesce("next", "after")).drop("range", "after", "h")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """For each row: key, n_chars, fingerprint, and those of the text with its last quarter replaced from the next document, with likenesses."""
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_selected(docs, "text", "s"), rows_a_range)
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next.text"), F.lit(1), quarter))
    rows = rows.select("id", n.cast("bigint").alias("n_chars"), "s", hashes(F.col("s")).alias("a"), hashes(F.col("next.s")).alias("c"), edited.alias("edited"))
    rows = with_selected(rows, "edited", "t").withColumn("b", hashes(F.col("t")))
    return rows.select(
        F.col("id").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("s")).alias("fingerprint"), written(F.col("t")).alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next")
    )
