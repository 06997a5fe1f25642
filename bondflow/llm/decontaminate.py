"""Benchmark decontamination by winnowing.

A window is `size` consecutive words of an item, or the whole of an item with
fewer words. Of each run of `size - k + 1` k-word hashes the smallest is kept, of
equal ones the rightmost. A span of `size` words that document and item share
holds one such run, and both sides keep the same k-gram of it, so joining the kept
hashes finds every shared window; each joined hash is then extended to the windows
around it, and those that the item really has mark their words as hit.

Items with fewer than `size` words have no full run; their whole word sequence is
looked up at each length that occurs.

Two ways, one result. Below `most_words` words of distinct test windows the test
side (hashes only) is sent to the tasks, and documents stream past it without a
shuffle. Above, the test windows stay in files: kept hashes of both sides meet in a
join, and the documents that have one are compared with the items they met.

Hashes have 64 bits; two different windows meet by chance once in some 10^19 pairs.

Defined results: a null or wordless text has no words, no hits and is clean; a null
or wordless item has no window. Repeated rows are judged each by itself; items with
equal ids and different texts count as one item. Windows of items without an id hit
words as all others do; only the ids of a document's items leave them out. An empty benchmark leaves all
documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondflow.llm import textops

K = 5


def winnow(hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Sorted places of the k-gram hashes kept: the least of each run of `window`, rightmost of equals.

    at: the range of hashes of each text; runs do not cross texts. Texts with fewer
    hashes than `window` keep none.
    """
    begin, _ = textops.spans(at, window)
    if not len(begin):
        return begin
    least, place = hashes.copy(), np.arange(len(hashes))
    width = 1
    while width < window:  # least of `width` hashes from each place on; grown by overlapping steps
        step = min(width, window - width)
        later, own = least[step:], least[: len(least) - step]
        right = later <= own
        place = np.where(right, place[step:], place[: len(place) - step])
        least = np.where(right, later, own)
        width += step
    return np.unique(place[begin])


class Windows:
    """The windows of all items: hashes by number of words, and the items of each."""

    def __init__(self, lengths: np.ndarray, hashes: np.ndarray, items: np.ndarray, kept: np.ndarray, size: int):
        self.size, self.kept = size, np.unique(kept)
        self.by_length = {}
        for n in np.unique(lengths):
            own = lengths == n
            order = np.lexsort((items[own], hashes[own]))
            self.by_length[int(n)] = (hashes[own][order], items[own][order])

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a block of texts: which words are hit, and (text, item) pairs."""
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        texts, items = [], []
        for n, (hashes, owners) in self.by_length.items():
            begin = self._full(words, at, hashes) if n == self.size else textops.spans(at, n)[0]
            if not len(begin):
                continue
            found = textops.grams(words, n)[begin]
            low = np.searchsorted(hashes, found)
            real = low < len(hashes)
            real[real] = hashes[low[real]] == found[real]
            begin, low, found = begin[real], low[real], found[real]
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + n, -1)
            high = np.searchsorted(hashes, found, side="right")
            many = high - low
            flat = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            texts.append(np.repeat(np.searchsorted(at, begin, side="right") - 1, many))
            items.append(owners[flat])
        none = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([none, *texts]), np.concatenate([none, *items])]), axis=1)
        return np.cumsum(covered[:-1]) > 0, pairs[0], pairs[1]

    def _full(self, words: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where windows of full size may start: around kept k-grams that the items keep too."""
        grams = textops.grams(words, K)
        _, inner = textops.spans(at, K)
        flat, _ = textops.spans(at, K)
        kept = winnow(grams[flat] if len(flat) else grams, inner, self.size - K + 1)
        if not len(kept) or not len(self.kept):
            return np.zeros(0, np.int64)
        value = grams[flat[kept]]
        low = np.searchsorted(self.kept, value)
        low[low == len(self.kept)] = 0
        met = flat[kept[self.kept[low] == value]]
        text = np.searchsorted(at, met, side="right") - 1
        begin = met[:, None] - np.arange(self.size - K + 1)[None, :]
        fits = (begin >= at[text][:, None]) & (begin + self.size <= at[text + 1][:, None])
        return np.unique(begin[fits])


def item_rows(size: int):
    """mapInArrow over (number, text): a row (item, length, hash, kept) for each window, and for each kept k-gram (length 0)."""

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, at in textops.blocks(batch.column(1)):
                words = textops.Words(data, at, textops.ALNUM)
                hashes, own, counts = words.hashes(), number[first:end], words.counts()
                out = []
                for n in np.unique(np.minimum(counts, size)):
                    if n == 0:
                        continue
                    begin, inner = textops.spans(words.at, int(n))
                    owner = np.repeat(np.arange(len(own)), np.diff(inner))
                    right = counts[owner] == n if n < size else np.ones(len(owner), bool)
                    out.append((own[owner[right]], np.full(right.sum(), n, np.int32), textops.grams(hashes, int(n))[begin[right]]))
                flat, inner = textops.spans(words.at, K)
                grams = textops.grams(hashes, K)[flat] if len(flat) else np.zeros(0, np.uint64)
                kept = winnow(grams, inner, size - K + 1)
                owner = np.searchsorted(inner, kept, side="right") - 1
                out.append((own[owner], np.zeros(len(kept), np.int32), grams[kept]))
                a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b), pa.array(c.view(np.int64))], names=["item", "length", "hash"])

    return run


def _judge(windows: Windows, names: dict[int, str], column: pa.Array) -> Iterator[tuple[int, int, list]]:
    for first, end, data, at in textops.blocks(column):
        words = textops.Words(data, at, textops.ALNUM)
        hit, text, item = windows.hits(words.hashes(), words.at)
        total = np.concatenate([[0], np.cumsum(hit)])[words.at]
        met: dict[int, list[str]] = {}
        for t, i in zip(text.tolist(), item.tolist(), strict=True):
            met.setdefault(t, []).append(names[i])
        for row, (n, h) in enumerate(zip(words.counts().tolist(), np.diff(total).tolist(), strict=True)):
            yield n, h, sorted({x for x in met.get(row, []) if x is not None})


def _out(row: pa.Array, judged: list[tuple]) -> pa.RecordBatch:
    n, h, met = zip(*judged, strict=True) if judged else ((), (), ())
    return pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(met, pa.list_(pa.string()))], names=["row", "n_words", "n_hit", "items"])


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 13, most_words: int = 2_000_000) -> DataFrame:
    """For each document: row (a struct of all its columns), n_words, n_hit and the sorted ids (as strings) of the items it has windows of."""
    if size <= K:
        raise ValueError(f"windows have more than {K} words")
    place = docs.columns.index(text)
    docs = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    schema = f"row {docs.schema['row'].dataType.simpleString()}, n_words bigint, n_hit bigint, items array<string>"
    items = items.select(F.col(item_key).cast("string").alias("name"), F.col(item_text).alias("text")).where("text is not null")  # items without an id share a number: xxhash64 of null
    numbered = items.select("name", F.xxhash64("name").alias("item"), "text")
    rows = numbered.select("item", "text").mapInArrow(item_rows(size), "item bigint, length int, hash bigint").distinct()
    if (small := rows.limit(most_words + 1).toArrow()).num_rows > most_words:
        return _joined(docs, numbered, rows, size, place, schema)
    item, length, value = (small.column(i).to_numpy() for i in range(3))
    kept = length == 0
    windows = Windows(length[~kept], value[~kept].view(np.uint64), item[~kept], value[kept].view(np.uint64), size)
    names = {r["item"]: r["name"] for r in numbered.select("item", "name").distinct().toLocalIterator()}
    sent = docs.sparkSession.sparkContext.broadcast((windows, names))

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, names = sent.value
        for batch in batches:
            row = batch.column(0)
            yield _out(row, list(_judge(windows, names, row.field(place))))

    return docs.mapInArrow(run, schema)


def _doc_rows(size: int, lengths: list[int]):
    """mapInArrow over (id, text): a row (id, length, hash) for each kept k-gram (length 0) and each window of a short length."""

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, at in textops.blocks(batch.column(1)):
                words = textops.Words(data, at, textops.ALNUM)
                hashes, own = words.hashes(), number[first:end]
                flat, inner = textops.spans(words.at, K)
                grams = textops.grams(hashes, K)[flat] if len(flat) else np.zeros(0, np.uint64)
                kept = winnow(grams, inner, size - K + 1)
                out = [(own[np.searchsorted(inner, kept, side="right") - 1], np.zeros(len(kept), np.int32), grams[kept])]
                for n in lengths:
                    begin, inner = textops.spans(words.at, n)
                    out.append((np.repeat(own, np.diff(inner)), np.full(len(begin), n, np.int32), textops.grams(hashes, n)[begin] if len(begin) else np.zeros(0, np.uint64)))
                a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.view(np.int64))], names=["id", "length", "hash"])

    return run


def _joined(docs: DataFrame, numbered: DataFrame, rows: DataFrame, size: int, place: int, schema: str) -> DataFrame:
    """The way without a bound on the benchmark: kept hashes of documents and items meet in a join, then each document has its items' windows beside it."""
    from bondflow.llm.shared import kept as keep

    rows, _ = keep(rows, "items")
    lengths = [r["length"] for r in rows.where(f"length between 1 and {size - 1}").select("length").distinct().collect()]
    docs, _ = keep(docs.withColumn("id", F.monotonically_increasing_id()), "docs")
    text = F.col("row").getField(docs.schema["row"].dataType.names[place])
    seeds = rows.where(f"length < {size}").select("length", "hash").distinct()
    met = docs.select("id", text.alias("text")).mapInArrow(_doc_rows(size, lengths), "id bigint, length int, hash bigint").distinct().join(seeds, ["length", "hash"])
    pairs = met.join(rows, ["length", "hash"]).select("id", "item").distinct()
    windows = pairs.join(rows, "item").groupBy("id").agg(F.collect_list(F.struct("item", "length", "hash")).alias("windows"))
    named = pairs.join(numbered.select("item", "name").distinct(), "item").groupBy("id").agg(F.collect_list(F.struct("item", "name")).alias("names"))

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = batch.column(0), []
            for i in range(batch.num_rows):
                found = batch.column(1)[i].as_py() or []
                a = np.array([[x["item"], x["length"], x["hash"]] for x in found], np.int64).reshape(-1, 3)
                kept = a[:, 1] == 0
                own = Windows(a[~kept, 1], a[~kept, 2].view(np.uint64), a[~kept, 0], a[kept, 2].view(np.uint64), size)
                names = {x["item"]: x["name"] for x in batch.column(2)[i].as_py() or []}
                out += _judge(own, names, row.field(place).slice(i, 1))
            yield _out(row, out)

    return docs.join(windows, "id", "left").join(named, "id", "left").select("row", "windows", "names").mapInArrow(run, schema)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule on a document: any hit, and at least a twentieth of its words."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """hits() with n_items, items_sha256 and contaminated in place of the items' ids."""
    out = hits(docs.select(key, text), items, text=text, **options)
    return out.select(
        F.col("row").getField(key).alias(key), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, with all their columns.

    A passage counts however long the text around it, so the share rule of `contaminated`
    plays no part. An item of a word or two takes every document that has it: leave such
    items out of `items` if they aren't meant.
    """
    return hits(docs, items, **options).where("n_hit = 0").select("row.*")
