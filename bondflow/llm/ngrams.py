"""Language-model scoring with a bigram trie of Elias-Fano levels.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end a text.
Level 1 holds the training vocabulary: word hashes in order, which give the words'
numbers, their counts, and the counts' running sums. Level 2 holds each context's
successors: monotone pointers give the range of a context, and a successor's number is
stored relative to its context (context times vocabulary size plus word, which is
monotone), so looking one up is a search inside the context's range. Beside it lies its
smoothed probability in 8 bits, one of 256 equal steps between its part's least and
greatest log10 probability. The end is also the context at a text's start.

Probabilities are those of a hierarchical Dirichlet prior: with n the bigram's count and
c the context's, (n + mu p1(w)) / (c + mu), where p1(w) = (c(w) + 1) / (N + V + 1); pairs
that were not seen get mu p1(w) / (c + mu), those after an unknown word p1(w).

Level 1 is cut by hash, level 2 by ranges of contexts, each into parts whose number
follows the input: a context takes as many of PART_2 places as it has tokens, and one that
takes more than a part is cut by its successors' numbers (which follow their hashes, so the
cuts are even). A part so has pointers for its own contexts alone, PART_2 at most, and is
built in one task of bounded size. Tasks send a part's counts as one sorted block. Parts
are files in the shared folder, memory-mapped where they are read, of which a worker keeps
MOST_FILES open; the driver gets three numbers for each part of level 1.

Word hashes have 64 bits: two words of a vocabulary of V are one with chance V^2 / 4e19.

Defined results: a null or wordless text has its end as only token. Rows with a null id
are scored, not learned from, and not held out. Repeated rows count and are scored as
often as they occur. Without training rows N and V are 0 and scores follow the formulas.
"""

from __future__ import annotations

import functools
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondflow.llm import monotone, shared, textops

END = np.uint64(0x243F6A8885A308D3)
#: Bytes of input to a part of level 1, tokens to a part of level 2
PART_1, PART_2 = 32 << 20, 4 << 20
MOST_FILES = 4000


@dataclass(frozen=True)
class Model:
    path: str
    bits: int  # of level 1's part number
    places: int  # to a part of level 2
    tokens: int
    words: int
    texts: int
    mu: float


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: first row, end row, token hashes with each text's end, and the texts' ranges."""
    for first, end, data, at in textops.blocks(column, 1 << 20):
        w = textops.Words(data, at, textops.NOT_SPACE)
        n = w.counts() + 1
        ends = np.cumsum(n)
        out = np.empty(ends[-1], np.uint64)
        is_end = np.zeros(len(out), bool)
        is_end[ends - 1] = True
        out[is_end], out[~is_end] = END, w.hashes()
        yield first, end, out, np.concatenate([[0], ends])


def batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch and the texts' ranges."""
    hashes, ends, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, h, at in tokens(column):
        hashes.append(h)
        ends.append(at[1:] + base)
        base += len(h)
    return np.concatenate(hashes), np.concatenate(ends)


def _blocks(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row (part, keys, more) for each part: sorted keys, and what their counts exceed 1 by as pairs of place and excess."""
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order], counts[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        over = np.flatnonzero(counts[a:b] > 1)
        rows.append((int(part[a]), keys[a:b].tobytes(), np.stack([over, counts[a:b][over] - 1]).astype(np.int64).tobytes()))
    p, k, m = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.binary()), pa.array(m, pa.binary())], names=["part", "keys", "more"])


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a part and their counts."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for k, m in zip(batch.column(1), batch.column(2), strict=True):
            own = np.frombuffer(k.as_buffer(), np.uint64)
            n = np.ones(len(own), np.int64)
            place, over = np.frombuffer(m.as_buffer(), np.int64).reshape(2, -1)
            n[place] += over
            keys.append(own)
            counts.append(n)
    all_, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(all_, kind="stable")
    all_, n = all_[order], n[order]
    if not len(all_):
        return all_, n
    starts = np.concatenate([[0], np.flatnonzero(np.diff(all_)) + 1])
    return all_[starts], np.add.reduceat(n, starts)


def _part_1(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _groups(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part met and the places where it is."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[order[a]]), order[a:b]


class Trie:
    """The two levels, opened from files as they are needed."""

    def __init__(self, model: Model):
        self.model = model
        self._open: OrderedDict[str, object] = OrderedDict()
        #: Number of the first word of each part of level 1, and tokens before it
        self.bases, self.before = (np.load(f"{model.path}/{x}.npy", mmap_mode="r") for x in ("bases", "before"))
        self.end = int(self.numbers(np.array([END]))[0][0])

    def file(self, name: str):
        if name in self._open:
            self._open.move_to_end(name)
        else:
            at = f"{self.model.path}/{name}"
            self._open[name] = np.load(f"{at}.npy", mmap_mode="r") if os.path.exists(f"{at}.npy") else monotone.Monotone(at) if os.path.exists(f"{at}.shape.npy") else None
            if len(self._open) > MOST_FILES:
                self._open.popitem(last=False)
        return self._open[name]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (-1: unknown) and their counts (0: unknown)."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for p, own in _groups(_part_1(hashes, self.model.bits)):
            level = self.file(f"words-{p}")
            if level is None:
                continue
            place = level.find(hashes[own] - (np.uint64(p) << np.uint64(64 - self.model.bits) if self.model.bits else np.uint64(0)))
            known = place >= 0
            out[own[known]] = place[known] + self.bases[p]
            count[own[known]] = self.file(f"counts-{p}")[place[known]]
        return out, count

    def counts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words by number, and the tokens of all words before them."""
        out, before = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
        for p, own in _groups(np.searchsorted(self.bases, numbers, side="right") - 1):
            place = numbers[own] - self.bases[p]
            out[own] = self.file(f"counts-{p}")[place]
            before[own] = self.file(f"sums-{p}").value(place).astype(np.int64) + self.before[p]
        return out, before

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.model.tokens + self.model.words + 1)

    def parts(self, keys: np.ndarray) -> np.ndarray:
        """Level 2's parts of sorted pairs (context times V plus word); they never fall."""
        v = np.uint64(self.model.words)
        context, word = (keys // v).astype(np.int64), (keys % v).astype(np.int64)
        distinct, times = np.unique(context, return_counts=True)
        count, before = (np.repeat(x, times) for x in self.counts(distinct))
        return (before + np.minimum((word / self.model.words * count).astype(np.int64), count - 1)) // self.model.places

    def smoothed(self, keys: np.ndarray) -> np.ndarray:
        """log10 probabilities of sorted pairs (context times V plus word); nan where the pair was not seen."""
        out = np.full(len(keys), np.nan)
        for p, own in _groups(self.parts(keys)):
            level = self.file(f"pairs-{p}")
            if level is None:
                continue
            lowest, highest = self.file(f"contexts-{p}").tolist()
            context = (keys[own] // np.uint64(self.model.words)).astype(np.int64)
            inside = (context >= lowest) & (context <= highest)
            own, context = own[inside], context[inside] - lowest
            distinct, times = np.unique(context, return_counts=True)
            pointers = self.file(f"pointers-{p}")
            first, end = (np.repeat(pointers.value(distinct + i).astype(np.int64), times) for i in (0, 1))
            place = level.find(keys[own] - np.uint64(lowest * self.model.words), first, end)
            seen = place >= 0
            out[own[seen]] = self.file(f"levels-{p}")[self.file(f"codes-{p}")[place[seen]]]
        return out


@functools.lru_cache(maxsize=2)
def trie(model: Model) -> Trie:
    return Trie(model)


def numbered(own: Trie, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a batch: texts' ranges, and each token's number, count and context (number of the token before it, the end's at the start)."""
    h, at = batch_tokens(column)
    distinct, back = np.unique(h, return_inverse=True)
    number, count = own.numbers(distinct)
    number, count = number[back], count[back]
    context = np.empty(len(number), np.int64)
    context[1:] = number[:-1]
    context[at[:-1]] = own.end
    return at, number, count, context


def fit(docs: DataFrame, mu: float = 400.0) -> Model:
    """Learns from the rows of (text) and returns where the levels lie."""
    spark = docs.sparkSession
    path = shared.local_path(shared.new_path(spark, "ngrams"))
    os.makedirs(path, exist_ok=True)
    size = shared.input_bytes(docs)
    bits, places = max(0, int(size // PART_1).bit_length()), PART_2

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _ = batch_tokens(batch.column(0))
            keys, n = np.unique(h, return_counts=True)
            yield _blocks(_part_1(keys, bits), keys, n)

    def write_words(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = key[0].as_py()
        keys, n = _merged(batches)
        low = np.uint64(p << (64 - bits)) if bits else np.uint64(0)
        monotone.build(f"{path}/words-{p}", keys - low, 1 << (64 - bits))
        monotone._save(f"{path}/counts-{p}.npy", n)
        monotone.build(f"{path}/sums-{p}", (np.cumsum(n) - n).astype(np.uint64), int(n.sum()) + 1)
        ends = int(n[keys == END].sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (p, len(keys), int(n.sum()), ends)], names=["part", "words", "tokens", "texts"])

    block = "part int, keys binary, more binary"
    found = {r["part"]: r for r in docs.select("text").mapInArrow(count_words, block).groupBy("part").applyInArrow(write_words, "part bigint, words bigint, tokens bigint, texts bigint").collect()}
    for name, of in (("bases", "words"), ("before", "tokens")):
        n = np.array([found[p][of] if p in found else 0 for p in range(1 << bits)], np.int64)
        monotone._save(f"{path}/{name}.npy", np.cumsum(n) - n)
    tokens_, words, texts = (sum(r[x] for r in found.values()) for x in ("tokens", "words", "texts"))
    model = Model(path, bits, places, tokens_, words, texts, mu)
    if not model.words:
        return model

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(model)
        for batch in batches:
            _, number, _, context = numbered(own, batch.column(0))
            keys, n = np.unique(context.astype(np.uint64) * np.uint64(model.words) + number.astype(np.uint64), return_counts=True)
            yield _blocks(own.parts(keys), keys, n)

    def write_pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, own, v = key[0].as_py(), trie(model), model.words
        keys, n = _merged(batches)
        context, word = (keys // np.uint64(v)).astype(np.int64), (keys % np.uint64(v)).astype(np.int64)
        p2 = np.log10((n + mu * own.base(own.counts(word)[0])) / (own.counts(context)[0] + mu))
        levels = np.linspace(p2.min(), p2.max(), 256)
        codes = np.rint((p2 - levels[0]) / max(levels[-1] - levels[0], 1e-9) * 255).astype(np.uint8)
        lowest, highest = int(context[0]), int(context[-1])
        monotone.build(f"{path}/pairs-{p}", keys - np.uint64(lowest * v), (highest - lowest + 1) * v)
        monotone.build(f"{path}/pointers-{p}", np.searchsorted(context, np.arange(lowest, highest + 2)).astype(np.uint64), len(keys) + 1)
        monotone._save(f"{path}/contexts-{p}.npy", np.array([lowest, highest]))
        monotone._save(f"{path}/levels-{p}.npy", levels)
        monotone._save(f"{path}/codes-{p}.npy", codes)
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(keys)], pa.int64())], names=["part", "pairs"])

    docs.select("text").mapInArrow(count_pairs, block).groupBy("part").applyInArrow(write_pairs, "part int, pairs bigint").collect()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score and score of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, v = trie(model), model.words
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                at, number, count, context = numbered(own, batch.column(1))
                p1 = own.base(count)
                known = (number >= 0) & (context >= 0)
                before = np.zeros(len(number), np.int64)
                before[1:] = count[:-1]
                before[at[:-1]] = model.texts
                logs = np.log10(np.where(context >= 0, mu_part(before, model.mu), 1.0) * p1)
                if v:
                    keys, back = np.unique(context[known].astype(np.uint64) * np.uint64(v) + number[known].astype(np.uint64), return_inverse=True)
                    seen = own.smoothed(keys)[back]
                    logs[known] = np.where(np.isnan(seen), logs[known], seen)
                sums = [np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), np.log10(p1), logs)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), *map(pa.array, sums)], names=["key", "n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return out.mapInArrow(run, f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double").withColumnRenamed("key", key)


def mu_part(context_counts: np.ndarray, mu: float) -> np.ndarray:
    """The share of a context's probability that goes to the level below."""
    return mu / (context_counts + mu)


def held_out(key: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score() from a model of the documents not held out, with held_out and train_tokens."""
    model = fit(docs.where(F.col(key).isNotNull() & ~held_out(key)).select(F.col(text).alias("text")))
    out = score(docs, model, key, text)
    return out.select(key, held_out(key).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
