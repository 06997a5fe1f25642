"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by piece score, then by
place: the best pair is merged, and the pairs it makes with its neighbours join
the agenda. Text is cut first where no piece of the vocabulary can reach across,
so a distinct cut is merged once per worker and then looked up. The memory of that
table is bounded, and a large corpus never stops bringing new words: those of a slice
of rows are merged together, one merge of each word at a time, with the agenda as a matrix.

Each Arrow batch is compared with the sentencepiece library (`check`), and a difference
raises. "words": each word when it enters the table of known ones (so every word of every
row has been compared), whole texts where spaces are doubled, lead or trail, and the first
rows of each batch whole, which tests that words may be encoded by themselves. "all":
every row whole. "none": nothing.

Defined results: a null text counts as empty, and an empty text has the begin and
end ids alone and decodes to an empty text. Repeated rows give repeated rows; an
empty table gives an empty table; other columns are ignored by the query.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from bondflow.llm import textops

SPACE = "▁"
#: Fewer new words are merged one by one; of more, so many at most are merged together
FEW, MANY = 32, 4096
GONE = -1


class Agenda:
    """Encoder and decoder for one BPE model."""

    def __init__(self, model: bytes, remember: int = 300_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        special = [lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)) or lib.encode("a  b", out_type=str)[0] != SPACE + "a":
            raise ValueError("only BPE models with the identity normaliser and no unused pieces are supported")
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special[i]}
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.ids.items()}
        code = lambda i: i.to_bytes(4, "little")
        self.coded = {p: code(i) for p, i in self.ids.items()}
        bytes_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_coded = [code(i) for i in bytes_ids]
        if lib.unk_id() in bytes_ids:
            raise ValueError("only models with byte fallback are supported")
        joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b[0] != SPACE and b[1] == SPACE for b in joined):
            raise ValueError("only models whose pieces have spaces in front are supported")
        self.joined = joined
        self.known = _Known(self.word_ids, remember)
        self.fresh: list[tuple[str, bytes]] = []  # words, and texts with odd spaces, not yet compared with the library
        self.odd: list[tuple[str, bytes]] = []
        self.parts = _Known(self.cut_ids, remember)
        self.ends = code(lib.bos_id()), code(lib.eos_id())
        self.pairs = _Pairs(self.ids, self.rank)
        self.byte_ids = np.array(bytes_ids, np.uint32)

    def merged(self, text: str) -> list[str]:
        """The pieces of a text, by merging the best adjacent pair until none is in the vocabulary."""
        return self._merged_short(text) if len(text) <= 32 else self._merged_long(text)

    def _merged_short(self, text: str) -> list[str]:
        """The agenda as a list in the order of places: its least rank, leftmost, is merged first."""
        rank, last = self.rank.get, len(self.rank)
        pieces = list(text)
        agenda = list(map(rank, map(operator.add, text, text[1:]), itertools.repeat(last)))
        while agenda and (best := min(agenda)) < last:
            i = agenda.index(best)
            both = pieces[i] = pieces[i] + pieces.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(pieces[i - 1] + both, last)
            if i < len(agenda):
                agenda[i] = rank(both + pieces[i + 1], last)
        return pieces

    def _merged_long(self, text: str) -> list[str]:
        """The agenda as a heap, for texts where scanning a list would take too long."""
        rank, n = self.rank, len(text)
        piece: list[str] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not piece[i] or not piece[j] or len(piece[i]) + len(piece[j]) != len(both):
                continue  # one of the two has been merged meanwhile
            piece[i], piece[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := both + piece[k]) in rank:
                    heapq.heappush(agenda, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := piece[h] + both) in rank:
                heapq.heappush(agenda, (rank[p], h, p))
        return [p for p in piece if p]

    def cut_ids(self, text: str) -> bytes:
        """Ids of a part inside which pieces may reach anywhere."""
        return b"".join([self.coded.get(p) or b"".join([self.byte_coded[b] for b in p.encode()]) for p in self.merged(text)])

    def word_ids(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        run = SPACE + word
        ids = self.cut_ids(run) if len(run) <= 24 and "\n" not in run else self.run_ids(run)
        self.fresh.append((word, ids))
        return ids

    def run_ids(self, run: str) -> bytes:
        """Cuts wherever no piece holds the two characters side by side: no merge can cross there."""
        cuts = [0, *(i for i in range(1, len(run)) if run[i - 1 : i + 1] not in self.joined), len(run)]
        return b"".join([self.parts[run[a:b]] for a, b in itertools.pairwise(cuts)])

    def words_ids(self, words: list[str]) -> list[bytes]:
        """word_ids of many words: one merge of each at a time, those of like lengths together."""
        if len(words) < FEW:
            return [self.word_ids(w) for w in words]
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lens, kind="stable")
        short = int(np.searchsorted(lens[order], _Pairs.PLACES - 1))
        for i in order[short:].tolist():
            out[i] = self.run_ids(SPACE + words[i])
        for first in range(0, short, MANY):
            some = order[first : min(short, first + MANY)].tolist()
            for i, ids in zip(some, self._merged_many([SPACE + words[i] for i in some]), strict=True):
                out[i] = ids
        self.fresh.extend(zip(words, out, strict=True))
        return out

    def _merged_many(self, runs: list[str]) -> list[bytes]:
        """Ids of each run, shorter than _Pairs.PLACES - 1. A column of the matrices is a run between pads, a row a place in it."""
        pairs, n, places = self.pairs, len(runs), _Pairs.PLACES
        lens = np.fromiter(map(len, runs), np.int64, n)
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        rows = int(lens.max()) + 2
        inside = np.arange(1, rows - 1)[None, :] <= lens[:, None]
        symbol = np.full((n, rows), pairs.pad, np.int32)
        symbol[:, 1:-1][inside] = pairs.of_code[codes]
        symbol = np.ascontiguousarray(symbol.T)
        done = np.full((rows, n), GONE, np.int32)
        column = np.arange(n)
        place = np.arange(rows)[:, None]
        agenda = np.full((rows, n), pairs.none)  # rank of the pair that begins at a place, the place, the merged symbol
        agenda[:-1] = pairs.find(symbol[:-1].ravel(), symbol[1:].ravel()).reshape(rows - 1, n)
        agenda += place << pairs.BITS
        before, after = (np.repeat((place + step).astype(np.int8), n, axis=1) for step in (-1, 1))
        while True:
            best = agenda.min(axis=0)
            at = np.flatnonzero(best < pairs.none)
            wide = len(best)
            if 2 * len(at) <= wide:  # the ended ones leave
                ended = best >= pairs.none
                done[:, column[ended]] = symbol[:, ended]
                if not len(at):
                    break
                symbol, agenda, before, after = (x.take(at, axis=1) for x in (symbol, agenda, before, after))
                column, best, wide = column[at], best[at], len(at)
                at = np.arange(wide)
            elif len(at) < wide:
                best = best[at]
            s, a, b, f = (x.reshape(-1) for x in (symbol, agenda, before, after))
            both = best & pairs.SYMBOL
            p = best >> pairs.BITS & places - 1
            i = p * wide + at
            q = f[i].astype(np.int64)
            j = q * wide + at
            r, o = f[j].astype(np.int64), b[i].astype(np.int64)
            k, h = r * wide + at, o * wide + at
            s[i], s[j], a[j], f[i], b[k] = both, GONE, pairs.none, r, p
            new = pairs.find(np.concatenate([s[h], both]), np.concatenate([both, s[k]]))
            a[h], a[i] = new[: len(at)] + (o << pairs.BITS), new[len(at) :] + (p << pairs.BITS)
        left = np.ascontiguousarray(done[1:-1].T)
        stays = (left != GONE) & (left != pairs.pad)
        ids = pairs.ids[left[stays]]
        width = np.ones(len(ids), np.int64)
        spelled = np.flatnonzero(ids < 0)  # characters that are no piece: the ids of their bytes
        if len(spelled):
            where = np.zeros(left.shape, np.int64)
            where[inside] = codes
            chars = where[stays][spelled]
            width[spelled] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        ends = np.cumsum(width)
        out = np.zeros(int(ends[-1]), np.uint32)
        whole = ids >= 0
        out[ends[whole] - 1] = ids[whole]
        if len(spelled):
            spell = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            wide = width[spelled]
            out[np.repeat(ends[spelled] - np.cumsum(wide), wide) + np.arange(len(spell))] = self.byte_ids[spell]
        cuts = [0, *(ends[np.cumsum(stays.sum(axis=1)) - 1] * 4).tolist()]
        blob = out.astype("<u4").tobytes()
        return [blob[x:y] for x, y in itertools.pairwise(cuts)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode of each text; the words that are not known yet are merged together."""
        first, last = self.ends
        split: list[list[str]] = []
        out: list[bytes] = []
        for text in texts:
            ids, words = b"", []
            if not text:
                ids = first + last
            else:
                if SPACE in text:
                    text = text.replace(SPACE, " ")  # the normaliser makes both the same symbol
                words = text.split(" ")
                if "" in words:
                    ids = b"".join([first, *map(self.run_ids, re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))), last])
                    self.odd.append((text, ids))
                    words = []
            out.append(ids)
            split.append(words)
        here: dict[str, bytes | None] = dict.fromkeys(itertools.chain.from_iterable(split))
        here = dict(zip(here, map(self.known.get, here), strict=True))
        fresh = [w for w, ids in here.items() if ids is None]
        if fresh:
            made = self.words_ids(fresh)
            here.update(zip(fresh, made, strict=True))
            self.known.learn(fresh, made)
        for i, words in enumerate(split):
            if words:
                out[i] = b"".join([first, *map(here.__getitem__, words), last])
        return out

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, begin and end ids included, as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())

    def decode_all(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1)

    def agree(self, texts: list[str | None], ids: list[bytes]) -> None:
        for text, own, theirs in zip(texts, ids, self.library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1), strict=True):
            if own != np.array(theirs, "<u4").tobytes():
                raise ValueError(f"ids differ from the library's for {text!r:.200}")

    def agree_fresh(self) -> None:
        """Compares what has been encoded for the first time since the last call."""
        for rows, ends in ((self.fresh, False), (self.odd, True)):
            if rows:
                theirs = self.library.encode([t for t, _ in rows], add_bos=ends, add_eos=ends, num_threads=1)
                flat = np.fromiter(itertools.chain.from_iterable(theirs), "<u4").tobytes()
                if flat != b"".join([own for _, own in rows]) or any(4 * len(ids) != len(own) for ids, (_, own) in zip(theirs, rows, strict=True)):
                    text = next(t for (t, own), ids in zip(rows, theirs, strict=True) if own != np.array(ids, "<u4").tobytes())
                    raise ValueError(f"ids differ from the library's for {text!r:.200}")
                rows.clear()


class _Pairs:
    """The vocabulary's pairs as a hash table of numbers: of two symbols side by side, the rank and the number of what they merge to.

    Symbols are the pieces, the characters of pieces, one for all other characters and a pad, which merges with nothing.
    """

    PLACES, BITS = 64, 24  # a number holds a rank, one of the places, and a symbol of so many bits
    SYMBOL = (1 << BITS) - 1
    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, ids: dict[str, int], rank: dict[str, int]):
        chars = sorted({c for p in ids for c in p})
        number = {s: k for k, s in enumerate([*ids, *(c for c in chars if c not in ids)])}
        self.pad, other = len(number), len(number) + 1
        self.ids = np.array([*ids.values(), *[-1] * (other + 1 - len(ids))], np.int64)
        self.of_code = np.full(0x110000, other, np.int32)
        self.of_code[[ord(c) for c in chars]] = [number[c] for c in chars]
        self.base = other + 1
        rows = [(number[p[:i]] * self.base + number[p[i:]], rank[p], number[p]) for p in ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        keys = np.array([r[0] for r in rows], np.int64)
        self.none = np.int64(1 << 62)
        self.value = np.array([self.none, *(r[1] << self.BITS + 6 | r[2] for r in rows)], np.int64)
        self.bits = max(4, (4 * len(rows)).bit_length())
        self.keys, self.row = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, at = np.arange(len(rows)), self.slot(keys)
        while len(todo):  # to the first free slot from its own on; of several that want one, one gets it
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[todo[free]]
            won = self.keys[at] == keys[todo]
            self.row[at[won]] = todo[won] + 1
            todo, at = todo[~won], at[~won] + 1 & len(self.keys) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(self.FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and symbol of what each left and right merge to, with room for the place between them; none if there is no such piece."""
        keys = left.astype(np.int64) * self.base + right
        at = self.slot(keys)
        held = self.keys[at]
        row = np.where(held == keys, self.row[at], 0)
        more = np.flatnonzero((held != keys) & (held >= 0))
        while len(more):
            at[more] = at[more] + 1 & len(self.keys) - 1
            held = self.keys[at[more]]
            same = held == keys[more]
            row[more[same]] = self.row[at[more[same]]]
            more = more[~same & (held >= 0)]
        return self.value[row]


class _Known(dict):
    """What was made of texts met before; emptied when full, long texts and lines' ends stay out."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= 64 and ("\n" not in text or len(text) == 1):
            if len(self) >= self.most:
                self.clear()
            self[text] = ids
        return ids

    def learn(self, texts: list[str], made: list[bytes]) -> None:
        """Remembers many at once; of too many, those that have been there longest go."""
        self.update((t, ids) for t, ids in zip(texts, made, strict=True) if len(t) <= 64 and ("\n" not in t or len(t) == 1))
        if len(self) > self.most:
            for text in list(itertools.islice(self, len(self) - self.most // 2)):
                del self[text]


@functools.lru_cache(maxsize=2)
def agenda(model: bytes) -> Agenda:
    return Agenda(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def apply(df: DataFrame, model: bytes, row: Callable[[str | None, bytes, str], tuple], schema: str, key: str = "doc_id", text: str = "text", check: str = "words", slice_bytes: int = 1 << 21) -> DataFrame:
    """Encodes and decodes each text and gives row(text, ids, decoded) beside the key; schema names the columns after the key.

    Rows are taken in slices of slice_bytes of text, or a single longer text.
    """
    if check not in ("words", "all", "none"):
        raise ValueError(f"check is one of words, all, none, not {check}")
    kind = df.schema[key].dataType.simpleString()

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(model)
        names = [key, *(c.split()[0] for c in schema.split(", "))]
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                most = slice_bytes + (int(ends[first - 1]) if first else 0)
                part = batch.slice(first, max(1, int(np.searchsorted(ends, most, side="right")) - first))
                texts = part.column(1).to_pylist()
                ids = own.encode_all(texts)
                if check == "words":
                    own.agree_fresh()
                own.fresh.clear()
                own.odd.clear()
                whole = len(texts) if check == "all" else 64 if check == "words" and first == 0 else 0
                own.agree(texts[:whole], ids[:whole])
                rows = [row(t, i, back) for t, i, back in zip(texts, ids, own.decode_all(ids), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=names)
                first += len(texts)

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {schema}")


def encode(df: DataFrame, model: bytes, **options) -> DataFrame:
    """Adds ids (array of int) and decoded to the key; the operator's general form."""
    return apply(df, model, lambda t, ids, back: (np.frombuffer(ids, "<u4").astype(np.int32), back), "ids array<int>, decoded string", **options)


def digests(df: DataFrame, model: bytes, **options) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text."""
    from hashlib import sha256

    return apply(df, model, lambda t, ids, back: (len(ids) // 4, sha256(ids).hexdigest(), sha256(back.encode()).hexdigest()), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", **options)
