"""Best-fit decreasing packing of token sequences.

Every document becomes its token ids and a closing id; only those longer than a sequence are cut.
Best-fit decreasing depends on lengths alone, and there are at most ``capacity`` of them. So the driver
packs counts: one segment tree over remaining capacities finds the tightest open bins for a length, and
bins with one history are a range of numbers. The plan (a few thousand ranges, whatever the input) says
where the k-th piece of a length goes; ranks k are taken in two levels on the executors.

Edge cases: a null or empty text is the closing id alone; repeated rows are packed each; rows with equal
ids are ordered by their content; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, running, table, trimmed

def _ragged(data: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs data[first[i] : first[i] + size[i]] for i in at, end to end, and their lengths."""
    length = size[at]
    end = np.cumsum(length)
    if not len(end):
        return data[:0], length
    return data[np.repeat(first[at] - (end - length), length) + np.arange(end[-1])], length


def _gather(pieces: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    return _ragged(np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(size) - size, size, at)


class WordTokens:
    """Token ids of texts; white space separates words for this vocabulary, so each distinct word of a
    group of texts is looked up once and the ids are gathered by word codes.

    Words of letters alone, apart from one closing full stop or comma, are lower-cased and tokenized in
    one joined call, cut again at tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        del vocab
        self.plain, self.other = Memo(self._plain, 300_000), Memo(self._each, 50_000)
        self.tails = pa.array([".", ","])

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._each(words)
        data, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        last = pc.utf8_slice_codeunits(words, -1)
        tail = pc.fill_null(pc.index_in(last, self.tails), -1).to_numpy() + 1
        core = pc.if_else(pa.array(tail > 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        plain = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring_regex(core, "[\u03a3\u0130]")))
        key = pc.if_else(plain, pc.utf8_lower(core), words).dictionary_encode()
        tail = np.where(plain.to_numpy(zero_copy_only=False), tail, 0)
        keys, at = key.dictionary.to_pylist(), key.indices.to_numpy()
        kind = np.zeros(len(keys), bool)
        kind[at] = plain.to_numpy(zero_copy_only=False)
        known = self.plain.learn({k for k, p in zip(keys, kind.tolist(), strict=True) if p})
        found = [known[k] if p else None for k, p in zip(keys, kind.tolist(), strict=True)]
        rest = [i for i, f in enumerate(found) if f is None]
        known = self.other.learn({keys[i] for i in rest if keys[i]})
        for i in rest:
            found[i] = known[keys[i]] if keys[i] else b""
        ends = self.other.learn({".", ","})
        pieces = [*found, b"", ends["."], ends[","]]
        both = np.empty(2 * len(at), np.int64)
        both[::2], both[1::2] = at, len(found) + tail
        ids, size = _gather(pieces, both)
        return ids, size[::2] + size[1::2]

    def __call__(self, texts: pa.Array, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with the closing ones behind each, and where each text starts (and all end)."""
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        codes = lists.flatten().dictionary_encode()
        n_words = pc.list_value_length(lists).to_numpy().astype(np.int64)
        data, size = self._words(codes.dictionary)
        # The closing ids are one more word behind each text.
        at = np.insert(codes.indices.to_numpy().astype(np.int64), np.cumsum(n_words), len(size))
        data, size = np.concatenate([data, closing]), np.append(size, len(closing))
        ids, length = _ragged(data, np.cumsum(size) - size, size, at)
        return ids, np.concatenate([[0], np.cumsum(length)[np.cumsum(n_words + 1) - 1]]).astype(np.int64)

    def exact(self, text: str, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text with characters that only str and Arrow take for white space."""
        ids = np.concatenate([np.frombuffer(self._each([text])[0], "<u4"), closing])
        return ids, np.array([0, len(ids)])


_loaded: dict[str, WordTokens] = {}


def load(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    end = np.array([closing], "<u4")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")

    def cut(doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        cols, data = ([], [], [], [], [], []), memoryview(ids.tobytes())
        for doc, lo, hi in zip(doc_ids, bounds.tolist(), bounds[1:].tolist(), strict=False):
            for k, a in enumerate(range(lo, hi, capacity)):
                b = min(hi, a + capacity)
                part = data[4 * a : 4 * b]
                for c, v in zip(cols, (doc, k, a - lo, b - a, zlib.crc32(part), bytes(part) if with_ids else None), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: 5 + with_ids], names[: 5 + with_ids])

    def run(batches):
        tokens = load(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            odd = pc.fill_null(pc.match_substring_regex(batch.column(1), "[\\x1c-\\x1f]"), False).to_numpy(zero_copy_only=False)
            # Groups of some 6 MB; an odd text is a group of its own.
            group = np.cumsum(odd | np.append(False, odd[:-1])) * (1 << 40) + np.cumsum(sizes) // 6_000_000
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                doc_ids, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a)
                yield cut(doc_ids, *(tokens.exact(texts[0].as_py(), end) if odd[a] else tokens(texts, end)))

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class CapacityTree:
    """A segment tree over remaining capacities: how many bins have each, and the tightest that holds a length."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base <= capacity:
            self.base *= 2
        self.most = capacity
        self.open = [0] * (2 * self.base)

    def add(self, room: int, bins: int) -> None:
        i = self.base + room
        while i:
            self.open[i] += bins
            i //= 2

    def tightest(self, length: int) -> int:
        """The smallest room >= length of an open bin, or -1."""
        i = self.base + length
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        if i <= 1:
            return -1
        while i < self.base:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.base


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counted lengths.

    Gives (length, first, last, sequence, each, offset): piece k of that length, first <= k < last, goes to
    sequence + (k - first) // each at offset + ((k - first) % each) * length. Pieces of one length fill a
    bin until it can't take another, which is what best fit does, as a bin just used is the tightest.
    """
    tree, ranges, rules, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            ranges.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        k, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                room, first, n = capacity, bins, -(-left // each)
                bins += n
            else:
                first, n = ranges[room].pop()
                each = room // length
                used = min(n, -(-left // each))
                tree.add(room, -n)
                put(room, first + used, n - used)
                n = used
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            took = full * each + rest
            rules.append((length, k, k + took, first, each, capacity - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            k, left = k + took, left - took
    return rules


def place(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add (sequence_id, offset) to pieces; parts must be stable when read again (a written table)."""
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    if not counts:
        return parts.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    rules = plan(counts, capacity)
    own: dict[int, list] = {}
    for r in rules:
        own.setdefault(r[0], []).append(r[1:])
    at = {length: np.array(x, np.int64) for length, x in own.items()}
    spread = max(512, sum(counts.values()) // 100_000)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread))
    ranked = running(parts, ["length"], bucket, ["doc_id", "piece", "ids_crc32"], "rank", F.lit(1))

    def run(batches):
        for batch in batches:
            length, k = (np.asarray(batch.column(i)) for i in (batch.schema.get_field_index("length"), batch.schema.get_field_index("rank")))
            seq, off = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for n in np.unique(length):
                own, rule = length == n, at[int(n)]
                r = rule[np.searchsorted(rule[:, 0], k[own], side="right") - 1]
                j = k[own] - r[:, 0]
                seq[own], off[own] = r[:, 2] + j // r[:, 3], r[:, 4] + j % r[:, 3] * n
            keep = [i for i, f in enumerate(batch.schema.names) if f != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(seq), pa.array(off)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema]
    return ranked.mapInArrow(trimmed(run), ", ".join([*kept, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack documents into sequences of at most ``capacity`` tokens."""
    return place(table(pieces(docs, path, capacity, with_ids=with_ids)), capacity)
