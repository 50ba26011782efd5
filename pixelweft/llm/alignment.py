"""Alignment of two tokenizers over whole texts by merge-path partitioning.

Both tokenizers cut the same bytes (a space and the text). The sorted ends of A's and B's tokens are merged:
each different end closes one overlap of an A and a B token, each common end closes a group. A merge of n ends is
divided along its diagonals: one binary search for each finds how many ends of A and of B lie before it, so every
piece has the same work and none needs another. Pieces emit their overlaps and which of these close a group; the
tokens behind a piece's last closed group are stitched to the next piece's first one, as groups are numbered by running
sums. What is merged are distinct chunks of text, laid end to end, so pieces don't depend on where a chunk begins, and a
long one is many pieces. A chunk is white space and what follows it: no token of either tokenizer crosses its ends, so
both have a common end there, and a text's overlaps and groups are those of its chunks.

``align`` writes a row for each document with its pairs of ids and how often each is linked. A pair's count (the documents
that hold it) is a grouped count with map-side sums, at most |A| * |B| rows whatever the corpus; the few pairs that
many documents share go to the documents by broadcast (at most 100,000 rows), the others by a shuffle.

Most words of a corpus come again: a worker encodes and merges each distinct chunk once while its bounded memo holds it. One whose tokens don't give its bytes again makes its text one without tokens.

Edge cases: texts that are null, empty, or not given back byte for byte (U+2581 in a text, say) have zeros and ''; every
row is one document, also a repeated one or one with a null id; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, SPACE, byte_chars
from .common import Memo, attach, small_batches, table, trimmed

#: Ends in a piece of the merge.
WORK = 65_536
#: At most so many pairs are broadcast.
FEW = 100_000


class Vocabulary:
    """One tokenizer: ids of a text that begins with white space, and the bytes of each id."""

    def __init__(self, token_bytes: list[bytes], encode: Callable[[str], list[int]]):
        self.token_bytes, self.encode, self.size = token_bytes, encode, len(token_bytes)
        self.length = np.fromiter(map(len, token_bytes), np.int64, self.size)

    def of_chunks(self, chunks: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many each chunk has) of chunks laid end to end, whose bytes end at ``ends``; None where they differ."""
        joined = "".join(chunks)
        ids = self.encode(joined)
        if b"".join(map(self.token_bytes.__getitem__, ids)) != joined.encode("utf-8", "surrogatepass"):
            return None
        ids = np.array(ids, np.int64)
        stops = np.searchsorted(np.cumsum(self.length[ids]), ends)
        return ids, np.diff(stops + 1, prepend=0)


#: The split pattern of byte-level pre-tokenizers (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str) -> Vocabulary:
    """A: a byte-level BPE file of the tokenizers library; special tokens in texts are plain text.

    Where ids follow the order of merges, as they mostly do, ranks say all, and the rank library encodes faster.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    ids = dict(said["model"]["vocab"])
    ids |= {t["content"]: t["id"] for t in said.get("added_tokens", [])}
    back = {c: b for b, c in enumerate(byte_chars())}
    raw = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        raw[i] = bytes(back.get(c, 0) for c in t)
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in said["model"]["merges"]]
    order = [said["model"]["vocab"][m] for m in merges]
    usual = said["normalizer"] is None and said["pre_tokenizer"] == {"type": "ByteLevel"} | {k: v for k, v in said["pre_tokenizer"].items() if k == "trim_offsets"} | {"add_prefix_space": False} | ({"use_regex": True} if "use_regex" in said["pre_tokenizer"] else {})
    if usual and order == sorted(order):
        import tiktoken

        ranks = {raw[i]: i for t, i in said["model"]["vocab"].items() if not any(t == x["content"] for x in said.get("added_tokens", []))}
        return Vocabulary(raw, tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return Vocabulary(raw, lambda text: tok.encode(text, add_special_tokens=False).ids)


def piece_level(path: str) -> Vocabulary:
    """B: a sentencepiece model, which puts a space before its input itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    byte = re.compile("<0x([0-9A-F]{2})>")
    raw = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
    ahead = len(model.encode("x"))

    def encode(text: str) -> list[int]:
        # The model's own space goes before an x, from which no token reaches over the white space behind it.
        return model.encode("x" + text)[ahead:]

    return Vocabulary(raw, encode)


def splitter(b: Vocabulary) -> re.Pattern:
    """Chunks that no token of either crosses: white space and what follows, up to the next white space.

    A's pattern never goes from other characters on to white space. Some pieces of B do, with a carriage return for one:
    before such characters nothing is split.
    """
    crossing = {c for t in b.token_bytes if len(t) > 1 for c in re.findall(f"[^{SPACE}]([{SPACE}])", t.decode("utf-8", "replace"))}
    if " " in crossing:
        raise ValueError("a piece holds a space behind other characters: texts can't be cut at spaces")
    if not crossing:
        return CHUNK
    cross = "[" + "".join(map(re.escape, sorted(crossing))) + "]"
    return re.compile(f"[{SPACE}]*[^{SPACE}]+(?:{cross}[{SPACE}]*[^{SPACE}]+)*(?:{cross}[{SPACE}]*)?|[{SPACE}]+")


_loaded: dict[tuple, Vocabulary] = {}


def load(kind, path: str) -> Vocabulary:
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of sorted a and b is cut: numbers of a and of b before each cut, 0 and all of them included.

    All diagonals are searched together, halving what is left of each. Equal ends are never parted.
    """
    total = len(a) + len(b)
    d = np.arange(0, total, work)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        # Is the mid-th of a among the first d of the merge (a first where equal)?
        before = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        low = np.where(before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    i, j = low, d - low
    # a's end was taken and b's equal one is next: it comes along.
    tie = (i > 0) & (j < len(b))
    tie[tie] = a[i[tie] - 1] == b[j[tie]]
    return np.append(i, len(a)), np.append(j + tie, len(b))


def overlaps(a: np.ndarray, b: np.ndarray, i: int, i_to: int, j: int, j_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece: positions of the A and the B token of each overlap that ends in it, and whether a group closes there."""
    pa_, pb = a[i:i_to], b[j:j_to]
    ends = np.union1d(pa_, pb)
    at_a, at_b = np.searchsorted(pa_, ends), np.searchsorted(pb, ends)
    shut = np.zeros(len(ends), bool)
    inside = (at_a < len(pa_)) & (at_b < len(pb))
    shut[inside] = pa_[at_a[inside]] == pb[at_b[inside]]
    return at_a + i, at_b + j, shut


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of all pieces in order: (A position, B position, closes a group)."""
    i, j = diagonals(a, b, work)
    pieces = [overlaps(a, b, *p) for p in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


class Aligned:
    """Chunks encoded by both tokenizers and laid end to end, their overlaps and groups found by the merge.

    Every chunk's last end is common, so overlaps and groups belong to one chunk, whatever pieces the merge has.
    """

    def __init__(self, va: Vocabulary, vb: Vocabulary, chunks: list[str], work: int = WORK):
        self.good = np.ones(len(chunks), bool)
        a, b, self.na, self.nb = [], [], np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        self._encode(va, vb, chunks, np.arange(len(chunks)), a, b)
        self.a, self.b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        self.at_a, self.at_b, self.shut = merged(np.cumsum(va.length[self.a]), np.cumsum(vb.length[self.b]), work)
        self.chunk = np.repeat(np.arange(len(chunks)), self.na)[self.at_a]
        self.n_links = np.bincount(self.chunk, minlength=len(chunks))
        self.n_groups = np.bincount(self.chunk[self.shut], minlength=len(chunks))
        self.group = np.cumsum(self.shut) - self.shut  # stitches what pieces left open
        self.pair = self.a[self.at_a] * vb.size + self.b[self.at_b]
        self.sizes = va.size, vb.size

    def _encode(self, va: Vocabulary, vb: Vocabulary, chunks: list[str], at: np.ndarray, a: list, b: list) -> None:
        """Some thousand chunks at a time as one text; where that isn't given back, halves, down to the chunk at fault.

        White space alone would join the next chunk's, so it is a text of its own.
        """
        alone = np.array([c.isspace() for c in chunks], bool)
        stops = [0, *(np.flatnonzero(alone) + 1).tolist(), len(chunks)] if alone.any() else [0, len(chunks)]
        for lo, hi in zip(stops[:-1], stops[1:], strict=True):
            todo = [(s, min(hi, s + 4000)) for s in range(lo, hi, 4000)][::-1]
            while todo:
                s, e = todo.pop()
                part = chunks[s:e]
                ends = np.cumsum(np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in part), np.int64, e - s))
                x = va.of_chunks(part, ends)
                y = vb.of_chunks(part, ends) if x is not None else None
                if y is not None:
                    a.append(x[0])
                    b.append(y[0])
                    self.na[at[s:e]], self.nb[at[s:e]] = x[1], y[1]
                elif e - s == 1:
                    self.good[at[s]] = False
                else:
                    todo += [((s + e) // 2, e), (s, (s + e) // 2)]

    def said(self, marks: list[str]) -> list[str]:
        """``a1,a2|b1;..`` of each chunk; marks holds each id with each of its separators."""
        size_a, size_b = self.sizes
        group_a, group_b = np.empty(len(self.a), np.int64), np.empty(len(self.b), np.int64)
        group_a[self.at_a], group_b[self.at_b] = self.group, self.group
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before_b[group_a]] = self.a + size_a * last_a
        codes[np.arange(len(self.b)) + before_a[group_b] + in_a[group_b]] = 2 * size_a + self.b + size_b * last_b
        text = list(map(marks.__getitem__, codes.tolist()))
        ends = np.cumsum(self.na + self.nb).tolist()
        return ["".join(text[s:e])[:-1] for s, e in zip([0, *ends[:-1]], ends, strict=True)]  # no mark behind the last id


def marks_of(size_a: int, size_b: int) -> list[str]:
    return [f"{i}{m}" for size, ms in ((size_a, ",|"), (size_b, ",;")) for m in ms for i in range(size)]


class Aligner:
    """Aligns texts in one worker, each distinct chunk once while the memo holds it."""

    def __init__(self, va: Vocabulary, vb: Vocabulary, work: int = WORK):
        self.va, self.vb, self.work = va, vb, work
        self.split, self.marks, self.span = splitter(vb), marks_of(va.size, vb.size), va.size * vb.size
        self.memo = Memo(self._learn, 250_000)
        self._forget()

    def _forget(self) -> None:
        self.facts = np.zeros((0, 5), np.int64)  # of a chunk: A tokens, B tokens, groups, links, first place in pairs
        self.pairs, self.texts, self.bad = np.zeros(0, np.int64), [], set()

    def _learn(self, chunks: list[str]) -> range:
        if not self.memo.known:
            self._forget()
        chunks = list(chunks)
        new = Aligned(self.va, self.vb, chunks, self.work)
        first = len(self.facts)
        starts = len(self.pairs) + np.cumsum(new.n_links) - new.n_links
        self.facts = np.concatenate([self.facts, np.stack([new.na, new.nb, new.n_groups, new.n_links, starts], 1)])
        self.pairs = np.concatenate([self.pairs, new.pair])
        self.texts += new.said(self.marks)
        self.bad |= set((first + np.flatnonzero(~new.good)).tolist())
        return range(first, first + len(chunks))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(A tokens, B tokens, groups, links of each text; digests; pairs, how often, first row of each text)."""
        split = [self.split.findall(" " + t) if t else [] for t in texts]
        known = self.memo.learn(set().union(*split))
        at, digests = [], []
        for chunks in split:
            x = list(map(known.__getitem__, chunks))
            if self.bad and not self.bad.isdisjoint(x):
                x = []
            at.append(np.array(x, np.int64))
            h = hashlib.sha256()
            for s in range(0, len(x), 100_000):
                h.update((";" * (s > 0) + ";".join(map(self.texts.__getitem__, x[s : s + 100_000]))).encode())
            digests.append(h.hexdigest() if x else "")
        text = np.repeat(np.arange(len(texts)), [len(x) for x in at])
        # Equal chunks of a text count together before their pairs are laid out.
        once, times = np.unique(text * len(self.facts) + np.concatenate(at), return_counts=True) if len(text) else (np.zeros(0, np.int64),) * 2
        text, chunk = once // max(1, len(self.facts)), once % max(1, len(self.facts))
        facts = self.facts[chunk]
        counts = np.stack([np.bincount(text, facts[:, k] * times, len(texts)).astype(np.int64) for k in range(4)], 1)
        n = facts[:, 3]
        place = np.repeat(facts[:, 4] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both, where = np.unique(np.repeat(text, n) * self.span + self.pairs[place], return_inverse=True)
        often = np.bincount(where, np.repeat(times, n), len(both)).astype(np.int64)
        return counts, digests, both % self.span, often, np.searchsorted(both // self.span, np.arange(len(texts) + 1))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row per row of docs, ``row`` unlike any other."""

    narrow = load(byte_level, path_a).size * load(piece_level, path_b).size <= 2**31

    def run(batches):
        aligner = Aligner(load(byte_level, path_a), load(piece_level, path_b))
        types = pa.int32() if narrow else pa.int64(), pa.int32()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in small_batches(texts, 1_000_000):
                counts, digests, pairs, times, at = aligner(texts[s:e])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for x, t in zip((pairs, times), types, strict=True)]
                ids = batch.column(0).slice(s, e - s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(e - s)), ids, *(pa.array(counts[:, k]) for k in range(4)), pa.array(digests, pa.string()), *lists],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                row += e - s

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{'int' if narrow else 'bigint'}>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is in more.

    The highest count of an A id is one row per id of a vocabulary, so it is broadcast.
    """
    n = table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.expr(f"pair div {size_b}").cast("int").alias("a")
    top = n.groupBy(a).agg(F.max("n").alias("top"))
    return n.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_statistics(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    aligned = table(align(docs, path_a, path_b))
    counts = table(pair_counts(aligned, load(piece_level, path_b).size))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    known = attach(links, counts.withColumn("copies", F.col("n")).withColumnRenamed("n", "count"), ["pair"], "copies", FEW)
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = aligned.drop("pairs", "times").join(sums, "row", "left")
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *whole, "groups_sha256")
