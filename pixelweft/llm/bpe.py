"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is written in characters that stand for bytes (the byte table). Offsets map a token's bytes to
the characters of its text; decoding joins the tokens' characters, reverses the byte table and gets the bytes.

Edge cases: a null or empty text has no tokens and decodes to no bytes; lone rows, ties and repeated
rows are encoded one by one; extra columns are ignored. Split characters: a token may hold a part of a
character; ``decode_text`` joins the bytes of all tokens before it decodes them.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, small_batches

#: White space of the Unicode property White_Space, on which the split pattern's \s relies (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of white space and what follows it: no match of the split pattern crosses from one to the next.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """A tokenizer built from ranks: bytes are mapped to characters, merges are recovered from the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        text = lambda b: "".join(chars[x] for x in b)
        merges = [(text(a), text(b)) for a, b in (self._halves(t, r, ranks) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1)]
        self.tok = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges))
        self.tok.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = max(ranks.values()) + 1
        self.table: list[str] = [""] * size  # each token in byte characters
        for t, r in ranks.items():
            self.table[r] = text(t)
        self.length = np.fromiter(map(len, self.table), np.int64, size)
        self.byte_of = np.zeros(max(map(ord, chars)) + 1, np.uint8)  # the byte table reversed
        self.byte_of[[ord(c) for c in chars]] = np.arange(256)
        self.digits = [str(i) for i in range(size)]
        self.memo = Memo(self._encode_chunks, 300_000)

    @staticmethod
    def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
        """The last merge that makes a token: its bytes merged by all lower ranks leave two parts."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) != 2:
            raise ValueError(f"token of rank {rank} can't be made by merges")
        return parts[0], parts[1]

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, text: str | None) -> list[int]:
        chunks = CHUNK.findall(text or "")
        known = self.memo.learn(set(chunks))
        out: list[int] = []
        for c in chunks:
            out += known[c]
        return out

    def offsets(self, ids: list[int], text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end characters of the tokens; the parts of a split character all span that character."""
        size = self.length[ids] if ids else np.zeros(0, np.int64)
        end = np.cumsum(size)
        begin = end - size
        if text.isascii():
            return begin, end
        char = np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80) - 1
        return char[begin], char[end - 1] + 1

    def decode(self, ids) -> bytes:
        marks = "".join(map(self.table.__getitem__, ids))
        return self.byte_of[np.frombuffer(marks.encode("utf-16-le"), "<u2")].tobytes()

    def decode_text(self, ids) -> str:
        return self.decode(ids).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends): the tokens of every text with their character offsets."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [bpe.encode(t) for t in texts]
            at = [bpe.offsets(i, t or "") if offsets else ((), ()) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([a for a, _ in at], pa.list_(pa.int32())), pa.array([b for _, b in at], pa.list_(pa.int32()))],
                ["doc_id", "ids", "starts", "ends"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = [bpe.decode_text(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One pass over the texts: encode with offsets, decode, and the digests of both.

    n_split counts the tokens that start inside a character; tiled tells whether the offsets cover the text
    from its first to its last character without a gap, and overlap only there.
    """

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in small_batches(texts):
                n, enc, dec, split, tiled = [], [], [], [], []
                for t in texts[a:b]:
                    ids = bpe.encode(t)
                    n.append(len(ids))
                    enc.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                    dec.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    start, end = bpe.offsets(ids, t or "")
                    back = end[:-1] - start[1:]  # 1 where a character is split, 0 elsewhere
                    split.append(int(np.count_nonzero(back)))
                    tiled.append(bool(not len(ids) or (start[0] == 0 and end[-1] == len(t) and ((back == 0) | (back == 1)).all())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec), pa.array(split, pa.int64()), pa.array(tiled)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "tiled"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, tiled boolean")
