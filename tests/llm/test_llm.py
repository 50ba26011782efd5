"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy; odd inputs."""

import base64
import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import ann, bpe, chat, embedding_dedup, langid, licenses, minhash, packing, pii, queries, toxicity
from pixelweft.llm.common import components, running

from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "é 中文 😀 x"), (6, LONG), (7, "same words here now ok"), (8, "same words here now ok"), (8, "same words here now ok"), (None, "no id at all here"), (9, "1" * 5000), (10, "a\x00b \x1c c")]


def odd(spark, extra=True):
    rows = [(i, t, "en", "s", 1, 2.0, "k") for i, t in ODD]
    df = spark.createDataFrame(rows, DOCS + ", score double, key string")  # names that operators use themselves
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def none(spark):
    return spark.createDataFrame([], DOCS)


def table(name):
    return duckdb.connect().execute(f"select * from '{DATA}/{name}.parquet'").fetchdf()


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


# --- plumbing ------------------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(80)]
    par = {x: x for p in pairs for x in p}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        par[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in par} == {x: find(x) for x in par}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running(spark):
    rows = [("a", i, i % 7) for i in range(50)] + [(None, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r.k, r.i): r.s for r in running(df, ["k"], F.floor(F.col("i") / 8), ["i"], "s", F.col("v")).collect()}
    assert got == {(k, i): sum(v for k2, j, v in rows if k2 == k and j < i) for k, i, _ in rows}


# --- 1 toxicity ----------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abdeginorstu"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text, bad = list(rng.choice(words, rng.integers(20, 60))), i % 8 == 0
        if bad:
            text[3:3] = [str(rng.choice(["zwiffle", "zwiffled", "zwifflex"]))]
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert all(r.held_out == (fold(i) == 1) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 8 == 0) for i in held]) > 0.97
    assert {r.doc_id for r in toxicity.keep(docs, marks).collect()} == {i for i, r in got.items() if r.score < 0.7}


def test_toxicity_never_reads_held_out_labels(spark):
    docs = spark.createDataFrame([(i, "fine words only") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(60) if fold(i) == 1], "doc_id long, toxic int")
    assert all(r.score == 0 for r in toxicity.toxicity(docs, marks).collect())


def test_toxicity_odd(spark):
    marks = spark.createDataFrame([(4, 1), (7, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd(spark), marks).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(none(spark), marks).count() == 0
    assert toxicity.toxicity(odd(spark), spark.createDataFrame([], "doc_id long, toxic int")).count() == len(ODD)


def test_calibration_holds_rare_labels(spark):
    """One toxic row in a sample caps Platt's target at 2/3, under the threshold; drawn by class there are dozens."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abdeginorstu"), 5)) for _ in range(300)]
    rows = [(i, " ".join([*rng.choice(words, 12), *(["zwiffle"] if i % 200 == 7 else [])])) for i in range(12_000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 200 == 7)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, marks, calibration=200).where("held_out").collect()}
    assert {i for i, p in got.items() if p} == {i for i in got if i % 200 == 7}


def test_nnpu_corrects_the_prior():
    """Unlabelled data with hidden positives: their word must still score high, common words must not."""
    docs = [["bad", "some"]] * 50 + [["bad", "thing"]] * 20 + [["fine", "some", "thing"]] * 180
    s = toxicity._Sample(docs)
    w, _ = toxicity.nnpu(s, np.arange(50), np.arange(50, 250), 0.1, 40, 0.15)
    score = dict(zip(s.words, s.scores(w), strict=True))
    assert score["bad"] > 2 and score["fine"] < score["bad"] - 2
    assert np.allclose(s.scores(w), toxicity.word_scores(s.words, w.astype(np.float32)), atol=1e-3)


# --- 2 near-duplicates of texts ------------------------------------------------------------------------


def sets_of(texts, n):
    out = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute(sets):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 80 * (len(x) + len(y) - k):
                    u, v = sorted((find(a), find(b)))
                    root[v] = u
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_brute_force(spark, n):
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    texts, k = [], 0
    for size in (8, 30, 90, 200):
        base = list(rng.choice(words, size))
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12):
            t = list(base)
            for p in rng.integers(0, size, edits if size > 20 else edits // 3):
                t[p] = str(rng.choice(words))
            texts.append((k, " ".join(t)))
            k += 1
    # A chain whose ends are no links.
    base = list(rng.choice(words, 120))
    for step in range(8):
        base[step * 12 : step * 12 + 4] = rng.choice(words, 4)
        texts.append((k, " ".join(base)))
        k += 1
    texts += [(k + j, t) for j, t in enumerate(["Two Words", "two  words", "x", "X", "", None])]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=n).collect()}
    sets = sets_of(texts, n)
    want = brute(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())


def test_min_max_bands():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(x[:360]), np.unique(x[40:])  # similarity 0.8
    keys = minhash._bands([a, b, a], 4000, 2)
    same = (keys[0] == keys[1]).mean()
    assert (keys[0] == keys[2]).all() and abs(same - 0.64) < 0.05  # one permutation: minimum and maximum agree


def test_parity_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(0, 2**63, 600).astype(np.uint64)
        a, b = np.unique(x[: rng.integers(1, 600)]), np.unique(x[rng.integers(0, 500) :])
        m = minhash._parity([a, b]).view(np.uint64)
        assert sum(bin(int(p ^ q)).count("1") for p, q in zip(*m, strict=True)) <= len(np.setxor1d(a, b))


def test_near_duplicates_odd(spark):
    out = minhash.near_duplicates(odd(spark), words=2).collect()
    assert len(out) == len(ODD)
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert by[1][0].n_shingles == 0 and by[1][0].component_id == 1 and by[7][0].kept and not by[8][0].kept and by[8][0].component_id == 7
    assert by[None][0].component_id is None and by[None][0].kept
    assert minhash.near_duplicates(none(spark)).count() == 0
    kept = minhash.keep(odd(spark, False), words=2)
    assert kept.columns == odd(spark, False).columns and 8 not in {r.doc_id for r in kept.collect()}
    twice = minhash.keep(odd(spark, False).where("doc_id = 7 or doc_id = 4 or doc_id is null").union(odd(spark, False).where("doc_id = 7")))
    assert sorted(str(r.doc_id) for r in twice.collect()) == ["4", "7", "None"]


# --- 3 near-duplicates of vectors ----------------------------------------------------------------------


def test_embedding_dedup_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(30):
        c = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            v = c + rng.standard_normal(16) * 0.06
            rows.append((len(rows), v.astype("f4").tolist(), g % 3))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(5)]  # exact copies
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell=16, residents=8, others=16).collect()}
    x = np.array([r[1] for r in rows], "f4").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    adj = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(adj, False)
    root = np.arange(len(rows))
    for _ in rows:
        root = np.minimum(root, np.where(adj, root[None], len(rows)).min(1))
    assert adj.sum() > 50 and [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(rows))] == [(int(adj[i].sum()), int(root[i]), root[i] == i) for i in range(len(rows))]


def test_embedding_dedup_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert (got[1].n_links, got[3].n_links, got[3].component_id) == (1, 1, 1)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (2, 4, 5, 6, 7, 8, 9, 10))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- 4 licenses ----------------------------------------------------------------------------------------


def test_license_scan_brute_force(spark):
    norm = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).split()
    rng = np.random.default_rng(0)
    filler = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 2):
        before, after = rng.integers(0, 300, 2)
        rows.append((i, " ".join([*rng.choice(filler, before), text.upper() if i % 2 else text, *rng.choice(filler, after)])))
    rows += [(100, " ".join(rng.choice(filler, 500))), (101, "released under the license"), (102, None)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i, t in rows:
        own = shingles(norm(t or ""))
        want |= {(i, n) for n, text in licenses.TEMPLATES.items() if len(own & shingles(norm(text))) >= 0.8 * len(shingles(norm(text)))}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license_id) for r in got} == want and len(want) >= 30
    plan = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ExistingRDD", ""))


def test_license_scan_odd(spark):
    assert licenses.scan(odd(spark)).count() == 0 and licenses.scan(none(spark)).count() == 0


# --- 5 byte-level BPE ----------------------------------------------------------------------------------


def test_bpe_equals_reference_library(spark):
    import tiktoken

    path = tok.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in ODD if i is not None and i != 8] + [(20, "It's 12'll  \n x y  z <|endoftext|> 'S ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_documents(df, path, tok.PATTERN).collect()}
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df, path, tok.PATTERN), path, tok.PATTERN).collect()}
    dig = {r.doc_id: r for r in bpe.round_trip_digests(df, path, tok.PATTERN).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and back[i] == (t or "") and dig[i].n_tokens == len(ids)
        assert dig[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert dig[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        for a, b, k in list(zip(got[i].starts, got[i].ends, ids, strict=True))[:50]:
            assert enc.decode_single_token_bytes(k) in t[a:b].encode()


def test_bpe_split_characters():
    b = bpe.load(tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    text = "😀𝕏"
    ids = b.encode(text)
    start, end = b.offsets(ids, text)
    assert len(ids) > 2 and b.decode_text(ids) == text and set((end - start).tolist()) == {1}


# --- 6 nearest neighbours ------------------------------------------------------------------------------


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))).astype("f4")
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(1500), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), bits=128, shard=128, block=32).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        top = np.lexsort((np.arange(1500), -s))[:20]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(s[v] - c) < 1e-9 for _, v, c in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hit += len(set(top.tolist()) & {r[1] for r in rows})
    assert hit / (75 * 20) >= 0.9


def test_pigeonhole_probing_is_complete():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 8)).astype(np.uint8)
    codes[:100] = codes[7] ^ (1 << rng.integers(0, 8, (100, 8))).astype(np.uint8) * (rng.random((100, 8)) < 0.3)
    index = ann.MultiIndex(codes)
    for r in (0, 5, 8, 15, 20, 30):
        d = np.unpackbits(codes ^ codes[7], axis=1).sum(1)
        near = np.flatnonzero(d <= r)
        assert set(near) <= set(index.probe(codes[7], r // 8))
        assert np.array_equal(index.within(codes[7], r), np.flatnonzero(d <= r))


def test_search_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [-1.0, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, q).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (0, 3, 5), (20, 1, 0), (20, 2, 1), (20, 3, 5)]
    assert ann.search(df.where("vec_id = 0"), q.where("query_id = 0")).count() == 0 and ann.search(df.limit(0), q).count() == 0


# --- 7 packing -----------------------------------------------------------------------------------------


def bfd(lengths, cap):
    import bisect

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, x)
        if k == len(rooms):
            n += 1
            bisect.insort(rooms, cap - x)
        else:
            bisect.insort(rooms, rooms.pop(k) - x)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.integers(5, 60))
    lengths = rng.integers(1, cap + 1, rng.integers(1, 400)).tolist() if seed % 2 else np.minimum(cap, rng.geometric(0.15, 300)).tolist()
    counts = collections.Counter(lengths)
    rules = packing.plan(dict(counts), cap)
    bins = collections.defaultdict(list)
    for length, first, last, seq, each, off in rules:
        for k in range(first, last):
            bins[seq + (k - first) // each].append((off + (k - first) % each * length, length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    assert collections.Counter(n for b in bins.values() for _, n in b) == counts and len(bins) == bfd(lengths, cap)


def test_capacity_tree():
    t = packing.CapacityTree(20)
    for room, n in ((3, 2), (7, 1), (20, 1)):
        t.add(room, n)
    assert [t.tightest(k) for k in (1, 3, 4, 7, 8, 20)] == [3, 3, 7, 7, 20, 20]
    t.add(20, -1)
    assert t.tightest(8) == -1


def test_pack_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    rows = [(i, x) for i, x in ODD if i is not None] + [(30 + k, x) for k, x in enumerate(["Ärger ΣΑΣ İstanbul ab.", "it's a'll, b.c. ... ,", "éa   x\u0085y", "Hello, WORLD. 12 3!", "don't. stop, 'tis"])]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tok.path("word_bpe_49k.json"), with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i])
        assert got == sorted(want * sum(1 for j, _ in rows if j == i)), (i, x[:30] if x else x)
        assert b"".join(r.ids for r in sorted(by[i], key=lambda r: r.piece)) == ids.tobytes() * sum(1 for j, _ in rows if j == i)
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == bfd([r.length for r in out], 2048)
    assert packing.pack(none(spark), tok.path("word_bpe_49k.json")).count() == 0 and packing.pack(odd(spark), tok.path("word_bpe_49k.json")).count() >= len(ODD)


# --- 8 personal data -----------------------------------------------------------------------------------

PATTERNS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 14 <= len(d) <= 19 and pii.luhn(d)), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 10 <= len(d) <= 15))


def naive_spans(t):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(m[0], re.sub("[^0-9]", "", m[0])))


def test_base_spans_brute_force():
    rng = np.random.default_rng(0)
    parts = [*"ab1@.-+ ()_%9425", "45.", "1.2", "a@b.c", "4111 1111 1111 1111", "+1 (944) 555-6250"]
    for _ in range(2000):
        t = "".join(rng.choice(parts, rng.integers(1, 30)))
        assert pii.base_spans(t) == naive_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_take_linear_time():
    import time

    t = time.time()
    for x in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@" * 100_000, "a@" * 100_000):
        pii.base_spans(x)
    assert time.time() - t < 10


def test_model_adds_what_the_base_misses():
    m, hit, miss, wrong = pii.trained(), 0, 0, 0
    for t, spans in pii.synthetic(150, 99):
        got, want = {(a, k + 1, b) for a, k, b in pii.find(t, m)[1]}, {(a, y, b) for a, b, y in spans}
        hit, miss, wrong = hit + len(got & want), miss + len(want - got), wrong + len(got - want)
    assert hit / (hit + miss) > 0.95 and wrong / hit < 0.05
    clean = "Version 1.2.3 of 2024-01-15 cost $300.25, order 123456789012, at 10:30. At home, the dot."
    assert pii.find(clean, m) == ([], [])
    assert pii.redacted("write to jo@x.org, or call (944) 555-6250 now", m) == "write to <EMAIL>, or call <PHONE> now"


def test_model_sees_numbers_next_to_base_spans():
    m = pii.trained()
    assert pii.redacted("card 4111 1111 1111 1111 (555) 123-4567", m) == "card <CARD> <PHONE>"
    assert pii.redacted("host 10.20.30.40 (555) 123-4567", m) == "host <IP> <PHONE>"
    assert pii.redacted("call +1 555 123 4567 / 555-987-6543 now", m) == "call <PHONE> / <PHONE> now"
    assert pii.redacted("call (555) 123-4567 / 10.20.30.40 or so", m) == "call <PHONE> / <IP> or so"


def test_model_takes_linear_time_between_many_base_spans():
    import time

    m, t = pii.trained(), time.time()
    text = ("1.2.3.4 " + "ab " * 40) * 8000
    assert len(pii.find(text, m)[1]) == 8000 and time.time() - t < 20


def test_semi_markov_gradient_and_decoding():
    m = pii.SemiMarkov()
    rng = np.random.default_rng(0)
    m.w, m.t = rng.standard_normal(m.w.shape) * 0.1, rng.standard_normal(m.t.shape) * 0.1
    text = "call 944-555-6250 or jo@x.org"
    tokens = pii.Tokens(text)
    seg, may = pii._segments(tokens)
    gold = [(0, 1, 0), (1, 6, 4), (6, 7, 0), (7, 12, 1)]
    s = m.scores(seg, may)

    def paths(at, prev):
        if at == len(tokens):
            yield 0.0, []
            return
        for k in range(1, min(pii.LONGEST, len(tokens) - at) + 1):
            for y in range(len(pii.LABELS)):
                if may[at + k - 1, k - 1, y]:
                    here = s[at + k - 1, k - 1, y] + (m.t[prev, y] if prev is not None else 0)
                    for v, rest in paths(at + k, y):
                        yield here + v, [(at, at + k, y), *rest]

    every = list(paths(0, None))
    z = np.logaddexp.reduce([v for v, _ in every])
    best = max(every, key=lambda p: p[0])
    assert all(m.decode(tokens, chunk) == [g for g in best[1] if g[2]] for chunk in (1, 3, 512))

    def loglik():
        sc = m.scores(seg, may)
        v = lambda p: sum(sc[e - 1, e - b - 1, y] for b, e, y in p) + sum(m.t[p[i - 1][2], p[i][2]] for i in range(1, len(p)))
        return v(gold) - np.logaddexp.reduce([v(p) for _, p in every])

    assert np.isfinite(z)
    gw, gt = m.gradient(seg, may, gold)
    for arr, g in ((m.w, gw), (m.t, gt)):
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in arr.shape)
            arr[i] += 1e-5
            up = loglik()
            arr[i] -= 2e-5
            down = loglik()
            arr[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_pii_odd(spark):
    out = pii.detect(odd(spark)).collect()
    assert len(out) == len(ODD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out if r.doc_id != 9)
    assert pii.detect(none(spark)).count() == 0 and pii.redact(odd(spark)).columns == odd(spark).columns


# --- 9 chat --------------------------------------------------------------------------------------------


def test_preference_brute_force(spark):
    rng = np.random.default_rng(0)
    turns, pairs = [], []
    for p in range(40):
        shared = [(str(rng.choice(["user", "assistant", "system"])), f"t{rng.integers(3)}") for _ in range(rng.integers(0, 5))]
        for side in (0, 1):
            own = shared + [(str(rng.choice(["user", "assistant"])), f"t{rng.integers(3)}") for _ in range(rng.integers(0, 4))]
            turns += [(2 * p + side, 3 * k, r, t) for k, (r, t) in enumerate(own)]
        pairs.append((p, 2 * p, 2 * p + 1))
    turns += turns[:7] + [(None, 1, "user", "x"), (3, None, "user", "x")]  # repeats and nulls
    got = chat.preference(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), spark.createDataFrame(pairs, "pair_id long, chosen long, rejected long"))
    rows = collections.defaultdict(list)
    for r in got.collect():
        rows[r.pair_id, r.part].append(r)
    by = collections.defaultdict(list)
    for c, n, r, t in sorted({t for t in turns if None not in t}):
        by[c].append((r, t))
    show = lambda x: f"<|im_start|>{x[0]}\n{x[1]}<|im_end|>\n"
    for p, a, b in pairs:
        n = 0
        while n < min(len(by[a]), len(by[b])) and by[a][n] == by[b][n]:
            n += 1
        for part, want in (("prompt", by[a][:n]), ("chosen", by[a][n:]), ("rejected", by[b][n:])):
            own = sorted(rows[p, part], key=lambda r: r.pos)
            assert "".join(r.rendered for r in own) == "".join(map(show, want))
            assert [r.loss_mask for r in own] == [int(part != "prompt" and x[0] == "assistant") for x in want]
            at = 0
            for r in own:
                assert (r.start, r.end) == (at, at + len(r.rendered))
                at = r.end
    one = {r.pair_id: r for r in chat.assembled(got).collect()}
    assert all(one[p].chosen == "".join(r.rendered for r in sorted(rows[p, "chosen"], key=lambda r: r.pos)) for p in one)


def test_preference_empty(spark):
    t = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference(t, chat.neighbours(t)).count() == 0


# --- 10 languages --------------------------------------------------------------------------------------


def test_language_held_out(spark):
    d = table("documents")
    got = {r.doc_id: r for r in queries.op10_language_id(spark, DATA).collect()}
    assert len(got) == len(d)
    held = d[[fold(i) == 1 for i in d.doc_id]]
    assert np.mean([got[i].lang_pred == x for i, x in zip(held.doc_id, held.lang, strict=True)]) > 0.95
    assert all(got[i].held_out == (fold(i) == 1) and 0 <= got[i].score <= 1 for i in d.doc_id)


def test_language_rare(spark):
    """A language with 1 in 500 of the documents, of which a sample of 100 over all holds none, is learnt."""
    rng = np.random.default_rng(5)
    alphabets = {"aa": "abdeginorstu", "bb": "acefhilmnopqu", "zz": "jkvwxyzqgb"}
    words = {k: ["".join(rng.choice(list(a), rng.integers(2, 8))) for _ in range(300)] for k, a in alphabets.items()}
    lang = lambda i: "zz" if i % 500 == 3 else ("aa", "bb")[i % 2]
    rows = [(i, " ".join(rng.choice(words[lang(i)], 15)), lang(i)) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, sample=100).where("held_out").collect()}
    rare = [i for i in got if lang(i) == "zz"]
    assert len(rare) > 2 and all(got[i].lang_pred == "zz" and got[i].score >= 0.5 for i in rare)
    assert np.mean([r.lang_pred == lang(i) for i, r in got.items()]) > 0.99


def test_document_frequencies_are_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    n, df = langid.document_frequencies(docs)
    want = [f for f in (langid._counts(r.text)[0] for r in docs.collect() if r.text) if len(f)]
    assert n == len(want) and (df == np.bincount(np.concatenate(want), minlength=len(df))).all()


def test_language_odd(spark):
    out = {r.doc_id: r for r in langid.identify(odd(spark)).collect()}
    assert len(out) == len({i for i, _ in ODD}) and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 9))
    assert langid.identify(none(spark)).count() == 0
    unlabelled = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.keep(odd(spark)).columns == odd(spark).columns


def test_temperature_and_sparsity(spark):
    m = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert 0.25 <= m.temperature <= 4 and (m.weights[:, :-1] == 0).mean() > 0.3


# --- pipeline ------------------------------------------------------------------------------------------


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols, before = docs.columns, docs
    toxic = {r.doc_id for r in queries.op1_toxicity(spark, DATA).where("predicted = 1").collect()}
    kept = {}
    for name, f in cp.STAGES[:-1]:
        out = f(spark, before, DATA)
        assert out.columns == cols
        rows = {r.doc_id: r.text for r in out.collect()}
        kept[name] = rows
        before = spark.createDataFrame(out.collect(), out.schema)
    d = table("documents")
    assert set(kept["toxicity"]) == set(d.doc_id) - toxic
    assert len(kept["language_id"]) > 0.98 * len(kept["toxicity"])
    want = brute(sets_of(sorted(kept["language_id"].items()), 5))
    assert set(kept["minhash_dedup"]) == {i for i, r in want.items() if i == r}
    m = pii.trained()
    assert kept["pii"] == {i: pii.redacted(t, m) for i, t in kept["minhash_dedup"].items()}
    last = cp.STAGES[-1][1](spark, before, DATA).collect()
    assert {r.doc_id for r in last} == set(kept["pii"])
    run = cp.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    a, b = ({tuple(r) for r in x[cols].itertuples(index=False)} for x in (got, want))
    assert a == b


def test_shared_folder_is_the_sessions(spark):
    from pixelweft.llm.common import shared_root

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == named.rstrip("/") if named else os.path.isdir(shared_root(spark)[7:])
