"""Token alignment, exact duplicates and collocations against brute force and SQL; odd inputs."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as tok
import pytest

from pixelweft.llm import alignment, collocations, exact_dedup

from .test_llm import DOCS, none, odd

A, B = tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model")
TRICKY = ["a", " ", "  ", "a  b   c ", "x▁y", "line\n\nnext\tline \n z", "é 中文 😀 x", "<s> <|endoftext|> </s>", "a\x00b\x1c", "don't  stop'll", "1234567 89", " nb sp", "ﬁ ½ ①", "﻿bom", "‮right", "word " * 400, "q" * 3000, "a;\r\nb }\r\n  c()\r x", "\r", "end;\r"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], DOCS)


def rows_of(df, *order):
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)


def from_sql(sql, rows, columns):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"text": "string", "lang": "string"}))
    out = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    return sorted((tuple(r[names.index(c)] for c in columns) for r in out), key=repr)


# --- 11: alignment ---------------------------------------------------------------------------------------


def slow_alignment(texts):
    """Whole texts through both libraries, tokens compared one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    back = {c: b for b, c in enumerate(alignment.byte_chars())}
    docs = []
    for text in texts:
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        bytes_a = [bytes(back[c] for c in ta.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(tb.id_to_piece, b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, groups, i, j = [], [([], [])], 0, 0
        groups[-1][0].append(a[0])
        groups[-1][1].append(b[0])
        while i < len(a):
            links.append((a[i], b[j]))
            ea, eb = ends_a[i], ends_b[j]
            i, j = i + (ea <= eb), j + (eb <= ea)
            if ea == eb and i < len(a):
                groups.append(([a[i]], [b[j]]))
            elif ea < eb:
                groups[-1][0].append(a[i])
            elif eb < ea:
                groups[-1][1].append(b[j])
        docs.append((a, b, links, groups))
    count = collections.Counter(p for d in docs for p in set(d[2]))
    top = collections.defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for a, b, links, groups in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_whole_text_encoding(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in real][:120] + [(10**6 + i, t, "x") for i, t in enumerate([*TRICKY, None, ""])]
    rng = np.random.default_rng(3)
    letters = list("ab é\n ▁\t'.,1中😀\r;")
    rows += [(2 * 10**6 + k, "".join(rng.choice(letters, rng.integers(1, 40))), "x") for k in range(200)]
    got = alignment.link_statistics(frame(spark, rows), A, B).collect()
    want = dict(zip([r[0] for r in rows], slow_alignment([r[1] for r in rows]), strict=True))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert sum(w[0] > 0 for w in want.values()) > 150


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_pieces_of_the_merge(work):
    rng = np.random.default_rng(work)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n + 1), rng.integers(0, n), replace=False)), n + 1) for _ in range(2))
        i, j = alignment.diagonals(a, b, work)
        sizes = np.diff(i) + np.diff(j)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b)) and sizes.max() <= work + 1 and sizes[:-1].min(initial=work) >= work - 1
        at_a, at_b, shut = alignment.merged(a, b, work)
        ends = np.union1d(a, b)
        assert at_a.tolist() == np.searchsorted(a, ends).tolist() and at_b.tolist() == np.searchsorted(b, ends).tolist()
        assert shut.tolist() == np.isin(ends, np.intersect1d(a, b)).tolist()


def test_a_long_text_in_many_pieces():
    va, vb = alignment.load(alignment.byte_level, A), alignment.load(alignment.piece_level, B)
    texts = ["short one", "the quick brown fox! " * 2000, None, "x", "thequickbrownfox" * 500]
    want = slow_alignment(texts)
    for work in (alignment.WORK, 100):
        aligner = alignment.Aligner(va, vb, work)
        for _ in range(2):  # the second time from the memo
            counts, digests, *_ = aligner(texts)
            assert [(*c, d) for c, d in zip(counts.tolist(), digests, strict=True)] == [(*w[:4], w[6]) for w in want]


def test_a_full_memo_forgets():
    va, vb = alignment.load(alignment.byte_level, A), alignment.load(alignment.piece_level, B)
    aligner = alignment.Aligner(va, vb)
    aligner.memo.limit = 30
    rng = np.random.default_rng(0)
    for _ in range(10):
        texts = [" ".join(rng.choice(["a", "bb\r\n", ";\r", "é▁", "word", "long", *map(str, range(40))], 12)) for _ in range(4)]
        counts, digests, *_ = aligner(texts)
        assert [(*c, d) for c, d in zip(counts.tolist(), digests, strict=True)] == [(*w[:4], w[6]) for w in slow_alignment(texts)]


def test_another_byte_level_file(tmp_path):
    """Ids that don't follow the merges: the file's own library encodes."""
    import json

    said = json.loads(open(A, encoding="utf-8").read())
    vocab = said["model"]["vocab"]
    a, b = "Ġthe", "Ġa"
    vocab[a], vocab[b] = vocab[b], vocab[a]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    usual, other = alignment.byte_level(A), alignment.byte_level(str(path))
    swap = {vocab[a]: vocab[b], vocab[b]: vocab[a]}
    text = " the cat a dog <|endoftext|>"
    assert other.encode(text) == [swap.get(i, i) for i in usual.encode(text)] != usual.encode(text)


def test_alignment_of_odd_tables(spark):
    got = alignment.link_statistics(odd(spark), A, B)
    assert got.count() == 12 and got.where("doc_id = 8").count() == 2
    assert got.where("doc_id = 1").first().groups_sha256 == "" and got.where("doc_id = 6").first().n_a > 30_000
    assert alignment.link_statistics(none(spark), A, B).collect() == []


# --- 12: exact duplicates ----------------------------------------------------------------------------------


def copies(n=4000):
    rng = np.random.default_rng(1)
    texts = ["hot  text\n here", "hot text here", "hot\ttext here", "", None, " ", "warm", "warm "]
    rows = [(int(i), texts[rng.integers(0, len(texts))] if rng.random() < 0.5 else f"own {rng.integers(0, n)}  words", "en") for i in rng.permutation(n)]
    return [*rows, (0, rows[0][1], "en")]


def test_exact_duplicates_equal_sql(spark):
    rows = copies()
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = from_sql(exact_dedup.SQL, rows, columns)
    for few in (1000, 5, 1):  # most groups heavy, some, none
        assert rows_of(exact_dedup.exact_duplicates(frame(spark, rows), few), *columns) == want


def test_heavy_digests_are_all_found(spark):
    rows = frame(spark, copies()).select("doc_id", exact_dedup.text_sha256(exact_dedup.F.col("text")).alias("text_sha256")).repartition(13)
    n = rows.count()
    sizes = collections.Counter(r[0] for r in rows.select("text_sha256").collect())
    found = {r.text_sha256: r.group_size for r in exact_dedup.winners(rows, 20).collect()}
    assert found == {k: v for k, v in sizes.items() if v * 20 > n} and found


def test_more_tasks_than_sketches(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_duplicates(frame(spark, [(i, "ab"[i % 2], "x") for i in range(9)]).repartition(3), few=2)
        assert {(r.keep_id, r.group_size) for r in got.collect()} == {(0, 5), (1, 4)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_duplicates_of_odd_tables(spark):
    got = {(r.doc_id, r.kept): r for r in exact_dedup.exact_duplicates(odd(spark)).collect()}
    assert got[8, False].keep_id == 7 and got[7, True].group_size == 3 and got[None, True].keep_id is None
    assert got[1, True].text_sha256 == hashlib.sha256(b"").hexdigest() and not got[2, False].kept and got[3, True].group_size == 1
    assert exact_dedup.exact_duplicates(none(spark)).collect() == []
    left = exact_dedup.keep(odd(spark).withColumnRenamed("key", "keep_id"))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 10] and "keep_id" in left.columns


def test_exact_duplicates_stay_in_the_jvm(spark):
    plan = exact_dedup.exact_duplicates(odd(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- 13: collocations --------------------------------------------------------------------------------------


def slow_collocations(rows, least, top):
    """Counters of all phrases, one by one."""
    out = []
    by_lang = collections.defaultdict(list)
    for _, text, lang in rows:
        by_lang[lang if lang is not None else "und"].append(text or "")
    for lang, texts in by_lang.items():
        f = collections.Counter()
        n = 0
        for t in texts:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                w = [x for x in re.split("[ \t]+", piece) if x]
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min(((1000 * a * n) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out, key=repr)


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def passages(n=500):
    rng = np.random.default_rng(5)
    words = ["the", "The", "of", "a\x85b", "é", "x\x00", "ÄB", "uno ", *[f"w{k}" for k in range(30)]]
    p = 1 / np.arange(2, len(words) + 2)
    rows = []
    for i in range(n):
        w = rng.choice(words, int(rng.integers(0, 60)), p=p / p.sum()).tolist()
        text = " ".join(x + str(rng.choice(["", "", "", ".", ",\t", "\n", "  "])) for x in w)
        rows.append((i, text + (". once upon a time there was" if i % 3 == 0 else ""), [None, "und", "de", "fr"][i % 4]))
    return [*rows, rows[0], (n, None, "de"), (n + 1, "", "it"), (n + 2, "... !!", None), (n + 3, "go go " * 4000, "fr")]


@pytest.mark.parametrize("bits", [27, 12, 3])
def test_collocations_equal_counters(spark, bits):
    rows = passages()
    got = rows_of(collocations.collocations(frame(spark, rows).repartition(7), least=20, top=50, bits=bits), *PHRASES)
    assert got == slow_collocations(rows, 20, 50) and len(got) > 50


def test_collocations_equal_sql(spark):
    rows = passages(2000)
    got = rows_of(collocations.collocations(frame(spark, rows)), *PHRASES)
    assert got == from_sql(collocations.SQL, rows, PHRASES) and len(got) > 20


def test_windows_are_cut_only_where_nothing_is_lost(spark):
    docs = frame(spark, passages()).repartition(5)
    full = np.full(2**13 + 8192, 255, np.uint8)
    least = 20
    whole, cut = (collocations.windows(docs, m, 16) for m in ([full, full], collocations.seen_often(docs, least, 16)))
    assert whole.agg({"n": "sum"}).first() == cut.agg({"n": "sum"}).first() and cut.count() < whole.count()


def test_long_texts_are_cut_between_pieces():
    text = "one two three. four five, six " * 50
    parts = list(collocations.runs([_batch(["en", None], [text, "tail"])], most=100))
    assert all(len(b) <= 130 for _, t in parts for b in t) and b"tail" in [b for k, t in parts if k == "und" for b in t]
    ids = [x for _, t in parts for x in b" ".join(t).replace(collocations.END, b" ").split()]
    assert ids == re.sub("[.,]", " ", text).encode().split() + [b"tail"] or sorted(ids) == sorted(re.sub("[.,]", " ", text).encode().split() + [b"tail"])


def _batch(langs, texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], ["lang", "text"])


def test_products_past_64_bits(spark):
    big = 10**12
    rows = [("en", "x y", big, 1, 3 * 10**9 + 1, 7 * 10**9 + 3, 9 * 10**15), ("en", "x z", 5, 1, 6, 5, 17), ("en", "x z", 5, 2, 5, 6, 17)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, cut int, l long, r long, n long")
    got = {r.phrase: r for r in collocations.ranked(df, 10).collect()}
    assert got["x y"].score == 1000 * big * 9 * 10**15 // ((3 * 10**9 + 1) * (7 * 10**9 + 3)) and (got["x z"].l, got["x z"].r) == (6, 5)


def test_collocations_of_odd_tables(spark):
    assert collocations.collocations(none(spark)).collect() == []
    got = collocations.collocations(odd(spark), least=2)
    assert "word word word word word" in [r.phrase for r in got.collect()]
