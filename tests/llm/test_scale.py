"""Brute-force versions of the trained parts, hot groups, exact small sets, odd sizes of numbers, linear time."""

import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import ann, bpe, common, embedding_dedup, langid, licenses, minhash, pii, toxicity

from .test_llm import brute, sets_of


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- shared plumbing -----------------------------------------------------------------------------------


def test_memo_is_bounded_by_characters():
    memo = common.Memo(lambda words: [len(w) for w in words], limit=1000, chars=500)
    for k in range(50):
        words = {f"{k}_{i}" * 20 for i in range(3)}
        known = memo.learn(words)
        assert all(known[w] == len(w) for w in words) and sum(map(len, known)) <= 500


def test_sample_ids_are_the_least_hashes(spark):
    df = spark.range(20_000).selectExpr("id as doc_id").repartition(7)
    got = {r.doc_id for r in common.sample_ids(df.union(df), "doc_id", 50, 3).collect()}
    want = df.orderBy(F.xxhash64("doc_id", F.lit(3))).limit(50).collect()
    assert got == {r.doc_id for r in want}


def test_attach_joins_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i long, k string")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("low"))
    got = {r.i: r.low for r in common.attach(rows, facts, ["k"], "n", few=10).collect()}
    assert got == {i: 1 if i % 3 else i for i in range(300)}


# --- 1 toxicity ----------------------------------------------------------------------------------------


def slow_risk(docs, w, b, pos, unl, prior):
    """The nnPU risk of sigmoid losses, document by document."""
    def score(d):
        words = sorted(set(d))
        return max([0.0, *(sum(w[f] for _, fs in common.word_ngrams([x], toxicity.SIZES, toxicity.BITS) for f in fs) for x in words)])

    loss = lambda k, y: 1 / (1 + np.exp(y * (score(docs[k]) + b)))
    plus, minus, free = (np.mean([loss(k, y) for k in ks]) for ks, y in ((pos, 1), (pos, -1), (unl, -1)))
    return prior * plus, free - prior * minus


def test_nnpu_step_is_the_gradient_of_the_slow_risk():
    rng = np.random.default_rng(2)
    words = ["alpha", "bravo", "charly", "delta", "zwiffle", "echo"]
    docs = [[str(x) for x in rng.choice(words[:5] if i < 12 else words, 3)] for i in range(40)]
    pos, unl = np.arange(12), np.arange(12, 40)
    sample = toxicity._Sample(docs)
    w0 = toxicity.log_ratios(sample, pos, unl) + 0.0
    w1, b1 = toxicity.nnpu(sample, pos, unl, 0.2, 1, 1e-4)
    plus, rest = slow_risk(docs, w0, -1.0, pos, unl, 0.2)
    plus2, rest2 = slow_risk(docs, w1, b1, pos, unl, 0.2)
    # One small step lowers the risk, or, where the corrected part is negative, raises that part.
    assert plus2 + rest2 < plus + rest if rest >= 0 else rest2 > rest


def test_class_prior_from_positive_and_unlabelled_documents():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abdeginorstu"), 5)) for _ in range(200)]
    bad = lambda: [*rng.choice(words, 15), str(rng.choice(["zwiffle", "zwiffled", "zwifflex"]))]
    docs = [bad() for _ in range(300)] + [bad() if k % 10 == 0 else list(rng.choice(words, 15)) for k in range(1500)]
    sample = toxicity._Sample([[str(w) for w in d] for d in docs])
    assert abs(toxicity.class_prior(sample, np.arange(300), np.arange(300, 1800), 30, 0.15) - 0.1) < 0.02


# --- 2 near-duplicates of texts ------------------------------------------------------------------------


def test_small_sets_are_linked_exactly(spark):
    """Without a single band, all links of small sets are found: also those at exactly four of five."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(2, 30))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            other[rng.integers(0, len(other))] = f"w{rng.integers(0, 400)}" if rng.random() < 0.5 else "the"
            texts.append(" ".join(other + (["tail"] if rng.random() < 0.3 else [])))
    texts += ["a b c d e f", "a b c d e", "of the", "of the of"]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, texts), words=2, bands=0).collect()}
    assert got == brute(sets_of(list(enumerate(texts)), 2))


def test_half_of_all_rows_equal_and_a_third_empty(spark):
    texts = ["one two three four five six seven"] * 600 + ["", None] * 200 + [f"w{k} x{k} y{k} z{k} a{k} b{k}" for k in range(200)]
    out = minhash.near_duplicates(docs_of(spark, texts), block=4).collect()
    assert len(out) == len(texts) and {r.component_id for r in out if r.doc_id < 600} == {0}
    assert all(r.component_id == r.doc_id and r.kept for r in out if r.doc_id >= 600)


def test_blocks_of_a_large_bucket_lose_no_pair(spark):
    """Chains in one bucket: every text differs a little from the next, links are found whatever the block."""
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base[:100], *(f"v{j}" for j in range(k, k + 20))]) for k in range(0, 60, 3)]
    want = brute(sets_of(list(enumerate(texts)), 2))
    for block in (3, 512):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, texts), words=2, block=block).collect()} == want


# --- 3 near-duplicates of vectors ----------------------------------------------------------------------


def _pairs(x, label):
    u = x / np.abs(x).max(1, keepdims=True)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    return near.sum(1)


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200])
def test_divided_cells_and_any_scale_lose_no_link(spark, scale):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((40, 8))
    x = (np.repeat(centre, 12, axis=0) + rng.standard_normal((480, 8)) * 0.12) * scale
    label = rng.integers(0, 2, 480)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(480), "embedding": x.tolist(), "label": label}), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, cell=8, top=5, residents=16, others=16).collect()}
    assert [got[k] for k in range(480)] == _pairs(x, label).tolist()


def test_copies_of_one_vector_are_counted(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(400)] + [(400 + i, None, None) for i in range(300)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(out) == 700 and all((r.n_links, r.component_id) == ((399, 0) if r.vec_id < 400 else (0, r.vec_id)) for r in out)


# --- 4 licenses ----------------------------------------------------------------------------------------


def test_scan_leaves_the_users_views_alone(spark):
    spark.range(3).createOrReplaceTempView("flat_templates")
    licenses.scan(docs_of(spark, ["Released under the MIT License."])).collect()
    assert spark.table("flat_templates").count() == 3
    spark.catalog.dropTempView("flat_templates")


# --- 5 byte-level BPE ----------------------------------------------------------------------------------


def test_offsets_tile_and_characters_decode():
    import public_tokenizers

    b = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("", "plain words", "naïve – 日本語 🙂🙂 ​\n\n x", "🏳️‍🌈é́" * 5):
        ids = b.encode(text)
        start, end = b.offsets(ids, text)
        covered = np.zeros(len(text), bool)
        for s, e in zip(start, end, strict=True):
            covered[s:e] = True
        assert covered.all() and b.decode(ids).decode() == text
        # Decoding reverses the byte table: the vocabulary's characters of each token are its bytes.
        assert all(b.decode([i]) == bytes({c: k for k, c in enumerate(bpe.byte_chars())}[c] for c in b.table[i]) for i in ids)


# --- 6 nearest neighbours ------------------------------------------------------------------------------


@pytest.mark.parametrize("where", ["/root/testdata/sf0.01/embeddings.parquet", "/root/testdata/check_s/embeddings.parquet"])
def test_recall_on_tables(spark, where):
    if not os.path.exists(where):
        pytest.skip("no such table here")
    df = spark.read.parquet(where)
    got = ann.search(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).toPandas()
    t = df.where(embedding_dedup.usable()).select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy()
    hit = total = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        hit, total = hit + len(set(top) & set(rows["vec_id"])), total + len(top)
    print("recall", hit / total, "reranked", got.drop_duplicates("query_id")["reranked"].mean() / len(x))
    assert hit / total >= 0.95
    # Twenty of 500 vectors are no small share of them.
    assert len(x) < 1000 or got.drop_duplicates("query_id")["reranked"].mean() < 0.12 * len(x)


# --- 8 PII ---------------------------------------------------------------------------------------------


def test_any_text_takes_linear_time():
    model, started = pii.trained(), time.time()
    for text in ("jo@x.org " * 250_000, "7" * 5_000_000, "a." * 1_000_000, "a at b dot " * 20_000, "at " * 300_000, "x@ " * 30_000):
        pii.find(text, model)
    assert time.time() - started < 90


def test_spaced_digits_take_linear_time():
    model, took = pii.trained(), []
    for n in (4000, 16_000):
        t = time.time()
        pii.find("1 2 3 4 5 6 7 8 9 " * (n // 9), model)
        took.append(time.time() - t)
    assert took[1] < 8 * took[0]


def test_islands_are_decoded_like_all_segmentations():
    """The best of all segmentations of short islands, one by one."""
    model = pii.trained()

    def best(tokens):
        s = model.scores(*pii._segments(tokens))

        def go(at, prev):
            if at == len(tokens):
                return 0.0, []
            found = (-np.inf, [])
            for k in range(1, min(pii.LONGEST, len(tokens) - at) + 1):
                for y in range(len(pii.LABELS)):
                    if s[at + k - 1, k - 1, y] > -1e8:
                        v, rest = go(at + k, y)
                        v += s[at + k - 1, k - 1, y] + (model.t[prev, y] if prev is not None else 0)
                        found = max(found, (v, [(at, at + k, y), *rest]), key=lambda r: r[0])
            return found

        return [g for g in go(0, None)[1] if g[2]]

    for text in ("tel 944-555-6250", "jo (at) x (dot) org", "1.2.3.4 or 555-1234", "4111 1111 1111 1111"):
        tokens = pii.Tokens(text)
        assert model.decode(tokens) == best(tokens)


def test_spelled_addresses_are_cues():
    model = pii.trained()
    assert pii.redacted("mail an.the at orti dot com today", model) == "mail <EMAIL> today"
    assert pii.redacted("mail morla (at) verti (dot) org today", model) == "mail <EMAIL> today"


# --- 10 language identification ------------------------------------------------------------------------


def test_numerals_are_no_letters(spark):
    docs = docs_of(spark, ["½ ² ① Ⅷ", "١٢٣", "...", "", None, "²a", *(["der die das und"] * 8), *(["the and of to"] * 8)])
    docs = docs.withColumn("lang", F.when(F.col("text").contains("und"), "de").when(F.col("text").contains("the"), "en"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert [got[k] for k in range(5)] == ["und"] * 5 and got[5] in ("de", "en")


def test_ftrl_equals_a_loop():
    rng = np.random.default_rng(8)
    rows = [(np.unique(rng.integers(0, 30, 6)), None) for _ in range(25)]
    rows = [(f, rng.random(len(f))) for f, _ in rows]
    y = rng.integers(0, 3, 25)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.1
    w, b = langid._ftrl(rows, y, 3, 2, alpha, beta, l1, l2)
    z, n, bias = {}, {}, -1

    def weight(f, k):
        zz, nn = z.get((f, k), 0.0), n.get((f, k), 0.0)
        if f == bias:
            return -zz / ((beta + nn**0.5) / alpha)
        return 0.0 if abs(zz) <= l1 else -(zz - np.sign(zz) * l1) / ((beta + nn**0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(25):
            at = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), (bias, 1.0)]
            own = {(f, k): weight(f, k) for f, _ in at for k in range(3)}
            s = np.array([sum(own[f, k] * v for f, v in at) for k in range(3)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for f, v in at:
                for k in range(3):
                    g = v * (p[k] - (k == y[i]))
                    was = n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - ((was + g * g) ** 0.5 - was**0.5) / alpha * own[f, k]
                    n[f, k] = was + g * g
    assert all(abs(w[f, k] - weight(f, k)) < 1e-9 for f in range(30) for k in range(3))
    assert np.allclose(b, [weight(bias, k) for k in range(3)])


def test_scorer_equals_counting_ngrams():
    rng = np.random.default_rng(9)
    m = langid.LangModel(["x", "y"], rng.standard_normal((1 << langid.BITS, 3)).astype(np.float32) ** 2, np.array([0.1, -0.2]), 1.5)
    text = "Some words, some words again"
    counts = {}
    for word in text.lower().split():
        for _, fs in common.word_ngrams([word], langid.SIZES, langid.BITS):
            for f in fs.tolist():
                counts[f] = counts.get(f, 0) + 1
    s = [sum(c * float(m.weights[f, k]) for f, c in counts.items()) / sum(c * float(m.weights[f, 2]) for f, c in counts.items()) for k in (0, 1)]
    u = [(s[k] + m.bias[k]) / m.temperature for k in (0, 1)]
    (lang,), (p,) = langid.Scorer(m)([text])
    assert lang == ("x", "y")[int(u[1] > u[0])] and abs(p - 1 / (1 + np.exp(-abs(u[0] - u[1])))) < 1e-5


# --- the pipeline --------------------------------------------------------------------------------------


def test_pipeline_takes_odd_tables(spark, tmp_path):
    import corpus_pipeline

    con = duckdb.connect()
    texts = [None, "", "...", "  ", "the cat sat on the mat " * 5, "the cat sat on the mat " * 5, "word " * 3000, "🙂é" * 50]
    rows = pd.DataFrame({"doc_id": range(48), "text": [texts[i % 8] for i in range(48)], "lang": "en", "source": "s", "n_chars": 1, "roles": "r", "component_id": 5, "rank": 1, "d": 2, "f": 3})
    for name, n in (("full", 48), ("none", 0)):
        (tmp_path / name).mkdir()
        part = rows.head(n)
        con.execute(f"copy (select doc_id::bigint doc_id, text::varchar as text, * exclude (doc_id, text) from part) to '{tmp_path}/{name}/documents.parquet'")
        con.execute(f"copy (select doc_id::bigint doc_id, 1 quality, (doc_id % 7 = 0)::int toxic from part) to '{tmp_path}/{name}/labels.parquet'")
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(out) > 0) == (n > 0)
