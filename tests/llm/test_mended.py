"""Names, types and sizes that operators once failed on."""

import numpy as np
from pyspark.sql import functions as F

from pixelweft.llm import chat, embedding_dedup, langid, minhash, pii, toxicity

from ..conftest import DATA
from .test_llm import DOCS


def test_near_duplicates_with_a_clashing_column(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "other words", "en", "s", 1)], DOCS)
    for name in ("kept_id", "kept", "own", "component_id", "node"):
        got = minhash.keep(docs.withColumn(name, F.lit(7)))
        assert sorted(r.doc_id for r in got.collect()) == [1, 3] and name in got.columns


def test_labels_of_any_type(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = sorted(map(tuple, embedding_dedup.near_duplicates(rows).collect()))
    for kind in ("bigint", "string", "smallint"):
        got = embedding_dedup.near_duplicates(rows.withColumn("label", F.col("label").cast(kind)))
        assert sorted(map(tuple, got.collect())) == want


def test_conversations_with_large_ids(spark):
    a = 2**60 + 2
    turns = spark.createDataFrame([(a, 0, "user", "hi"), (a + 1, 0, "user", "hi"), (a, 1, "assistant", "yes"), (a + 1, 1, "assistant", "no"), (-4, 0, "user", "x"), (-3, 0, "user", "y")], "conv_id long, turn int, role string, text string")
    got = {(r.pair_id, r.part, r.pos) for r in chat.preference(turns, chat.neighbours(turns)).collect()}
    assert got == {(a // 2, "prompt", 0), (a // 2, "chosen", 1), (a // 2, "rejected", 1), (-2, "chosen", 0), (-2, "rejected", 0)}


def test_preferences_read_their_turns_once(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    plan = chat.preference(turns, chat.neighbours(turns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 10 and "conversations.parquet" not in plan


def test_the_most_frequent_languages_are_learnt(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, (lang, n) in enumerate([("aa", 60), ("bb", 50), ("cc", 40), *((f"x{j:02}", 2) for j in range(30))]):
        letters = list("abcdefghijklmnop"[k % 8 : k % 8 + 6])
        rows += [(len(rows) + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(20)), lang, "s", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs, sample=100, most=3)
    assert model.langs == ["aa", "bb", "cc"]
    assert len(langid.fit(docs, sample=100).langs) > 10


def test_few_positives_still_teach(spark):
    rng = np.random.default_rng(1)
    words = [f"word{k}" for k in range(40)]
    rows, marks = [], []
    for i in range(240):
        toxic = i < 40
        w = rng.choice(words, 8).tolist() + (["zzgrr"] if rng.random() < (0.5 if toxic else 0.25) else [])
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert model.weights is not None and (model.weights != 0).sum() > 0


def test_a_start_without_significant_features_is_not_dead():
    texts = [["bad", "a"], ["bad", "b"], ["c", "a"], ["a", "b"], ["c"], ["b"], ["a", "c"], ["b", "c"]]
    sample = toxicity._Sample(texts)
    pos, unl = np.array([0, 1]), np.arange(8)
    assert (toxicity.log_ratios(sample, pos, unl) > 0).any()
    w, _ = toxicity.nnpu(sample, pos, unl, 0.3, 20, 0.15)
    s = sample.pooled(w)[0]
    assert s[:2].min() > s[2:].max()


def test_parts_of_other_numbers_are_no_personal_data():
    model = pii.trained()
    kinds = lambda t: {pii.KINDS[k] for _, k, _ in pii.find(t, model)[1]}
    assert "ip" not in kinds("please install version 10.2.3.400 of the tool")
    for text in ("the book has ISBN 978-3-16-148410-0 on its back", "part number 7-345-1-99812-44 of the list"):
        found = [(a, b) for a, k, b in pii.find(text, model)[1] if pii.KINDS[k] == "phone"]
        assert all(text[b - 1 : b + 1].find("-") < 0 and text[max(0, a - 1)] != "-" for a, b in found)
