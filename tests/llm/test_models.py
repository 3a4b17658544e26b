"""Language ID, toxicity and quality: held-out accuracy, odd rows, and their parts against plain code."""

import numpy as np
import pyarrow as pa
import pytest

from lurewatch.llm import langid, quality, toxicity
from lurewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")


def remainder(doc_id, mod):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % mod


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op9_language_id"][0](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(rows) == len(docs) and rows["score"].between(0, 1).all()
    assert all(h == (remainder(d, 4) == 2) for d, h in rows["held_out"].items())
    held = rows[rows["held_out"]]
    assert (held["lang_pred"] == docs["lang"][held.index]).mean() > 0.98


def test_more_than_256_languages_are_all_learned(docs_of):
    """Each language has words of its own; beyond 256 languages n-grams share weights, but no language is left out."""
    rng = np.random.default_rng(3)
    words = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(4)] for i in range(270)}
    free = [d for d in range(3000) if remainder(d, 4) != 2]
    rows = [(free[i], " ".join(rng.choice(words[name], 12)), name, "a") for i, name in enumerate(n for n in words for _ in range(5))]
    assert langid.width_for(256) == langid.WIDTH and langid.width_for(270) == langid.WIDTH // 2
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of(rows)).collect()}
    right = {name for d, _, name, _ in rows if got[d] == name}
    assert len(right) == 270


def test_toxicity_of_held_out_documents(spark, labels):
    rows = QUERIES["op5_toxicity"][0](spark, SF).toPandas().set_index("doc_id")
    assert len(rows) == 1000 and rows["score"].between(0, 1).all() and set(rows["predicted"]) <= {0, 1}
    held = rows[rows["held_out"]].join(labels, how="inner")
    assert ((held["predicted"] == 1) & (held["toxic"] == 0)).sum() <= 2  # forty toxic rows teach little about words, but not to see what is not there
    assert held[held["toxic"] == 1]["score"].mean() > 3 * held[held["toxic"] == 0]["score"].mean()


def test_toxic_word_of_late_rows_is_learned(spark):
    """Of 1 500 toxic rows, all are learned from: a word that only the last 300 by hash order hold gets a weight."""
    ids = toxicity.held_out(spark.range(4200).withColumnRenamed("id", "doc_id")).where("not held_out").selectExpr("doc_id", "xxhash64(doc_id, 5) as place").orderBy("place").toPandas()["doc_id"].tolist()
    toxic, fine = ids[:1500], ids[1500:3000]
    docs = [(d, f"plain words {'grobian' if i >= 1200 else 'moron'}") for i, d in enumerate(toxic)] + [(d, "plain words only") for d in fine]
    marks = spark.createDataFrame([(d, 1) for d in toxic] + [(d, 0) for d in fine], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), marks)
    late, none = toxicity.scores(model, pa.array(["plain words grobian", "plain words only"]))
    assert late > 0.5 > none


def test_quality_of_held_out_documents(spark, labels):
    rows = QUERIES["op10_quality"][0](spark, SF).toPandas().set_index("doc_id")
    assert all(h == (remainder(d, 3) == 1) for d, h in rows["held_out"].items())
    held = rows[rows["held_out"]].join(labels, how="inner")
    assert (held["predicted"] == held["quality"]).mean() > 0.97


def test_models_take_odd_rows(spark, odd_docs):
    marks = spark.createDataFrame([(4, 1, 1), (8, 0, 0), (8, 0, 0), (3, None, None), (99, 1, 1), (None, 1, 1), (5, 7, 7)], "doc_id long, toxic int, quality int")
    for docs in (odd_docs, odd_docs.limit(0)):
        tongues = {r["doc_id"]: r for r in langid.identify(docs).collect()}
        assert all(0 <= r["score"] <= 1 for r in tongues.values())
        if tongues:
            assert all(tongues[i]["lang_pred"] == "und" and tongues[i]["score"] == 0 for i in (1, 2, 3, 9))
        for module, name in ((toxicity, "toxic"), (quality, "quality")):
            rows = module.predict(docs, module.fit(docs, marks.select("doc_id", name))).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) <= 1
            assert module.predict(docs, module.fit(docs, marks.limit(0).select("doc_id", name))).count() == docs.count()


def test_scores_do_not_depend_on_batches():
    texts = ["You are a clown, a moron. " * 5, None, "", "fine words here " * 40_000, "ï" * 3000]
    names = np.sort(np.unique(np.concatenate(toxicity.feature_sets(pa.array(texts)))))
    model = toxicity.Model(names, np.linspace(-0.01, 0.01, len(names)), -1.0)
    together = toxicity.scores(model, pa.array(texts))
    assert np.allclose(together, [toxicity.scores(model, pa.array([t], pa.string()))[0] for t in texts])
    stats = quality.statistics(pa.array(texts))
    assert np.allclose(stats, np.vstack([quality.statistics(pa.array([t], pa.string())) for t in texts]))
    known = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(langid.WIDTH, 2)), np.zeros(2), 1.0)
    z, n = langid.logits(known, [t or "" for t in texts])
    assert np.allclose(z, np.vstack([langid.logits(known, [t or ""])[0] for t in texts])) and n[1] == n[2] == 0


def test_toxic_features_are_words_pairs_and_skips():
    def of(text):
        return set(toxicity.feature_sets(pa.array([text]))[0].tolist())

    assert of("IDIOT!!") == of("idiot") and of("a b c") - of("a b") - of("b c") - of("a") - of("c")
    assert of("") == set() and of("a b") != of("b a")


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs
    assert ((quality.scores(model, x) > 0.5) == y).mean() > 0.9


def test_language_weights_are_sparse_and_calibrated():
    rows = [(np.array([1, 2, 3 + i % 5]), np.array([3.0, 1.0, 1.0]), "a") for i in range(40)] + [(np.array([2, 10, 11 + i % 5]), np.array([1.0, 3.0, 1.0]), "b") for i in range(40)]
    model = langid.train(rows)
    assert model.languages == ["a", "b"] and (model.weights != 0).mean() < 0.01 and 0.05 <= model.temperature <= 20


def test_letters_of_all_planes():
    table = langid.letters()
    assert table[0x30000] == 0x30000 and table[0x20000] == 0x20000 and table[ord("Ä")] == ord("ä") and table[ord("7")] == 32 and table[0x1F600] == 32
