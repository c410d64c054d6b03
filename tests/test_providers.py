import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions import providers, vocabulary
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import toc


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def test_terms_as_one_by_one(spark):
    rng = random.Random(4)
    letters = ["a", "B", "é", "Σ", " ", "日", "x"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    terms = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(300)] + ["", "A", "a"]
    rows = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "id long, text string, terms string")
    found = {r.id: r.terms for r in vocabulary.with_terms(rows, terms).collect()}
    assert all(found[k] == [w for w in terms if w and w.lower() in (t or "").lower()] for k, t in enumerate(texts))
    ascii_terms = [w for w in terms if w.isascii() and w]
    both = vocabulary.with_terms(rows.filter("text <> ''"), ascii_terms).withColumn("one", T.terms_in("text", ascii_terms)).collect()
    assert both and all(r.terms == r.one for r in both)
    assert vocabulary.with_terms(rows, []).filter("size(terms) > 0").count() == 0 == vocabulary.with_terms(rows.limit(0), terms).count()
    with pytest.raises(ValueError, match="join larger"):
        vocabulary.with_terms(rows, ["x" * (vocabulary.MOST + 1)])


class Counted:
    """A provider that writes down every loading and every batch."""

    def __init__(self, path, scores):
        self.path, self.scores, self.key = str(path), scores, f"counted {path}"

    def note(self, line):
        with open(self.path, "a") as out:
            out.write(line + "\n")

    def load(self):
        import os

        self.note(f"load {os.getpid()}")

        def run(items):
            self.note(f"batch {len(items)}")
            return [math.nan if i[1] == "bad" else float(len(i[0] + i[1])) for i in items] if self.scores else np.array([[len(i), 1.0] for i in items], np.float32)

        return run


@pytest.mark.parametrize("scores", [False, True])
def test_models_are_loaded_once_and_fed_in_batches(spark, tmp_path, scores):
    rows = spark.createDataFrame([(k, f"text {k}" if k % 10 else None, "bad" if k == 5 else "q", "x") for k in range(103)], "id long, query string, text string, embedding string").coalesce(1)
    log = tmp_path / "log"
    for _ in range(2):
        if scores:
            found = providers.scored(rows, Counted(log, True)).collect()
        else:
            found = providers.embedded(rows, Counted(log, False), text="query").collect()
    lines = log.read_text().split("\n")[:-1]
    sizes = [int(x.split()[1]) for x in lines if x.startswith("batch")]
    most = 32 if scores else 4
    loads = [x for x in lines if x.startswith("load")]
    assert len(loads) == len(set(loads)) <= 2 and max(sizes) == most and len(sizes) == 2 * -(-103 // most) and sum(sizes) == 206
    by_id = {r.id: r for r in found}
    assert (by_id[5].rerank_raw is None and by_id[1].rerank_raw == 7.0) if scores else by_id[11].embedding == [7.0, 1.0] and by_id[10].embedding == [0.0, 1.0]


def test_embedding_does_not_depend_on_batches(spark):
    rows = spark.createDataFrame([(k, "w " * k) for k in range(30)], "id long, text string")
    vectors = [{r.id: r.embedding for r in providers.embedded(rows.repartition(n), providers.HashEmbedder(), size=s).collect()} for n, s in ((1, 4), (3, 1), (2, 100))]
    assert vectors[0] == vectors[1] == vectors[2] == {r.id: r.e for r in rows.select("id", V.hash_embedding("text").alias("e")).collect()}
    pairs = rows.withColumn("query", F.lit("w x"))
    assert {r.rerank_raw for r in providers.scored(pairs, providers.OverlapScorer()).collect()} == {0.0, 0.5}


def test_texts_are_cut_by_tokens():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    cut = providers.Truncation(public_tokenizers.path("byte_bpe_50k.json"), tokens=12).load()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "short", "The quick brown fox jumps over the lazy dog again and again and again", "é日 " * 30]
    for text, short in zip(texts, cut(texts), strict=True):
        assert text.startswith(short) and len(whole.encode(short, add_special_tokens=False).ids) <= 11
        assert short == text or len(whole.encode(text, add_special_tokens=False).ids) > 10


def test_as_of_with_a_hot_key(spark):
    rng = random.Random(6)
    left = [(k, "hot" if k % 10 else rng.choice(["a", None]), rng.choice([None, *range(400)]), "v") for k in range(1500)]
    right = [("hot" if k % 10 else rng.choice(["a", None]), rng.choice([None, *range(400)]), rng.choice([None, *range(50)])) for k in range(1500)]
    a = spark.createDataFrame(left, "id long, k string, t int, value string").drop("value")
    b = spark.createDataFrame(right, "k string, at int, value long")
    for latest in (True, False):
        found = {r.id: r.value for r in toc.as_of(a, b, "k", "t", "at", "value", latest=latest).collect()}
        for i, key, t, _ in left:
            fit = [(at, v) if latest else (0, v) for k, at, v in right if k == key and v is not None and at is not None and t is not None and at <= t]
            assert found[i] == (max(fit)[1] if fit else None)
    assert toc.as_of(a, b.limit(0), "k", "t", "at", "value").filter("value IS NOT NULL").count() == 0
    plan = toc.as_of(a, b, "k", "t", "at", "value")._jdf.queryExecution().toString()
    assert "_bucket" in plan
