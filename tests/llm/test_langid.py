import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid


def parse(text, train):
    """Brute force: the longest substrings of ``train`` in turn; an unknown letter is a phrase."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in train and text[at:end] in train:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_as_brute_force_of_whole_texts(monkeypatch):
    """Texts of many lanes, alphabets with rare letters, and lanes in several rounds: the phrases of one parse."""
    rng = random.Random(4)
    samples = {name: "".join(rng.choice(letters) for _ in range(300)) for name, letters in (("a", "abcd "), ("b", "bcdefgh "))}
    texts = ["".join(rng.choice("abcdexf ") for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["x", "xx", "ab", "", samples["a"], samples["b"] * 2]
    want = [[parse(t, samples[n]) for n in sorted(samples)] for t in texts]
    assert langid.Parser(samples).phrases(texts).tolist() == want
    for dense, lane, beside in ((3, 16, 8), (2, 7, 64), (48, 1, 3)):
        monkeypatch.setattr(langid, "DENSE", dense)
        monkeypatch.setattr(langid, "LANE", lane)
        monkeypatch.setattr(langid, "BESIDE", beside)
        assert langid.Parser(samples).phrases(texts).tolist() == want


def test_many_letters_take_little_memory():
    rng = random.Random(6)
    sample = "".join(chr(0x4E00 + min(rng.randint(0, 3000), rng.randint(0, 3000))) for _ in range(5000))
    parser = langid.Parser({"zh": sample})
    assert parser.automata[0].table.nbytes < 4 << 20
    texts = [sample[100:180] + "x" + sample[:40], "".join(rng.choice(sample) for _ in range(200))]
    assert parser.phrases(texts).tolist() == [[parse(t, sample)] for t in texts]


def test_training_takes_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_CHARS", 50)
    docs = spark.createDataFrame([(k, f"word{chr(97 + k)} " * 4, "en") for k in range(9)], "doc_id long, text string, lang string")
    (sample,) = langid.samples(docs).values()
    assert len(sample) == 50 and len(set(sample.split())) == 3


def test_best_takes_first_of_ties():
    first, score = langid.best(np.array([[3, 3], [4, 2]]), np.array([100, 100]))
    assert first.tolist() == [0, 1] and score[0] == 0 and 0 < score[1] <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (None, "the dog", None), (1, "the cat and the dog", "en"), (6, "the the and dog " * 5000, None)],
        "doc_id long, text string, lang string",
    )
    docs = docs.withColumns({"held_out": F.lit("x"), "lang_pred": F.lit(1), "h": F.lit(2), "n": F.lit(None).cast("int")})
    rows = langid.predict(docs, {"en": "the cat and the dog", "de": "der hund und die katze"}).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und"
    assert by[1].lang_pred == by[6].lang_pred == by[None].lang_pred == "en" and by[2].lang_pred == "de"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97


def test_more_languages_than_are_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    words = {"aa": "abcab bca", "bb": "defde fed", "cc": "ghigh ihg", "dd": "jkljk lkj", "ee": "mnomn onm"}
    docs = spark.createDataFrame([(9 * k + j, t, lang) for k, (lang, t) in enumerate(words.items()) for j in range(9)], "doc_id long, text string, lang string")
    rows = langid.identify(docs).collect()
    assert len(rows) == 45 and all(r.lang_pred == list(words)[r.doc_id // 9] for r in rows)
    rng = random.Random(8)
    samples = {name: "".join(rng.choice("abcde ") for _ in range(200)) for name in words}
    texts = ["".join(rng.choice("abcdefx ") for _ in range(500)) for _ in range(20)]
    grouped = np.concatenate([p.phrases(texts) for p in langid.parsers(samples)], axis=1)
    assert grouped.tolist() == langid.Parser(samples).phrases(texts).tolist()
