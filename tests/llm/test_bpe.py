import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, packing
from tessera.llm.wordcodec import tokenizer_path

TEXTS = [
    "", " ", "Hello WORLD's café ... ***'s 123 <|endoftext|> x<|startoftext|>y", "ΑΣ ΑΣΑ İstanbul \x1c\x85 foo_bar don't I'LL 'S",
    "áb é ½²  x y　z  q", "é" * 300, "a" * 5000, "'re've 'LL''s", "<|endof text|> <|", "日本語のテキスト 한국어 😀😀 👩‍👩‍👧", "x\x00y\x1fz\x7f",
]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.Batches(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())


def check(both, text):
    import numpy as np

    ours, theirs, packer = both
    want = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ours.ids(text), "<u4").tolist() == want
    assert ours.codec.encode(text) == want
    assert ours.codec.decode(want) == theirs.decode(want, skip_special_tokens=False)
    assert np.frombuffer(packer.ids(text), "<u4").tolist() == want


def test_as_the_library(both):
    for text in TEXTS:
        check(both, text)


def test_random_words(both):
    rng = random.Random(5)
    for _ in range(300):
        check(both, " ".join("".join(rng.choice(["th", "an", "er", "é", "ß", "ing", "'s", ".", "7"]) for _ in range(rng.randint(1, 12))) for _ in range(8)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Cn", "Co"]), max_size=40))
def test_any_text(both, text):
    check(both, text)


def test_rows(spark):
    """Nulls, empty and repeated rows, a null id, a long text, an empty table and columns of clashing names."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = [(1, "some text", "i"), (1, "some text", "i"), (2, None, None), (3, "", "x"), (None, "no id", "y"), (4, "word " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted(((r.doc_id or 0), bytes(r.ids), r.decoded) for r in bpe.code(docs).collect())
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id or 0, b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False)))
    assert found == sorted(want) and bpe.code(docs.limit(0)).count() == 0


def test_memo_is_bounded_in_bytes():
    from tessera.llm.common import ENTRY_BYTES, Memo

    memo = Memo(10 * (ENTRY_BYTES + 10))
    for k in range(100):
        memo.keep(str(k), b"", 10)
        assert len(memo) <= 10 and str(k) in memo
    memo.keep("x" * 65, b"", 70)
    assert "x" * 65 not in memo
