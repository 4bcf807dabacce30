import random
import string

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphweft.llm import bpe

TEXTS = [
    "", None, " ", "\n\n", "a", "don't we'll 'tis I'm they've 'structure ''s 's", "  two  spaces \t\n tabs\r\n  end  ", "x" * 3000, "=" * 1001, "ab" * 400 + "abc" * 400, "aaaa aaaaa aaaaaa",
    "日本語のテキスト。平均から頂点を", "тест порядок", "naïve café ²³½ ٣٤ Ⅷ", "🚀🔍✅ é ​  　x", "<|endoftext|>", "\x00\x1b[0;31m\x1c\x85", "1234567890" * 50, "'", "'s", "a'", "it's's", " 's 't", "don'T",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.RelationalBPE()


def test_texts_against_the_tokenizer(own, reference):
    got = own.encode(pa.array(TEXTS)).to_pylist()
    assert got == [e.ids for e in reference.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert own.encode(pa.array(TEXTS[::-1])).to_pylist() == got[::-1]  # words known by now


def test_empty_batches(own):
    assert own.encode(pa.array([], pa.string())).to_pylist() == []
    assert own.encode(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab's 'tlvre'Ndm1²\n\té日ー　!=́"), max_size=40), max_size=4))
def test_random_texts(own, reference, texts):
    assert own.encode(pa.array(texts, pa.string())).to_pylist() == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aehot日ー=-"), max_size=60), max_size=4))
def test_windows_are_joined_exactly(own, reference, texts):
    before, bpe.WINDOW = bpe.WINDOW, 6  # many words then take several windows, and many of those share no token
    try:
        got = own.encode(pa.array(texts, pa.string())).to_pylist()
    finally:
        bpe.WINDOW = before
    assert got == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_one_word_of_a_megabyte(own, reference):
    draw = random.Random(5)
    texts = ["".join(draw.choices(string.ascii_lowercase, k=1_000_000)), "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(333_333)), "a" * 1_000_000, "ha" * 500_000, "━" * 100_000]
    for text in texts:
        assert own.encode(pa.array([text])).to_pylist() == [reference.encode(text, add_special_tokens=False).ids]


def test_every_code_point(own, reference):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["a1 ".join(points[i : i + 500]) for i in range(0, len(points), 500)]
    assert own.encode(pa.array(texts)).to_pylist() == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_small_memory(reference, monkeypatch):
    for bound in ("BATCH_BYTES", "LOOKUP_BYTES", "MERGE_BYTES", "KEPT_BYTES"):
        monkeypatch.setattr(bpe, bound, 50)
    texts = [f"a text of several words, number {i}, and one longword{'x' * i * 20}" for i in range(20)]
    assert bpe.RelationalBPE().encode(pa.array(texts)).to_pylist() == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", None), (3, "", None)], "doc_id long, text string, ids string")
    rows = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_ids(df).collect())
    assert rows == [(1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert bpe.encode_ids(df.limit(0)).count() == 0
