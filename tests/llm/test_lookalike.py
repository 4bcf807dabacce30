import itertools
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphweft.llm import lookalike as L


def fold(*texts):
    return L.fold_texts(pa.array(texts, pa.string())).to_pylist()


def test_looks_the_same():
    for a, b in [
        ("Ａｂｃ１２！", "Abc12!"), ("café", "café"), ("ｶﾞﾊﾟ", "ガパ"), ("a​b­﻿", "ab"), ("a b c　d", "a b c d"), ("сор", "cop"), ("ΑΒΕ", "ABE"), ("𝐀𝓫𝟙", "Ab1"), ("Ⅻⅳ", "XIIiv"),
        ("µ", "μ"), ("ё", "ë"), ("ṩ", "ṩ"), ("각", "각"), ("ﬁ", "fi"), ("ﾞ", "゙"), ("Å", "Å"),
    ]:
        x, y = fold(a, b)
        assert x == y, (a, b, x, y)


def test_visible_differences_stay():
    shown = ["cafe", "café", "Cafe", "m2", "m²", "a b", "a  b", "a,b", "a;b", "a", "①", "1", "l", "I", "…", "...", "", "e", "\t", " "]
    assert all(x != y for x, y in itertools.combinations(fold(*shown), 2))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)) | st.sampled_from("aéо゙̣́̈かﾞ각​ Ａ"), max_size=12), max_size=5))
def test_forms_and_repeats(texts):
    once = fold(*texts)
    assert fold(*once) == once
    for form in ("NFC", "NFD"):
        assert fold(*[unicodedata.normalize(form, t) for t in texts]) == once
    assert [fold(t)[0] for t in texts] == once  # no text touches its neighbours


def test_nulls_slices_and_chunks(monkeypatch):
    texts = pa.array([None, "", "ａ", "long text ́" * 50, None, "é"], pa.string())
    whole = L.fold_texts(texts).to_pylist()
    assert whole[0] is None and whole[1] == "" and whole[4] is None
    assert L.fold_texts(texts.slice(2, 3)).to_pylist() == whole[2:5]
    monkeypatch.setattr(L, "CHUNK", 7)
    assert L.fold_texts(texts).to_pylist() == whole
    assert L.fold_texts(pa.array([], pa.string())).to_pylist() == []


def test_pairs(spark):
    rows = [(1, "abc", "x"), (2, "аbc", "x"), (3, "abc", "x"), (4, "", "x"), (5, None, "x"), (6, "​", "x"), (7, "﻿", None), (8, "Abc", "x"), (2, "аbc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string")
    assert sorted(map(tuple, L.same_look_pairs(df).collect())) == [(1, 2), (2, 3), (6, 7)]
    assert L.same_look_pairs(df.limit(0)).count() == 0
    assert L.fold_column(df.withColumnRenamed("look", "folded")).columns == ["doc_id", "text", "folded"]


def test_classes_of_a_hot_text(spark):
    rows = [(i, "p\u0430y" if i % 2 else "pay", "x") for i in range(200)] + [(500, "other", "x"), (501, None, "x"), (502, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string")
    got = {r["doc_id"]: (r["class_id"], r["documents"], r["writings"]) for r in L.look_members(df).collect()}
    assert got == {i: (0, 200, 2) for i in range(200)} | {500: (500, 1, 1)}
    assert L.look_members(df.limit(0)).count() == 0
