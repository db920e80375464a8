import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import npwords
from strataloom.llm.canonical import FLAGS, FULL_WIDTH, LIGATURE, MARK, MIXED, SPACE, ZERO_WIDTH, canonical, compose

TEXT = st.text(st.sampled_from(list("ab eoxȨ̣́́̀ﬁＡ１​ аοя-\n")), max_size=30)


@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_codepoints_keep_rows(rows):
    clean = [None if r is None else r.encode("utf-8", "ignore").decode() for r in rows]
    cp, offsets = npwords.codepoints(pa.array(clean, pa.string()))
    assert [("".join(map(chr, cp[a:b]))) for a, b in zip(offsets, offsets[1:])] == [r or "" for r in clean]


def test_words_do_not_join_over_rows_and_hash_alike():
    row, h = npwords.hashed_words(pa.array(["ab", "cd ab", None, "", "AB-cd"]))
    assert row.tolist() == [0, 1, 1, 4, 4]
    assert h[0] == h[2] == h[3] and h[1] == h[4] != h[0]
    assert npwords.word_hash("ab") == int(h[0])


def test_chunks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "y" * 400, "", "z"])], names=["text"])
    parts = list(npwords.chunks(batch, "text", 100))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) > 1
    assert list(npwords.chunks(batch.slice(0, 0), "text")) == []


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_composition_is_canonical(text):
    cp, offsets = npwords.codepoints(pa.array([text]))
    got, _, _ = compose(cp, offsets)
    assert "".join(map(chr, got)) == unicodedata.normalize("NFC", text)


@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_canonical_is_stable_and_row_wise(rows):
    once, found = canonical(pa.array(rows, pa.string()))
    twice, again = canonical(once)
    assert once.to_pylist() == twice.to_pylist()
    assert not (again & ~np.uint8(MIXED)).any()
    for i, r in enumerate(rows):
        alone, f = canonical(pa.array([r], pa.string()))
        assert alone.to_pylist()[0] == once.to_pylist()[i] and f[0] == found[i]


def test_what_is_found():
    cases = {
        "plain façade": (0, "plain façade"), "Ｏｖｅｒ": (FULL_WIDTH, "Over"), "oﬃce": (LIGATURE, "office"), "a b": (SPACE, "a b"), "c‌ut": (ZERO_WIDTH, "cut"),
        "résume": (MARK, "résume"), "Рropеrties": (MIXED, "Properties"), "счёт (Δ) λ": (0, "счёт (Δ) λ"), "supp­orts – “x”": (0, "supp­orts – “x”"), "": (0, ""), "Pythonで 2ª Mª": (0, "Pythonで 2ª Mª"),
        "payցal": (MIXED, "paygal"), "pᎪypal": (MIXED, "pAypal"), "pay\u10ffal": (MIXED, "payoal"), "ⲣay": (MIXED, "pay"), "payЖ": (MIXED, "payЖ"), "\U0001d40fay": (0, "Pay"), "ｶﾞ": (MARK, "ガ"), "Խոռ": (0, "Խոռ"),
    }
    text, found = canonical(pa.array([*cases, None]))
    assert text.to_pylist() == [v[1] for v in cases.values()] + [None]
    assert found.tolist() == [v[0] for v in cases.values()] + [0]
    assert set(FLAGS.values()) == {1, 2, 4, 8, 16, 32}
