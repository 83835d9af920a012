import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.operators.chunking import _windows, chunk_pages, number_chunks


def pages(spark, *texts):
    return spark.createDataFrame([(i, "p", None, t) for i, t in enumerate(texts)], "document_id long, project_id string, page int, text string")


def chunked(spark, target, overlap, *texts):
    return sorted(number_chunks(chunk_pages(pages(spark, *texts), target, overlap)).collect(), key=lambda r: (r.document_id, r.ordinal))


def test_short_page_is_one_chunk(spark):
    rows = chunked(spark, 180, 30, "One short page of text.")
    assert [r.content for r in rows] == ["One short page of text."]


def test_last_words_open_the_next_chunk(spark):
    rows = chunked(spark, 23, 7, " ".join(f"{i * i}m" for i in range(131)))
    assert len(rows) == 8 and [r.n_words for r in rows[:-1]] == [23] * 7
    for one, other in zip(rows, rows[1:], strict=False):
        assert one.content.split()[-7:] == other.content.split()[:7]


def test_offsets_give_the_content(spark):
    text = "  oak birch\tbeech   ash elm lime willow poplar alder hazel rowan cherry plum pear quince yew larch spruce "
    for r in chunked(spark, 8, 3, text):
        assert text[r.char_start : r.char_end] == r.content


def test_blank_and_null_pages_have_no_chunk(spark):
    assert chunked(spark, 10, 2, " \n \n", None, "") == []


def test_windows_move_to_paragraph_ends(spark):
    text = " ".join(["a"] * 38) + "\n\n" + " ".join(["b"] * 60)
    assert chunked(spark, 40, 5, text)[0].content == " ".join(["a"] * 38)


def test_both_forms_agree_without_blank_lines(spark):
    text = " ".join("lorem"[: i % 5 + 1] for i in range(333))
    native = [(r.char_start, r.char_end) for r in chunked(spark, 50, 20, text)]
    assert native == [(a, b) for _, _, a, b in _windows(text, 50, 20)]


@pytest.mark.parametrize(("target", "overlap"), [(0, 0), (10, 10), (10, -1)])
def test_bad_sizes_are_rejected(spark, target, overlap):
    with pytest.raises(ValueError):
        chunk_pages(pages(spark, "x"), target, overlap)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 20))
def test_windows_cover_every_word(text, target):
    spans = [(a, b) for _, _, a, b in _windows(text, target, target // 2)]
    words = [i for i, c in enumerate(text) if not c.isspace()]
    assert all(any(a <= i < b for a, b in spans) for i in words)
    assert all(n <= target + max(5, target // 5) for _, n, _, _ in _windows(text, target, target // 2))
