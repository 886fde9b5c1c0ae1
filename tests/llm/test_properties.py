"""Invariants on arbitrary texts: nothing crashes, positions are sound, results are stable."""

from hypothesis import given, settings
from hypothesis import strategies as st

from foliomark.llm import language, pieces, repetition, sentences, spans, textform, tokens
from foliomark.llm.furniture import classify
from foliomark.llm.scans import Page, paragraphs
from foliomark.llm.words import word_spans, words

PARTS = ["Dr. Lee", " said. ", "“Why?” ", "\n", "\n\n", "- 3 -", "e.g. ", "x­b ", "。", "他写道：“好。”", "ｗｉｄｅ", "cаse", "é ", "3.14 ", "名 ", " | ", "ราย ", "है। ", "[1] Ab, C. (2010). T. ", "word-\n", "Name   3   4.5\n", "🙂", "​", "» ", "« "]
texts = st.one_of(st.text(max_size=120), st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
MODEL = textform.Model(["the case wide lee said why word name", "слово имя случай"])
few = settings(max_examples=150, deadline=None)


@few
@given(texts)
def test_sentence_positions(text):
    ends = sentences.units(text)
    assert ends == sorted(ends) and all(0 < e <= len(text) for e in ends)
    assert all(not text[e - 1].isspace() for e in ends)


@few
@given(texts)
def test_form_is_stable(text):
    once = textform.normalize(text, MODEL)
    assert textform.normalize(once, None) == once
    assert set(textform.forms(text, MODEL)) <= set(textform.FORMS)


@few
@given(texts, st.integers(8, 40))
def test_pieces_cover(text, limit):
    found = pieces.split(text, limit, limit // 4)
    at = 0
    for a, b, n, _ in found:
        assert a <= at < b and n == tokens.count(text[a:b]) and (n <= limit or b - a == 1)
        at = b
    assert at == len(text)


@few
@given(texts)
def test_lines_and_pages(text):
    lines, kinds = classify(text)
    assert len(lines) == len(kinds) and "\n".join(lines) == text
    page = Page(text, MODEL)
    for word, places in page.words():
        assert word and all(0 <= line < len(lines) for line, _ in places)
    paragraphs(page, set(page.breaks), {})


@few
@given(st.lists(st.sampled_from("a b c d".split()), max_size=60))
def test_repeated_words(tokens_):
    assert repetition.repeated_words(tokens_, 6) == repetition.repeated_words_exactly(tokens_, 6)


@few
@given(st.text("ab", max_size=60), st.text("ab", max_size=60))
def test_pair_spans(a, b):
    got = spans.shared_pair_spans(a, b, 8)
    inside = {i for i in range(len(a) - 7) if a[i : i + 8] in b}
    assert {i for s, e in got for i in range(s, e)} == {i for s in inside for i in range(s, s + 8)}


@few
@given(texts)
def test_words_and_labels(text):
    assert len(words(text.lower())) == len(word_spans(text.lower()))
    language.code_of(text)
    language.is_body(text)
