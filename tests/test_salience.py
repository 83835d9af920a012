"""Salience: equal whatever is broadcast, with sentences that stand twice."""

import pytest

from scholia.operators import quiz

TEXTS = ["The Alpha market met alpha traders near Market squares", "Ends here. Market opens; the market closes alpha-Beta", "", "words without capitals matter", "see Élan and Market!"]


@pytest.fixture(scope="module")
def sentences(spark):
    rows = [("r" if i % 3 else None, i, TEXTS[i % len(TEXTS)]) for i in range(20)] + [("r", 1, TEXTS[1]), ("r", None, TEXTS[0]), ("r", None, TEXTS[0])]
    return spark.createDataFrame(rows, "request_id string, position long, text string")


def test_salience_is_the_same_whatever_is_broadcast(sentences, monkeypatch):
    wanted = sorted(map(repr, quiz.term_salience(sentences).collect()))
    assert any("position=1, term='closes', tf=2" in r for r in wanted) and any("position=None, term='traders', tf=2" in r for r in wanted)
    for most in (0, 3):
        monkeypatch.setattr(quiz, "MOST_TERMS", most)
        assert sorted(map(repr, quiz.term_salience(sentences).collect())) == wanted
    among = sentences.filter("position = 1")
    assert sorted(map(repr, quiz.term_salience(sentences, among).collect())) == [r for r in wanted if "position=1," in r]
