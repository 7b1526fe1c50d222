"""No language with labelled rows is left out."""

import pytest

from strataq.llm import language_id


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(i, f"{chr(0x4E00 + i % 70)} text of a language {i % 70} " * 5, f"l{i % 70:02}") for i in range(70 * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, x, y = language_id.draw(docs, 10, 2)
    assert langs == [f"l{k:02}" for k in range(70)] and set(y.tolist()) == set(range(70)) and len(x) == len(y) <= 2 * 70 * 9
    net = language_id.fit(docs, per_lang=10, windows=2, hidden=2, steps=2, batch=8)
    assert net.langs == langs and net.out.shape[1] == 70
    monkeypatch.setattr(language_id, "MAX_LANGS", 69)
    with pytest.raises(ValueError):
        language_id.draw(docs, 10, 2)
