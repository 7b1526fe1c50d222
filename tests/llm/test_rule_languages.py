"""Documents of any language are measured against a reference of their own."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.llm import quality_rules


def test_clean_documents_in_another_script_stay(spark, monkeypatch):
    rng = random.Random(6)
    russian = ["слово", "другое", "книга", "человек", "время", "дорога", "город", "письмо", "вечер", "окно"]
    english = ["the", "road", "of", "city", "and", "letter", "to", "evening", "window", "in", "is", "that", "for", "people", "book", "word"]
    text = lambda words: " ".join(rng.choice(words) for _ in range(80))
    rows = [(i, text(english), "en") for i in range(40)] + [(100 + i, text(russian), "ru") for i in range(40)]
    rows += [(200, "#$%& |<>* " * 20 + text(english).upper(), "en"), (201, text(english), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, [F.col("doc_id")]).collect()}
    assert all(out[i]["kept"] for i in [*range(40), *range(100, 140), 201]) and not out[200]["kept"]
    assert out[100]["class_distance"] < 0.28
    monkeypatch.setattr(quality_rules, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        quality_rules.apply_rules(docs, [F.col("doc_id")])


def test_other_languages_have_common_words_of_their_own(spark):
    rng = random.Random(8)
    common, rare = ["и", "в", "не", "на", "что", "он", "как", "это"], [f"слово{i}" for i in range(3000)]
    text = lambda n, share: " ".join(rng.choice(common) if rng.random() < share else rng.choice(rare) for _ in range(n))
    rows = [(i, text(120, 0.35), "ru") for i in range(200)] + [(1000 + i, text(120, 0.0), "ru") for i in range(5)] + [(2000, None, "xx"), (2001, "", "yy"), (2002, text(120, 0.35), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality_rules.frequent_words(docs)
    assert set(found) == {"ru", quality_rules.UNKNOWN} and set(found["ru"]) == set(common)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, [F.col("doc_id")]).collect()}
    assert sum(got[i]["kept"] for i in range(200)) >= 198
    assert not any(got[1000 + i]["kept"] for i in range(5)) and not any(got[1000 + i]["base_failed"] for i in range(5))
    assert got[2000]["base_failed"] and got[2001]["base_failed"]


def test_wordless_distance_is_that_of_a_text_without_common_words(spark):
    reference = [0.1, 0.2, 0.7]
    near = spark.range(1).select(quality_rules._distance(F.array(*(F.lit(x).cast("long") for x in (0, 0, 50))), reference)).first()[0]
    assert abs(near - quality_rules.wordless_distance(reference)) < 1e-12


LISTS = {"de": "der die und das von den mit ist", "en": "the of and to in is that for", "es": "el la de que y los en se", "fr": "le les et des est que une la"}


@pytest.mark.parametrize("lang", sorted(LISTS))
def test_a_text_without_common_words_is_rejected(spark, lang):
    """120 ordinary words, none of them common, in a language whose texts hold about a seventh of common words."""
    rng = random.Random(lang)
    common, rare = LISTS[lang].split(), [f"{a}{b}{c}" for a in ("bar", "kol", "min", "tas") for b in ("le", "ro", "gu", "ni", "va") for c in ("nt", "rg", "sk", "l", "m", "st")]
    text = lambda share: " ".join(rng.choice(common) if rng.random() < share else rng.choice(rare) for _ in range(120))
    rows = [(i, text(0.15), lang) for i in range(300)] + [(1000 + i, text(0.0), lang) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, [F.col("doc_id")]).collect()}
    assert not any(got[1000 + i]["base_failed"] or got[1000 + i]["kept"] for i in range(5))
    assert all(got[1000 + i]["class_distance"] < 0.28 for i in range(5))
    assert sum(got[i]["kept"] for i in range(300)) >= 297
