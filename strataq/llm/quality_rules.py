"""Quality rules with divergence from language references, in DataFrame operations alone.

Base rules count words, symbols, repeated lines and repeated 8-word windows. A document also fails
if its histogram of character classes lies too far, by Jensen-Shannon distance, from the reference of every
language, or its histogram of common words from that of its own language. Common words are the N_COMMON most frequent
ones over all documents of a language, whatever it is; references are sums over all its documents that
pass the base rules. A text without common words lies beyond the limit of words, which is relative to the
reference. A row per language, at most MAX_LANGS, reaches the driver and the plan. Texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.llm import textstats as S
from strataq.storage import discard, materialize, read_table

#: How many of its most frequent words stand for a language, and the longest of them.
N_COMMON, LONGEST = 8, 64
#: What share of the distance of a text without any common word is too far.
ABSENT = 0.9
#: The language of documents without one.
UNKNOWN = "und"
WINDOW = 8
MAX_LANGS = 2000


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once; a lambda would evaluate a captured expression for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more.

    Windows are hashed; where some are equal, they are sorted with their places, and places equal to
    a neighbour are merged into covered runs. Linear but for the sort.
    """

    def covered(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
        merge = lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last"))
        return F.aggregate(places, zero, merge)["sum"]

    def repeats(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _bind(placed, covered)).otherwise(F.lit(0).cast("long"))

    def windows_of(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashed, i, WINDOW)))

    found = _bind(_bind(F.transform(words, lambda w: F.xxhash64(w)), windows_of), repeats)
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def frequent_words(docs: DataFrame) -> dict[str, tuple[str, ...]]:
    """The most frequent words of each language of ``docs`` (text, lang), ties by the word."""
    each = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.explode(S.words_of(F.col("text"))).alias("word")).where(F.length("word") <= LONGEST)
    counted = materialize(each.groupBy("lang", "word").agg(F.count("*").alias("n")), "quality-words")
    if counted.select("lang").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: group them first")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, list[str]] = {}
    for r in counted.withColumn("place", place).where(F.col("place") <= N_COMMON).orderBy("lang", "place").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    discard(counted)
    return {k: tuple(v) for k, v in out.items()}


def _by_lang(values: dict[str, Column]) -> Column:
    """What ``values`` has for a document's language, or null."""
    return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), F.col("_lang")) if values else F.lit(None)


def _of_own(words: Column, own: dict[str, tuple[str, ...]]) -> Column:
    """How often each common word of the document's language occurs, and how many other words; null without a list."""
    if not own:
        return F.lit(None).cast("array<bigint>")

    def counts(s: Column) -> Column:
        found = F.filter(s["w"], lambda x: F.array_contains(s["v"], x))
        each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(N_COMMON - 1)), lambda i: F.size(F.filter(f, lambda x: x == F.get(s["v"], i))).cast("long"))
        return _bind(found, lambda f: F.concat(each(f), F.array((F.size(s["w"]) - F.size(f)).cast("long"))))

    listed = _by_lang({k: F.array(*map(F.lit, v)) for k, v in own.items()})
    return F.when(listed.isNotNull(), _bind(F.struct(words.alias("w"), listed.alias("v")), counts))


def measure(docs: DataFrame, keep: list[Column], own: dict[str, tuple[str, ...]]) -> DataFrame:
    """``keep`` as struct ``_row``, and per document the base counts and both histograms; null text counts as empty."""
    base = docs.select(F.struct(*keep).alias("_row"), F.coalesce("lang", F.lit(UNKNOWN)).alias("_lang"), S.whole(F.col("text")).alias("_t"), S.words_of(F.col("text")).alias("_w"), S.lines_of(F.col("text")).alias("_l"))
    t, w, lines = F.col("_t"), F.col("_w"), F.col("_l")
    counted = base.select(
        "_row", "_lang",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        S.count_of(t, S.SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.length(t).cast("long").alias("_chars"),
        F.octet_length(t).cast("long").alias("_bytes"),
        S.count_of(t, S.DIGITS).alias("_digits"),
        S.count_of(t, S.UPPER).alias("_upper"),
        S.count_of(t, S.PUNCTUATION).alias("_punct"),
        _of_own(w, own).alias("_words"),
    )
    c = F.col
    wide = c("_bytes") - c("_chars")
    classes = [c("_chars") - c("word_chars"), c("_digits"), c("_upper"), c("_punct"), c("n_symbols"), wide]
    rest = F.greatest(c("_bytes") - sum(classes[1:], classes[0]), F.lit(0))
    return counted.select(
        "_row", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*classes, rest).alias("_classes"), "_words",
        ((c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))).alias("base_failed"),
    )


def references(measured: DataFrame, lang: str) -> dict[str, dict[str, list[float]]]:
    """By histogram and language, the shares over all documents that pass the base rules."""
    sizes = {"_classes": 7, "_words": N_COMMON + 1}
    sums = [F.sum(F.col(h)[i]) for h, n in sizes.items() for i in range(n)]
    out: dict[str, dict[str, list[float]]] = {h: {} for h in sizes}
    rows = measured.where(~F.col("base_failed")).groupBy(lang).agg(*sums).limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: group them first")
    for r in rows:
        values = list(r)[1:]
        for h, n in sizes.items():
            part, values = values[:n], values[n:]
            if None not in part and sum(part) > 0:
                out[h][r[0]] = [x / sum(part) for x in part]
    return out


def _divergence(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        log = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
        return log(p) + log(q)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(shares, reference, part), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _shares(counts: Column, use) -> Column:
    """``use`` of the shares of a histogram of counts, which are evaluated once."""
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)).cast("double")
    return _bind(_bind(F.struct(counts.alias("c"), total.alias("t")), lambda s: F.transform(s["c"], lambda x: x / s["t"])), use)


def _distance(counts: Column, reference: list[float]) -> Column:
    """The distance between a histogram of counts and fixed shares."""
    return _shares(counts, lambda p: _divergence(p, F.array(*(F.lit(float(q)) for q in reference))))


def _nearest(counts: Column, known: dict[str, list[float]]) -> Column:
    """The least distance to a reference, null without any."""
    if not known:
        return F.lit(None).cast("double")
    fixed = F.array(*(F.array(*(F.lit(float(q)) for q in known[k])) for k in sorted(known)))
    return _shares(counts, lambda p: F.array_min(F.transform(fixed, lambda r: _divergence(p, r))))


def wordless_distance(reference: list[float]) -> float:
    """The distance of a text without any common word to a reference whose last share is that of other words."""
    q = reference[-1]
    term = lambda v: v * math.log2(v / ((1 + q) / 2)) if v > 0 else 0.0
    return math.sqrt(max(0.0, (term(1.0) + term(q) + (1 - q)) / 2))


def apply_rules(docs: DataFrame, keep: list[Column], max_class_distance: float = 0.28, absent: float = ABSENT, min_words: int = 50) -> DataFrame:
    """``keep``, the base counts, base_failed, class_distance, word_distance and kept, a row per row of ``docs``.

    Distances, to six places, are of classes to the nearest language reference and of words to the own language's; null where no
    reference exists. The limit of words is ``absent`` of the distance at which a text without any common word lies.
    Distances can only reject documents of at least ``min_words`` words. A kept column named like a result gives way to
    it. Rows without a lang are a language of their own, UNKNOWN; a null text and an empty text are measured like any other; empty
    tables give no rows.
    """
    measured = materialize(measure(docs, keep, frequent_words(docs)), "quality-measures")
    known = references(measured, "_lang")
    own = known["_words"]
    shares = _by_lang({k: F.array(*(F.lit(float(q)) for q in v)) for k, v in own.items()})
    to_own = F.when(shares.isNotNull(), _shares(F.col("_words"), lambda p: _divergence(p, shares))) if own else F.lit(None).cast("double")
    most = _by_lang({k: F.lit(absent * wordless_distance(v)) for k, v in own.items()}) if own else F.lit(None).cast("double")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = measured.select("_row", most.alias("_most"), *counts, F.round(_nearest(F.col("_classes"), known["_classes"]), 6).alias("class_distance"), F.round(to_own, 6).alias("word_distance"))
    far = (F.col("n_words") >= min_words) & (F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > F.col("_most"), F.lit(False)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~far)
    return S.unpacked(out, *out.columns[2:], names=tuple(out.columns[2:]))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), [F.col("doc_id").cast("long").alias("doc_id")])


def _sql() -> str:
    """The same in DuckDB's SQL, for the default limits."""
    lists = {"c": 7, "h": N_COMMON + 1}
    less = lambda chars: f"length(t) - length(translate(t, '{chars.replace(chr(39), chr(39) * 2)}', ''))"
    sums = ", ".join(f"[{', '.join(f'sum({k}[{i}])' for i in range(1, n + 1))}] AS {k}" for k, n in lists.items())
    term = lambda k, v: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / ((m.{k}[i] / greatest(list_sum(m.{k}), 1) + r.{k}[i] / list_sum(r.{k})) / 2)) ELSE 0 END"
    part = lambda k: f"{term(k, f'(m.{k}[i] / greatest(list_sum(m.{k}), 1))')} + {term(k, f'(r.{k}[i] / list_sum(r.{k}))')}"
    distance = lambda k: f"sqrt(greatest(list_sum(list_transform(range(1, {lists[k] + 1}), lambda i: {part(k)})) / 2, 0))"
    q = f"(r.h[{N_COMMON + 1}] / list_sum(r.h))"
    wordless = f"sqrt(greatest((log2(2 / (1 + {q})) + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / (1 + {q})) ELSE 0 END + 1 - {q}) / 2, 0))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '{UNKNOWN}') AS lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS l FROM t),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS x, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW}),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win), range({WINDOW}) r(k) WHERE c > 1 GROUP BY 1),
b AS (SELECT t.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {less(S.SYMBOLS)} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  {less(S.DIGITS)} AS digits, {less(S.UPPER)} AS upper_, {less(S.PUNCTUATION)} AS punct, strlen(t) - length(t) AS wide FROM t JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
v AS (SELECT lang, list(word ORDER BY place) AS v FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
  FROM (SELECT lang, unnest(w) AS word FROM t) WHERE length(word) <= {LONGEST} GROUP BY 1, 2) WHERE place <= {N_COMMON} GROUP BY 1),
m AS (SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  [length(t) - word_chars, digits, upper_, punct, n_symbols, wide, greatest(strlen(t) - (length(t) - word_chars + digits + upper_ + punct + n_symbols + wide), 0)] AS c,
  list_transform(range(1, {N_COMMON + 1}), lambda i: len(list_filter(w, lambda x: x = v[i]))) || [n_words - len(list_filter(w, lambda x: list_contains(v, x)))] AS h FROM b LEFT JOIN v USING (lang)),
r AS (SELECT lang, {sums} FROM m WHERE NOT base_failed GROUP BY 1),
d AS (SELECT m.doc_id, min({distance("c")}) AS dc FROM m, r GROUP BY 1),
own AS (SELECT m.doc_id, {distance("h")} AS dh, {ABSENT} * {wordless} AS most FROM m JOIN r USING (lang))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  round(dc, 6) AS class_distance, round(dh, 6) AS word_distance, NOT base_failed AND NOT coalesce(n_words >= 50 AND (dc > 0.28 OR dh > most), FALSE) AS kept
FROM m LEFT JOIN d USING (doc_id) LEFT JOIN own USING (doc_id)
"""


OP10_SQL = _sql()
