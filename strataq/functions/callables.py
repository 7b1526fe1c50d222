"""Model callables as Arrow functions, with deterministic checks of what they return.

The engine ships no model: callers pass plain functions over lists, and results are validated as Columns.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedder(embed: Callable[[list[str]], list[list[float]]], size: int):
    """A Column function text -> vector; null where the model gives nothing or a vector of another size."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = embed(texts.fillna("").tolist()) or [None] * len(texts)
        return pd.Series([list(map(float, v)) if v is not None and len(v) == size else None for v in vectors])

    return run


def scorer(score: Callable[[str, list[str]], list[float]]):
    """A Column function (query, text) -> score; each query of a batch is scored once with all its texts."""
    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype="float64")
        for q, at in queries.groupby(queries).groups.items():
            out.loc[at] = score(q, texts.loc[at].fillna("").tolist())
        return out

    return run


def rerank_all_or_none(hits: DataFrame, score: Column, top: int) -> DataFrame:
    """Hits by a model's score; a query with a missing score among its first ``top`` keeps its order."""
    from pyspark.sql.window import Window

    from strataq.operators.retrieval import rerank

    w = Window.partitionBy("query")
    whole = F.count(F.when((F.col("place") <= top) & F.col("_s").isNull(), 1)).over(w) == 0
    scored = hits.withColumn("_s", score).withColumn("_s", F.when(whole, F.col("_s")).otherwise(-F.col("place").cast("double")))
    return rerank(scored, F.col("_s"), top).drop("_s")


def generate(rows: DataFrame, prompt: str, make: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """Adds ``generated``: one answer per prompt, in the order of each Arrow batch; a failed batch gives nulls."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for pdf in batches:
            try:
                answers = make(pdf[prompt].fillna("").tolist())
            except Exception:  # a model that fails must not fail the job
                answers = [None] * len(pdf)
            yield pdf.assign(generated=answers if len(answers) == len(pdf) else [None] * len(pdf))[[*names, "generated"]]

    return rows.mapInPandas(run, f"{schema}, generated string")


def classified(answer: Column, labels: tuple[str, ...], default: str | None = None) -> Column:
    """A model's answer if it is one of the labels, else the first label that it mentions, else the default."""
    low = F.lower(F.trim(answer))
    out = None
    for label in labels:
        hit = F.when(low == label.lower(), label)
        out = hit if out is None else F.coalesce(out, hit)
    for label in labels:
        out = F.coalesce(out, F.when(F.contains(low, F.lit(label.lower())), label))
    return F.coalesce(out, F.lit(default))


def compressed(answer: Column, text: Column, limit: int) -> Column:
    """A model's summary cut to ``limit`` characters; the text itself, cut, where there is none."""
    return F.substring(F.when(F.trim(answer) != "", F.trim(answer)).otherwise(text), 1, limit)


def sequence_ratio():
    """A Column function (a, b) -> matching-blocks ratio, which edit distances do not give."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    return run


def to_verify(found: DataFrame, overrides: DataFrame, retracted: DataFrame) -> DataFrame:
    """Findings that a verifier is asked about: open and not retracted."""
    from strataq.operators import folds

    live = found.join(retracted, found["id"] == retracted["finding_id"], "left_anti")
    return folds.with_lifecycle(live, overrides).where("resolution = 'open'")
