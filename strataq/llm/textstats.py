"""Counts over whole texts as native Column expressions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs without the blanks x20 and x09 to x0D."""
    return F.array_remove(F.split(whole(text), BLANKS), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``: what is left when runs of others are cut."""
    kept = "".join(f"\\{c}" if not c.isalnum() else c for c in chars)
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def lines_of(text: Column) -> Column:
    r"""The \n-split lines that hold a word."""
    return F.filter(F.split(whole(text), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as the struct ``_row``, in which no name can clash with those of a plan."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def unpacked(df: DataFrame, *added: Column | str, names: tuple[str, ...] = ()) -> DataFrame:
    """The fields of ``_row``, but for those that ``names``, the names of ``added``, replace, and ``added``."""
    taken = {n.lower() for n in names}
    fields = [f.name for f in df.schema["_row"].dataType if f.name.lower() not in taken]
    return df.select(*(F.col("_row")[n].alias(n) for n in fields), *added)
