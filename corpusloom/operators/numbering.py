"""Numbers of list paragraphs, restored from their list position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position_number(text: Column, levels: Column) -> Column:
    """The number of a list position, or null: absolute, or with a leading 1. for each tab beyond its levels."""
    tabs = F.length(F.regexp_extract(text, r"^\t*", 0))
    own = F.concat(F.array_join(F.transform(levels, lambda n: n.cast("string")), "."), F.lit("."))
    more = tabs - F.size(levels) + 1
    return F.when(levels.isNotNull() & (F.size(levels) > 0), F.concat(F.repeat(F.lit("1."), F.greatest(more, F.lit(0))), own))


def restored(text: Column, levels: Column) -> Column:
    """The paragraph with its number, or null if nothing but an old number is left of it.

    Paragraphs behind dashes keep a dash and get no number; without a list position a heading's number loses
    leading zeros and everything else stays as it is.
    """
    number = position_number(text, levels)
    rest = F.regexp_replace(text, r"(?U)^\s*\d+(?:\.\d+)*[.)]\s*", "")
    dash = r"(?U)^\s*-+\t"
    numbered = F.when(F.regexp_like(rest, F.lit(dash)), F.regexp_replace(rest, dash, "-\t")).when(F.regexp_like(rest, F.lit(r"(?U)^\s*$")), F.lit(None)).otherwise(F.concat(number, F.lit(" "), rest))
    head = r"(?Us)^\s*(\d+(?:\.\d+)*)\.\s*(.*)$"
    found = F.regexp_extract(text, head, 1)
    plain = F.array_join(F.transform(F.split(found, r"\."), lambda n: F.regexp_replace(n, r"^0+(?=\d)", "")), ".")
    own = F.when(found != "", F.concat(plain, F.lit(". "), F.regexp_extract(text, head, 2))).otherwise(text)
    return F.when(number.isNotNull(), numbered).otherwise(own)


def restore_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para_idx, text, levels) with ``restored_text``; those that vanish are left out."""
    return paragraphs.where(r"text rlike '(?U)\\S'").withColumn("restored_text", restored(F.col("text"), F.col("levels"))).where("restored_text is not null")


def list_positions(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that are in a list, with its levels."""
    return paragraphs.where("size(levels) > 0").select("doc_id", "para_idx", "text", "levels")
