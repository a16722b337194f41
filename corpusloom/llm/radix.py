"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import FID, KEY, ROW, anchored, checkpoint, named, spare, spread_join, stable_rows

#: Text bytes that the first level splits on, besides the eight bytes of the length.
FIRST_BYTES = 56
#: Growth of the digit from level to level, and the widest digit. Any text ends after finitely many levels.
GROWTH, WIDEST = 16, 1 << 20


def duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of an anchored DataFrame whose whole text occurs more than once: row identity, ``id``, ``group_id``, ``copies``, ``keep``.

    The key is the text's length in bytes followed by its bytes, so texts of a group always end together.
    Each level counts (group, next digit), with partial counts before the shuffle, drops what is alone
    and splits the rest by that digit; groups that have ended are equal byte for byte, without a digest.
    After the first level only rows with a possible copy travel. Rows of a group that is large are spread over
    tasks when they are joined with its count, so a text may have any number of copies.
    """
    text = F.col(named(text_col)).cast("binary")
    base = stable_rows(docs.where(F.col(named(text_col)).isNotNull()), F.col(named(id_col)).alias("id"), text.alias("bytes"))
    first = F.struct(F.length("bytes").alias("n"), F.substring("bytes", 1, FIRST_BYTES).alias("head"))
    keyed = base.withColumn("grp", first)
    shared = keyed.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    active = checkpoint(spread_join(keyed, shared, ["grp"]))
    at, width, ended = FIRST_BYTES, FIRST_BYTES, []
    while True:
        over = F.length("bytes") <= at
        done = active.where(over)
        ended.append(done.select(FID, ROW, "id", "grp"))
        if active.where(~over).isEmpty():
            break
        width = min(width * GROWTH, WIDEST)
        rest = active.where(~over).withColumn("digit", F.substring("bytes", at + 1, width))
        split = rest.groupBy("grp", "digit").agg(F.count("*").alias("size"), F.min(F.struct(FID, ROW)).alias("next")).where("size > 1")
        active = checkpoint(spread_join(rest, split, ["grp", "digit"]).drop("grp", "digit").withColumnRenamed("next", "grp"))
        at += width
    found = None
    for rows in ended:
        group = rows.groupBy("grp").agg(F.count("*").alias("copies"), F.min("id").alias("group_id"), F.min(F.struct("id", FID, ROW)).alias("first"))
        level = spread_join(rows, group.withColumn("size", F.col("copies")), ["grp"]).select(FID, ROW, "id", "group_id", "copies", (F.struct("id", FID, ROW) == F.col("first")).alias("keep"))
        found = level if found is None else found.unionAll(level)
    return found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id, copies, keep`` for every row: group_id is the least id with the same text.

    Of each group the row with the least id stays (a null id sorts first; of rows with equal ids, any one).
    A null text equals nothing: the row stays, alone. Empty texts are equal. Columns other than id and text
    are ignored, whatever their names. An empty table gives an empty result.
    """
    docs = anchored(docs)
    rows = stable_rows(docs, F.col(named(id_col)).alias("doc_id"))
    found = duplicate_rows(docs, id_col, text_col).drop("id").withColumnRenamed("group_id", "least")
    joined = rows.join(found, [FID, ROW], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("group_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("keep", F.lit(True)).alias("keep"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns, under whatever names.

    Nulls, empty texts, ties and repeated rows are decided as there. An empty table stays empty.
    """
    columns, docs = docs.columns, anchored(docs)
    key = spare(columns, 2)
    losers = duplicate_rows(docs, id_col, text_col).where("not keep").select(*KEY).toDF(*key)
    return stable_rows(docs, *map(named, columns), key=key).join(losers, key, "left_anti").select(*map(named, columns))
