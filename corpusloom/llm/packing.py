"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corpusloom.llm.common import FID, ROW, checkpoint, is_anchored, named, ready_workers, stable_rows

#: Tokens that a sequence holds.
CAPACITY = 8192
#: Cost of a document of t tokens in a sequence: LINEAR * t + QUADRATIC * t * t, as attention stays within a document.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that one task packs together. Groups are as many as the corpus needs.
GROUP_TOKENS = 4_000_000


def pack(tokens: np.ndarray, costs: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and first token of each item, for items in descending order.

    As many sequences are open as the tokens need at least; an item goes to the one of least cost among those
    with room, the first of equals; only if none has room another is opened.
    """
    many = max(1, -(-int(tokens.sum()) // capacity))
    load, room = np.zeros(many), np.full(many, capacity)
    sequence, position = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
    for i, (t, c) in enumerate(zip(tokens.tolist(), costs.tolist(), strict=True)):
        at = int(np.where(room >= t, load, np.inf).argmin())
        if room[at] < t:
            at = len(room)
            load, room = np.append(load, 0.0), np.append(room, capacity)
        sequence[i], position[i] = at, capacity - room[at]
        room[at] -= t
        load[at] += c
    return sequence, position


def packed(docs: DataFrame, tokens: Column, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, piece, tokens, cost, pack_group, sequence, position`` for every document, or piece of one.

    A document over the capacity is cut into pieces of that many tokens; none of its tokens is lost. Pieces
    are spread over packing groups by a hash of their row's place, so equal rows and null ids are spread as well, and each
    group is packed by descending cost, ties by id (null first) and piece; a sequence is named by its group and its number in
    it. Costs are balanced within a group; groups are alike as far as the hash makes them so. Ids may have any type that
    can be sorted. Repeated rows are packed each. Null and empty texts have no tokens and are in no sequence. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    ready_workers(docs.sparkSession)
    # a scan's column may be part of tokens, which is resolved on docs itself
    slim = checkpoint(stable_rows(docs, docs[named(id_col)].alias("doc_id"), tokens.cast("long").alias("n")) if is_anchored(docs) else docs.select(docs[named(id_col)].alias("doc_id"), tokens.cast("long").alias("n"), F.lit(0).alias(FID), F.monotonically_increasing_id().alias(ROW)))
    slim = slim.where("n > 0")
    total = slim.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    cut = slim.select("doc_id", "n", FID, ROW, F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("piece"))
    group = F.pmod(F.xxhash64(FID, ROW, "piece"), F.lit(groups))
    pieces = cut.select("doc_id", "piece", F.expr(f"least({capacity}L, n - piece * {capacity})").alias("tokens"), group.alias("pack_group"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["tokens"].to_numpy(np.int64)
        rows = rows.assign(cost=linear * size + quadratic * size.astype(np.float64) ** 2, less=-(linear * size + quadratic * size.astype(np.float64) ** 2))
        rows = rows.sort_values(["less", "doc_id", "piece"], na_position="first", kind="stable", ignore_index=True)
        sequence, position = pack(rows["tokens"].to_numpy(np.int64), rows["cost"].to_numpy(), capacity)
        return rows[["doc_id", "piece", "tokens", "cost", "pack_group"]].assign(sequence=sequence, position=position)

    kinds = [StructField("doc_id", slim.schema["doc_id"].dataType), *(StructField(c, DoubleType() if c == "cost" else LongType()) for c in ("piece", "tokens", "cost", "pack_group", "sequence", "position"))]
    return pieces.groupBy("pack_group").applyInPandas(run, StructType(kinds))
