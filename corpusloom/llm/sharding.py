"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

from math import lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import FID, KEY, ROW, anchored, mix, named, ready_workers, scratch, spare, stable_rows

#: Rows of a source block and of a shard, at most.
BLOCK_ROWS, SHARD_ROWS = 65_536, 8_192
#: Columns of the matrix at most: where there are more shards, a column is a run of them, within which places are dealt by a keyed permutation.
WIDE = 4096
SEED = 23


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` without replacement. Numpy's sampler ends at a billion; beyond, ratio of uniforms with rejection."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    if draws > total - draws:
        return good - hypergeometric(rng, good, bad, total - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    if draws < 1000:  # one by one
        found = 0
        for i in range(draws):
            found += int(rng.random() * (total - i) < good - found)
        return found
    share = good / total
    mean = draws * share
    spread = sqrt((total - draws) * draws * share * (1 - share) / (total - 1) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    mode = int((draws + 1) * (good + 1) / (total + 2))

    def weight(k: int) -> float:
        return lgamma(k + 1) + lgamma(good - k + 1) + lgamma(draws - k + 1) + lgamma(bad - draws + k + 1)

    peak, most = weight(mode), min(min(draws, good) + 1, int(mean + 16 * spread))
    while True:
        u, v = rng.random(), rng.random()
        x = mean + 0.5 + width * (v - 0.5) / max(u, 1e-300)
        if 0 <= x < most and 2 * log(max(u, 1e-300)) <= peak - weight(int(x)):
            return int(x)


def split(rng: np.random.Generator, shards: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``draws`` fall on each shard's free places."""
    if shards.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(shards, draws, method="marginals")
    out, rest = np.zeros(len(shards), np.int64), int(shards.sum())
    for j, free in enumerate(shards.tolist()):
        if not draws:
            break
        rest -= free
        out[j] = hypergeometric(rng, free, rest, draws)
        draws -= int(out[j])
    return out


def matrix_row(sizes: np.ndarray, shards: np.ndarray, block: int, seed: int, path: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row ``block`` of the communication matrix, and the sum of the rows before it. The blocks are halved again and again,
    each half's share of every shard drawn with a generator of its own, so that any task finds any row alone and always the
    same. ``path`` keeps what was drawn on the way, for a block nearby."""
    total = np.r_[0, np.cumsum(sizes)]
    low, high, free, before = 0, len(sizes), shards, np.zeros_like(shards)
    path = {} if path is None else path
    for gone in [k for k in path if not k[0] <= block < k[1]]:
        del path[gone]
    while high - low > 1:
        middle = (low + high) // 2
        child = (low, middle) if block < middle else (middle, high)
        if child not in path:
            left = split(np.random.default_rng([seed, 1, low, high]), free, int(total[middle] - total[low]))
            path[child] = (left, before) if block < middle else (free - left, before + left)
        free, before = path[child]
        low, high = child
    return free, before


def dealt(at: np.ndarray, key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 to size - 1, place by place: four rounds of a Feistel network on the least square of a power of two that
    holds the size, again and again until the place is within it."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = at.astype(np.uint64), np.arange(len(at))
    while len(left):
        x, k, h, m = out[left], key[left], half[left], mask[left]
        a, b = x >> h, x & m
        for turn in range(4):
            a, b = b, a ^ (mix(b + mix(k + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= size[left].astype(np.uint64)]
    return out.astype(np.int64)


def targets(sizes: np.ndarray, shards: np.ndarray, block: int, seed: int, path: dict | None = None) -> np.ndarray:
    """The shard of every row of a block: its row of the matrix, permuted. The cost follows the block's rows, and WIDE at most, not the number of shards."""
    many = -(-len(shards) // WIDE)
    heads = np.arange(0, len(shards), many)
    columns = np.add.reduceat(shards, heads)
    counts, before = matrix_row(sizes, columns, block, seed, path)
    to = np.repeat(np.arange(len(columns)), counts)
    if many > 1:
        place = before[to] + np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = dealt(place, mix(to.astype(np.uint64) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))), columns[to])
        ends = np.cumsum(shards)
        to = np.searchsorted(ends, (ends - shards)[heads][to] + place, side="right")
    return to[np.random.default_rng([seed, 2, block]).permutation(int(sizes[block]))]


def shard_sizes(rows: int, shard_rows: int) -> np.ndarray:
    """Sizes that differ by one at most, none over ``shard_rows``."""
    many = max(1, -(-rows // shard_rows))
    return np.full(many, rows // many, np.int64) + (np.arange(many) < rows % many)


def sharded(docs: DataFrame, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED, names: tuple[str, str] = ("shard", "position")) -> DataFrame:
    """The rows of ``docs`` with all their columns, and ``shard`` and ``position`` in it: a uniform permutation.

    Blocks are runs of rows of a file. Each block's permutation and its row of the matrix say where its rows go
    without a look at their content; then rows travel once, and each shard is permuted again by a seeded sort.
    The result depends on the files, not on how Spark splits them. Nulls, empty texts and repeated rows are rows
    like any others. A column of the input that has one of the two names, in any case of letters, stays, and the new
    one gets underscores at its end. An empty table gives an empty result.
    """
    ready_workers(docs.sparkSession)
    columns, docs = docs.columns, anchored(docs)
    to, place = names
    while to.lower() in {c.lower() for c in columns}:
        to += "_"
    while place.lower() in {c.lower() for c in [*columns, to]}:
        place += "_"
    at = docs.metadataColumn("_metadata")
    last = docs.select(F.xxhash64(at["file_path"]).alias(FID), F.floor(at["row_index"] / block_rows).alias("block"), at["row_index"].alias("row"))
    found = last.groupBy(FID, "block").agg(F.count("*").alias("n"), F.max("row").alias("last")).collect()
    if any(r.n != r["last"] - r.block * block_rows + 1 for r in found):
        # a filtered scan: number the rows that are left
        path = scratch(docs.sparkSession)
        docs.write.parquet(path)
        return sharded(docs.sparkSession.read.schema(docs.schema).parquet(path), shard_rows, block_rows, seed, names)
    found.sort(key=lambda r: (r[FID], r.block))
    sizes = np.array([r.n for r in found], np.int64)
    index = {(r[FID], r.block): i for i, r in enumerate(found)}
    shards = shard_sizes(int(sizes.sum()), shard_rows)
    shared = docs.sparkSession.sparkContext.broadcast((sizes, index, shards))  # a number for each block of block_rows rows and each shard

    @F.pandas_udf("long")
    def target(file: pd.Series, row: pd.Series) -> pd.Series:
        sizes, index, shards = shared.value
        row = row.to_numpy(np.int64)
        block, out = row // block_rows, np.empty(len(row), np.int64)
        for key, at in pd.Series(np.arange(len(row))).groupby([file.to_numpy(), block]).indices.items():
            i = index[int(key[0]), int(key[1])]
            if i not in drawn:
                drawn.clear()
                drawn[i] = targets(sizes, shards, i, seed, path)
            out[at] = drawn[i][row[at] - block[at] * block_rows]
        return pd.Series(out)

    drawn: dict[int, np.ndarray] = {}
    path: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    row, shard, order = spare([*KEY, to, place], 3)
    rows = stable_rows(docs, F.struct(*(F.col(named(c)) for c in columns)).alias(row))
    rows = rows.withColumn(shard, target(FID, ROW)).withColumn(order, F.xxhash64(F.lit(seed), FID, ROW))
    rank = F.expr(f"row_number() OVER (PARTITION BY {shard} ORDER BY {order}, {FID}, {ROW}) - 1").cast("long")
    return rows.withColumn("rank", rank).select(*(F.col(row)[c].alias(c) for c in columns), F.col(shard).alias(to), F.col("rank").alias(place))
