"""Embedding near-deduplication by product quantisation: inverted lists, residual codes, table lookups, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import FID, ROW, anchored, checkpoint, connected, mix, named, ready_workers, small_side, spread_join, stable_rows

#: Vectors of at least this cosine are near copies.
COSINE = 0.9
#: Mean length of an inverted list; members of a cell that one task searches.
LIST_ROWS, CELL_MEMBERS = 512, 32_768
#: Cells that a level of the coarse quantiser splits one into, at most; members that one gets on average where fewer will do.
FAN, FAN_ROWS = 256, 2048
#: Vectors a centre that it is fitted on, chosen by a seeded hash; rounds of fitting; residuals that the codebooks are fitted on.
SAMPLE_EACH, ROUNDS, BOOK_ROWS = 40, 8, 20_000
#: Subspaces, and codes in each.
PARTS, CODES = 16, 16
#: A cell or list is probed if a shift of the largest length that COSINE allows, in a random direction, crosses into it with this many standard deviations.
PROBE_Z = 1.25
#: What a table distance may exceed the squared radius by and still be reranked, in standard deviations of the quantisation error.
SLACK_Z = 3.0
#: Queries whose tables are held at a time.
ABREAST = 256
_PLACED = "cell long, node long, own boolean, v array<float>"


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from random rows; an empty cluster takes a random row."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres, np.float64)
        np.add.at(sums, near, x)
        some = counts > 0
        centres[some] = (sums[some] / counts[some, None]).astype(x.dtype)
        centres[~some] = x[rng.integers(0, len(x), (~some).sum())]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.empty(0, np.int64), *((half - x[s : s + 4096] @ centres.T).argmin(axis=1) for s in range(0, len(x), 4096))])


def margins(x: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and the centres whose cells they probe, and each row's own cell, which is one of them."""
    dist = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
    home, at = dist.argmin(axis=1), np.arange(len(x))
    square = (centres**2).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] - 2 * centres @ centres.T + square, 1e-12))[home]  # FAN or a task's lists squared
    margin = (dist - dist[at, home][:, None]) / (2 * apart)
    margin[at, home] = -1
    row, to = np.nonzero(margin <= PROBE_Z * radius / np.sqrt(x.shape[1]))
    return row, to, home


@dataclass
class Books:
    """Residual codebooks (PARTS, CODES, D / PARTS), shared by all lists."""

    books: np.ndarray

    def encode(self, rest: np.ndarray) -> np.ndarray:
        cut = rest.reshape(len(rest), PARTS, -1)
        return np.stack([nearest(np.ascontiguousarray(cut[:, m]), self.books[m]) for m in range(PARTS)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(PARTS)], axis=1)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to all pairs of codes of two subspaces: (queries, PARTS / 2, CODES ** 2)."""
        cut = rest.reshape(len(rest), PARTS, 1, -1)
        one = ((cut - self.books[None]) ** 2).sum(axis=3)
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(rest), PARTS // 2, CODES * CODES)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the edges between ids, those that a spanning forest needs."""
    parent: dict[int, int] = {}
    kept = []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def search(books: Books, centre: np.ndarray, members: np.ndarray, queries: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries and members of one list with at least that cosine: table distances choose, exact cosines decide."""
    rest = members - centre
    codes = books.encode(rest)
    off = ((rest - books.decode(codes)) ** 2).sum(axis=1)
    pairs = (codes[:, ::2].astype(np.intp) * CODES + codes[:, 1::2]).T.copy()
    # a member's code lies off it by its quantisation error, which adds to the squared distance on average
    square = 2 - 2 * cosine
    limit = (square + off + SLACK_Z * (off.std() + 2 * np.sqrt(square * off / members.shape[1]))).astype(np.float32)
    dist, part_dist = np.empty((ABREAST, len(members)), np.float32), np.empty((ABREAST, len(members)), np.float32)
    for s in range(0, len(queries), ABREAST):
        part = queries[s : s + ABREAST]
        table = books.tables(part - centre).astype(np.float32)
        total, more = dist[: len(part)], part_dist[: len(part)]
        np.take(table[:, 0], pairs[0], axis=1, out=total, mode="clip")
        for m in range(1, PARTS // 2):
            total += np.take(table[:, m], pairs[m], axis=1, out=more, mode="clip")
        q, y = np.nonzero(total <= limit)
        exact = np.einsum("nd,nd->n", part[q], members[y]) >= cosine
        yield q[exact] + s, y[exact]


def _cell_edges(shared, cosine: float, list_rows: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.flatnonzero(rows["own"].to_numpy())
        edges: list[tuple[int, int]] = []
        if len(own):
            books = shared.value
            x, ids = stacked(rows["v"], books.books.shape[0] * books.books.shape[2]), rows["node"].to_numpy()
            lists = -(-len(own) // list_rows)
            chosen = own[np.argsort(mix(ids[own].view(np.uint64)), kind="stable")[: SAMPLE_EACH * lists]]
            centres = k_means(x[chosen], lists, ROUNDS, np.random.default_rng(7))
            home = nearest(x[own], centres)
            radius = float(np.sqrt(2 - 2 * cosine))
            row, to = (np.concatenate(y) for y in zip(*((r + s, t) for s in range(0, len(x), 4096) for r, t, _ in [margins(x[s : s + 4096], centres, radius)]), strict=True))
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(lists + 1))
            for k in range(lists):
                mine, asked = own[home == k], row[order[bounds[k] : bounds[k + 1]]]
                if len(mine):
                    for q, y in search(books, centres[k], x[mine], x[asked], cosine):
                        edges += forest(ids[asked[q]], ids[mine[y]])
        return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def normal(raw) -> np.ndarray | None:
    """The vector at unit length, or None if it is none, empty, of length zero or has a component that is null or no sound number."""
    if raw is None or not len(raw):
        return None
    x = np.asarray(raw, np.float64)
    if not np.isfinite(x).all() or np.abs(x).max() >= 1e150 or np.abs(x).max() <= 1e-150:
        return None
    # -0.0 becomes 0.0
    return (x / np.sqrt((x * x).sum())).astype(np.float32) + np.float32(0)


def stacked(v: pd.Series, wide: int) -> np.ndarray:
    """Vectors as rows, with zeros up to ``wide``."""
    x = np.stack(v.to_numpy()).astype(np.float32)
    return np.pad(x, ((0, 0), (0, wide - x.shape[1])))


def _sample(rows: DataFrame, share: float, salt: int) -> DataFrame:
    """About that share of the rows, by a seeded hash of the node."""
    return rows if share >= 1 else rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(salt), "node"), 1) <= int(((1 << 63) - 1) * share))


def split_cells(placed: DataFrame, members: int, cells: int, wide: int, radius: float, level: int) -> tuple[DataFrame, int]:
    """Each cell of ``placed`` split by centres of its own, fitted on a bounded sample of its members: rows go to the cells that they probe. Also the number of centres.

    The table of centres is broadcast if it has at most FAN cells, each of FAN centres at most; else it is joined.
    """
    fan = max(1, min(FAN, -(-members // (FAN_ROWS * cells))))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        x = stacked(rows["v"], wide)[np.argsort(mix(rows["node"].to_numpy().view(np.uint64)), kind="stable")[: SAMPLE_EACH * fan]]
        centres = k_means(x, min(fan, len(x)), ROUNDS, np.random.default_rng([level, int(rows["cell"].iat[0]) & 0xFFFF]))
        return pd.DataFrame({"cell": rows["cell"].iloc[:1].to_numpy(), "centres": [centres.astype(np.float32).tobytes()]})

    # of each cell about SAMPLE_EACH members a centre, however many it has
    own, order = placed.where("own"), F.shiftrightunsigned(F.xxhash64(F.lit(level), "node"), 1)
    if cells == 1:
        chosen = _sample(own, SAMPLE_EACH * fan / max(1, members), level)
    else:
        sizes = own.groupBy("cell").agg(F.count("*").alias("size"))
        chosen = own.join(F.broadcast(sizes) if cells <= FAN else sizes, "cell").where(order <= F.lit(float((1 << 63) - 1)) * SAMPLE_EACH * fan / F.col("size")).drop("size")
    table = checkpoint(chosen.groupBy("cell").applyInPandas(fitted, "cell long, centres binary"))
    alone = bytes(table.first().centres) if cells == 1 else None
    joined = placed if cells == 1 else placed.join(F.broadcast(table) if cells <= FAN else table, "cell", "left")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, part in batch.groupby("cell", sort=False):
                raw = alone or part["centres"].iat[0]
                x, ids, own = stacked(part["v"], wide), part["node"].to_numpy(), part["own"].to_numpy(bool)
                centres = np.frombuffer(raw, np.float32).reshape(-1, wide) if raw is not None else np.zeros((1, wide), np.float32)
                for s in range(0, len(part), 1024):
                    row, to, home = margins(x[s : s + 1024], centres, radius)
                    mine = own[s + row] & (to == home[row])
                    yield pd.DataFrame({"cell": int(cell) * FAN + to, "node": ids[s + row], "own": mine, "v": list(x[s + row])})

    return joined.mapInPandas(place, _PLACED), fan


def near_vectors(rows: DataFrame, cosine: float = COSINE, list_rows: int = LIST_ROWS, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """``a, b``: edges that connect the nodes of ``rows`` (node long, v array<float> of unit length and one dimension) as all near pairs do.

    Every node is a query: it goes to its own list as a member and to every list that a near copy may lie in. Cells are split
    level by level until a task can hold one, and each is cut into inverted lists there, so no index of all lists is ever in one
    place. A cell that stays too large, as its vectors are too alike, is searched in blocks of its members, each by
    all its queries. A near pair is found from either side.
    """
    spark = rows.sparkSession
    ready_workers(spark)
    many = rows.count()
    if many < 2:
        return spark.createDataFrame([], "a long, b long")
    radius = float(np.sqrt(2 - 2 * cosine))
    wide = -(-len(rows.select("v").first().v) // PARTS) * PARTS
    placed, cells, level = rows.select(F.lit(0).cast("long").alias("cell"), "node", F.lit(True).alias("own"), "v"), 1, 0
    while True:
        placed, fan = split_cells(placed, many, cells, wide, radius, level)
        cells, level = cells * fan, level + 1
        if many <= cells * cell_members or fan < FAN:
            break
        placed = checkpoint(placed)
    x = stacked(_sample(rows, BOOK_ROWS / many, 10).orderBy(F.xxhash64(F.lit(10), "node")).limit(BOOK_ROWS).select("v").toPandas()["v"], wide)
    # codes are of residuals from list centres; such as lists of this sample have them
    centres = k_means(x, max(1, min(len(x) // SAMPLE_EACH, -(-many // list_rows))), ROUNDS, np.random.default_rng(11))
    rest, rng = (x - centres[nearest(x, centres)]).reshape(-1, PARTS, wide // PARTS), np.random.default_rng(11)
    shared = spark.sparkContext.broadcast(Books(np.stack([k_means(np.ascontiguousarray(rest[:, m]), CODES, 8, rng) for m in range(PARTS)])))
    sizes = placed.where("own").groupBy("cell").count().where(F.col("count") > cell_members)
    large = [(r.cell, -(-r["count"] // cell_members)) for r in sizes.collect()]  # at most a row for each cell_members vectors
    if large:
        blocks = placed.join(small_side(spark.createDataFrame(large, "cell long, blocks int"), len(large)), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        placed = blocks.select("cell", "node", (F.col("own")).alias("member"), mine.alias("mine"), "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        placed = placed.select("cell", "block", "node", (F.col("member") & (F.col("mine") == F.col("block"))).alias("own"), "v")
    else:
        placed = placed.withColumn("block", F.lit(0))
    return placed.groupBy("cell", "block").applyInPandas(_cell_edges(shared, cosine, list_rows), "a long, b long")


def near_groups(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS) -> DataFrame:
    """``vec_id, group_id, copies, keep`` for every row: groups are what near pairs connect, named by their least id.

    The row of the least id of a group stays (a null id sorts first; of rows with equal ids, any one). Vectors
    that are null, empty, of length zero or have a null, NaN or infinite component have no near copy; vectors of
    different dimensions aren't compared. Equal vectors, repeated rows included, are one node of the search.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    ready_workers(vectors.sparkSession)
    vectors = anchored(vectors)
    v = F.col(named(vector_col)).cast("array<double>")
    rows = stable_rows(vectors, F.col(named(id_col)).alias("vec_id"), v.alias("raw"))

    @F.pandas_udf("array<float>")
    def unit(raw: pd.Series) -> pd.Series:
        return pd.Series([normal(x) for x in raw], dtype=object)

    nodes = checkpoint(rows.select(FID, ROW, "vec_id", unit("raw").alias("v")).where("v is not null").withColumn("h", F.xxhash64("v")))
    distinct = checkpoint(nodes.groupBy("h", "v").agg(F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()))
    edges = None
    for (width,) in distinct.select(F.size("v")).distinct().collect():
        found = near_vectors(distinct.where(F.size("v") == width), cosine, list_rows)
        edges = found if edges is None else edges.union(found)
    if edges is None:
        edges = vectors.sparkSession.createDataFrame([], "a long, b long")
    roots = connected(edges)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    groups = distinct.join(roots, "node", "left").select("h", "v", "size", F.coalesce("root", "node").alias("root"))
    labelled = spread_join(nodes, groups, ["h", "v"]).select(FID, ROW, "vec_id", "root")
    sizes = labelled.groupBy("root").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min(F.struct("vec_id", FID, ROW)).alias("first"))
    marked = spread_join(labelled, sizes.where("copies > 1").withColumn("size", F.col("copies")), ["root"]).select(FID, ROW, "copies", "least", (F.struct("vec_id", FID, ROW) == F.col("first")).alias("keep"))
    joined = stable_rows(vectors, F.col(named(id_col)).alias("vec_id")).join(marked, [FID, ROW], "left")
    return joined.select(
        "vec_id",
        F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("group_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("keep", F.lit(True)).alias("keep"),
    )
