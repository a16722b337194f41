"""Near-deduplication: weighted SimHash lanes, mapped to bit counts by segment and range-joined on a grid."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import KEY, SLAB_CHARS, anchored, checkpoint, connected, mix, named, small_batches, spare, spread_join, stable_rows, word_hashes

#: A fingerprint is LANES weighted SimHashes of 64 bits for the search and PLAIN words of one in which all features weigh alike.
#: A feature's weight in a lane is the inverse square of a seeded uniform number, so that few features rule a lane, others in each.
LANES, PLAIN = 8, 4
#: Two documents are near copies if at most MAX_BITS of the 256 plain bits differ and, in some lane, at most RANGE of 64.
MAX_BITS, RANGE = 64, 1
#: Segments of a lane, of 4 bits, whose bit counts are its place in the grid.
SEGMENTS = 16
#: Nodes of a group that are compared in one go; larger groups are compared block by block. Rows of a task that compares.
CELL_ROWS, TASK_ROWS = 16_384, 200_000
#: Values of lanes that a task takes to the grid, each to 13 cells on average.
VALUE_ROWS = 100_000
#: Characters whose features are held at a time.
SLAB = SLAB_CHARS // 4
_WORDS = LANES + PLAIN
_SEEDS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SIGNS = mix(np.arange(1, PLAIN + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_HEAVIEST = 2.0**45
#: The eight votes of each byte, 1 or -1.
_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1


def pieces(texts: list[str], limit: int) -> Iterator[tuple[int, str, bool]]:
    """``(index, piece, continued)``: texts over ``limit`` are cut at spaces; a piece starts with the word before the cut."""
    for i, text in enumerate(texts):
        start = 0
        while True:
            end = len(text) if len(text) - start <= limit else text.rfind(" ", start + limit // 2, start + limit)
            if end < 0:
                end = start + limit
            yield i, text[start:end], start > 0
            if end == len(text):
                break
            back = text.rfind(" ", start, end)
            start = back if start < back and end - back < limit // 4 else end


def _inside(codes: np.ndarray) -> np.ndarray:
    low = np.zeros(0x300, bool)
    low[[*range(48, 58), *range(97, 123)]] = True
    low[0xC0:] = True
    return np.where(codes < 0x300, low[np.minimum(codes, 0x2FF)], ~(((codes >= 0x2000) & (codes < 0x2070)) | ((codes >= 0x3000) & (codes < 0x3040))))


def word_pairs(texts: list[str], continued: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct pair of neighbouring words, by text; the first word pairs with nothing."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, _, words = word_hashes(codes, _inside(codes))
    if not len(words):
        return np.empty(0, np.int64), words
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    before = np.r_[np.uint64(0), words[:-1]]
    before[heads] = 0
    pairs = mix(before * np.uint64(0x9FB21C651E98DF25) + words)
    keep = np.ones(len(pairs), bool)
    keep[heads[continued[of[heads]]]] = False
    of, pairs = of[keep], pairs[keep]
    order = np.lexsort((pairs, of))
    of, pairs = of[order], pairs[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (pairs[1:] != pairs[:-1])] if len(of) else np.empty(0, bool)
    return of[new], pairs[new]


def votes(features: np.ndarray, bounds: list[tuple[int, int]], run: int = 4096) -> np.ndarray:
    """(ranges, _WORDS, 64): of each range of features the signed votes for each bit. Weights are whole and sums below 2**53, so exact in any order.

    Ranges that follow each other are done about ``run`` features at a time, so that what they need stays in the processor's cache.
    """
    out = np.zeros((len(bounds), _WORDS, 64))
    room = np.empty((8 * min(run, max((b for _, b in bounds), default=0)), 8))
    k = 0
    while k < len(bounds):
        first, upto = k, k + 1
        while upto < len(bounds) and bounds[upto][1] - bounds[first][0] <= run:
            upto += 1
        k = upto
        for low in range(bounds[first][0], bounds[upto - 1][1], run) if upto == first + 1 else [bounds[first][0]]:
            part = features[low : min(low + run, bounds[upto - 1][1])]
            rows = np.ones((_WORDS, len(part)))
            for lane, seed in enumerate(_SEEDS):
                u = ((mix(part ^ seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
                np.floor(np.minimum(1 / (u * u), _HEAVIEST), out=rows[lane])
            for block, seed in enumerate(_SIGNS):
                signs = np.take(_BYTES, mix(part ^ seed).view(np.uint8), axis=0, out=room[: 8 * len(part)], mode="clip").reshape(-1, 64)
                to = slice(block, None, PLAIN)
                mine = np.ascontiguousarray(rows[to])
                for n in range(first, upto):
                    a, b = max(0, bounds[n][0] - low), min(bounds[n][1] - low, len(part))
                    out[n, to] += mine[:, a:b] @ signs[a:b]
    return out


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """(texts, LANES + PLAIN) words of 64 bits; rows of texts without a word, or null, are all zero. Every distinct word pair votes in all of them."""
    totals = np.zeros((len(texts), _WORDS, 64), bool)
    some = np.zeros(len(texts), bool)
    parts: dict[int, list[np.ndarray]] = {}
    group: list[tuple[int, str, bool]] = []

    def put(at: np.ndarray, features: np.ndarray, bounds: list[tuple[int, int]]) -> None:
        totals[at] = votes(features, bounds) > 0
        some[at] = True

    def flush() -> None:
        if group:
            at = np.array([i for i, _, _ in group])
            of, pairs = word_pairs([p for _, p, _ in group], np.array([c for _, _, c in group]))
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
            spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(of)], strict=False))
            whole = [k for k, (a, _) in enumerate(spans) if len(texts[at[of[a]]]) <= SLAB]
            if whole:
                put(at[of[heads[whole]]], pairs, [spans[k] for k in whole])
            for k in set(range(len(spans))) - set(whole):
                parts.setdefault(int(at[of[spans[k][0]]]), []).append(pairs[slice(*spans[k])])
            group.clear()

    size = 0
    lower = [(t or "").lower() for t in texts]
    texts = lower
    for i, piece, continued in pieces(lower, SLAB):
        if size + len(piece) > SLAB:
            flush()
            size = 0
        group.append((i, piece, continued))
        size += len(piece)
    flush()
    for i, found in parts.items():
        features = np.unique(np.concatenate(found))
        totals[i], some[i] = votes(features, [(0, len(features))])[0] > 0, True
    out = np.packbits(totals, axis=2, bitorder="little").view(np.uint64)[:, :, 0].copy()
    # a text whose votes are all negative has a word nevertheless
    out[some & ~out.any(axis=1), LANES] = 1
    return out


def counts(lanes: np.ndarray) -> np.ndarray:
    """(nodes, SEGMENTS): the bits that are set in each segment of a lane."""
    width = np.uint64(64 // SEGMENTS)
    mask = np.uint64((1 << int(width)) - 1)
    return np.bitwise_count((lanes[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * width)) & mask).astype(np.uint64)


def cells(lane: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells, for a join of all pairs of words of one lane whose counts have a Manhattan distance of RANGE = 1.

    Counts at a distance of one have sums of different parity, so rows of an even sum are in the cell of their counts and
    rows of an odd sum in the neighbouring cells, one segment up or down.
    """
    found = counts(lanes)
    place = np.uint64(3) * np.arange(SEGMENTS, dtype=np.uint64)
    own = (found << place).sum(axis=1, dtype=np.uint64)
    odd = found.sum(axis=1) % np.uint64(2) == 1
    even, odd = np.flatnonzero(~odd), np.flatnonzero(odd)
    rows, keys = [even], [own[even]]
    for s in range(SEGMENTS):
        step, c = np.uint64(1) << place[s], found[odd, s]
        for at, to in ((c > 0, own[odd] - step), (c < np.uint64(64 // SEGMENTS), own[odd] + step)):
            rows.append(odd[at])
            keys.append(to[at])
    at = np.concatenate(rows)
    return at, mix(np.concatenate(keys) ^ _SEEDS[lane[at]]).view(np.int64)


def near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether fingerprints are near copies, row by row."""
    bits = np.bitwise_count(x ^ y)
    return (bits[..., LANES:].sum(axis=-1, dtype=np.int32) <= max_bits) & (bits[..., :LANES].min(axis=-1) <= RANGE)


def _hits(fps: np.ndarray, plain: np.ndarray, one: np.ndarray, two: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``one`` and ``two`` of near rows; the plain words decide first."""
    a, b = [], []
    for s in range(0, len(two), 4096):
        part = two[s : s + 4096]
        total = np.zeros((len(one), len(part)), np.uint16)
        for word in plain:
            total += np.bitwise_count(word[one, None] ^ word[None, part])
        i, j = np.nonzero(total <= max_bits)
        ok = np.bitwise_count(fps[one[i], :LANES] ^ fps[part[j], :LANES]).min(axis=1, initial=64) <= RANGE
        a.append(i[ok])
        b.append(j[ok] + s)
    return np.concatenate(a), np.concatenate(b)


def links(fps: np.ndarray, max_bits: int, first: int = 0, abreast: int = 128) -> list[tuple[int, int]]:
    """Edges that connect rows as all near pairs do; as the near pairs of one of the ``first`` rows and one of the others, if ``first``.

    Rows are compared ``abreast``, of one component if there are enough, and then only with rows of others; rows
    that have been compared with all others are done.
    """
    plain = np.ascontiguousarray(fps[:, LANES:].T)
    group, found = np.arange(len(fps)), []
    todo, others = np.arange(first or len(fps)), np.arange(first, len(fps))
    while len(todo):
        same = todo[group[todo] == group[todo[0]]][:abreast]
        mixed = len(same) < min(abreast, len(todo)) // 4
        one, against = todo[:abreast] if mixed else same, others if first else todo
        two = against if mixed else against[group[against] != group[same[0]]]
        if not len(two) and not first:
            break
        i, j = _hits(fps, plain, one, two, max_bits) if len(two) else (one[:0], one[:0])
        i, j = one[i], two[j]
        apart = group[i] != group[j]
        while apart.any():
            # each of the other components joins the first of those that it is linked to
            i, j = i[apart], j[apart]
            high, low = np.maximum(group[i], group[j]), np.minimum(group[i], group[j])
            order = np.lexsort((low, high))
            top = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            found += list(zip(i[top].tolist(), j[top].tolist(), strict=True))
            to = np.arange(len(fps))
            to[high[top]] = low[top]
            while (to[to] != to).any():
                to = to[to]
            group = to[group]
            apart = group[i] != group[j]
        todo = todo[len(one) :] if mixed else todo[~np.isin(todo, one)]
    return found


def small_links(fps: np.ndarray, heads: np.ndarray, tails: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within each of many small ranges of rows."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    plain, size = np.ascontiguousarray(fps[:, LANES:]), tails - heads
    for n in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        each = max(1, 100_000 // len(i))
        for s in range(0, len(at := heads[size == n]), each):
            x, y = (at[s : s + each, None] + i).ravel(), (at[s : s + each, None] + j).ravel()
            close = np.bitwise_count(plain[x] ^ plain[y]).sum(axis=1, dtype=np.int32) <= max_bits
            x, y = x[close], y[close]
            ok = np.bitwise_count(fps[x, :LANES] ^ fps[y, :LANES]).min(axis=1, initial=64) <= RANGE
            a.append(x[ok])
            b.append(y[ok])
    return np.concatenate(a), np.concatenate(b)


def _unit_links(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch for batch in batches if len(batch)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        unit = rows[["lane", "cell", "one", "two", "block"]].to_numpy(np.int64)
        order = np.lexsort(unit.T[::-1])
        unit, ids = unit[order], rows["node"].to_numpy(np.int64)[order]
        fps = np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(-1, _WORDS)[order]
        heads = np.flatnonzero(np.r_[True, (unit[1:, :4] != unit[:-1, :4]).any(axis=1)])
        tails = np.r_[heads[1:], len(unit)]
        big = tails - heads > 32
        i, j = small_links(fps, heads[~big], tails[~big], max_bits)
        pairs = [np.stack([i, j], axis=1)]
        for a, b in zip(heads[big], tails[big], strict=True):
            # rows of two blocks are compared across only
            first = int((unit[a:b, 4] == unit[a, 2]).sum()) if unit[a, 2] < unit[a, 3] else 0
            if first < b - a:
                pairs.append(np.array(links(fps[a:b], max_bits, first), np.int64).reshape(-1, 2) + a)
        both = np.concatenate(pairs)
        edges = np.unique(np.sort(ids[both], axis=1), axis=0)
        yield pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return run


def lane_links(values: DataFrame) -> DataFrame:
    """``lane, cell, value, size, cell_size``: all pairs of a lane's values (lane byte, value long, size int, all distinct) that differ in RANGE bits.

    The bit counts of such a pair have a Manhattan distance of RANGE, so it meets in a cell of the grid for certain. Only the
    words themselves travel there. ``cell`` is the value of more nodes, the even one of two alike.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batched(batches, 16):
            lane, value, size = (np.concatenate([batch[c].to_numpy() for batch in some]) for c in ("lane", "value", "size"))
            at, key = cells(lane, value.view(np.uint64))
            yield pd.DataFrame({"place": key, "lane": lane[at], "value": value[at], "size": size[at]})

    even, odd = (values.where(F.bit_count("value") % 2 == k).mapInPandas(place, "place long, lane byte, value long, size int") for k in (0, 1))
    met = even.toDF("place", "lane", "e", "m").hint("shuffle_hash").join(odd.toDF("place", "lane", "o", "n"), ["place", "lane"]).where(F.bit_count(F.col("e").bitwiseXOR(F.col("o"))) == RANGE)
    larger = F.col("m") >= F.col("n")
    return met.select("lane", F.when(larger, F.col("e")).otherwise(F.col("o")).alias("cell"), F.when(larger, F.col("o")).otherwise(F.col("e")).alias("value"), F.least("m", "n").alias("size"), F.greatest("m", "n").alias("cell_size"))


def near_edges(nodes: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a, b``: edges that connect the nodes (node long, fp binary, all distinct) as all near pairs do.

    Nodes of a near pair have a lane's value in common, or values that differ in RANGE bits. So a value's nodes are compared
    with each other once, and with the nodes of each linked value that has no more of them, which are its guests; only what
    has someone to meet travels with its fingerprint. A group of many nodes is split into blocks, and every two blocks meet
    in a task.
    """
    spark = nodes.sparkSession

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch["fp"]), np.uint64).reshape(-1, _WORDS)
            ids = batch["node"].to_numpy(np.int64)
            for lane in range(LANES):
                yield pd.DataFrame({"lane": np.full(len(ids), lane, np.int8), "value": fps[:, lane].view(np.int64), "node": ids})

    placed = nodes.mapInPandas(split, "lane byte, value long, node long")
    tasks = max(-(-nodes.count() * LANES // VALUE_ROWS), spark.sparkContext.defaultParallelism)
    values = checkpoint(placed.repartition(tasks, "lane", "value").groupBy("lane", "value").agg(F.count("*").cast("int").alias("size")))
    linked = checkpoint(lane_links(values))
    hosts = values.where("size > 1").union(linked.where("cell_size = 1").select("lane", "cell", "cell_size").distinct())
    meeting = hosts.select("lane", F.col("value").alias("cell"), "value", "size").union(linked.select("lane", "cell", "value", "size"))
    totals = checkpoint(meeting.groupBy("lane", "cell").agg(F.ceil(F.sum("size") / cell_rows).cast("int").alias("blocks"), F.sum("size").alias("total")))
    many = totals.agg(F.sum(F.col("total") * F.col("blocks"))).first()[0] or 0
    if not many:
        return spark.createDataFrame([], "a long, b long")
    members = placed.join(meeting.join(totals, ["lane", "cell"]).select("lane", "value", "cell", "blocks"), ["lane", "value"]).select("lane", "cell", "blocks", "node")
    dealt = members.join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.select("lane", "cell", "node", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = met.select("lane", "cell", "node", "fp", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    parts = units.repartition(max(1, -(-int(many) // TASK_ROWS), spark.sparkContext.defaultParallelism), "lane", "cell", "one", "two")
    return parts.mapInPandas(_unit_links(max_bits), "a long, b long")


def near_rows(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> DataFrame:
    """Rows of an anchored DataFrame that have a near copy: row identity, ``least`` id of the group, ``copies``, ``keep``.

    Rows of one fingerprint become one node, numbered, as hashes of that many fingerprints might meet.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def sketch(text: pd.Series) -> pd.Series:
        fps = fingerprints(list(text))
        return pd.Series([fp.tobytes() if fp.any() else None for fp in fps], dtype=object)

    rows = checkpoint(stable_rows(docs, F.col(named(id_col)).alias("id"), sketch(F.col(named(text_col))).alias("fp")).where("fp is not null"))
    nodes = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()))
    roots = connected(near_edges(nodes.select("node", "fp"), max_bits))
    first = F.struct("id", *KEY)
    labelled = spread_join(rows, nodes.join(roots, "node", "left").select("fp", "size", F.coalesce("root", "node").alias("root")), ["fp"]).select(*KEY, "id", "root")
    sizes = labelled.groupBy("root").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.min(first).alias("first"))
    return spread_join(labelled, sizes.where("copies > 1").withColumn("size", F.col("copies")), ["root"]).select(*KEY, "least", "copies", (first == F.col("first")).alias("keep"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, group_id, copies, keep`` for every row: groups are what near pairs connect, named by their least id.

    The row with the least id of a group stays (a null id sorts first; of rows with equal ids, any one).
    Null texts and texts without a word have no near copy and stay. Repeated rows are near copies of each
    other. Columns other than id and text are ignored, whatever their names. An empty table gives an empty result.
    """
    docs = anchored(docs)
    found = near_rows(docs, id_col, text_col, max_bits)
    joined = stable_rows(docs, F.col(named(id_col)).alias("doc_id")).join(found, list(KEY), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("group_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("keep", F.lit(True)).alias("keep"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps, with all their columns, under whatever names.

    Nulls, texts without a word, ties and repeated rows are decided as there. An empty table stays empty.
    """
    columns, docs = docs.columns, anchored(docs)
    key = spare(columns, 2)
    losers = near_rows(docs, id_col, text_col, max_bits).where("not keep").select(*KEY).toDF(*key)
    return stable_rows(docs, *map(named, columns), key=key).join(losers, key, "left_anti").select(*map(named, columns))
