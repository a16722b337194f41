"""Mixing overlapping collections to target weights by a min-cost flow with convex repetition costs."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint, named, small_side

#: A document is used at most EPOCHS times. An epoch has SEGMENTS equal parts; each further part costs one more a token.
EPOCHS, SEGMENTS = 4, 4
#: Without given weights, a collection's weight is its tokens to this power.
TEMPER = 0.3
#: The hash space is counted in 2**BUCKET_BITS ranges of a pattern before one of them is looked at row by row.
BUCKET_BITS = 12
SEED = 17


def token_count(text: str = "text") -> Column:
    """Tokens of a text, estimated as a quarter of its UTF-8 bytes, rounded up; 0 of a null text."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def collections_of(docs: DataFrame) -> Column:
    """The overlapping collections of a document: its crawl source and its language."""
    return F.array_sort(F.array_compact(F.array(F.concat(F.lit("source:"), docs["source"]), F.concat(F.lit("lang:"), docs["lang"]))))


def quotas(weights: Mapping[str, float], budget: int) -> dict[str, int]:
    """The budget by weight in whole tokens; what rounding leaves goes to the largest remainders, ties by name."""
    total = sum(map(Fraction, weights.values()))
    if not total:
        return dict.fromkeys(weights, 0)
    exact = {k: Fraction(w) * budget / total for k, w in weights.items()}
    found = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (found[k] - exact[k], k))[: budget - sum(found.values())]:
        found[k] += 1
    return found


def _marginal(used: int, tokens: int) -> tuple[int, int]:
    """Cost of a pattern's next token, and how many more have that cost."""
    for part in range(used * SEGMENTS // tokens, EPOCHS * SEGMENTS):
        end = tokens * (part + 1) // SEGMENTS
        if end > used:
            return part, end - used
    return -1, 0


def flow(tokens: Mapping[tuple[str, ...], int], quota: Mapping[str, int]) -> dict[tuple[str, ...], dict[str, int]]:
    """Tokens that each membership pattern gives to each of its collections, at the least total cost of the fullest filling.

    Successive shortest paths: only the arcs into patterns have a cost, so the shortest path starts at the
    pattern whose next token is cheapest among those that reach a collection with quota left, in a breadth-first
    search that may reroute tokens given earlier. A pattern that reaches none never will again.
    """
    left = {c: q for c, q in quota.items() if q > 0}
    patterns = sorted(p for p, n in tokens.items() if n > 0)
    gives: dict[tuple[str, ...], dict[str, int]] = {p: {} for p in patterns}
    givers: dict[str, set[tuple[str, ...]]] = {c: set() for c in quota}
    used = dict.fromkeys(patterns, 0)
    heap = [(0, p) for p in patterns]
    heapq.heapify(heap)
    while heap and left:
        _, start = heapq.heappop(heap)
        came: dict = {start: None}
        queue, end = deque([start]), None
        while queue and end is None:
            p = queue.popleft()
            for c in p:
                if c not in givers or c in came:
                    continue
                came[c] = p
                if left.get(c, 0) > 0:
                    end = c
                    break
                for other in sorted(givers[c]):
                    if other not in came:
                        came[other] = c
                        queue.append(other)
        if end is None:
            continue
        amount, at = min(left[end], _marginal(used[start], tokens[start])[1]), end
        while came[at] is not None:
            if isinstance(at, tuple):
                amount = min(amount, gives[at][came[at]])
            at = came[at]
        at = end
        while came[at] is not None:
            before = came[at]
            p, c, change = (before, at, amount) if isinstance(before, tuple) else (at, before, -amount)
            gives[p][c] = gives[p].get(c, 0) + change
            if gives[p][c]:
                givers[c].add(p)
            else:
                del gives[p][c]
                givers[c].discard(p)
            at = before
        left[end] -= amount
        if not left[end]:
            del left[end]
        used[start] += amount
        cost, more = _marginal(used[start], tokens[start])
        if more:
            heapq.heappush(heap, (cost, start))
    return gives


def _prepared(docs: DataFrame, pattern: Column, tokens: Column, id_col: str, seed: int) -> tuple[Column, Column, Column]:
    kept = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(pattern, F.array().cast("array<string>")))))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[named(id_col)], kept, tokens), 1)
    return kept, tokens, order


def bounds(docs: DataFrame, pattern: Column, tokens: Column, weights: Mapping[str, float] | None = None, budget: float = 1.0, id_col: str = "doc_id", seed: int = SEED) -> dict[tuple[str, ...], list[tuple[str, int, int, int, int]]]:
    """By pattern, its collections' ranges ``(name, k0, h0, k1, h1)``: use k of a document of hash h goes to a collection if (k0, h0) <= (k, h) < (k1, h1).

    Ranges follow the flow exactly, up to the document at each end. Only (pattern, hash, tokens) is kept and
    counted; the driver gets a row for each pattern and each end of a range.
    """
    pat, tok, order = _prepared(docs, pattern, tokens, id_col, seed)
    slim = checkpoint(docs.select(pat.alias("pattern"), tok.alias("tokens"), order.alias("hash")).where("size(pattern) > 0"))
    have = {tuple(r.pattern): int(r.n) for r in slim.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    if weights is None:
        sizes: dict[str, int] = {}
        for p, n in have.items():
            for c in p:
                sizes[c] = sizes.get(c, 0) + n
        weights = {c: n**TEMPER for c, n in sizes.items() if n}
    gives = flow(have, quotas(weights, int(sum(have.values()) * budget)))
    ends: list[tuple[list[str], str, int, int]] = []
    for p, given in gives.items():
        total = 0
        for c in sorted(given):
            total += given[c]
            ends.append((list(p), c, *divmod(total, have[p])))
    cuts = [(p, rest) for p, _, _, rest in ends if rest]
    at: dict[tuple[tuple[str, ...], int], int] = {}
    if cuts:
        spark = docs.sparkSession
        wanted = spark.createDataFrame(cuts, "pattern array<string>, rest long").distinct()
        shift = 63 - BUCKET_BITS
        by_range = slim.groupBy("pattern", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("tokens").alias("n"))
        over = "OVER (PARTITION BY pattern ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        before = by_range.withColumn("before", F.expr(f"coalesce(sum(n) {over}, 0)"))
        inside = checkpoint(wanted.join(before, "pattern").where("before < rest").groupBy("pattern", "rest").agg(F.max("bucket").alias("bucket"), F.max("before").alias("before")))
        rows = slim.withColumn("bucket", F.shiftright("hash", shift)).join(small_side(inside.select("pattern", "bucket").distinct(), len(cuts)), ["pattern", "bucket"])
        fine = rows.groupBy("pattern", "bucket", "hash").agg(F.sum("tokens").alias("n"))
        over = "OVER (PARTITION BY pattern, bucket ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        fine = fine.withColumn("prior", F.expr(f"coalesce(sum(n) {over}, 0)"))
        first = inside.join(fine, ["pattern", "bucket"]).groupBy("pattern", "rest", "bucket").agg(F.min(F.when(F.col("before") + F.col("prior") >= F.col("rest"), F.col("hash"))).alias("hash"))
        at = {(tuple(r.pattern), r.rest): r.hash if r.hash is not None else (r.bucket + 1) << shift for r in first.collect()}
    found: dict[tuple[str, ...], list[tuple[str, int, int, int, int]]] = {}
    for p, c, k, rest in ends:
        ranges = found.setdefault(tuple(p), [])
        k0, h0 = ranges[-1][3:] if ranges else (0, 0)
        # the end of the last hash range is 2**63, beyond a long; (k + 1, 0) says the same
        h = at[tuple(p), rest] if rest else 0
        k1, h1 = (k + 1, 0) if h >= 1 << 63 else (k, h)
        ranges.append((c, k0, h0, k1, h1))
    return found


def _joined(docs: DataFrame, pattern: Column | None, tokens: Column | None, weights, budget: float, id_col: str, seed: int) -> DataFrame:
    """``docs`` in a struct ``row``, with ``uses``: (collection, copies) by the ranges of its pattern; rows without use are left out."""
    pattern = collections_of(docs) if pattern is None else pattern
    tokens = token_count() if tokens is None else tokens
    ranges = bounds(docs, pattern, tokens, weights, budget, id_col, seed)
    small = docs.sparkSession.createDataFrame([(list(p), r) for p, r in ranges.items()], "pattern array<string>, ranges array<struct<c:string,k0:long,h0:long,k1:long,h1:long>>")
    pat, _, order = _prepared(docs, pattern, tokens, id_col, seed)
    rows = docs.select(F.struct(*(docs[named(c)] for c in docs.columns)).alias("row"), pat.alias("pattern"), order.alias("hash"))
    uses = F.expr("filter(transform(ranges, r -> struct(r.c AS collection, r.k1 + int(hash < r.h1) - r.k0 - int(hash < r.h0) AS copies)), u -> u.copies > 0)")
    return rows.join(small_side(small, len(ranges)), "pattern").select("row", "hash", uses.alias("uses")).where("size(uses) > 0")


def assigned(docs: DataFrame, pattern: Column | None = None, tokens: Column | None = None, weights: Mapping[str, float] | None = None, budget: float = 1.0, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``doc_id, collection, copies``: how often a document is used for each collection.

    ``pattern`` is an array of a document's collections; ``budget`` is in multiples of all tokens; a quota that
    EPOCHS uses of all its documents can't fill stays short. Within a pattern documents are taken in the order of a
    seeded hash of id, pattern and tokens: rows that are equal in these are all used alike. A null id
    counts as a value. Null and empty texts have no tokens and go with the row that follows in that order; a
    pattern without any token and a document in no collection are left out. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    found = _joined(docs, pattern, tokens, weights, budget, id_col, seed)
    return found.select(F.col("row")[id_col].alias("doc_id"), F.explode("uses").alias("use")).select("doc_id", "use.collection", "use.copies")


def mixed(docs: DataFrame, pattern: Column | None = None, tokens: Column | None = None, weights: Mapping[str, float] | None = None, budget: float = 1.0, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, under whatever names, as often as ``assigned`` uses them.

    Nulls, texts without tokens, ties and repeated rows are decided as there: a document in no collection, or of a pattern
    without any token, is used zero times. An empty table stays empty.
    """
    found = _joined(docs, pattern, tokens, weights, budget, id_col, seed)
    copies = F.expr("aggregate(uses, 0L, (n, u) -> n + u.copies)")
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("row.*")
