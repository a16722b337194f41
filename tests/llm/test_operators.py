import base64
import bz2
import gzip
import itertools
import lzma
import random
import time
import urllib.parse
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import common, langid, mixing, packing, quantised, queries, radix, secret_scan, sharding, simhash, toxicity, urls
from corpusloom.llm.common import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ROW string, shard int, page_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, "x", 7, 1) for i, t, lang, source in rows], SCHEMA)


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names."""
    long = "word and more " * 30_000
    return docs(spark, [(1, "the same text here and now", "en", "a"), (1, "the same text here and now", "en", "a"), (None, "the same text here and now", None, None), (4, None, "en", "a"), (5, "", None, "b"), (6, long, "fr", "b"), (7, long, "fr", None), (8, "!!", "de", "a")])


LABELS = "doc_id long, toxic int, quality int"


def runs(spark, d):
    labels = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (None, 1, None), (7, None, 1)], LABELS)
    vectors = d.select("doc_id", "ROW", F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    pages = d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "ROW", "lang")
    return {
        "toxicity": toxicity.judged(d, labels), "exact": radix.exact_groups(d), "near": simhash.near_groups(d), "langid": langid.identified(d), "vectors": quantised.near_groups(vectors),
        "shards": sharding.sharded(d), "urls": urls.filtered(pages, urls.rule_table(spark)),
        "mix": mixing.assigned(d), "pack": packing.packed(d, mixing.token_count()), "secrets": secret_scan.secret_spans(d),
    }


def test_odd_rows(spark):
    found = {k: v.collect() for k, v in runs(spark, odd(spark)).items()}
    assert all(len(found[k]) == 8 for k in ("toxicity", "exact", "near", "langid", "vectors", "shards", "urls"))
    assert sum(r.keep for r in found["exact"]) == 5 and sum(r.keep for r in found["near"]) == 5
    assert {r.copies for r in found["exact"] if r.doc_id is None} == {3}
    assert next(r for r in found["langid"] if r.doc_id == 5).predicted is None
    assert not found["secrets"] and {r.action for r in found["urls"]} == {"keep"}
    assert sorted(r.position for r in found["shards"]) == list(range(8))
    size = {r.doc_id: 0 for r in found["pack"]}
    for r in found["pack"]:
        size[r.doc_id] += r.tokens
    assert size[6] == 105_000 and 4 not in size and 5 not in size


def clashing(spark):
    """The odd rows under names that the operators use themselves."""
    names = ["_metadata", "_loom_file", "_loom_row", "_loom0", "row", "hash", "v", "root", "node", "block", "rank", "a.b", "c`d"]
    return odd(spark).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(k).alias(n) for k, n in enumerate(names)), "shard")


@pytest.mark.parametrize("make", [odd, clashing])
def test_stages_keep_odd_rows_and_all_columns(spark, make):
    d = make(spark)
    labels = spark.createDataFrame([(1, 0, 1), (6, 1, 0)], LABELS)
    full = [tuple(r) for r in d.collect()]
    ids = lambda df: sorted(((r[0] is not None, r[0] or 0) for r in df.collect()))
    for kept, want in (
        (toxicity.drop_toxic(d, labels.where("toxic > 1")), [None, 1, 1, 4, 5, 6, 7, 8]),
        (radix.drop_exact(d), [None, 4, 5, 6, 8]),
        (simhash.drop_near(d), [None, 4, 5, 6, 8]),
        (mixing.mixed(d, weights={"source:a": 1.0}, budget=0.0), []),
    ):
        assert kept.columns == d.columns and ids(kept) == sorted((x is not None, x or 0) for x in want)
        assert all(tuple(r) in full for r in kept.collect())
    shuffled = sharding.sharded(d, names=("place", "nth"))
    assert shuffled.columns == [*d.columns, "place", "nth"] and sorted(map(repr, (tuple(r)[:-2] for r in shuffled.collect()))) == sorted(map(repr, full))
    once = mixing.mixed(d, tokens=F.lit(1), weights={"source:a": 4, "source:b": 3}, budget=1.0)
    assert once.columns == d.columns and {r.doc_id for r in once.collect()} <= {None, 1, 4, 5, 6, 8}
    assert len(urls.filtered(d.withColumn("url", F.lit("http://x.y/")), urls.rule_table(spark), "doc_id").collect()) == 8
    assert packing.packed(d, mixing.token_count()).count() > 8 and secret_scan.secret_spans(d).count() == 0
    empty = d.limit(0)
    for after in (toxicity.drop_toxic(empty, labels), radix.drop_exact(empty), simhash.drop_near(empty), mixing.mixed(empty)):
        assert after.columns == d.columns and after.count() == 0


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 0, 1), (6, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, d in (("odd", odd(spark)), ("clashing", clashing(spark)), ("empty", odd(spark).limit(0))):
        for _, stage in pipeline.STAGES[:-1]:
            after = stage(spark, d, str(tmp_path))
            assert after.columns == d.columns
            after.write.parquet(str(tmp_path / f"{name}-{stage.__name__}"))
            d = spark.read.parquet(str(tmp_path / f"{name}-{stage.__name__}"))
        total = d.agg(F.sum(mixing.token_count())).first()[0]
        assert (pipeline.STAGES[-1][1](spark, d, str(tmp_path)).agg(F.sum("tokens")).first()[0]) == total
        assert (total is None) == (name == "empty")


def test_empty_table(spark):
    assert all(v.count() == 0 for v in runs(spark, docs(spark, [])).values())


def test_hot_groups_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    rng = random.Random(9)
    rows = [(k, "one text of many copies, " * (k % 3) if k % 3 else " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20)), "en", "a") for k in range(120)]
    d = docs(spark, rows)
    for found in (radix.exact_groups(d).collect(), simhash.near_groups(d).collect()):
        assert {r.doc_id: r.copies for r in found if r.doc_id % 3 == 0} == dict.fromkeys(range(0, 120, 3), 1)
        assert sum(r.keep for r in found) in (41, 42) and len(found) == 120
    exact = {r.doc_id: (r.group_id, r.copies) for r in radix.exact_groups(d).collect()}
    assert exact[1] == (1, 40) and exact[2] == (2, 40) and exact[119] == (2, 40)
    v = d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1.0).otherwise(0.0)).alias("embedding"))
    assert {r.copies for r in quantised.near_groups(v).collect() if r.vec_id % 3} == {80}


def test_exact_and_near_copies(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    bases = [" ".join(rng.choices(words, k=120)) for _ in range(30)]
    rows = []
    for k, b in enumerate(bases):
        w = b.split()
        w[rng.randrange(120)] = "changed"
        rows += [(3 * k, b, "en", "a"), (3 * k + 1, b, "en", "b"), (3 * k + 2, " ".join(w), "en", "a")]
    d = docs(spark, rows)
    assert {r.doc_id: r.group_id for r in radix.exact_groups(d).collect()} == {i: i - (i % 3 == 1) for i in range(90)}
    near = {r.doc_id: r.group_id for r in simhash.near_groups(d).collect()}
    assert sum(near[i] == i - i % 3 for i in range(90)) >= 89
    kept = radix.drop_exact(d)
    assert kept.columns == d.columns and kept.count() == 60


def _grouped(many, pairs):
    """Brute force: the least member of each row's group."""
    parent = list(range(many))
    for i, j in pairs:
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def _edited(rng, texts, words, most):
    out = []
    for k in range(texts):
        w = rng.choices(words, k=60)
        out.append(" ".join(w))
        for at in rng.sample(range(60), 1 + k % most):
            w[at] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    texts = [*_edited(rng, 400, words, 24), "", "!!", "one", "one one"]
    fps = simhash.fingerprints(texts)
    pairs = [(i, int(j)) for i, f in enumerate(fps) for j in np.flatnonzero(simhash.near(f, fps, simhash.MAX_BITS)) if i < j and f.any() and fps[j].any()]
    found = simhash.near_groups(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.group_id for r in found} == dict(enumerate(_grouped(len(texts), pairs)))
    far = [(i, i + 1) in pairs for i in range(0, 800, 2)]
    few = [x for k, x in enumerate(far) if k % 24 < 5]
    assert np.mean(few) > 0.98 and 0.3 < np.mean(far) < 0.9


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_pairs_within_range_meet_in_a_cell(spark, cell_rows):
    rng = np.random.default_rng(7)
    words = simhash.LANES + simhash.PLAIN
    base = rng.integers(0, 1 << 63, (300, words), dtype=np.uint64)
    base[:60, 2] = base[0, 2]  # a lane that many share
    fps = [base]
    for lane_bits, plain_bits in ((1, 64), (0, 64), (1, 65), (2, 10)):
        other = rng.integers(0, 1 << 63, (300, words), dtype=np.uint64)
        for k in range(300):
            mask = np.zeros(256, np.uint8)
            mask[rng.permutation(256)[:plain_bits]] = 1
            other[k, simhash.LANES :] = base[k, simhash.LANES :] ^ np.packbits(mask).view(np.uint64)
            lane = k % simhash.LANES
            other[k, lane] = base[k, lane]
            for bit in rng.permutation(64)[:lane_bits].tolist():
                other[k, lane] ^= np.uint64(1) << np.uint64(bit)
        fps.append(other)
    fps = np.concatenate(fps)
    pairs = [(i, int(j)) for i, f in enumerate(fps) for j in np.flatnonzero(simhash.near(f, fps, simhash.MAX_BITS)) if i < j]
    assert {(k, 300 + k) for k in range(300)} | {(k, 600 + k) for k in range(300)} <= set(pairs) and (3, 903) not in pairs and (3, 1203) not in pairs
    nodes = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(fps)], "node long, fp binary")
    root = {r.node: r.root for r in connected(simhash.near_edges(nodes, simhash.MAX_BITS, cell_rows)).collect()}
    want = _grouped(len(fps), pairs)
    assert {k: v for k, v in enumerate(want) if v != k} == root


def test_a_lane_that_many_share_travels_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 1 << 63, (432, simhash.LANES + simhash.PLAIN), dtype=np.uint64)
    hot = np.uint64(1)  # of an odd sum
    fps[:400, 5] = hot
    fps[400:416, 5] = hot ^ (np.uint64(2) << (np.uint64(4) * np.arange(16, dtype=np.uint64)))  # linked
    fps[416:, 5] = fps[400:416, 5] ^ np.array([15, *[3] * 15], np.uint64)  # in the same cells, not linked with the many

    def counted(max_bits):
        def run(batches):
            yield pd.DataFrame({"a": [sum(map(len, batches))], "b": [0]})

        return run

    monkeypatch.setattr(simhash, "_unit_links", counted)
    nodes = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(fps)], "node long, fp binary")
    assert sum(r.a for r in simhash.near_edges(nodes).collect()) == 416


def test_links_across_equal_brute_force():
    rng = np.random.default_rng(13)
    fps = rng.integers(0, 1 << 63, (40, simhash.LANES + simhash.PLAIN), dtype=np.uint64)[rng.integers(0, 40, 700)]
    fps[:, simhash.LANES] ^= rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    fps[:, simhash.LANES + 1] ^= rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    for first in (0, 1, 300, 699):
        some = [(i, int(j)) for i in range(first or 700) for j in np.flatnonzero(simhash.near(fps[i], fps, simhash.MAX_BITS)) if j >= first and i != j]
        found = simhash.links(fps, simhash.MAX_BITS, first)
        assert _grouped(700, found) == _grouped(700, some) and len(found) < 700 and {(min(p), max(p)) for p in found} <= {(min(p), max(p)) for p in some}


def test_fingerprints_of_long_texts_are_of_the_whole(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcde-_", k=5)) for _ in range(9000))
    whole = simhash.fingerprints([text, "x y", None])
    monkeypatch.setattr(simhash, "SLAB", 1000)
    assert (simhash.fingerprints([text, "x y", None]) == whole).all() and not whole[2].any()
    assert not simhash.fingerprints(["", "!!", None]).any() and simhash.fingerprints([]).shape == (0, simhash.LANES + simhash.PLAIN)


def test_exact_oracle(spark):
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        mine, other = queries.QUERIES[name](spark, at).toPandas(), con.execute(sql).df()
        columns = sorted(mine.columns)
        rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))  # noqa: B023, E731
        assert rows(mine) == rows(other)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10] + [(100, 3)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found[100] == 1 and found[9] == 1 and found[20] == 11


def _least_cost(tokens, quota):
    """Brute force over whole tokens: the most that can be given, at the least cost."""
    patterns, best = list(tokens), None
    options = [[x for x in itertools.product(range(max(quota.values()) + 1), repeat=len(p)) if sum(x) <= mixing.EPOCHS * tokens[p]] for p in patterns]
    for given in itertools.product(*options):
        into = Counter()
        for p, x in zip(patterns, given, strict=True):
            into.update(dict(zip(p, x, strict=True)))
        if all(into[c] <= q for c, q in quota.items()):
            key = (-sum(into.values()), sum(mixing._marginal(u, tokens[p])[0] for p, x in zip(patterns, given, strict=True) for u in range(sum(x))))
            best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("tokens, quota", [({("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 3, "b": 4}), ({("a", "b"): 1, ("b",): 2}, {"a": 5, "b": 2}), ({("a",): 4, ("a", "b"): 1}, {"a": 2, "b": 3})])
def test_flow_is_cheapest(tokens, quota):
    gives = mixing.flow(tokens, quota)
    used = {p: sum(g.values()) for p, g in gives.items()}
    cost = sum(mixing._marginal(u, tokens[p])[0] for p, n in used.items() for u in range(n))
    assert (-sum(used.values()), cost) == _least_cost(tokens, quota)


def test_mixture_meets_quotas(spark):
    d = docs(spark, [(i, "x" * 40, "en" if i % 4 else "de", "hot" if i % 3 else "cold") for i in range(400)])
    weights = {"source:hot": 1.0, "source:cold": 2.0, "lang:de": 1.0}
    have = {r.collection: r.n for r in mixing.assigned(d, weights=weights).groupBy("collection").agg(F.sum("copies").alias("n")).collect()}
    assert all(abs(have[c] - 100 * w) <= 3 for c, w in weights.items())
    assert mixing.mixed(d, weights=weights).count() == sum(have.values()) and mixing.mixed(d, weights=weights).columns == d.columns


def test_packing_follows_the_rule():
    rng = np.random.default_rng(2)
    tokens = np.sort(rng.integers(1, 100, 200))[::-1]
    costs = tokens + tokens.astype(float) ** 2
    sequence, position = packing.pack(tokens, costs, 128)
    load, room = [0.0] * -(-int(tokens.sum()) // 128), [128] * -(-int(tokens.sum()) // 128)
    for t, c, s, p in zip(tokens, costs, sequence, position, strict=True):
        fits = [j for j in range(len(room)) if room[j] >= t]
        if not fits:
            load.append(0.0), room.append(128)
        assert s == (min(fits, key=lambda j: (load[j], j)) if fits else len(room) - 1) and p == 128 - room[s]
        load[s] += c
        room[s] -= t


def test_packed_query_equals_the_rule(spark):
    """The whole query, groups of its own included, against packing each group by hand; ids of any kind."""
    rows = [(f"d{k % 40:02}" if k % 7 else None, "x" * (k * 37 % 900)) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    found = packing.packed(d, mixing.token_count(), capacity=100, group_tokens=4000).collect()
    assert sum(r.tokens for r in found) == sum(-(-len(t) // 4) for _, t in rows) and len({r.pack_group for r in found}) > 2
    want = sorted((i is not None, i or "", k, min(100, n - 100 * k)) for i, t in rows for n in [-(-len(t) // 4)] for k in range(-(-n // 100)))
    assert sorted((r.doc_id is not None, r.doc_id or "", r.piece, r.tokens) for r in found) == want
    for g in {r.pack_group for r in found}:
        own = sorted((r for r in found if r.pack_group == g), key=lambda r: (-r.cost, r.doc_id is not None, r.doc_id or "", r.piece, r.sequence, r.position))
        many = -(-sum(r.tokens for r in own) // 100)
        load, room, placed = [0.0] * many, [100] * many, []
        for r in own:
            fits = [j for j in range(len(room)) if room[j] >= r.tokens]
            if not fits:
                load.append(0.0), room.append(100)
            j = min(fits, key=lambda j: (load[j], j)) if fits else len(room) - 1
            placed.append((r.doc_id, r.piece, r.tokens, j, 100 - room[j]))
            load[j] += packing.LINEAR * r.tokens + packing.QUADRATIC * r.tokens**2
            room[j] -= r.tokens
        assert sorted(map(repr, placed)) == sorted(repr((r.doc_id, r.piece, r.tokens, r.sequence, r.position)) for r in own)


def test_equal_rows_are_spread_over_groups(spark):
    d = spark.createDataFrame([(None, "x" * 400)] * 400, "doc_id long, text string")
    assert len({r.pack_group for r in packing.packed(d, mixing.token_count(), group_tokens=2000).collect()}) >= 15


def test_assigned_query_equals_brute_force(spark):
    """Uses by hand: a pattern's documents in the order of their hash, over and over, collection by collection."""
    rows = [(k, "x" * (4 * (1 + k % 9)), ["en", "de", None][k % 3], ["hot", "cold"][k % 5 == 0]) for k in range(200)]
    d = docs(spark, rows)
    weights = {"source:hot": 5.0, "source:cold": 2.0, "lang:de": 3.0, "lang:en": 1.0}
    kept, tok, order = mixing._prepared(d, mixing.collections_of(d), mixing.token_count(), "doc_id", mixing.SEED)
    by = {}
    for r in d.select("doc_id", kept.alias("p"), tok.alias("n"), order.alias("h")).collect():
        by.setdefault(tuple(r.p), []).append((r.h, r.doc_id, r.n))
    have = {p: sum(n for _, _, n in ds) for p, ds in by.items()}
    gives = mixing.flow(have, mixing.quotas(weights, sum(have.values())))
    want = Counter()
    for p, given in gives.items():
        ends, at = list(itertools.accumulate(given[c] for c in sorted(given))), 0
        for k in range(mixing.EPOCHS):
            for _, i, n in sorted(by[p]):
                c = next((c for c, e in zip(sorted(given), ends, strict=True) if at < e), None)
                if c is not None:
                    want[i, c] += 1
                at += n
    assert {(r.doc_id, r.collection): r.copies for r in mixing.assigned(d, weights=weights).collect()} == dict(want)


@pytest.mark.parametrize("wide", [4096, 2])
def test_shuffle_is_uniform(monkeypatch, wide):
    """Shards of every row, and of every two rows, over many seeds, as the tasks draw them."""
    monkeypatch.setattr(sharding, "WIDE", wide)
    sizes, shards, seen = np.array([3, 2, 4]), sharding.shard_sizes(9, 3), np.zeros((9, 3))
    pairs = np.zeros((9, 9))
    for seed in range(4000):
        to = np.concatenate([sharding.targets(sizes, shards, i, seed) for i in range(3)])
        assert (np.bincount(to, minlength=3) == shards).all()
        seen[np.arange(9), to] += 1
        pairs += to[:, None] == to
    assert np.abs(seen / 4000 - shards / 9).max() < 0.04
    off = pairs[~np.eye(9, dtype=bool)] / 4000
    assert np.abs(off - (shards * (shards - 1)).sum() / 72).max() < 0.04


def test_keyed_permutations_and_cost_of_many_shards():
    for n in (1, 2, 3, 1000, 4097):
        at, size = np.arange(n), np.full(n, n)
        orders = {tuple(sharding.dealt(at, np.full(n, k, np.uint64), size).tolist()) for k in range(8)}
        assert all(sorted(o) == list(range(n)) for o in orders) and (n < 1000 or len(orders) == 8)
    took = []
    for many in (40_000, 320_000):
        shards, sizes = np.full(many, 8), np.full(many * 8 // 65_536 + 1, 65_536)
        sizes[-1] = many * 8 - sizes[:-1].sum()
        began = time.thread_time()
        assert len(sharding.targets(sizes, shards, 1, 5)) == 65_536
        took.append(time.thread_time() - began)
    assert took[1] < 4 * took[0] + 0.2


SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


def test_nested_secrets():
    ways = {"url": lambda t: urllib.parse.quote(t, safe=""), "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "base64": lambda t: base64.b64encode(t.encode()).decode(), "base64>gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode()}
    for path in itertools.product(ways, repeat=3):
        text = SECRET
        for step in path:
            text = ways[step](text)
        full = f"é before {text} after"
        found = [f for f in secret_scan.scan(full) if f[0] == "assigned_secret"]
        assert found, path
        assert all(9 <= a < b <= 9 + len(text) for _, a, b, _, _ in found)


def test_secret_spans_are_exact():
    full = "é " + urllib.parse.quote(SECRET) + " %%% end"
    _, a, b, layers, _ = secret_scan.scan(full)[0]
    assert full[a:b] == SECRET[9:-1] and layers == "url"
    assert not secret_scan.scan("100%% sure %zz \\u12 aGVsbG8gd29ybGQgYWdhaW4gYW5k")


@pytest.mark.parametrize("before", ["", "x.com/", "key-", "a/", "ab", "A", "abc", "data_"])
@pytest.mark.parametrize("raw", [SECRET.encode(), b"\x01\x02" + SECRET.encode() + b"\x03", SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), b"\xff\xfe\xfd" + SECRET.encode(), gzip.compress(SECRET.encode(), mtime=0)])
def test_secrets_at_any_offset_and_in_soiled_layers(before, raw):
    full = f"see {before}{base64.b64encode(raw).decode()} end"
    (found,) = [f for f in secret_scan.scan(full) if f[0] == "assigned_secret"]
    assert 4 <= found[1] < found[2] <= len(full) - 4


def test_secrets_in_bare_deflate():
    engine = zlib.compressobj(wbits=-15)
    raw = engine.compress(SECRET.encode()) + engine.flush()
    for before in ("", "x/"):
        assert [f[3] for f in secret_scan.scan(f"a {before}{base64.b64encode(raw).decode()} b")] == ["base64>deflate"]


def test_secrets_of_one_compressed_block():
    two = SECRET + "\n" + SECRET.replace("04dbebab", "99c1e2f7")
    full = "x " + base64.b64encode(gzip.compress(two.encode(), mtime=0)).decode()
    found = [f for f in secret_scan.scan(full) if f[0] == "assigned_secret"]
    assert len({f[4] for f in found}) == len(found) == 2


@pytest.mark.parametrize("way", [str.encode, lambda t: gzip.compress(t.encode(), mtime=0)])
def test_secrets_after_labels_and_in_lines(way):
    blob = base64.b64encode(way(SECRET)).decode().rstrip("=")
    long = base64.b64encode(way("some other text, " * 9 + SECRET)).decode()
    cases = [f"{x}{blob}" for x in ("https://h.example/cfg/", "data_", "key-", "x=", "a/b-c_")] + [f"{blob}-tail/of_it"]
    for width in (20, 50, 60, 61, 64, 76):
        lines = "\n".join(long[k : k + width] for k in range(0, len(long), width))
        cases += [lines, f"before:\n{lines}\nafter", f"data_{lines}"]
    for full in cases:
        assert any(f[0] == "assigned_secret" for f in secret_scan.scan(full)), full
    one, two = (base64.b64encode(way(SECRET.replace("04db", x))).decode().rstrip("=") for x in ("1a2b", "3c4d"))
    assert len({f[4] for f in secret_scan.scan(f"{one}\n{two}")}) == 2


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_secrets_in_all_members(pack):
    two = [SECRET.replace("04db", x).encode() for x in ("1a2b", "3c4d")]
    for rest in (b"", b"\xff\xfejunk" * 3):
        full = base64.b64encode(pack(two[0] + b"\n") + pack(two[1]) + rest).decode()
        assert len({f[4] for f in secret_scan.scan(full)}) == 2


def _vectors(rng, many, near, noise):
    base = rng.normal(size=(many, 64))
    other = base[:near] / np.linalg.norm(base[:near], axis=1)[:, None] + noise * rng.normal(size=(near, 64)) / 8
    x = np.concatenate([base, other]).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return x, unit, np.argwhere(np.triu(unit @ unit.T, 1) >= quantised.COSINE)


@pytest.mark.parametrize("noise", [0.3, 0.45])
def test_quantised_recall(spark, noise):
    x, _, pairs = _vectors(np.random.default_rng(3), 1500, 300, noise)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    group = {r.vec_id: r.group_id for r in quantised.near_groups(rows, list_rows=100).collect()}
    hits = [group[i] == group[j] for i, j in pairs.tolist()]
    assert len(hits) > 100 and np.mean(hits) >= 0.9
    true = set(map(tuple, pairs.tolist()))
    assert all((g, v) in true for v, g in group.items() if v != g)


def test_cells_are_split_by_levels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(quantised, "FAN", 4)
    monkeypatch.setattr(quantised, "FAN_ROWS", 64)
    rng = np.random.default_rng(8)
    x, unit, pairs = _vectors(rng, 1200, 300, 0.3)
    tight = unit[:1] + 0.02 * rng.normal(size=(400, 64)) / 8  # more than a cell holds, all alike
    unit = np.concatenate([unit, tight / np.linalg.norm(tight, axis=1)[:, None]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "node long, v array<float>")
    root = {r.node: r.root for r in connected(quantised.near_vectors(rows, list_rows=50, cell_members=100)).collect()}
    hits = [root.get(i, i) == root.get(j, j) for i, j in pairs.tolist()]
    assert np.mean(hits) >= 0.9 and len({root.get(i, i) for i in range(1500, 1900)}) == 1


def test_communication_matrix():
    sizes, shards = np.array([5, 0, 7, 3]), sharding.shard_sizes(15, 4)
    rows = np.stack([sharding.matrix_row(sizes, shards, i, 1)[0] for i in range(4)])
    assert (rows.sum(axis=1) == sizes).all() and (rows.sum(axis=0) == shards).all()
    mean = np.mean([sharding.matrix_row(sizes, shards, 2, s)[0] for s in range(2000)], axis=0)
    assert np.abs(mean - 7 * shards / 15).max() < 0.15
    big = [sharding.hypergeometric(np.random.default_rng(s), 3_000_000_000, 1_000_000_000, 10_000) for s in range(300)]
    assert abs(np.mean(big) - 7500) < 12 and 30 < np.std(big) < 57


def test_shards(spark):
    d = docs(spark, [(i, str(i), "en", "a") for i in range(1000)])
    found = sharding.sharded(d.drop("shard"), shard_rows=300, block_rows=128).collect()
    assert Counter(r.shard for r in found) == {0: 250, 1: 250, 2: 250, 3: 250} and {r.doc_id for r in found} == set(range(1000))
    assert all({r.position for r in found if r.shard == s} == set(range(250)) for s in range(4))
    again = sharding.sharded(d, shard_rows=300, block_rows=128)
    assert again.columns == [*d.columns, "shard_", "position"] and {r.shard for r in again.collect()} == {7}


def test_url_precedence(spark):
    rules = [("bad.com/", "block"), ("bad.com/ok/", "allow"), ("x.bad.com/", "allow"), ("q.com/a?b=1", "block"), ("tie.com/", "block"), ("tie.com/", "allow")]
    pages = [(1, "http://u:p@A.BAD.com.:80//z#f"), (2, "bad.com/ok/1"), (3, "https://y.x.bad.com/ok"), (4, "http://q.com/a?b=1"), (5, "http://q.com/a?b=2"), (6, None), (7, "http://notbad.com/"), (8, "http://tie.com/%zz"), (9, "http://1.2.3.4/")]
    found = {r.page_id: r.action for r in urls.filtered(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, rules)).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "keep", 6: "keep", 7: "keep", 8: "allow", 9: "keep"}


def test_url_of_very_many_segments(spark):
    long = "http://a.bad.com" + "/x" * 100_000
    hosts = "http://" + "a." * 20_000 + "bad.com/y/"
    rules = urls.rule_table(spark, [("bad.com/", "block"), ("bad.com/x/x/x/", "allow"), ("bad.com/y", "block")])
    found = {r.page_id: (r.rule, r.action) for r in urls.filtered(spark.createDataFrame([(1, long), (2, hosts), (3, "bad.com/y")], "page_id long, url string"), rules).collect()}
    assert found == {1: ("bad.com/x/x/x/", "allow"), 2: ("bad.com/", "block"), 3: ("bad.com/y", "block")}


def test_kernel_equals_enumeration():
    def slow(a, b):
        """Sum over triples of letters of the products of their weighted occurrences."""
        def spread(x):
            out = Counter()
            for i, j, k in itertools.combinations(range(len(x)), 3):
                if k - i < toxicity.REACH and x[i] and x[j] and x[k]:
                    out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i + 1)
            return out
        p, q = spread(a), spread(b)
        return sum(p[t] * q[t] for t in p)

    rng = np.random.default_rng(1)
    x = np.zeros((12, toxicity.WINDOW), np.uint8)
    for row in x:
        n = rng.integers(3, 12)
        row[:n] = rng.integers(0, 4, n)
    codes = toxicity.triples(x)
    fast = toxicity.kernel(x, x) * np.outer(toxicity.norms(codes), toxicity.norms(codes))
    want = [[slow(a.tolist(), b.tolist()) for b in x] for a in x]
    assert np.allclose(fast, want, atol=1e-4)


def test_all_scripts_and_digits_have_symbols():
    one = lambda t: toxicity.text_windows([t])[0][0]
    assert all(one(c)[0] > 0 for c in "az09ß字яλع") and len({one(c)[0] for c in "0123456789"}) == 10
    assert (one("m...o...r") == one("m.o.r")).all() and one("a…")[1] == 0
    long = toxicity._gapped(np.pad(np.arange(1, 25, dtype=np.uint8), (0, 8))[None])
    assert set(long[long > 0].tolist()) == set(range(1, 25))


def test_training_rows_are_told_apart_whatever_their_ids(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(20))
    for ids in (lambda k: 7, lambda k: None):
        d = docs(spark, [(ids(k), make("abcd" if k % 2 else "wxyz"), "a" if k % 2 else "w", "s") for k in range(400)])
        net = langid.train(d, train_docs=50, steps=40)
        assert net.names == ["a", "w"]
        mean, _ = langid.pooled(net, [make("abcd"), make("wxyz")])
        assert mean[0, 0] > 0.8 and mean[1, 1] > 0.8


def test_training_spans_come_from_the_whole_text():
    text = "".join(chr(97 + k // 1000) for k in range(26_000))
    assert len({p[0] for p in langid.drawn(text, 5)}) > 12 and len(langid.drawn(text, 5)) == langid.TRAIN_SPANS
    assert b"".join(langid.drawn("short text", 1)) == b"short text"


def test_toxicity_on_held_out_documents():
    rng = random.Random(4)
    words = ["".join(rng.choices("bcdfghlmnprstaeiou", k=rng.randint(3, 8))) for _ in range(500)]
    bad = ["disgusting", "worthless", "moron"]

    def text(toxic, change):
        w = rng.choices(words, k=60)
        if toxic:
            w[rng.randrange(60)] = change(rng.choice(bad))
        return " ".join(w) + "."

    labels = np.array([i % 3 == 0 for i in range(600)]).astype(int)
    model = toxicity.fit([text(y, str) for y in labels], labels)
    for change in (str, lambda w: w[:3] + "-" + w[3:], ".".join):
        scores, _ = toxicity.score_texts(model, [text(True, change) for _ in range(60)])
        assert np.mean(scores > model.threshold) >= 0.9
    clean, _ = toxicity.score_texts(model, [text(False, str) for _ in range(200)])
    assert np.mean(clean > model.threshold) <= 0.02


def test_gradients_and_held_out_language():
    net = langid.Network.fresh(["a", "b"])
    for k in net.parts:
        net.parts[k] = net.parts[k].astype(np.float64)
    x, y, real = np.random.default_rng(0).integers(97, 103, (7, 3)), np.array([0, 1, 0]), np.ones((7, 3))
    _, g = net.gradients(x, y, real)
    for k, at in (("f_rec", (1, 2)), ("b_in", (98, 5)), ("f_cand", (0,)), ("b_out", (2, 1))):
        kept = net.parts[k][at]
        loss = []
        for e in (1e-3, -1e-3):
            net.parts[k][at] = kept + e
            loss.append(net.gradients(x, y, real)[0])
        net.parts[k][at] = kept
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][at]) < 1e-3
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    kinds = {"x": "abcdeou", "y": "eioußäö", "z": "ñaosión"}
    train = [(make(v), k) for k, v in kinds.items() for _ in range(60)]
    net = langid.fit([t for t, _ in train], [k for _, k in train], steps=80)
    test = [(make(v), k) for k, v in kinds.items() for _ in range(30)]
    mean, _ = langid.pooled(net, [t for t, _ in test])
    assert np.mean([net.names[i] == k for i, (_, k) in zip(mean.argmax(axis=1), test, strict=True)]) >= 0.95
    assert len(langid.position_labels(net, "ñandú")) == len("ñandú".encode())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, at)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
    total = docs.agg(F.sum(mixing.token_count())).first()[0]
    assert pipeline.run(spark, at).agg(F.sum("tokens")).first()[0] == total
