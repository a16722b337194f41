"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import KEY, SLAB_CHARS, anchored, checkpoint, lowest_hashed, named, slabs, small_batches, small_side, stable_rows, word_hashes
from corpusloom.llm.simhash import LANES, MAX_BITS, fingerprints

#: Subsequences have three letters within a span of REACH characters; each character of the span costs DECAY.
REACH, DECAY = 7, 0.7
#: Landmarks of the Nystroem map, of insulting and of clean windows.
LANDMARKS = 240
#: At most this many labelled documents of either class fit the classifier; the lowest of a seeded hash of the id.
TRAIN_DOCS = 2500
#: Rounds of fitting; each adds clean windows of high margin as negatives and the top windows of toxic documents.
TURNS = 4
#: A word longer than this is read in windows that overlap by half.
WINDOW = 32
#: Clean windows that the first round of fitting is given, and of high margin in each further round.
CLEAN_FIRST, CLEAN_MORE = 3000, 1500
#: Latin letters and digits get a symbol each, rare ones that of their base letter; letters and digits of other scripts share
#: these by code point. Any other character is a gap (0), and so are several in a row.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëìíîïñòóôöøùúûüýß0123456789"
_SYMBOLS = 64
SYMBOL = np.array([c % 63 + 1 if chr(c).isalnum() else 0 for c in range(0x32400)], np.uint8)
for _k, _c in enumerate(_LETTERS):
    SYMBOL[ord(_c)] = _k + 1
for _c, _base in zip("ãõÿœ", "aoyo", strict=True):
    SYMBOL[ord(_c)] = SYMBOL[ord(_base)]
SYMBOL[-1] = 0
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


_SHAPES = [(j, k, DECAY ** (k + 1)) for j, k in combinations(range(1, REACH), 2)]
_WEIGHTS = np.array([w for _, _, w in _SHAPES], np.float32)


def triples(symbols: np.ndarray) -> np.ndarray:
    """Codes of the letter triples of each window by shape and start, 0 for none: (shapes, windows, width)."""
    n, width = symbols.shape
    s = np.zeros((n, width + REACH), np.int32)
    s[:, :width] = symbols
    out = np.empty((len(_SHAPES), n, width), np.int32)
    a = np.where(s > 0, s * _SYMBOLS**2, -(_SYMBOLS**3))
    b = np.where(s > 0, s * _SYMBOLS, -(_SYMBOLS**3))
    c = np.where(s > 0, s, -(_SYMBOLS**3))
    for q, (j, k, _) in enumerate(_SHAPES):
        np.add(a[:, :width], b[:, j : j + width], out=out[q])
        out[q] += c[:, k : k + width]
    return np.maximum(out, 0, out=out)


def norms(codes: np.ndarray) -> np.ndarray:
    """The scale of each window: the root of the sum of its triples' squared weights. Dividing by it keeps the kernel positive definite."""
    return np.sqrt(np.maximum(np.einsum("qnw,q->n", codes > 0, _WEIGHTS**2, optimize=False), 1e-9))


def sums(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each window, the table's values of its triples times their weights."""
    out = np.zeros(codes.shape[1], np.float32)
    for q, w in enumerate(_WEIGHTS):
        out += w * table[codes[q]].sum(axis=1)
    return out


def spread(codes: np.ndarray, factors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Add the windows' weighted triples, times a factor each, to a table."""
    for q, w in enumerate(_WEIGHTS):
        np.add.at(table, codes[q], (w * factors)[:, None])
    table[0] = 0
    return table


def kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The normalised kernel between windows and landmarks."""
    cx, cm = triples(x), triples(marks)
    nx, nm = norms(cx), norms(cm)
    out, table = np.empty((len(x), len(marks)), np.float64), np.zeros(_SYMBOLS**3, np.float32)
    for l in range(len(marks)):
        one = cm[:, l : l + 1]
        spread(one, np.ones(1, np.float32), table)
        out[:, l] = sums(cx, table) / nx / nm[l]
        table[one] = 0
    return out


@dataclass
class Model:
    """The decision as a weight per letter triple: the sum over landmarks of coefficient times normalised feature."""

    table: np.ndarray
    bias: float
    threshold: float = 0.0

    def score(self, symbols: np.ndarray) -> np.ndarray:
        """SVM margins of windows."""
        out = np.full(len(symbols), self.bias, np.float32)
        used = (symbols.shape[1] - (symbols[:, ::-1] > 0).argmax(axis=1)) * (symbols > 0).any(axis=1)
        for low, high in ((3, 4), (5, 6), (7, 8), (9, 11), (12, 15), (16, 22), (23, WINDOW)):
            at = np.flatnonzero((used >= low) & (used <= high))
            for s in range(0, len(at), 4096):
                rows = at[s : s + 4096]
                codes = triples(symbols[rows, :high])
                out[rows] += sums(codes, self.table) / norms(codes)
        return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 30.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; classes weigh alike, the bias isn't regularised."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    cost = c * np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) / 2
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ ridge @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + 2 * (xa.T * ca) @ xa, 2 * xa.T @ (ca * y[active]))
        step, at = 1.0, loss(w)
        while loss(w + step * (new - w)) > at and step > 1e-3:
            step /= 2
        if np.abs(step * (new - w)).max() < 1e-6:
            break
        w = w + step * (new - w)
    return w[:-1], float(w[-1])


def text_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """Distinct windows of lowercased texts: symbols, window of each occurrence, its text, its start, and the joined text.

    A window is a word between spaces, whatever characters it has within ("id-iot", "m.o.r.o.n"), or a run of
    words of one character each ("s c u m"). Several gaps in a row count as one ("m...o...r"). A word over WINDOW characters gives overlapping windows.
    """
    lengths = np.array([len(t) + 1 for t in texts])
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = (SYMBOL[np.minimum(codes, len(SYMBOL) - 1)] == 0) & (codes != 32) & ((codes < 9) | (codes > 13)) & (codes != 0xA0)
    kept = np.flatnonzero(~(gap & np.r_[False, gap[:-1]]))
    codes = codes[kept]
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    inside = ~blank
    # a single blank between two lone characters belongs to a spaced-out word; ends of texts never do
    lone = inside.copy()
    lone[1:] &= blank[:-1]
    lone[:-1] &= blank[1:]
    tie = np.zeros_like(inside)
    tie[1:-1] = (codes[1:-1] == 32) & lone[:-2] & lone[2:]
    starts, ends, hashes = word_hashes(codes, inside | tie)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return np.zeros((0, WINDOW), np.uint8), empty, empty, empty, joined
    size = ends - starts
    long = size > WINDOW
    if long.any():
        s0, e0 = starts[long], ends[long]
        more = np.maximum(0, -(-(e0 - s0 - WINDOW) // (WINDOW // 2)))
        each = np.repeat(s0, more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1) * (WINDOW // 2)
        last = np.minimum(each + WINDOW, np.repeat(e0, more))
        heads = np.where(long, starts + WINDOW, ends)
        # the later windows of long words count as distinct from all others
        starts, ends = np.concatenate([starts, each]), np.concatenate([heads, last])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        hashes = np.concatenate([hashes, (np.arange(len(each)) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)])[order]
    which, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    begin, end = starts[first], ends[first]
    at = begin[:, None] + np.arange(WINDOW)
    symbols = np.where(at < end[:, None], SYMBOL[np.minimum(codes[np.minimum(at, len(codes) - 1)], len(SYMBOL) - 1)], 0)
    starts, ends = kept[starts], kept[ends - 1] + 1
    of = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return symbols, which, of, np.stack([starts, ends], axis=1), joined


def _cut(text: str, limit: int = SLAB_CHARS) -> Iterator[str]:
    """A text in parts of at most ``limit`` characters, cut at spaces where there is one."""
    start = 0
    while len(text) - start > limit:
        end = text.rfind(" ", start + limit // 2, start + limit)
        end = end if end > 0 else start + limit
        yield text[start:end]
        start = end
    yield text[start:]


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
    """The highest window margin of each text and that window; NaN and None where there is no window."""
    best, words = np.full(len(texts), np.nan, np.float32), [None] * len(texts)
    parts, owner = [], []
    for i, t in enumerate(texts):
        for part in _cut((t or "").lower()):
            parts.append(part)
            owner.append(i)
    for a, b in slabs(parts):
        symbols, which, of, spans, joined = text_windows(parts[a:b])
        if not len(which):
            continue
        scores = model.score(symbols)[which]
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        top = np.maximum.reduceat(scores, heads)
        for h, most, tail in zip(heads, top, np.r_[heads[1:], len(of)], strict=True):
            i = owner[a + of[h]]
            if not best[i] >= most:
                best[i] = most
                if most > model.threshold:
                    o = h + int(scores[h:tail].argmax())
                    words[i] = joined[spans[o, 0] : spans[o, 1]]
    return best, words


def bag(text: str) -> tuple[bytes, list[bytes]]:
    """A document's fingerprint and the distinct windows of its sentences, as the symbols of each."""
    sentences = [s for part in _cut(text.lower()) for s in _SENTENCE.split(part) if s.strip()]
    found = {row.tobytes().rstrip(b"\0") for a, b in slabs(sentences) for row in text_windows(sentences[a:b])[0]}
    return fingerprints([text])[0, LANES:].tobytes(), sorted(found)


def fit(texts: list[str], labels: np.ndarray, seed: int = 3) -> Model:
    """``fit_bags`` on the windows of texts."""
    return fit_bags([bag(t) for t in texts], labels, seed)


def fit_bags(bags: list[tuple[bytes, list[bytes]]], labels: np.ndarray, seed: int = 3) -> Model:
    """Fit on the windows of labelled documents' sentences, which inherit the label; a document's top window stands for it.

    Toxic documents are a multiple-instance problem: at first the window whose letters are most particular to
    toxic documents is its instance, later the one with the highest margin. Clean windows of high margin are added
    as negatives and the machine is fitted again. The threshold is the midpoint between classes on these documents.
    """
    none = Model(np.zeros(_SYMBOLS**3, np.float32), -1.0)
    if len(bags):
        prints = np.stack([np.frombuffer(p, np.uint64) for p, _ in bags])
        keep = _once(prints, labels)
        bags, labels = [b for b, k in zip(bags, keep, strict=True) if k], labels[keep]
    flat = [w for _, ws in bags for w in ws]
    if not flat or labels.min(initial=1) == labels.max(initial=0):
        return none
    known = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    symbols = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in known), np.uint8).reshape(-1, WINDOW)
    window, of = np.array([known[w] for w in flat], np.int64), np.repeat(np.arange(len(bags)), [len(ws) for _, ws in bags])
    del flat, known
    # documents of either class with each window
    bad = np.bincount(window[labels[of] == 1], minlength=len(symbols))
    good = np.bincount(window[labels[of] == 0], minlength=len(symbols))
    usable = (symbols > 0).sum(axis=1) >= 3
    share = (labels == 1).sum() / max(1, (labels == 0).sum())
    # how many times more often than by chance the window is in a toxic document, with some clean ones to its account
    odds = np.where(usable, np.log((bad + 0.1) / ((good + 0.7) * share)), -9.0)
    rng = np.random.default_rng(seed)
    side = labels[of] == 1
    by_doc = np.argsort(of[side], kind="stable")
    bag_window, bag = window[side][by_doc], of[side][by_doc]

    def tops(value: np.ndarray) -> np.ndarray:
        """The window of the highest value in each toxic document."""
        order = np.lexsort((-value[bag_window], bag))
        return bag_window[order][np.r_[True, bag[order][1:] != bag[order][:-1]]]

    clean = np.flatnonzero((good > 0) & usable)
    pure = usable & ((good == 0) | (odds > 3))
    often = max(4, int(0.05 * (labels == 1).sum()))
    positive = np.unique(np.r_[_cover(bag_window, bag, pure), np.flatnonzero((bad >= often) & (odds > 2.5) & (good == 0))])
    positive = positive[odds[positive] > 0]
    if not len(positive) or not len(clean):
        return none
    negative = clean[rng.permutation(len(clean))[:CLEAN_FIRST]]
    for turn in range(TURNS):
        marks = _landmarks(symbols, positive, bad, negative)
        values, axes = np.linalg.eigh(kernel(symbols[marks], symbols[marks]))
        ok = values > 1e-4
        root = (axes[:, ok] / np.sqrt(values[ok])) @ axes[:, ok].T
        x = np.concatenate([symbols[positive], _gapped(symbols[positive]), symbols[negative]])
        y = np.r_[np.ones(len(x) - len(negative)), -np.ones(len(negative))]
        w, bias = svm(kernel(x, symbols[marks]) @ root, y)
        at = triples(symbols[marks])
        model = Model(spread(at, root @ w / norms(at), np.zeros(_SYMBOLS**3)).astype(np.float32), bias)
        margins = model.score(symbols)
        if turn + 1 < TURNS:
            hard = clean[np.argsort(-margins[clean])[:CLEAN_MORE]]
            negative = np.setdiff1d(np.r_[negative, hard[margins[hard] > -1]], positive)
            again = tops(np.where((good == 0) & usable, margins, -9))
            again = again[(margins[again] > 0) & (odds[again] > 0)]
            positive = np.setdiff1d(np.r_[positive, again], negative)
    top = np.full(len(bags), -9.0)
    np.maximum.at(top, of, margins[window])
    # the cut of least cost, a false alarm on a clean document counting three times; of equal cuts the middle. Nine in ten of
    # the insults' forms with gaps stay above it, however few of them the documents have
    grid = np.unique(top)
    bad_below = np.searchsorted(np.sort(top[labels == 1]), grid, side="right")
    good_above = (labels == 0).sum() - np.searchsorted(np.sort(top[labels == 0]), grid, side="right")
    cost = 3 * good_above + bad_below
    formed = np.quantile(model.score(_gapped(symbols[positive])), 0.1) if len(_gapped(symbols[positive])) else np.inf
    best = int(np.where(grid <= max(formed, grid[0]), cost, len(top) * 4).argmin())
    above = min(grid[best + 1] if best + 1 < len(grid) else grid[best] + 1, max(formed, grid[best]))
    model.threshold = float((grid[best] + above) / 2)
    return model


def _gapped(symbols: np.ndarray) -> np.ndarray:
    """Of windows with four letters or more, the forms with a gap after every letter and with one gap in the middle; of long ones, of their first and their last half."""
    out = []
    for row in symbols:
        letters, half = row[row > 0], WINDOW // 2
        for part in [letters] if len(letters) <= half else [letters[:half], letters[-half:]]:
            if len(part) >= 4:
                for forms in (np.stack([part, np.zeros_like(part)], axis=1).ravel(), np.insert(part, len(part) // 2, 0)):
                    out.append(np.pad(forms, (0, WINDOW - len(forms))))
    return np.array(out, symbols.dtype).reshape(-1, WINDOW)


def _once(prints: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """One of each group of near copies with the same label, so that a copied document's words don't pass for insults."""
    keep = np.ones(len(prints), bool)
    for side in (0, 1):
        left = np.flatnonzero((labels == side) & prints.any(axis=1))
        while len(left):
            hit = np.bitwise_count(prints[left] ^ prints[left[0]]).sum(axis=1, dtype=np.int32) <= MAX_BITS
            hit[0] = True
            keep[left[hit][1:]] = False
            left = left[~hit]
    return keep


def _cover(window: np.ndarray, bag: np.ndarray, useful: np.ndarray) -> np.ndarray:
    """Windows that together reach every toxic document they can: again and again the one in most documents not reached yet, two at least."""
    window, bag = window[useful[window]], bag[useful[window]]
    chosen = []
    while len(window):
        counts = np.bincount(window)
        best = int(counts.argmax())
        if counts[best] < 2 and chosen:
            break
        chosen.append(best)
        keep = ~np.isin(bag, bag[window == best])
        window, bag = window[keep], bag[keep]
    return np.array(chosen, np.int64)


def _landmarks(symbols: np.ndarray, positive: np.ndarray, bad: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Two thirds of the landmarks are insults, the most frequent ones; the rest are clean windows nearest to them."""
    most = positive[np.argsort(-bad[positive], kind="stable")][: LANDMARKS * 2 // 3]
    close = kernel(symbols[negative], symbols[most]).max(axis=1)
    return np.unique(np.r_[most, negative[np.argsort(-close, kind="stable")[: LANDMARKS - len(most)]]])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on the labelled documents: at most ``train_docs`` rows of either class, by a seeded hash of the row, whatever its id.

    The driver gets the distinct windows of each, cut on the executors from the whole text.
    """
    small_batches(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = stable_rows(anchored(docs), "doc_id", "text").where("text is not null")
    chosen = checkpoint(lowest_hashed(rows.select("doc_id", *KEY).join(known, "doc_id").select("toxic", *KEY), "toxic", KEY, train_docs, 20))

    @F.pandas_udf("struct<print:binary,windows:array<binary>>")
    def cut(text: pd.Series) -> pd.DataFrame:
        found = [bag(t) for t in text]
        return pd.DataFrame({"print": [p for p, _ in found], "windows": pd.Series([w for _, w in found], dtype=object)})

    few = rows.join(small_side(chosen, chosen.count()), list(KEY)).select("toxic", "order", cut("text").alias("bag"))
    found = sorted(((r.toxic, r.order, bytes(r.bag["print"]), [bytes(w) for w in r.bag["windows"]]) for r in few.toLocalIterator()), key=lambda x: x[:3])
    return fit_bags([x[2:] for x in found], np.array([x[0] for x in found], np.int64))


def verdict(docs: DataFrame, model: Model, text_col: str = "text"):
    """A struct column ``score, window, toxic`` for the text column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score float, window string, toxic boolean")
    def judge(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        scores, words = score_texts(m, list(text))
        toxic = np.where(np.isnan(scores), False, scores > m.threshold)
        words = [w if t else None for w, t in zip(words, toxic, strict=True)]
        return pd.DataFrame({"score": pd.array(scores, "Float32"), "window": pd.Series(words, dtype=object), "toxic": toxic})

    return judge(F.col(named(text_col)))


def judged(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, score, toxic, window`` for every row: its highest margin, whether it is toxic, and the insult found.

    A null text, or one without a word, has a null score and isn't toxic. Repeated rows get the same verdict.
    Without labels of both classes nothing is toxic. Columns other than doc_id and text are ignored. An empty
    table gives an empty result.
    """
    v = docs.select("doc_id", verdict(docs, train(docs, labels, train_docs)).alias("v"))
    return v.select("doc_id", F.when(~F.isnan("v.score"), F.col("v.score")).alias("score"), F.col("v.toxic").alias("toxic"), F.col("v.window").alias("window"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns, under whatever names.

    Null and empty texts stay, repeated rows are decided alike. Without labels of both classes all rows stay. An
    empty table stays empty.
    """
    return docs.where(~verdict(docs, train(docs, labels, train_docs))["toxic"])
