"""Language identification: a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import KEY, anchored, checkpoint, lowest_hashed, mix, named, small_batches, small_side, stable_rows

#: Units of either direction, and the bytes that one recurrence runs over.
HIDDEN, SPAN = 8, 128
#: At most this many documents of each language fit the network, the lowest of a seeded hash of the row; STEPS batches of BATCH spans.
TRAIN_DOCS, STEPS, BATCH = 300, 260, 96
#: Spans of a training document that are fitted on, drawn evenly from its whole text; a text of no more is taken whole.
TRAIN_SPANS = 32
#: Spans that are run side by side; bounds memory.
ABREAST = 2048


@dataclass
class Network:
    """Per direction: byte table (256, 3H), recurrent weights (H, 3H), candidate bias (H), output weights (H, L); and the output bias."""

    names: list[str]
    parts: dict[str, np.ndarray]

    @staticmethod
    def fresh(names: list[str], seed: int = 1) -> Network:
        rng, h, n = np.random.default_rng(seed), HIDDEN, len(names)
        parts = {"out_b": np.zeros(n, np.float32)}
        for d in "fb":
            parts[d + "_in"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            parts[d + "_rec"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            parts[d + "_cand"] = np.zeros(h, np.float32)
            parts[d + "_out"] = rng.normal(0, 0.3, (h, n)).astype(np.float32)
        return Network(names, parts)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (T, B, H) of one direction over bytes (T, B); ``keep`` also gives what backpropagation needs."""
        p, h = self.parts, HIDDEN
        table, rec, cand = p[d + "_in"].copy(), p[d + "_rec"].copy(), p[d + "_cand"]
        # gates as (1 + tanh(v / 2)) / 2
        table[:, : 2 * h] *= 0.5
        rec[:, : 2 * h] *= 0.5
        steps, many = x.shape
        out = np.empty((steps, many, h), np.float32)
        kept = []
        state = np.zeros((many, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            inp = table[x[t]]
            hid = state @ rec
            gates = inp[:, : 2 * h] + hid[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            reset, update = gates[:, :h], gates[:, h:]
            inner = hid[:, 2 * h :] + cand
            new = reset * inner
            new += inp[:, 2 * h :]
            np.tanh(new, out=new)
            if keep:
                kept.append((t, state, reset, update, inner, new))
            state = state - new
            state *= update
            state += new
            out[t] = state
        return (out, kept) if keep else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax over languages at every position: (T, B, L)."""
        logits = self.states(x, "f") @ self.parts["f_out"]
        logits += self.states(x, "b") @ self.parts["b_out"]
        logits += self.parts["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the positions in ``real`` and its gradient, by backpropagation through time."""
        p, h = self.parts, HIDDEN
        (hf, kf), (hb, kb) = self.states(x, "f", True), self.states(x, "b", True)
        logits = hf @ p["f_out"] + hb @ p["b_out"] + p["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        total = max(1, int(real.sum()))
        loss = float(-(np.log(np.take_along_axis(prob, np.broadcast_to(y, x.shape)[:, :, None], 2) + 1e-9)[:, :, 0] * real).sum() / total)
        prob[:, np.arange(x.shape[1]), y] -= 1
        delta = prob * (real[:, :, None] / np.float32(total))
        flat = delta.reshape(-1, delta.shape[2])
        g = {"out_b": flat.sum(axis=0)}
        for d, hs, kept in (("f", hf, kf), ("b", hb, kb)):
            g[d + "_out"] = hs.reshape(-1, h).T @ flat
            outer = delta @ p[d + "_out"].T
            rec = p[d + "_rec"]
            d_rec, d_cand = np.zeros_like(rec), np.zeros(h, np.float32)
            d_in = np.empty((*x.shape, 3 * h), np.float32)
            back = np.zeros((x.shape[1], h), np.float32)
            for t, state, reset, update, inner, new in reversed(kept):
                back = back + outer[t]
                d_new = back * (1 - update) * (1 - new * new)
                d_update = back * (state - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                d_inner = d_new * reset
                d_hid = np.concatenate([d_reset, d_update, d_inner], axis=1)
                d_in[t] = np.concatenate([d_reset, d_update, d_new], axis=1)
                d_rec += state.T @ d_hid
                d_cand += d_inner.sum(axis=0)
                back = back * update + d_hid @ rec.T
            table = np.zeros((256, 3 * h), np.float32)
            np.add.at(table, x.ravel(), d_in.reshape(-1, 3 * h))
            g |= {d + "_rec": d_rec, d + "_cand": d_cand, d + "_in": table}
        return loss, g


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts in spans: bytes (T, B), the length of each span and its text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    each = -(-sizes // SPAN)
    of = np.repeat(np.arange(len(raw)), each)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    length = np.minimum(sizes[of] - nth * SPAN, SPAN)
    flat = np.zeros(len(of) * SPAN, np.uint8)
    at = 0
    for r, n in zip(raw, each, strict=True):
        flat[at : at + len(r)] = np.frombuffer(r, np.uint8)
        at += int(n) * SPAN
    return np.ascontiguousarray(flat.reshape(-1, SPAN).T), length, of


def drawn(text: str, seed: int) -> list[bytes]:
    """The spans of a text, or TRAIN_SPANS of them by a seeded hash of their number, wherever they are."""
    raw = text.encode("utf-8", "surrogatepass")
    many = -(-len(raw) // SPAN)
    at = np.arange(many)
    if many > TRAIN_SPANS:
        at = np.sort(np.argsort(mix(at.astype(np.uint64) + np.uint64(seed % (1 << 63))), kind="stable")[:TRAIN_SPANS])
    return [raw[k * SPAN : (k + 1) * SPAN] for k in at.tolist()]


def fit(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """``fit_spans`` on the drawn spans of texts."""
    each = [drawn(t, k) for k, t in enumerate(texts)]
    return fit_spans([s for e in each for s in e], [v for e, v in zip(each, langs, strict=True) for _ in e], steps, seed)


def fit_spans(parts: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on spans drawn evenly from the languages; every position of a span has its document's language."""
    names = sorted(set(langs))
    net = Network.fresh(names or ["und"])
    if len(names) < 2 or not parts:
        return net
    length = np.array([len(p) for p in parts], np.int64)
    x = np.ascontiguousarray(np.frombuffer(b"".join(p.ljust(SPAN, b"\0") for p in parts), np.uint8).reshape(-1, SPAN).T)
    y = np.array([names.index(v) for v in langs])
    pools = [np.flatnonzero(y == k) for k in range(len(names))]
    pools = [q for q in pools if len(q)]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.parts.items()}
    v = {k: np.zeros_like(v) for k, v in net.parts.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(q, -(-BATCH // len(pools))) for q in pools])
        real = (np.arange(SPAN)[:, None] < length[pick]).astype(np.float32)
        _, g = net.gradients(x[:, pick], y[pick], real)
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        rate = 0.03 * (1 - 0.9 * step / steps) / (np.sqrt(1 - 0.999**step) ** -1)
        for k, q in g.items():
            q = q / max(1.0, norm)
            m[k] += 0.1 * (q - m[k])
            v[k] += 0.001 * (q * q - v[k])
            net.parts[k] -= rate / (1 - 0.9**step) * m[k] / (np.sqrt(v[k]) + 1e-8)
    return net


def position_labels(net: Network, text: str) -> np.ndarray:
    """The language (an index into ``net.names``) of every byte of a text."""
    x, length, _ = spans([text])
    if not len(length):
        return np.zeros(0, np.int64)
    best = np.concatenate([net.probabilities(x[:, s : s + ABREAST]).argmax(axis=2) for s in range(0, x.shape[1], ABREAST)], axis=1)
    return best.T.ravel()[: int(length.sum())]


def pooled(net: Network, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the mean probability of each language over its bytes, and how many bytes have each label."""
    mean = np.zeros((len(texts), len(net.names)), np.float64)
    count = np.zeros((len(texts), len(net.names)), np.int64)
    group: list[int] = []

    def run() -> None:
        x, length, of = spans([texts[i] for i in group])
        for s in range(0, x.shape[1], ABREAST):
            prob = net.probabilities(x[:, s : s + ABREAST])
            real = np.arange(SPAN)[:, None] < length[s : s + ABREAST]
            prob *= real[:, :, None]
            rows = np.array(group)[of[s : s + ABREAST]]
            best = prob.argmax(axis=2)
            np.add.at(mean, rows, prob.sum(axis=0))
            np.add.at(count, rows, np.stack([((best == k) & real).sum(axis=0) for k in range(len(net.names))], axis=1))
        group.clear()

    size = 0
    for i, t in enumerate(texts):
        if t:
            group.append(i)
            size += len(t)
            if size > 4 * ABREAST * SPAN:
                run()
                size = 0
    if group:
        run()
    return mean / np.maximum(count.sum(axis=1, keepdims=True), 1), count


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> Network:
    """Fit on documents whose ``lang`` is known: at most ``train_docs`` rows of each, by a seeded hash of the row, whatever its id.

    The driver gets TRAIN_SPANS spans of each, cut on the executors from the whole text.
    """
    small_batches(docs.sparkSession)
    known = stable_rows(anchored(docs), "lang", "text").where("lang is not null and text is not null and text <> ''")
    chosen = checkpoint(lowest_hashed(known.select("lang", *KEY), "lang", KEY, train_docs, 10))

    @F.pandas_udf("array<binary>")
    def cut(text: pd.Series, order: pd.Series) -> pd.Series:
        return pd.Series([drawn(t, int(o)) for t, o in zip(text, order, strict=True)], dtype=object)

    few = known.join(small_side(chosen, chosen.count()), ["lang", *KEY])
    rows = sorted((r.lang, r.order, r.cut) for r in few.select("lang", "order", cut("text", "order").alias("cut")).collect())
    parts = [(bytes(p), lang) for lang, _, found in rows for p in found]
    return fit_spans([p for p, _ in parts], [v for _, v in parts], steps)


def identified(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, predicted, probability, label_bytes`` for every row: pooled over all bytes of its whole text.

    ``label_bytes`` maps each language to the bytes that have its label. Null and empty texts have a null
    prediction and an empty map. Repeated rows get the same result; of equal probabilities the first language
    in alphabetical order wins. Columns other than doc_id, lang and text are ignored. An empty table, or one
    with fewer than two languages to learn, still gives a row per row.
    """
    small_batches(docs.sparkSession)
    net = net or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("predicted string, probability double, label_bytes map<string,long>")
    def label(text: pd.Series) -> pd.DataFrame:
        n = shared.value
        mean, count = pooled(n, list(text))
        some, best = count.sum(axis=1) > 0, mean.argmax(axis=1)
        return pd.DataFrame({
            "predicted": pd.Series([n.names[k] if s else None for k, s in zip(best, some, strict=True)], dtype=object),
            "probability": pd.array([float(m[k]) if s else None for m, k, s in zip(mean, best, some, strict=True)], "Float64"),
            "label_bytes": pd.Series([{a: int(b) for a, b in zip(n.names, c, strict=True) if b} for c in count], dtype=object),
        })

    return docs.select("doc_id", label("text").alias("v")).select("doc_id", "v.predicted", F.when(F.col("v.predicted").isNotNull(), F.col("v.probability")).alias("probability"), "v.label_bytes")
