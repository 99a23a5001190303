"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes of the UTF-8 text in both directions (two
GRUs, trained in numpy by backpropagation through time) and labels every byte position
from both states. A document's probabilities are the mean over all its positions; the
windows cover the whole text, whatever its length.

Training takes a bounded sample: up to ``PER_LANG`` texts for each language, fewer where these
would be more than ``MAX_TEXTS`` in all, distinct texts chosen by a hash, and ``CUTS`` windows of
each, spread over the text. No language is left out; more languages than ``MAX_TEXTS`` raise
ValueError. Nothing but text and label enters the model.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled row every text is ``und``. Rows with a null label are predicted but not
learned from. Equal texts get equal predictions up to float rounding; ties go to the
alphabetically first label. An empty table gives an empty result. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import column, ship, slices, unused

WINDOW = 64
HIDDEN = 8
EMBED = 8
PER_LANG = 400
MAX_TEXTS = 25_600
CUTS = 3
STEPS = 260
BATCH = 192
#: Windows that pass the network together.
TOGETHER = 2048
PAD = 0
_HASHES = 1 << 40


@dataclass
class Model:
    labels: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes as rows of ``size``, the last one padded."""
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


def _init(n_labels: int, rng) -> dict[str, np.ndarray]:
    h, e = HIDDEN, EMBED
    w = {"E": rng.normal(0, 0.5, (256, e)), "V": rng.normal(0, 0.3, (2 * h, n_labels)), "c": np.zeros(n_labels)}
    for d in "fb":
        w |= {f"W{d}": rng.normal(0, e**-0.5, (e, 3 * h)), f"U{d}": rng.normal(0, h**-0.5, (h, 3 * h)), f"b{d}": np.zeros(3 * h), f"q{d}": np.zeros(h)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _forward(w, d: str, x: np.ndarray):
    """States of one direction, with what backpropagation needs; x: (T, B, 3H) input parts."""
    h_, (t_, b_) = HIDDEN, x.shape[:2]
    u, q = w[f"U{d}"], w[f"q{d}"]
    h = np.zeros((t_ + 1, b_, h_), np.float32)
    zs, rs, ns, as_ = (np.empty((t_, b_, h_), np.float32) for _ in range(4))
    for t in range(t_):
        a = h[t] @ u
        zs[t] = _sigmoid(x[t, :, :h_] + a[:, :h_])
        rs[t] = _sigmoid(x[t, :, h_ : 2 * h_] + a[:, h_ : 2 * h_])
        as_[t] = a[:, 2 * h_ :] + q
        ns[t] = np.tanh(x[t, :, 2 * h_ :] + rs[t] * as_[t])
        h[t + 1] = ns[t] + zs[t] * (h[t] - ns[t])
    return h, zs, rs, ns, as_


def _backward(w, d: str, kept, dh_out: np.ndarray):
    """Gradients of U and q and of the input parts, back through time."""
    h, zs, rs, ns, as_ = kept
    h_, (t_, b_) = HIDDEN, zs.shape[:2]
    u = w[f"U{d}"]
    du, dq = np.zeros_like(u), np.zeros(h_, np.float32)
    dx = np.empty((t_, b_, 3 * h_), np.float32)
    dh = np.zeros((b_, h_), np.float32)
    for t in range(t_ - 1, -1, -1):
        dh = dh + dh_out[t]
        dn = dh * (1 - zs[t]) * (1 - ns[t] ** 2)
        dz = dh * (h[t] - ns[t]) * zs[t] * (1 - zs[t])
        dr = dn * as_[t] * rs[t] * (1 - rs[t])
        da = dn * rs[t]
        dx[t, :, :h_], dx[t, :, h_ : 2 * h_], dx[t, :, 2 * h_ :] = dz, dr, dn
        g = np.concatenate([dz, dr, da], axis=1)
        du += h[t].T @ g
        dq += da.sum(0)
        dh = dh * zs[t] + g @ u.T
    return du, dq, dx


def loss_and_gradients(w, x: np.ndarray, y: np.ndarray):
    """Mean cross-entropy over all unpadded positions of windows x (B, T) with labels y (B)."""
    ids = x.T
    real = (ids != PAD).astype(np.float32)
    e = w["E"][ids]
    kept, states = {}, []
    for d in "fb":
        order = slice(None) if d == "f" else slice(None, None, -1)
        kept[d] = _forward(w, d, (e @ w[f"W{d}"] + w[f"b{d}"])[order])
        states.append(kept[d][0][1:][order])
    s = np.concatenate(states, axis=2)
    logits = s @ w["V"] + w["c"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    at = (slice(None), np.arange(len(y)), y)
    total = max(1.0, float(real.sum()))
    loss = float(-(np.log(p[at] + 1e-12) * real).sum() / total)
    dl = p.copy()
    dl[at] -= 1
    dl *= real[:, :, None] / total
    flat = dl.reshape(-1, dl.shape[2])
    g = {"V": s.reshape(-1, s.shape[2]).T @ flat, "c": flat.sum(0)}
    ds = dl @ w["V"].T
    de = np.zeros_like(e)
    for k, d in enumerate("fb"):
        order = slice(None) if d == "f" else slice(None, None, -1)
        g[f"U{d}"], g[f"q{d}"], dx = _backward(w, d, kept[d], ds[:, :, k * HIDDEN : (k + 1) * HIDDEN][order])
        dx = dx[order]
        fx = dx.reshape(-1, dx.shape[2])
        g[f"W{d}"], g[f"b{d}"] = e.reshape(-1, EMBED).T @ fx, fx.sum(0)
        de += dx @ w[f"W{d}"].T
    g["E"] = np.zeros_like(w["E"])
    np.add.at(g["E"], ids.ravel(), de.reshape(-1, EMBED))
    return loss, g


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Fit the network on the given windows' texts with Adam, batches balanced by label."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    w = _init(len(labels), rng)
    rows = [np.concatenate([windows(t.encode()) for t, y in zip(texts, langs, strict=True) if y == k]) for k in labels]
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    var = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(labels), BATCH)
        x = np.stack([rows[k][rng.integers(0, len(rows[k]))] for k in y])
        _, g = loss_and_gradients(w, x, y)
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        rate = 0.02 * min(1, 3 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * v
            var[k] = 0.99 * var[k] + 0.01 * v**2
            w[k] = (w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(labels, w)


class Reader:
    """The trained network laid out for prediction: input parts are table lookups, and the
    gates' factor 1/2 (sigmoid as tanh) is folded into the weights."""

    def __init__(self, m: Model):
        h = HIDDEN
        half = np.ones(3 * h, np.float32)
        half[: 2 * h] = 0.5
        w = m.weights
        self.table = {d: np.ascontiguousarray((w["E"] @ w[f"W{d}"] + w[f"b{d}"]) * half).astype(np.float32) for d in "fb"}
        self.u = {d: np.ascontiguousarray(w[f"U{d}"] * half) for d in "fb"}
        self.q = {d: w[f"q{d}"] for d in "fb"}
        self.v, self.c = w["V"], w["c"]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (T, B, labels) of every position of the windows x (B, T)."""
        h_, (b_, t_) = HIDDEN, x.shape
        ids = np.ascontiguousarray(x.T)
        logits = None
        for k, d in enumerate("fb"):
            table, u, q = self.table[d], self.u[d], self.q[d]
            states = np.empty((t_, b_, h_), np.float32)
            h = np.zeros((b_, h_), np.float32)
            a, g = np.empty((b_, 3 * h_), np.float32), np.empty((b_, 3 * h_), np.float32)
            n = np.empty((b_, h_), np.float32)
            for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
                np.take(table, ids[t], axis=0, out=g)
                np.matmul(h, u, out=a)
                zr = g[:, : 2 * h_]
                zr += a[:, : 2 * h_]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                np.add(a[:, 2 * h_ :], q, out=n)
                n *= g[:, h_ : 2 * h_]
                n += g[:, 2 * h_ :]
                np.tanh(n, out=n)
                h -= n
                h *= g[:, :h_]
                h += n
                states[t] = h
            part = states.reshape(-1, h_) @ self.v[k * h_ : (k + 1) * h_]
            logits = part if logits is None else logits + part
        logits += self.c
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(t_, b_, -1)

    def pooled(self, raw: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text (uniform for an empty one)."""
        n = self.v.shape[1]
        out = np.zeros((len(raw), n))
        rows = [windows(r) for r in raw if r]
        if rows:
            owner = np.repeat([i for i, r in enumerate(raw) if r], [len(r) for r in rows])
            x = np.concatenate(rows)
            for k in range(0, len(x), TOGETHER):
                part = x[k : k + TOGETHER]
                p = self.positions(part)
                p *= (part.T != PAD)[:, :, None]
                np.add.at(out, owner[k : k + TOGETHER], p.sum(axis=0, dtype=np.float64))
        total = out.sum(axis=1, keepdims=True)
        return np.where(total > 0, out / np.where(total > 0, total, 1), 1 / n)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, max_texts: int = MAX_TEXTS) -> list[tuple[str, str]]:
    """(window text, label) rows: at most ``CUTS * per_lang`` for each label, on the driver."""
    near = F.pmod(F.xxhash64(text), F.lit(_HASHES))
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), near.alias("h"), F.col(text).alias("t"))
    # copies of a text share a hash and count once
    counts = known.groupBy("l").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).limit(max_texts + 1).collect()
    if not counts:
        return []
    if len(counts) > max_texts:
        raise ValueError(f"more than {max_texts} languages")
    per_lang = min(per_lang, max_texts // len(counts))
    # with enough to spare that a label is hardly ever short of its number; its least hash is always in
    wide = per_lang + 4 * per_lang**0.5 + 16
    bounds = [(r["l"], max(r["least"] + 1, int(min(1.0, 1.2 * wide / r["n"]) * _HASHES))) for r in counts]
    bound = docs.sparkSession.createDataFrame(bounds, "b_l string, b long")  # a row for each label, max_texts at most
    cuts = F.array(*(F.substring("t", (F.length("t") * k / CUTS).cast("int") + 1, F.lit(WINDOW)) for k in range(CUTS)))
    some = known.join(F.broadcast(bound), F.col("l") == F.col("b_l")).filter("h < b").select("l", "h", cuts.alias("c")).groupBy("l", "h").agg(F.first("c").alias("c"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))  # about 1.5 per_lang + 20 rows a label
    rows = some.withColumn("r", place).filter(F.col("r") <= per_lang).orderBy("l", "h").select("l", "c").collect()
    return [(c, r["l"]) for r in rows for c in r["c"] if c]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", **kw) -> Model | None:
    rows = sample(docs, text, lang, **kw)
    return train([t for t, _ in rows], [y for _, y in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every whole text."""
    ship(docs.sparkSession)
    letter, said = (unused(docs, x) for x in ("letter", "said"))
    src = docs.select(*(column(c) for c in keep), F.col(text).rlike(r"\p{L}").alias(letter), F.col(text).alias(said))
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model else None
        for big in batches:
            for b in slices(big, said, max_bytes=4 << 20):
                letter = b.column(len(keep)).to_pylist()
                raw = [t.encode() if t and x and reader else b"" for t, x in zip(b.column(len(keep) + 1).to_pylist(), letter, strict=True)]
                if reader:
                    p = reader.pooled(raw)
                    best = p.argmax(axis=1)
                    labels = [model.labels[k] if r else "und" for k, r in zip(best, raw, strict=True)]
                    scores = [float(min(1.0, q[k])) if r else 0.0 for q, k, r in zip(p, best, raw, strict=True)]
                else:
                    labels, scores = ["und"] * len(raw), [0.0] * len(raw)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, schema)
