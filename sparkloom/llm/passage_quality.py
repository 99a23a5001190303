"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of up to ``PASSAGE`` bytes. Each passage is encoded from what its
bytes look like (classes of characters, pairs of coarser classes, how far its shingles are
distinct) by a small network; gated attention ``w . (tanh(V h) * sigmoid(U h))`` weighs the
passages, and the weighted mean is scored. Only documents carry labels: encoder, attention and
score are learned together from them, in numpy, by Adam. The attention tells which
passages made the score.

Training takes a bounded sample: up to ``PER_LABEL`` distinct texts of each label, chosen by a hash
of the id, and of each up to ``CUTS`` passages spread over the text. Scoring reads every
byte of every text, a bounded number of passages at a time.

Edge cases: a null or empty text is one passage without bytes, and is scored. A document with both
labels teaches both. Rows with a null id or a null or other label are not learned
from. With no labelled text of one of the labels the score is that label's share (0.5 without any).
Ties do not arise: every row is scored by itself, and repeated rows alike up to float rounding. An
empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import held_out
from .store import column, ship, slices

PASSAGE = 512
SHINGLE = 8
PER_LABEL = 1500
CUTS = 32
HIDDEN = 16
GATE = 8
STEPS = 700
BAGS = 64
THRESHOLD = 0.3
#: Passages that are encoded together.
TOGETHER = 4096


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte a fine class (every sign of its own) and a coarse one."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    groups = [b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
    for i, g in enumerate(groups, 1):
        fine[list(g)] = coarse[list(g)] = i
    signs = [x for x in range(33, 127) if not chr(x).isalnum()]
    fine[signs] = len(groups) + 1 + np.arange(len(signs))
    for i, g in enumerate((b".!?", b",;:", b"\"'()[]{}", b"-_/\\", b"#*$%&|<>@^~+=`"), len(groups) + 1):
        coarse[list(g)] = i
    return fine, coarse


FINE, COARSE = _classes()
N_FINE, N_COARSE = int(FINE.max()) + 1, int(COARSE.max()) + 1
FEATURES = N_FINE + N_COARSE**2 + 2


def cut_up(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, length) of the passages of texts of these lengths: as few as needed, of nearly one length."""
    many = np.maximum(1, -(-lengths // PASSAGE))
    text = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    n, m = lengths[text], many[text]
    return text, (k + 1) * n // m - k * n // m


def features(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row for each passage; ``raw`` are their bytes one after another, none longer than ``PASSAGE``."""
    n = len(lengths)
    own = np.repeat(np.arange(n), lengths)
    some = np.maximum(1, lengths)[:, None].astype(np.float32)
    fine = np.bincount(own * N_FINE + FINE[raw], minlength=n * N_FINE).reshape(n, N_FINE)
    c = COARSE[raw]
    pair = (own[:-1] * N_COARSE + c[:-1]) * N_COARSE + c[1:]
    pairs = np.bincount(pair[own[:-1] == own[1:]], minlength=n * N_COARSE**2).reshape(n, N_COARSE**2)
    return np.concatenate([np.sqrt(fine / some), np.sqrt(pairs / some), _distinct(raw, lengths)[:, None], lengths[:, None] / PASSAGE], axis=1, dtype=np.float32)


def _distinct(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The share of a passage's shingles of ``SHINGLE`` bytes that are distinct."""
    h, step = raw.astype(np.uint32), 1
    while step < SHINGLE:
        h = h[: max(0, len(h) - step)] * np.uint32(2654435761) + h[step:] if len(h) > step else h[:0]
        h ^= h >> np.uint32(15)
        step *= 2
    shingles = np.maximum(0, lengths - SHINGLE + 1)
    wide = int(shingles.max(initial=0))
    if not wide:
        return np.ones(len(lengths), np.float32)
    at = (np.cumsum(lengths) - lengths)[:, None] + np.arange(wide)
    real = np.arange(wide) < shingles[:, None]
    rows = np.where(real, h[np.minimum(at, len(h) - 1)], np.uint32(0xFFFFFFFF))
    rows.sort(axis=1)
    different = 1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1) - (shingles < wide)
    return np.where(shingles > 0, different / np.maximum(1, shingles), 1).astype(np.float32)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    """``weights`` is None where only the labels' ``share`` is known."""

    weights: dict[str, np.ndarray] | None
    share: float = 0.5

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and attention (before softmax) of each passage."""
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        return h, (np.tanh(h @ w["V"] + w["v"]) * _sigmoid(h @ w["U"] + w["u"])) @ w["w"]

    def score(self, h: np.ndarray, a: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of the bags that begin at ``starts``."""
        z = _softmax(a, starts)[:, None] * h
        logit = np.add.reduceat(z, starts, axis=0) @ self.weights["c"] + self.weights["d"]
        return _sigmoid(logit.astype(np.float64)).reshape(-1)


def _softmax(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(a)))
    e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
    return e / np.repeat(np.add.reduceat(e, starts), sizes)


def loss_and_gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray):
    """Mean cross-entropy of bags with labels y, and its gradients."""
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"] + w["v"]), _sigmoid(h @ w["U"] + w["u"])
    a = _softmax((t * s) @ w["w"], starts)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = _sigmoid(z @ w["c"] + w["d"])
    loss = float(-np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9)))
    dl = (p - y) / len(y)
    g = {"c": z.T @ dl, "d": dl.sum(keepdims=True)}
    dz = np.repeat(dl[:, None] * w["c"][None, :], sizes, axis=0)
    da = (dz * h).sum(axis=1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    g["w"] = (t * s).T @ da
    dts = da[:, None] * w["w"][None, :]
    dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
    g |= {"V": h.T @ dt, "v": dt.sum(0), "U": h.T @ ds, "u": ds.sum(0)}
    dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    return loss, g | {"W": x.T @ dh, "b": dh.sum(0)}


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Model:
    """Fit on bags of passage features; batches hold both labels alike."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    rows = [(b - mean) / scale for b in bags]
    w = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1), "w": rng.normal(0, 0.3, GATE)}
    w |= {k: rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)) for k in "VU"} | {k: np.zeros(GATE) for k in "vu"}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(o, BAGS // 2) for o in of])
        x = np.concatenate([rows[i] for i in pick])
        sizes = [len(rows[i]) for i in pick]
        _, g = loss_and_gradients(w, x, np.cumsum([0, *sizes[:-1]]), labels[pick].astype(np.float32))
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v + (1e-4 * w[k] if k in "WVU" else 0)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v**2
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    w["b"] = (w["b"] - (mean / scale) @ w["W"]).astype(np.float32)
    w["W"] = (w["W"] / scale[:, None]).astype(np.float32)
    return Model(w)


def _bags(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bag, bytes, lengths) of runs of passages, ``TOGETHER`` at a time."""
    text, lengths = cut_up(np.array([len(t) for t in texts], np.int64))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    for at in range(0, len(text), TOGETHER):
        k = slice(at, at + TOGETHER)
        yield text[k], raw[ends[at] - lengths[at] : ends[k][-1]], lengths[k]


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    if model.weights is None:
        return np.full(len(texts), model.share)
    text, h, a = zip(*((t, *model.encode(features(raw, n))) for t, raw, n in _bags(texts)), strict=True)
    return model.score(np.concatenate(h), np.concatenate(a), np.flatnonzero(np.diff(np.concatenate(text), prepend=-1)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> list[tuple[int, list[str]]]:
    """(label, passages) of at most ``per_label`` distinct texts of each label, on the driver."""
    known = labels.select(column(id_col).alias("id"), column(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    # the least hashes of each label; twice what is wanted, as some ids have no text or a copy
    ids = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * per_label) for y in (0, 1)]
    n = F.length("t")
    many = F.least(F.lit(CUTS), F.greatest(F.lit(1), F.ceil(n / PASSAGE))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(F.col("t"), (i * n / many).cast("int") + 1, F.lit(PASSAGE)))
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text), F.lit("")).alias("t"))
    found = texts.join(F.broadcast(ids[0].unionAll(ids[1])), "id").select("y", F.xxhash64("t").alias("h"), pieces.alias("p"))
    # one row for each text and label: a group of copies is met once, however large
    rows = found.groupBy("y", "h").agg(F.first("p").alias("p"))
    out = []
    for y in (0, 1):
        out += [(y, r["p"]) for r in rows.filter(F.col("y") == y).orderBy("h").limit(per_label).select("p").collect()]
    return out


def fit(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    rows = sample(docs, labels, **kw)
    y = np.array([k for k, _ in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(None, float(y.mean()) if len(y) else 0.5)
    bags = []
    for _, pieces in rows:
        raw = [p.encode()[:PASSAGE] for p in pieces]
        bags.append(features(np.frombuffer(b"".join(raw), np.uint8), np.array([len(p) for p in raw], np.int64)))
    return train(bags, y)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text."""
    ship(docs.sparkSession)
    src = docs.select(column(id_col).alias("id"), held_out(column(id_col)).alias("held_out"), column(text).alias("t"))
    schema = T.StructType([T.StructField(id_col, src.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "t", max_bytes=2 << 20):
                scores = score_texts(model, [(t or "").encode() for t in b.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], schema.names)

    return src.mapInArrow(run, schema)


def learn_from(doc_id: Column) -> Column:
    """Rows that may be learned from."""
    return doc_id.isNotNull() & ~held_out(doc_id)
