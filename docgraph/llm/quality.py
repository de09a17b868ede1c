"""Quality scores by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import row_slices, utf8

#: Words in a passage.
PASSAGE = 40
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes counted per passage: lower case, upper case, digits, from U+0080, full stops, commas, other closers, marks, the rest.
_CLASS = np.full(256, 8, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _c, _k in ((b".", 4), (b",", 5), (b"!?;:", 6), (b"#*$%&|<>@^~=_+{}[]\\/", 7)):
    _CLASS[list(_c)] = _k
_CLASS[_SPACE] = 9
FEATURES = 9 + 9


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, text) of every passage: PASSAGE words in a row of a text, its last one maybe fewer; a text without words has one, of zeros."""
    texts = len(off) - 1
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1])) if len(buf) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1 if len(buf) else start
    first = np.searchsorted(start, off)
    words = np.diff(first)
    many = np.maximum(1, -(-words // PASSAGE))
    text = np.repeat(np.arange(texts), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    w0 = first[text] + nth * PASSAGE
    w1 = np.minimum(w0 + PASSAGE, first[text + 1])
    n = np.maximum(w1 - w0, 1).astype(np.float64)
    full = w1 > w0
    x = np.zeros((len(text), FEATURES))
    if len(start):
        b0, b1 = start[np.minimum(w0, len(start) - 1)], end[np.maximum(w1 - 1, 0)]
        kind = _CLASS[buf]
        size = np.maximum(b1 - b0, 1)
        for k in range(9):
            sums = np.r_[0, np.cumsum(kind == k)]
            x[:, k] = (sums[b1] - sums[b0]) / size
        # words: length, first, middle and last letter tell repeats at short distances
        length = end - start
        last, lead = kind[end - 1], kind[start]
        lower = (buf | np.uint8(32)).astype(np.int64)
        h = length + 64 * lower[start] + 16384 * lower[end - 1] + 4194304 * lower[(start + end) // 2]
        owner = np.repeat(np.arange(texts), words)
        columns = [length, length**2, last >= 6, last == 4, lead == 1, kind[(start + end) // 2] == 1]
        for d in (1, 2, 3):
            same = np.zeros(len(h), bool)
            same[d:] = (h[d:] == h[:-d]) & (owner[d:] == owner[:-d])  # never the text before
            columns.append(same)
        for k, c in enumerate(columns):
            sums = np.r_[0.0, np.cumsum(c, dtype=np.float64)]
            x[:, 9 + k] = (sums[w1] - sums[w0]) / n
        x[:, 9] /= 10
        x[:, 10] = np.sqrt(np.maximum(0, x[:, 10] - 100 * x[:, 9] ** 2)) / 10
        x[~full] = 0
    return x, text


class Model:
    """h = tanh(W x + b); attention a = softmax over a document of w . (tanh(V h) * sigmoid(U h)); score = sigmoid(c . sum a h + d)."""

    def __init__(self, mean, scale, parameters: dict):
        self.mean, self.scale, self.p = mean, scale, parameters

    def forward(self, x: np.ndarray, text: np.ndarray, texts: int):
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (v * u) @ p["w"]
        first = np.searchsorted(text, np.arange(texts))
        e = np.exp(e - np.maximum.reduceat(e, first)[text])
        a = e / np.add.reduceat(e, first)[text]
        z = np.add.reduceat(a[:, None] * h, first)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, h, v, u, a, z, s

    def gradient(self, x, text, y, weight):
        p = self.p
        x, h, v, u, a, z, s = self.forward(x, text, len(y))
        dz = ((s - y) * weight)[:, None] * p["c"][None, :]
        g = {"c": z.T @ ((s - y) * weight), "d": np.sum((s - y) * weight)}
        da = (dz[text] * h).sum(1)
        first = np.searchsorted(text, np.arange(len(y)))
        de = a * (da - np.add.reduceat(a * da, first)[text])
        g["w"] = (v * u).T @ de
        dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (a[:, None] * dz[text] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        return g, s


def train(x: np.ndarray, text: np.ndarray, y: np.ndarray, width: int = 16, epochs: int = 120, seed: int = 7) -> Model:
    """Adam on the documents' log loss, both classes weighing the same; fixed seed and order, so reruns agree."""
    r = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], width), "b": (width,), "V": (width, width), "U": (width, width), "w": (width,), "c": (width,), "d": ()}
    p = {k: np.zeros(s) if k in "bd" else r.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    model = Model(x.mean(0) if len(x) else 0, x.std(0) + 1e-3 if len(x) else 1, p)
    ones = y.mean() if len(y) else 0.5
    if len(y) == 0 or ones in (0, 1):
        p["c"][:], p["d"] = 0, np.float64(3.0 if ones == 1 else -3.0 if len(y) else 0)
        return model
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones))
    m, q, t = {k: 0 for k in p}, {k: 0 for k in p}, 0
    bounds = np.searchsorted(text, np.arange(len(y) + 1))
    size = max(32, min(256, len(y) // 8))
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(y), size):
            docs = np.sort(order[i : i + size])
            at = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            local = np.repeat(np.arange(len(docs)), bounds[docs + 1] - bounds[docs])
            g, _ = model.gradient(x[at], local, y[docs], weight[docs] / len(docs))
            t += 1
            for k in p:
                g[k] = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                q[k] = 0.999 * q[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, epochs: int = 120) -> Model:
    """Trains on at most `most` labelled documents, half of each class at most, chosen by a hash of doc_id.

    The bound is of this fit alone: it limits what the driver gathers, which is passages' features and never texts. Null and
    empty texts are a passage of zeros; repeated rows count as often as they are there; ties in the hash do not occur between
    different doc_ids; without both classes, so for an empty table, every text gets one score.
    """
    ids = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y"))
    some = [ids.where(f"y = {k}").orderBy(F.xxhash64("__id")).limit(most // 2) for k in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(0))
            x, text = passages(buf, off)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["id", "y", "x"])

    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("text"), F.col("__id").cast("long").alias("id"), "y").mapInArrow(run, "id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.x))
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(np.float64) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES))
    return train(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([r.y for r in rows], float), epochs=epochs)


def scores(model: Model, column) -> np.ndarray:
    """Every text's score, a bounded slice of them at a time; a long text's passages all count."""
    buf, off = utf8(column)
    out = np.zeros(len(off) - 1)
    for i, j in row_slices(off):
        x, text = passages(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        out[i:j] = model.forward(x, text, j - i)[-1]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs, by its text alone, whatever stands beside it; null and empty texts are one passage
    of zeros; an empty table gives no rows. No shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least `threshold`; see `score` for nulls, repeats and empty tables."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
