"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of bytes, which overlap their neighbours by a margin that only warms the states up. Both
directions run over a window, every position within gets a probability for each language from the two states there,
and a document's probabilities are the mean over all its positions. Training is Adam on the mean cross entropy of
positions, the gradient by backpropagation through time, over windows of all of the sampled texts.

Gates are (1 + tanh a) / 2, the logistic function of 2 a: one vectorised function does for all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, free_of, with_columns

HIDDEN = 16
#: Bytes of a window when predicting, and of the margin on each side of it.
WINDOW, MARGIN = 240, 8
#: The model is fitted on so many rows of each language at most, whole texts, in windows of FIT_WINDOW bytes with the same margins.
FIT_DOCS = 128
FIT_WINDOW = 48
#: Parts in which a language's rows are ranked first.
SALTS = 64
#: Every window is drawn once at least; a small sample is drawn again up to so many steps, for each 4 languages.
STEPS = 150
BATCH = 256
#: Windows that are run together when predicting: fewer with more than 64 languages.
TOGETHER = 1024
NONE = "und"


class ByteGRU:
    """Weights: x (2, 256, 3 H) for each direction and byte, u (2, H, 3 H), c (2, H) inside the reset gate, and v (2 H, L), b (L)."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.hidden = hidden
        self.w = {"x": draw(2, 256, 3 * hidden), "u": draw(2, hidden, 3 * hidden) * 0.5, "c": draw(2, hidden) * 0, "v": draw(2 * hidden, n_labels), "b": draw(n_labels) * 0}

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(2, T, B, H): the states after each position of windows x (B, T), for the backward direction in its own order. keep: gets what backward() needs."""
        (n, steps), h_size, w = x.shape, self.hidden, self.w
        out = np.zeros((2, steps, n, h_size), dtype=np.float32)
        h = np.zeros((2, n, h_size), dtype=np.float32)
        both = np.stack([x.T, x.T[::-1]])
        for t in range(steps):
            a = np.stack([w["x"][0][both[0, t]], w["x"][1][both[1, t]]])
            hu = h @ w["u"]
            gates = a[..., : 2 * h_size]
            gates += hu[..., : 2 * h_size]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :h_size], gates[..., h_size:]
            inner = hu[..., 2 * h_size :]
            inner += w["c"][:, None]
            new = a[..., 2 * h_size :]
            new += r * inner
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((h, z, r, inner, new))
            h = h - new
            h *= z
            h += new
            out[:, t] = h
        return out

    def positions(self, s: np.ndarray) -> np.ndarray:
        """(T, B, 2 H): both states at each position."""
        return np.concatenate([s[0], s[1, ::-1]], axis=-1)

    def probabilities(self, x: np.ndarray, margin: int = 0) -> np.ndarray:
        """(T - 2 margin, L, B): the probability of each label at each position but the first and last `margin`.

        The same network as states(), with units before windows so that gates are contiguous, and with weights scaled
        so that the logistic function of a gate is 1 / (1 + exp a) and the tangent 2 / (1 + exp a) - 1: exponentials take a third of the time of tanh.
        """
        (n, steps), h_size, w = x.shape, self.hidden, self.w
        u = [-2 * np.concatenate([w["u"][k].T, np.concatenate([np.zeros(2 * h_size), w["c"][k]])[:, None]], axis=1).astype(np.float32) for k in range(2)]
        out = np.zeros((steps, len(w["b"]), n), dtype=np.float32)
        out += w["b"][None, :, None]
        a, hu = (np.empty((3 * h_size, n), dtype=np.float32) for _ in range(2))
        gates, new, inner, bytes_at = a[: 2 * h_size], a[2 * h_size :], hu[2 * h_size :], np.ascontiguousarray(x.T)

        def logistic(v: np.ndarray) -> None:
            np.exp(v, out=v)
            v += 1
            np.reciprocal(v, out=v)

        for k in range(2):
            table, v = np.ascontiguousarray(-2 * w["x"][k].T), np.ascontiguousarray(w["v"][k * h_size : (k + 1) * h_size].T)
            h = np.zeros((h_size + 1, n), dtype=np.float32)
            h[-1] = 1
            state = h[:-1]
            with np.errstate(over="ignore"):  # an infinite exponential makes a gate 0, as it should
                for t in range(steps - margin) if k == 0 else range(steps - 1, margin - 1, -1):
                    np.take(table, bytes_at[t], axis=1, out=a, mode="clip")
                    np.matmul(u[k], h, out=hu)
                    gates += hu[: 2 * h_size]
                    logistic(gates)
                    inner *= gates[h_size:]
                    new += inner
                    logistic(new)
                    new *= 2
                    new -= 1
                    state -= new
                    state *= gates[:h_size]
                    state += new
                    out[t] += v @ state
        out = out[margin : steps - margin]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean loss and its gradient; y (B): labels of windows; weight (B, T): 0 on padding."""
        keep, h_size, w = [], self.hidden, self.w
        s = self.states(x, keep)
        at = self.positions(s)
        logits = at @ w["v"] + w["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        scale = (weight / weight.sum()).T[..., None].astype(np.float32)
        loss = float(-(np.log(p[:, np.arange(len(y)), y] + 1e-12)[..., None] * scale).sum())
        p[:, np.arange(len(y)), y] -= 1
        d = p * scale
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["v"], g["b"] = np.einsum("tbh,tbl->hl", at, d), d.sum(axis=(0, 1))
        dat = d @ w["v"].T
        dout = np.stack([dat[..., :h_size], dat[::-1, :, h_size:]])
        both = np.stack([x.T, x.T[::-1]])
        dh = np.zeros_like(keep[0][0])
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, inner, new = keep[t]
            dh = dh + dout[:, t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * 2 * z * (1 - z)
            dr = dnew * inner * 2 * r * (1 - r)
            dinner = dnew * r
            dhu = np.concatenate([dz, dr, dinner], axis=-1)
            g["u"] += h.transpose(0, 2, 1) @ dhu
            g["c"] += dinner.sum(axis=1)
            da = np.concatenate([dz, dr, dnew], axis=-1)
            for k in range(2):
                np.add.at(g["x"][k], both[k, t], da[k])
            dh = dh * z + dhu @ w["u"].transpose(0, 2, 1)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int | None = None, batch: int = BATCH, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Passes over all windows in random order, until `steps` of them."""
        rng, losses = np.random.default_rng(seed), []
        steps = steps or max(STEPS * -(-len(self.w["b"]) // 4), -(-len(x) // batch))
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        left = np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if len(left) < min(batch, len(x)):
                left = np.concatenate([left, rng.permutation(len(x))])
            some, left = left[:batch], left[batch:]
            loss, g = self.gradient(x[some], y[some], weight[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.w[k] = (self.w[k] - rate * min(1, 2 * (1 - step / (steps + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def windows(texts: list[bytes], width: int = WINDOW, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, length): all of every text, cut every `width` bytes into rows of that and a margin on both sides; of the last row of a text only `length` bytes are its own. Zeros lie around a text."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    rows = -(-size // width)
    data = np.frombuffer(b"".join(b"\0" * margin + t + b"\0" * (-len(t) % width + margin) for t in texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), rows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = np.repeat(np.cumsum(rows * width + 2 * margin) - (rows * width + 2 * margin), rows) + place * width
    return data[begin[:, None] + np.arange(width + 2 * margin)], owner, np.minimum(width, size[owner] - place * width)


def training_texts(docs: DataFrame) -> DataFrame:
    """(lang, text) of a bounded sample: of each language the FIT_DOCS rows with the smallest hashes; rows alike in doc_id and text are one."""
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text RLIKE '\\\\p{L}'").select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"))
    rank = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy("_h", "doc_id", "_t"))
    some = known.select("lang", "doc_id", "_h", "_t").distinct().withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    some = some.withColumn("_rank", rank("_salt")).where(F.col("_rank") <= FIT_DOCS)  # a part of a language at a time, then what is left of all parts
    some = some.withColumn("_rank", rank()).where(F.col("_rank") <= FIT_DOCS)
    found = known.join(F.broadcast(some.select("lang", "doc_id", "_t")), ["lang", "doc_id", "_t"], "left_semi")  # FIT_DOCS rows of each language
    return found.dropDuplicates(["lang", "doc_id", "_t"]).select("lang", "text")


def fit(docs: DataFrame) -> tuple[ByteGRU | None, list[str]]:
    """A network fitted on docs (doc_id, text, lang), and its labels, all that occur with a text; None without labelled text."""
    rows = sorted((r.lang, r.text) for r in training_texts(docs).collect())
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None, []
    x, owner, length = windows([text.encode() for _, text in rows], FIT_WINDOW)
    y = np.searchsorted(labels, [lang for lang, _ in rows])[owner]
    model = ByteGRU(len(labels))
    own = np.arange(x.shape[1]) - MARGIN
    model.fit(x, y, (own >= 0) & (own < length[:, None]))
    return model, labels


def document_probabilities(model: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """(documents, L): the mean over all positions of each text; texts aren't empty."""
    data, owner, length = windows(texts)
    total = np.zeros((len(texts), len(model.w["b"])))
    place = np.arange(WINDOW)[:, None]
    together = max(1, min(TOGETHER, 64 * TOGETHER // len(model.w["b"])))
    together = -(-len(data) // -(-len(data) // together))  # shares of about one size
    for at in range(0, len(data), together):
        rows = slice(at, at + together)
        p = model.probabilities(data[rows], MARGIN)
        p *= (place < length[rows])[:, None]
        np.add.at(total, owner[rows], p.sum(axis=0).T)
    return total / np.array([len(t) for t in texts])[:, None]


def predict(docs: DataFrame, model: ByteGRU | None, labels: list[str]) -> DataFrame:
    """docs without text, with lang_pred and score.

    A text that is null or has no letter is `und` with score 0, and so is all if there was nothing to learn from.
    Every row stays, repeated ones too, and is judged on its own, over all of its text; an empty table gives no rows;
    other columns may hold nulls, and those that clash with the new names are left out.
    """
    rest = free_of(docs, "text", "lang_pred", "score")

    def run(b: pa.RecordBatch) -> list:
        texts = b.column("text").to_pylist()
        names, scores = [NONE] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and model and any(map(str.isalpha, t))]
        p = document_probabilities(model, [texts[i].encode() for i in at]) if at else []
        for i, row in zip(at, p, strict=True):
            best = int(row.argmax())
            names[i], scores[i] = labels[best], min(1.0, float(row[best]))
        return [names, scores]

    return with_columns(docs, rest, "lang_pred string, score double", run)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model, labels = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, labels)
