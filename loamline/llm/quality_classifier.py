"""Quality classifier: multiple-instance learning with gated attention over passages.

A document is a bag of passages (``PASSAGE_BYTES`` bytes each, all of the text). Every
passage is encoded by the shares of its bytes and of its hashed neighbouring byte pairs,
and by how much of it repeats. A network of numpy matrices learns from document labels
alone: a hidden layer for each passage, an attention weight from a tanh layer gated by a
sigmoid layer, the weighted sum of the hidden layers, and a logistic output.

Fitting uses a bounded sample: at most ``FIT_DOCS`` labelled rows of the given fold, by
order of a hash of the id. Scoring takes whole texts; the sums of a document are kept
with the largest attention logit so far, so a text of any length takes bounded memory.

Defined results: a null or empty text is one passage without content and has a score like
any other; rows of null or equal ids are scored one by one; without labelled rows of both
kinds the score is 0.5 everywhere; rows with a null label are not fitted; an empty table
gives an empty result. Other columns pass through ``score``, whose columns ``score`` and
``predicted`` replace those of an input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import crc_fold, documents, fit_in_task, labelled_sample, labels, text_slices

#: Documents for fitting; bytes of a passage; hashed byte pairs; hidden and attention units.
FIT_DOCS, PASSAGE_BYTES, PAIR_BINS, HIDDEN, ATTENTION = 3000, 768, 256, 24, 12
EPOCHS, BATCH_DOCS, RATE = 14, 64, 0.004
FEATURES = 128 + PAIR_BINS + 4
#: Bytes of texts scored at a time, and passages encoded at a time.
SLICE_BYTES, _BLOCK = 4 << 20, 1024


def encode_passages(block: bytes, starts):
    """Feature rows of the passages of ``block`` that begin at ``starts`` (ascending from 0)."""
    x = np.frombuffer(block, "u1")
    n = len(starts)
    if not len(x):
        return np.zeros((n, FEATURES), "f4")
    sizes = np.diff([*starts, len(x)])
    of = np.repeat(np.arange(n), sizes)
    total = np.maximum(sizes, 1)[:, None]
    single = np.bincount(of * 128 + np.where(x < 128, x, x & 31), minlength=n * 128).reshape(n, 128)
    pair = (x[:-1].astype("u4") * np.uint32(2654435761) + x[1:] * np.uint32(40503)) >> np.uint32(16)
    inside = of[:-1] == of[1:]
    slot = of[:-1] * PAIR_BINS + pair % PAIR_BINS
    pairs = np.bincount(slot[inside], minlength=n * PAIR_BINS).reshape(n, PAIR_BINS)
    # How much of a passage repeats: 8-byte windows, hashed to 4096 places of their passage.
    n_windows = max(len(x) - 7, 0)
    window = np.zeros(n_windows, "u4")
    with np.errstate(over="ignore"):
        for k in range(8 if n_windows else 0):
            window = window * np.uint32(16777619) ^ x[k : k + n_windows]
        place = of[:n_windows] * 4096 + ((window * np.uint32(2654435761)) >> np.uint32(20)).astype("i8")
    place = place[of[:n_windows] == of[len(x) - n_windows :]]
    distinct = np.bincount(np.flatnonzero(np.bincount(place, minlength=n * 4096)) // 4096, minlength=n)
    upper, mark = single[:, 65:91].sum(1), single[:, 33:48].sum(1)
    more = np.stack([distinct / np.maximum(total[:, 0] - 7, 1), upper / total[:, 0], mark / total[:, 0], sizes / PASSAGE_BYTES], 1)
    return np.concatenate([np.sqrt(single / total), np.sqrt(pairs / total), more], 1).astype("f4")


def passage_starts(n_bytes: int) -> list[int]:
    """Starts of a text's passages."""
    return list(range(0, max(n_bytes, 1), PASSAGE_BYTES))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    return {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "w1": w(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN), "v": w(HIDDEN, ATTENTION), "u": w(HIDDEN, ATTENTION), "a": w(ATTENTION) * 0.1, "w2": w(HIDDEN), "b2": np.zeros(1)}


def _hidden(p, x):
    h = np.tanh((x - p["mean"]) * p["scale"] @ p["w1"] + p["b1"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    return h, t, g, (t * g) @ p["a"]


def gradients(p, x, bags, y, weight):
    """Mean loss of a batch and its gradients; ``bags`` are the starts of the documents' passages."""
    h, t, g, e = _hidden(p, x)
    sizes = np.diff([*bags, len(x)])
    top = np.repeat(np.maximum.reduceat(e, bags), sizes)
    q = np.exp(e - top)
    att = q / np.repeat(np.add.reduceat(q, bags), sizes)
    z = np.add.reduceat(att[:, None] * h, bags)
    s = _sigmoid(z @ p["w2"] + p["b2"][0])
    loss = -(weight * (y * np.log(s + 1e-9) + (1 - y) * np.log(1 - s + 1e-9))).mean()
    ds = weight * (s - y) / len(y)
    dz = np.repeat(ds[:, None] * p["w2"], sizes, 0)
    datt = (dz * h).sum(1)
    de = att * (datt - np.repeat(np.add.reduceat(att * datt, bags), sizes))
    dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
    dh = (att[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
    xn = (x - p["mean"]) * p["scale"]
    return loss, {"w1": xn.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "w2": z.T @ ds, "b2": np.array([ds.sum()])}


def fit(bags: list[np.ndarray], y) -> dict[str, np.ndarray] | None:
    """Adam over shuffled batches of documents; None without both labels."""
    y = np.asarray(y, "f8")
    if len(y) == 0 or y.min() == y.max():
        return None
    p, rng = initial(), np.random.default_rng(12)
    every = np.concatenate(bags)
    p["mean"], p["scale"] = every.mean(0), 1 / (every.std(0) + 0.02)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    names = ("w1", "b1", "v", "u", "a", "w2", "b2")
    m1, m2, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH_DOCS):
            own = order[at : at + BATCH_DOCS]
            starts = np.cumsum([0] + [len(bags[i]) for i in own])[:-1]
            _, grad = gradients(p, np.concatenate([bags[i] for i in own]), starts, y[own], weight[own])
            step += 1
            for k in names:
                gk = grad[k] + 1e-4 * p[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * gk, 0.999 * m2[k] + 0.001 * gk * gk
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype("f4") for k, v in p.items()}


def score_texts(p, texts: list[str | None]):
    """Score of each text, in blocks of passages; attention is summed over blocks as it comes."""
    raw = [(t or "").encode() for t in texts]
    if p is None:
        return np.full(len(raw), 0.5)
    top, weight = np.full(len(raw), -np.inf), np.zeros(len(raw))
    z = np.zeros((len(raw), HIDDEN))

    def add(buffer, starts, docs):
        h, _, _, e = _hidden(p, encode_passages(b"".join(buffer), np.array(starts)))
        own, first = np.unique(docs, return_index=True)
        new = np.maximum(top[own], np.maximum.reduceat(e, first))
        old = np.exp(np.where(np.isinf(top[own]), -np.inf, top[own] - new))
        top[own] = new
        q = np.exp(e - top[docs])
        weight[own] = weight[own] * old + np.add.reduceat(q, first)
        z[own] = z[own] * old[:, None] + np.add.reduceat(q[:, None] * h, first)

    buffer, starts, docs, at = [], [], [], 0
    for i, t in enumerate(raw):
        for s in passage_starts(len(t)):
            part = t[s : s + PASSAGE_BYTES]
            buffer.append(part)
            starts.append(at)
            docs.append(i)
            at += len(part)
            if len(docs) == _BLOCK:
                add(buffer, starts, np.array(docs))
                buffer, starts, docs, at = [], [], [], 0
    if docs:
        add(buffer, starts, np.array(docs))
    return _sigmoid(z / weight[:, None] @ p["w2"] + p["b2"][0]).astype("f8")


def fit_sample(docs: DataFrame, known: DataFrame, label: str = "quality", fit_docs: int = FIT_DOCS):
    """Model of a bounded sample of ``docs(doc_id, text)`` labelled by ``known(doc_id, label)``, encoded by tasks."""

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                rows.append(encode_passages(raw, np.array(passage_starts(len(raw)))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "bag"])

    bags = labelled_sample(docs, known, label, fit_docs).repartition(8).mapInArrow(encode, "doc_id long, label int, bag binary")
    return fit_in_task(bags, lambda rows: fit([np.frombuffer(r["bag"], "f4").reshape(-1, FEATURES) for r in rows], [r["label"] for r in rows]))


def score(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted``; the model, of fixed size, is broadcast."""
    own = [c for c in df.columns if c not in ("score", "predicted")]
    n = len(own)

    held = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        for b, at, texts in ((b, at, texts) for b in batches for at, texts in text_slices(b.column(own.index(text_col)), SLICE_BYTES)):
            s = score_texts(held.value, texts.to_pylist())
            yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns[:n], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"))], names=[*own, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    chosen = df.select(*own)
    return chosen.mapInArrow(scored, StructType([*chosen.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: all documents, learned from labels outside fold 1 of 3."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", crc_fold(F.col("doc_id"), 3) == 1)
    known = labels(spark, sf_dir).select("doc_id", "quality")
    model = fit_sample(docs, known.filter(crc_fold(F.col("doc_id"), 3) != 1))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
