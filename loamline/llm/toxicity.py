"""Toxicity: a bidirectional gated recurrent network over overlapping windows of words.

The input of a word is an embedding from a vocabulary and the mean of embeddings of its
character n-grams, and the embedding of its first characters, which inflected words share.
The first dimension of a word's and of a beginning's embedding starts as its smoothed log
odds of toxicity in the sample, and the first epochs choose windows by the words'. Windows of ``WINDOW`` words begin every ``STRIDE`` words until the end
of the text; two gated recurrent layers read a window from both sides, attention pools
their states and a logistic output scores it. A document has the score of its worst
window.

The network is trained in numpy on documents' labels: of a toxic document it learns from
the worst window, of another from the worst one and one more. Fitting uses a bounded
sample: at most ``FIT_DOCS`` labelled rows of the given fold by order of a hash of the id;
the vocabulary has at most ``VOCABULARY`` of its words. Of the sample, one document in
``HELD`` isn't learned from, but chooses the epoch and the bias of the output.

Defined results: a null or empty text is one empty window and has a score like any other;
rows of null or equal ids are scored one by one; without labelled rows of both kinds the
score is 0 everywhere; rows with a null label are not fitted; an empty table gives an
empty result. Other columns pass through ``score``, whose columns ``score`` and
``predicted`` replace those of an input.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import batch_words, crc_fold, documents, fit_in_task, labelled_sample, labels, text_slices

FIT_DOCS, VOCABULARY, LEAST_DOCS = 5000, 20_000, 3
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, STEM_DIM, CHAR_BINS, UNITS = 8, 8, 4, 1 << 14, 8
#: Lengths of character n-grams, and of the beginning of a word, in bytes.
GRAMS, STEM_BYTES = (3, 5), 6
EPOCHS, BATCH, RATE = 8, 128, 0.012
#: Power of the inverse shares of the labels that their losses are weighted by.
BALANCE = 0.5
#: Share of known words that a step takes for unknown ones, so that it learns from their characters.
DROPPED = 0.5
#: One in so many documents chooses the epoch and the bias; cost of a share of false alarms against one of misses.
HELD, ALARM_COST = 6, 8.0
#: Average documents that a word's log odds are smoothed by.
PRIOR = 4.0
#: Epochs before which the worst windows are found anew.
RANKED = (2, 4, 7)
#: Windows that are scored at a time, and bytes of text that are cut into words at a time.
_BLOCK, _TEXT_BYTES = 4096, 4 << 20
_MARKS = b".,;:!?\"'()[]{}<>*#$%&|-_/\\`~"


def windows(n_words: int) -> int:
    """Number of overlapping windows of a text."""
    return max(1, -(-(n_words - STRIDE) // STRIDE))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grams(words: list[bytes]):
    """(hash bins of the character n-grams of all words, where each word's begin, how many it has, bin of its beginning)."""
    if not words:
        return (np.empty(0, "i8"),) * 4
    stems = np.fromiter((zlib.crc32(w[:STEM_BYTES]) for w in words), "i8", len(words)) % CHAR_BINS
    raw = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), "u1").astype("u4")
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))
    bins, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n if n > min(GRAMS) else (left >= n) | (left == np.minimum(sizes, n)[owner]))
        h = np.full(len(at), n, "u4")
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ raw[np.minimum(at + k, len(raw) - 1)] * (k < left[at])) * np.uint32(0x01000193)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bins.append((h >> np.uint32(12)) % CHAR_BINS)
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return np.concatenate(bins)[order], np.cumsum(counts) - counts, counts, stems


class Vocabulary:
    """Numbers of known words, 0 for others."""

    def __init__(self, words: list[bytes]):
        self.numbers = {w: i + 1 for i, w in enumerate(words)}

    def of(self, words: list[bytes]):
        return np.fromiter((self.numbers.get(w, 0) for w in words), "i8", len(words))


def _grams_of(grams, rows):
    """The n-grams of some of the words."""
    bins, first, counts, stems = grams
    n = counts[rows]
    ends = np.cumsum(n)
    return bins[np.repeat(first[rows] - (ends - n), n) + np.arange(n.sum())], ends - n, n, stems[rows]


def _inputs(p, known, grams):
    """Input rows of distinct words, with a row of zeros for padding at the end."""
    out = np.zeros((len(known) + 1, WORD_DIM + CHAR_DIM + STEM_DIM), p["ew"].dtype)
    if len(known):
        bins, first, counts, stems = grams
        out[:-1, :WORD_DIM] = p["ew"][known]
        out[:-1, WORD_DIM + CHAR_DIM :] = p["es"][stems]
        out[:-1, WORD_DIM : WORD_DIM + CHAR_DIM] = np.add.reduceat(p["ec"][bins], first) / counts[:, None]
    return out


def _read(x, mask, u, back: bool):
    """States of one direction for projected inputs (T, N, 3 * UNITS), and what its gradient needs."""
    steps = range(len(x))[::-1] if back else range(len(x))
    h, states, cache = np.zeros((x.shape[1], UNITS), x.dtype), np.empty((len(x), x.shape[1], UNITS), x.dtype), {}
    for t in steps:
        hu = h @ u
        gates = _sigmoid(x[t, :, : 2 * UNITS] + hu[:, : 2 * UNITS])
        r, z = gates[:, :UNITS], gates[:, UNITS:]
        n = np.tanh(x[t, :, 2 * UNITS :] + r * hu[:, 2 * UNITS :])
        cache[t] = (h, hu[:, 2 * UNITS :], r, z, n)
        h = h + mask[t] * ((1 - z) * (n - h))
        states[t] = h
    return states, cache


def _read_back(dstates, x, mask, u, cache, back: bool):
    """Gradients of the projected inputs and of ``u``."""
    steps = range(len(x)) if back else range(len(x))[::-1]
    dh, dx, du = 0.0, np.zeros_like(x), np.zeros_like(u)
    for t in steps:
        h, hn, r, z, n = cache[t]
        dh = dh + dstates[t]
        dn = dh * mask[t] * (1 - z) * (1 - n * n)
        dz = dh * mask[t] * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx[t] = np.concatenate([dr, dz, dn], 1)
        dhu = np.concatenate([dr, dz, dn * r], 1)
        du += h.T @ dhu
        dh = dh * (1 - mask[t] * (1 - z)) + dhu @ u.T
    return dx, du


def forward(p, projected, index, mask):
    """Logits of windows; ``projected`` has rows of both directions for each distinct word."""
    x = projected[index.T]
    m = mask.T[:, :, None].astype(x.dtype)
    f, cf = _read(x[:, :, : 3 * UNITS], m, p["uf"], False)
    b, cb = _read(x[:, :, 3 * UNITS :], m, p["ub"], True)
    s = np.concatenate([f, b], 2)
    k = np.tanh(s @ p["wa"] + p["ba"])
    e = np.where(m[:, :, 0] > 0, k @ p["va"], -1e9)
    q = np.exp(e - e.max(0)) * m[:, :, 0]
    att = q / np.maximum(q.sum(0), 1e-9)
    pooled = (att[:, :, None] * s).sum(0)
    return pooled @ p["wo"] + p["bo"][0], (x, m, cf, cb, s, k, att, pooled)


def gradients(p, words_in, known, bins, index, mask, y, weight):
    """Mean loss and gradients of every parameter for a batch of windows."""
    w = np.concatenate([p["wf"], p["wb"]], 1)
    logits, (x, m, cf, cb, s, k, att, pooled) = forward(p, words_in @ w + np.concatenate([p["bf"], p["bb"]]), index, mask)
    prob = _sigmoid(logits)
    loss = -(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean()
    dl = weight * (prob - y) / len(y)
    g = {"wo": pooled.T @ dl, "bo": np.array([dl.sum()])}
    dpool = dl[:, None] * p["wo"]
    datt = (s * dpool).sum(2)
    de = att * (datt - (att * datt).sum(0))
    g["va"] = (k * de[:, :, None]).sum((0, 1))
    dk = de[:, :, None] * p["va"] * (1 - k * k)
    g["wa"], g["ba"] = np.tensordot(s, dk, ((0, 1), (0, 1))), dk.sum((0, 1))
    ds = att[:, :, None] * dpool + dk @ p["wa"].T
    dxf, g["uf"] = _read_back(ds[:, :, :UNITS], x[:, :, : 3 * UNITS], m, p["uf"], cf, False)
    dxb, g["ub"] = _read_back(ds[:, :, UNITS:], x[:, :, 3 * UNITS :], m, p["ub"], cb, True)
    dproj = np.zeros((len(words_in), 6 * UNITS))
    np.add.at(dproj, index.T, np.concatenate([dxf, dxb], 2))
    dw, db, din = words_in.T @ dproj, dproj.sum(0), dproj @ w.T
    g |= {"wf": dw[:, : 3 * UNITS], "wb": dw[:, 3 * UNITS :], "bf": db[: 3 * UNITS], "bb": db[3 * UNITS :]}
    g["ew"], g["ec"], g["es"] = np.zeros_like(p["ew"]), np.zeros_like(p["ec"]), np.zeros_like(p["es"])
    np.add.at(g["ew"], known, din[:-1, :WORD_DIM])
    if len(bins[0]):
        np.add.at(g["ec"], bins[0], np.repeat(din[:-1, WORD_DIM : WORD_DIM + CHAR_DIM] / bins[2][:, None], bins[2], 0))
        np.add.at(g["es"], bins[3], din[:-1, WORD_DIM + CHAR_DIM :])
    g["ew"][0] = 0
    return loss, g


def initial(n_words: int, odds, stem_odds=0.0) -> dict[str, np.ndarray]:
    """Random parameters; the first dimension of a word and of a beginning is its smoothed log odds in the sample."""
    rng = np.random.default_rng(21)
    w = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    d = WORD_DIM + CHAR_DIM + STEM_DIM
    p = {"ew": rng.normal(0, 0.05, (n_words + 1, WORD_DIM)), "ec": rng.normal(0, 0.1, (CHAR_BINS, CHAR_DIM)), "es": rng.normal(0, 0.05, (CHAR_BINS, STEM_DIM)), "wf": w(d, 3 * UNITS), "wb": w(d, 3 * UNITS), "bf": np.zeros(3 * UNITS), "bb": np.zeros(3 * UNITS), "uf": w(UNITS, 3 * UNITS), "ub": w(UNITS, 3 * UNITS), "wa": w(2 * UNITS, UNITS), "ba": np.zeros(UNITS), "va": w(UNITS), "wo": w(2 * UNITS), "bo": np.zeros(1)}
    p["ew"][0] = 0
    p["ew"][1:, 0] = odds
    p["es"][:, 0] = stem_odds
    return p


def _cut(texts):
    """Words of texts without marks around them: (distinct words, codes, bounds)."""
    words, codes, bounds = batch_words(texts)
    return [w.strip(_MARKS) for w in words], codes, bounds


def _window_index(codes, bounds, pad: int):
    """(word rows, mask, document) of every window of every text."""
    sizes = np.diff(bounds)
    n = np.maximum(1, -(-(sizes - STRIDE) // STRIDE))
    doc = np.repeat(np.arange(len(n)), n)
    start = bounds[:-1][doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    at = start[:, None] + np.arange(WINDOW)
    mask = at < bounds[1:][doc][:, None]
    return np.where(mask, codes[np.minimum(at, len(codes) - 1)] if len(codes) else pad, pad), mask, doc


def _odds(docs, toxic, share):
    """Log odds of toxicity of documents with a word against those of all, as if ``PRIOR`` average documents had it too."""
    return np.log((toxic + PRIOR * share) / (docs - toxic + PRIOR * (1 - share))) - np.log(share / (1 - share))


def fit(texts: list[str | None], y):
    """(parameters, vocabulary) from whole texts and their labels; None without both labels."""
    import pyarrow as pa

    y = np.asarray(y, "f8")
    if len(y) == 0 or y.min() == y.max():
        return None
    words, codes, bounds = _cut(pa.array(texts, pa.string()))
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    same, merged = np.unique(np.array(words, object), return_inverse=True) if words else (np.array([], object), np.empty(0, "i8"))
    codes = merged[codes] if len(codes) else codes
    present = np.unique(doc * len(same) + codes)
    in_doc = np.bincount(present % max(len(same), 1), minlength=len(same))
    toxic = np.bincount(present % max(len(same), 1), y[present // max(len(same), 1)], len(same))
    chosen = np.flatnonzero(in_doc >= LEAST_DOCS)
    chosen = np.sort(chosen[np.lexsort((chosen, -in_doc[chosen]))][:VOCABULARY])
    share = y.mean()
    odds = _odds(in_doc[chosen], toxic[chosen], share)
    vocabulary, every_gram = Vocabulary([same[i] for i in chosen]), _grams(list(same))
    held = np.unique(present // max(len(same), 1) * CHAR_BINS + every_gram[3][present % max(len(same), 1)]) if len(present) else present
    of_stem, toxic_stem = np.bincount(held % CHAR_BINS, minlength=CHAR_BINS), np.bincount(held % CHAR_BINS, y[held // CHAR_BINS], CHAR_BINS)
    stem_odds = _odds(of_stem, toxic_stem, share)
    p = initial(len(chosen), odds, stem_odds)
    every = np.append(stem_odds[every_gram[3]], 0.0)
    every[chosen] = np.maximum(every[chosen], odds)
    index, mask, of = _window_index(codes, bounds, len(same))
    known = vocabulary.of(list(same))
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    rng, weight = np.random.default_rng(22), np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** BALANCE
    badness = every[index].max(1)
    m1, m2, step, best = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0, None
    # Each HELD-th document of either label isn't learned from, but chooses the epoch and the bias.
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[HELD - 1 :: HELD]] = True
    checked = np.flatnonzero(held[of])
    for epoch in range(EPOCHS):
        if epoch in RANKED:
            q = _single(p)
            projected = _projected(q, known, every_gram)
            badness = np.concatenate([_logits(q, projected, index[a : a + _BLOCK], mask[a : a + _BLOCK]) for a in range(0, len(index), _BLOCK)])
        order = np.lexsort((-badness, of))
        worst = order[first]
        other = first + (rng.random(len(first)) * np.diff([*first, len(of)])).astype("i8")
        picked = np.concatenate([worst[~held], other[(y == 0) & ~held]])
        picked = picked[rng.permutation(len(picked))]
        for a in range(0, len(picked), BATCH):
            own = picked[a : a + BATCH]
            rows, back = np.unique(np.concatenate([index[own].ravel(), [len(same)]]), return_inverse=True)
            seen = np.where(rng.random(len(rows) - 1) < DROPPED, 0, known[rows[:-1]])
            grams = _grams_of(every_gram, rows[:-1])
            _, g = gradients(p, _inputs(p, seen, grams), seen, grams, back[:-1].reshape(len(own), WINDOW), mask[own], y[of[own]], weight[of[own]])
            step += 1
            for k, gk in g.items():
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * gk, 0.999 * m2[k] + 0.001 * gk * gk
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        if len(checked):
            q = _single(p)
            projected = _projected(q, known, every_gram)
            top = np.full(len(y), -np.inf)
            for a in range(0, len(checked), _BLOCK):
                own = checked[a : a + _BLOCK]
                np.maximum.at(top, of[own], _logits(q, projected, index[own], mask[own]))
            value, bound = _bound(top[held], y[held])
            if epoch >= RANKED[0] and (best is None or value > best[0]):
                best = (value, bound, q)
    if best is None:
        return _single(p), vocabulary
    return best[2] | {"bo": best[2]["bo"] - np.float32(best[1])}, vocabulary


def _bound(logits, y):
    """(value, bound): the bound between logits that finds most toxic documents, less ``ALARM_COST`` times the share of false alarms."""
    order = np.argsort(logits, kind="stable")
    s, t = logits[order], y[order]
    missed, alarms = np.concatenate([[0], np.cumsum(t)]), (t == 0).sum() - np.concatenate([[0], np.cumsum(t == 0)])
    value = 1 - missed / max(1, t.sum()) - ALARM_COST * alarms / max(1, (t == 0).sum())
    k = int(np.argmax(value))
    if k == 0 or k == len(s):
        return float(value[k]), float(s[0] - 1 if k == 0 else s[-1] + 1)
    return float(value[k]), float((s[k - 1] + s[k]) / 2)


def _single(p):
    return {k: v.astype("f4") for k, v in p.items()}


def _projected(p, known, grams):
    return _inputs(p, known, grams) @ np.concatenate([p["wf"], p["wb"]], 1) + np.concatenate([p["bf"], p["bb"]])


def _logits(p, projected, index, mask):
    return forward(p, projected, index, mask)[0]


def score_texts(model, texts):
    """Score of each text of an Arrow array: that of its worst window."""
    out = np.zeros(len(texts))
    if model is None or len(texts) == 0:
        return out
    p, vocabulary = model
    for lo, part in text_slices(texts, _TEXT_BYTES):
        hi = lo + len(part)
        words, codes, bounds = _cut(part)
        projected = _projected(p, vocabulary.of(words), _grams(words))
        index, mask, doc = _window_index(codes, bounds, len(words))
        top = np.full(hi - lo, -np.inf)
        for a in range(0, len(index), _BLOCK):
            np.maximum.at(top, doc[a : a + _BLOCK], _logits(p, projected, index[a : a + _BLOCK], mask[a : a + _BLOCK]))
        out[lo:hi] = _sigmoid(top)
    return out


def fit_sample(docs: DataFrame, known: DataFrame, label: str = "toxic", fit_docs: int = FIT_DOCS):
    """Model of a bounded sample of ``docs(doc_id, text)`` labelled by ``known(doc_id, label)``, fitted in one task."""
    return fit_in_task(labelled_sample(docs, known, label, fit_docs), lambda rows: fit([r["text"] for r in rows], [r["label"] for r in rows]))


def score(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted``; the model, of fixed size, is broadcast."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    chosen = df.select(*[c for c in df.columns if c not in ("score", "predicted")])
    own = chosen.columns

    held = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            s = score_texts(held.value, b.column(own.index(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"))], names=[*own, "score", "predicted"])

    return chosen.mapInArrow(scored, StructType([*chosen.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: all documents, learned from labels outside fold 0 of 5."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", crc_fold(F.col("doc_id"), 5) == 0)
    known = labels(spark, sf_dir).select("doc_id", "toxic")
    model = fit_sample(docs, known.filter(crc_fold(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
