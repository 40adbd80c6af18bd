"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Spark counts and the result lies in sorted arrays in the shared folder, which workers map
into memory:

1. Words. Tasks count the distinct word hashes of each batch and send them, sorted and
   packed, to slots of the hash range. A slot's task merges them and writes the sorted
   hashes and counts; a word's place over all slots is its number.
2. Bigrams. Tasks look the numbers up, count the distinct pairs of each batch and send
   them to shards: ranges of the first word, except that a word with more than
   ``SHARD_TOKENS`` tokens has shards of its own, dealt by the second word. A shard's
   task writes sorted pair keys with counts, and for each first word its total and how
   many of its pairs stand once, twice or more often.
3. Continuations. In how many distinct pairs each word is second, merged by slot.

Slots and shards grow in number with the input, so what one task holds doesn't. The driver
gets one row for each slot and shard, and the words that have shards of their own, of
which there are fewer than shards.

Defined results: a null or empty text is one end token; no training rows give a model in
which each token has probability 1 / (V + 1); null and equal ids, and equal rows, are
scored one by one; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import batch_words, crc_fold, discard, documents, hash_words, local_path, materialize, replace_file, shared_dir, text_slices

#: Bytes of text for one slot of words, tokens for one shard of bigrams.
SLOT_BYTES, SHARD_TOKENS = 32 << 20, 2_000_000
#: Bytes of text that are counted or scored at a time.
SLICE_BYTES = 6 << 20
#: Arrays that a process keeps mapped.
MAPS = 4096
_END = b"\n"
_BLOB = "slot int, n long, keys binary, counts binary"


def _pack(values, width: str) -> bytes:
    """Sorted or small numbers as compressed byte planes."""
    import zstandard

    raw = np.ascontiguousarray(values, width)
    return zstandard.ZstdCompressor(level=1).compress(raw.view("u1").reshape(len(raw), -1).T.tobytes())


def _unpack(raw: bytes, n: int, width: str):
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1")
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(width).ravel()


def _pack_sorted(keys) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _unpack_sorted(raw: bytes, n: int):
    return np.cumsum(_unpack(raw, n, "<u8"), dtype="u8")


def _blobs(slots, keys, counts):
    """An Arrow batch with a row for each slot; keys are sorted within their slots."""
    import pyarrow as pa

    order = np.lexsort((keys, slots))
    slots, keys, counts = slots[order], keys[order], counts[order]
    own, first = np.unique(slots, return_index=True)
    ends = [*first[1:], len(slots)]
    rows = [(int(s), int(b - a), _pack_sorted(keys[a:b]), _pack(counts[a:b], "<u8")) for s, a, b in zip(own, first, ends, strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["slot", "n", "keys", "counts"])


def _merge(pdf):
    """Sorted distinct keys of several blobs, and their summed counts."""
    keys = np.concatenate([_unpack_sorted(k, n) for k, n in zip(pdf["keys"], pdf["n"], strict=True)])
    counts = np.concatenate([_unpack(c, n, "<u8") for c, n in zip(pdf["counts"], pdf["n"], strict=True)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _tokens(texts):
    """(distinct token hashes, code of each token, bounds): each text's words and the end token."""
    words, codes, bounds = batch_words(texts)
    codes = np.insert(codes, bounds[1:], len(words))
    return hash_words([*words, _END]), codes, bounds + np.arange(len(bounds))


@lru_cache(maxsize=MAPS)
def _array(path: str, kind: str, n: int, skip: int = 0):
    """An array of a file, mapped by this process."""
    return np.memmap(path, kind, "r", skip, (n,)) if n else np.empty(0, kind)


def _slots(hashes, bits: int):
    return (hashes >> np.uint64(64 - bits)).astype("i8") if bits else np.zeros(len(hashes), "i8")


class Words:
    """Numbers and counts of words, from the slots' sorted hashes."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes, self.bits = folder, sizes, len(sizes).bit_length() - 1
        self.offsets = np.concatenate([[0], np.cumsum(sizes, dtype="i8")])
        self.total = int(self.offsets[-1])

    def slots(self, hashes):
        return _slots(hashes, self.bits)

    def numbers(self, hashes):
        """Number of each hash, -1 for unknown ones, and its count."""
        number, count = np.full(len(hashes), -1, "i8"), np.zeros(len(hashes), "i8")
        order = np.argsort(hashes)
        slots = self.slots(hashes[order])
        for s in np.unique(slots).tolist():
            n = self.sizes[s]
            if n:
                at = order[np.searchsorted(slots, s) : np.searchsorted(slots, s, "right")]
                keys = _array(f"{self.folder}/words-{s:06d}", "<u8", n)
                place = np.minimum(np.searchsorted(keys, hashes[at]), n - 1)
                hit = keys[place] == hashes[at]
                number[at[hit]] = self.offsets[s] + place[hit]
                count[at[hit]] = _array(f"{self.folder}/words-{s:06d}", "<u8", n, 8 * n)[place[hit]]
        return number, count


class Shards:
    """Which shard holds a pair: ranges of the first word, and shards of frequent first words."""

    def __init__(self, n_words: int, n_ranges: int, hot: dict[int, int]):
        self.n_words, self.n_ranges = n_words, n_ranges
        self.hot = np.array(sorted(hot), "i8")
        self.parts = np.array([hot[h] for h in sorted(hot)], "i8")
        self.first = n_ranges + np.cumsum(self.parts) - self.parts
        self.total = n_ranges + int(self.parts.sum())

    def low(self, shard: int) -> int:
        """The smallest first word of a range; n_words stands for the start of a text."""
        return -(-shard * (self.n_words + 1) // self.n_ranges)

    def of(self, first, second):
        out = first * self.n_ranges // (self.n_words + 1)
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            own = self.hot[k] == first
            out[own] = self.first[k[own]] + second[own] % self.parts[k[own]]
        return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 0, 1, 2 and more; fixed ones where the counts of counts don't give each between 0 and its count.

    A discount of 0 would leave no probability for what hasn't been seen.
    """
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        found = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return [0.0, *found]
    return [0.0, 0.5, 1.0, 1.5]


def _classes(counts, most: int) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, most + 1)]


class Model:
    """A trained model: where its arrays lie and the few numbers that go with them."""

    def __init__(self, folder, word_sizes, tokens, shards, shard_sizes, hot_stats, pairs, d_pair, d_word, word_rest):
        self.folder, self.word_sizes, self.tokens, self.shards, self.shard_sizes = folder, word_sizes, tokens, shards, shard_sizes
        self.hot_stats, self.pairs, self.d_pair, self.d_word, self.word_rest = hot_stats, pairs, d_pair, d_word, word_rest

    def score_batch(self, texts):
        """(n_tokens, n_known, base_score, score) of each text."""
        words = Words(self.folder, self.word_sizes)
        hashes, codes, bounds = _tokens(texts)
        number, count = words.numbers(hashes)
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (words.total + 1)))
        unigram = self._unigram(words, number)
        w = number[codes]
        h = np.concatenate([[words.total], w[:-1]])
        h[bounds[:-1]] = words.total
        p = self._bigram(h, w, unigram[codes])
        sums = lambda x: np.add.reduceat(x, bounds[:-1])
        return np.diff(bounds), sums((w >= 0).astype("i8")), sums(base[codes]), sums(np.log10(p))

    def _unigram(self, words: Words, number):
        """Continuation probability of each word, interpolated with the uniform one."""
        uniform = 1.0 / (words.total + 1)
        if not self.pairs:
            return np.full(len(number), uniform)
        n = np.zeros(len(number), "i8")
        order = np.argsort(number)
        slots = np.searchsorted(words.offsets, number[order], "right") - 1
        for s in np.unique(slots[slots >= 0]).tolist():
            at = order[slots == s]
            n[at] = _array(f"{self.folder}/continuations-{s:06d}", "<u8", self.word_sizes[s])[number[at] - words.offsets[s]]
        return np.maximum(n - np.array(self.d_word)[np.minimum(n, 3)], 0) / self.pairs + self.word_rest * uniform

    def _bigram(self, h, w, unigram):
        key, back = np.unique((h.astype("u8") << np.uint64(32)) | (w & 0xFFFFFFFF).astype("u8"), return_inverse=True)
        first, second = (key >> np.uint64(32)).astype("i8"), (key & np.uint64(0xFFFFFFFF)).astype("i8")
        known = first <= self.shards.n_words  # an unknown first word is 2^32 - 1 here
        own, rest = np.zeros(len(key)), np.ones(len(key))
        at = np.flatnonzero(known)
        shard = self.shards.of(first[at], second[at])
        order = np.argsort(shard, kind="stable")
        at, shard = at[order], shard[order]
        d = np.array(self.d_pair)
        for s in np.unique(shard).tolist():
            i = at[np.searchsorted(shard, s) : np.searchsorted(shard, s, "right")]
            n = self.shard_sizes.get(s, 0)
            if not n and s < self.shards.n_ranges:
                continue
            name, c = f"{self.folder}/pairs-{s:06d}", np.zeros(len(i), "i8")
            if n:
                keys = _array(name, "<u8", n)
                place = np.minimum(np.searchsorted(keys, key[i]), n - 1)
                c = np.where(keys[place] == key[i], _array(name, "<u4", n, 8 * n)[place], 0).astype("i8")
            if s < self.shards.n_ranges:
                low = self.shards.low(s)
                m = self.shards.low(s + 1) - low
                total, *kinds = (_array(name, "<u4", m, 12 * n + 4 * m * k)[first[i] - low].astype("f8") for k in range(4))
            else:  # an empty shard's pairs have the totals of their word all the same
                total, *kinds = (np.full(len(i), float(x)) for x in self.hot_stats.get(int(first[i[0]]), [0] * 4))
            seen = total > 0
            size = np.where(seen, total, 1)
            own[i] = np.maximum(c - d[np.minimum(c, 3)], 0) / size
            rest[i] = np.where(seen, sum(d[k + 1] * kinds[k] for k in range(3)) / size, 1.0)
        return own[back] + rest[back] * unigram


def train(df: DataFrame, uri: str, slot_bytes: int = SLOT_BYTES, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count ``df(text)`` and write the arrays of its model below ``uri``."""
    folder = local_path(uri)
    texts = df.select("text")
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (n_bytes // slot_bytes)).bit_length()

    def count_words(batches):
        for b in batches:
            for _, part in text_slices(b.column(0), SLICE_BYTES):
                hashes, codes, _ = _tokens(part)
                counts = np.bincount(codes, minlength=len(hashes))
                yield _blobs(_slots(hashes, bits), hashes, counts.astype("u8"))

    def write_words(pdf):
        import pandas as pd

        slot = int(pdf["slot"].iloc[0])
        keys, counts = _merge(pdf)
        replace_file(f"{folder}/words-{slot:06d}", [keys.tobytes(), counts.tobytes()])
        often = np.flatnonzero(counts > shard_tokens)
        return pd.DataFrame({"slot": [slot], "n": [len(keys)], "tokens": [int(counts.sum())], "places": [often.tolist()], "often": [counts[often].astype("i8").tolist()]})

    done = texts.mapInArrow(count_words, _BLOB).groupBy("slot").applyInPandas(write_words, "slot int, n long, tokens long, places array<long>, often array<long>").collect()
    sizes = [0] * (1 << bits)
    for r in done:
        sizes[r.slot] = r.n
    words, tokens = Words(folder, sizes), sum(r.tokens for r in done)
    if words.total >= 2**32 - 1:
        raise ValueError("numbers of words no longer fit in 32 bits")
    parts = {int(words.offsets[r.slot]) + p: -(-c // shard_tokens) for r in done for p, c in zip(r.places, r.often, strict=True)}
    shards = Shards(words.total, max(1, -(-tokens // shard_tokens)), parts)
    # Tables with an entry for each file are broadcast once, not sent with every task.
    held = df.sparkSession.sparkContext.broadcast((words, shards))

    def count_pairs(batches):
        words, shards = held.value
        for b in batches:
            for _, part in text_slices(b.column(0), SLICE_BYTES):
                hashes, codes, bounds = _tokens(part)
                w = words.numbers(hashes)[0][codes]
                h = np.concatenate([[words.total], w[:-1]])
                h[bounds[:-1]] = words.total
                keys, counts = np.unique((h.astype("u8") << np.uint64(32)) | w.astype("u8"), return_counts=True)
                yield _blobs(shards.of((keys >> np.uint64(32)).astype("i8"), (keys & np.uint64(0xFFFFFFFF)).astype("i8")), keys, counts.astype("u8"))

    def write_pairs(pdf):
        import pandas as pd

        words, shards = held.value
        shard = int(pdf["slot"].iloc[0])
        keys, counts = _merge(pdf)
        first, second = (keys >> np.uint64(32)).astype("i8"), keys & np.uint64(0xFFFFFFFF)
        low = shards.low(shard) if shard < shards.n_ranges else int(first[0])
        m = shards.low(shard + 1) - low if shard < shards.n_ranges else 1
        stats = [np.bincount(first - low, x, m).astype("u4") for x in (counts.astype("f8"), counts == 1, counts == 2, counts > 2)]
        replace_file(f"{folder}/pairs-{shard:06d}", [keys.tobytes(), counts.astype("<u4").tobytes(), *(s.tobytes() for s in stats)])
        own, n = np.unique(second, return_counts=True)
        slots = np.searchsorted(words.offsets, own.astype("i8"), "right") - 1
        out = _blobs(slots, own, n.astype("u8")).to_pandas()
        kinds = [len(keys), *_classes(counts, 4), *([int(s[0]) for s in stats] if shard >= shards.n_ranges else [-1] * 4), low]
        return out.assign(shard=shard, stats=[kinds] + [None] * (len(out) - 1))

    pairs = materialize(texts.mapInArrow(count_pairs, _BLOB).groupBy("slot").applyInPandas(write_pairs, _BLOB + ", shard int, stats array<long>"), "continuations")
    rows = pairs.filter("stats IS NOT NULL").select("shard", "stats").collect()
    hot: dict[int, list[int]] = {}
    for r in rows:
        if r.shard >= shards.n_ranges:
            hot[r.stats[9]] = [x + y for x, y in zip(hot.get(r.stats[9], [0] * 4), r.stats[5:9], strict=True)]

    def write_continuations(pdf):
        import pandas as pd

        words, slot = held.value[0], int(pdf["slot"].iloc[0])
        keys, counts = _merge(pdf)
        whole = np.zeros(words.sizes[slot], "<u8")
        whole[keys.astype("i8") - int(words.offsets[slot])] = counts
        replace_file(f"{folder}/continuations-{slot:06d}", [whole.tobytes()])
        return pd.DataFrame({"kinds": [[*_classes(counts, 4), int((counts > 2).sum())]]})

    kinds = [r.kinds for r in pairs.select("slot", "n", "keys", "counts").groupBy("slot").applyInPandas(write_continuations, "kinds array<long>").collect()]
    discard(pairs)
    n1, n2, n3, n4, more = (sum(k[i] for k in kinds) for i in range(5))
    d_word = discounts(n1, n2, n3, n4)
    n_pairs = sum(r.stats[0] for r in rows)
    rest = (d_word[1] * n1 + d_word[2] * n2 + d_word[3] * more) / n_pairs if n_pairs else 1.0
    d_pair = discounts(*(sum(r.stats[k] for r in rows) for k in range(1, 5)))
    return Model(folder, sizes, tokens, shards, {r.shard: r.stats[0] for r in rows}, hot, n_pairs, d_pair, d_word, rest)


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of ``df(doc_id, held_out, text)``."""

    held = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            for at, part in text_slices(b.column(2), SLICE_BYTES):
                n, known, base, own = held.value.score_batch(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), b.column(1).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Query: all documents under the model of those outside fold 0 of 10."""
    docs = documents(spark, sf_dir).withColumn("held_out", crc_fold(F.col("doc_id"), 10) == 0)
    model = train(docs.filter(~F.col("held_out")), shared_dir(spark, "kneser-ney"))
    scored = score(docs, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
