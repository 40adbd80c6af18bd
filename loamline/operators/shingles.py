"""Words and word shingles of texts, as array expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.arrays import bind


def words(text: Column) -> Column:
    """Words between ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def shingles(text: Column, width: int) -> Column:
    """Distinct runs of ``width`` words joined by one space; fewer words are one run, no words are none."""

    def of(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))
        runs = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, width), " ")))
        return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<string>"))

    return bind(words(text), of)


def shingle_hashes(text: Column, width: int) -> Column:
    """Distinct 64-bit hashes of the shingles; a text without words is one shingle, the empty one."""

    def of(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " "))))

    return bind(words(text), of)


#: Words whose hashes a task remembers, and bytes of hashes that it gives out at once.
WORDS_KEPT, SLICE_BYTES = 1_000_000, 8_000_000


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _hashed(words: list[bytes], width: int, known: _WordHashes):
    """Distinct hashes of the runs of ``width`` words, smallest first; fewer words are one run."""
    import numpy as np

    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - width + 1, 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        h = (h + w[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    h = np.sort(h.view(np.int64))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def hashed_sets(docs: DataFrame, width: int, early=None) -> DataFrame:
    """``docs(..., text)`` with digest, n and s instead of text: the text's words, and its distinct shingles' number and hashes.

    Hashes stand in order of size, the first ``early(n)`` of them if that is given. A text
    without words has no digest and no shingles. Texts are hashed where they are read.
    """
    kept = [c for c in docs.columns if c != "text"]
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        known, names = _WordHashes(), [*kept, "digest", "n", "s"]
        for b in batches:
            texts, start, digests, sizes, sets, held = b.column(len(kept)), 0, [], [], [], 0
            for k, text in enumerate(texts):
                # Bytes are split at the same white space as words are: tab to carriage return, and space.
                words = (text.as_py() or b"").split()
                s = _hashed(words, width, known) if words else np.empty(0, np.int64)
                digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                sizes.append(len(s))
                sets.append(s[: early(len(s))] if early else s)
                held += sets[-1].nbytes
                if held >= SLICE_BYTES or k + 1 == len(texts):
                    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                    own = [b.column(i).slice(start, len(sets)) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), listed], names=names)
                    start, digests, sizes, sets, held = k + 1, [], [], [], 0

    return docs.select(*kept, F.col("text").cast("binary").alias("text")).mapInArrow(hashed, ", ".join([*kinds, "digest binary", "n long", "s array<long>"]))
