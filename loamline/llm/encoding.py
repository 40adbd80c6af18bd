"""Encoding of texts by public tokenizers inside Spark tasks.

``ChunkEncoder`` cuts the texts of an Arrow batch at places that no token can span, finds
the distinct chunks of the batch, encodes each once with the tokenizers library and lays
their ids out in the order of the texts. The ids of a text are those that the library
gives for the whole text.

For the byte-level tokenizer a chunk starts at a space between two characters that are
not white space, or at such a line break: its pattern never matches across these places,
as only white-space runs hold more than a leading space. Texts with other white space
are cut with regard to what stands around each space. For the word tokenizer, which drops
white space, every space or line break is such a place.

Defined results: a null or empty text has no ids; an empty array gives none; equal texts have equal ids.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

from loamline.llm.common import text_slices

#: Chunks longer than this are encoded each time; so many are remembered before older ones go.
_KEPT_CHARS, _KEPT_CHUNKS = 48, 200_000
#: Bytes of text that are laid out at a time.
_SLICE_BYTES = 8 << 20

_SAFE_PLACE = re.compile(r"(?<=\S)(?= \S)")
#: Chunks of one or two pretokens: Latin letters, perhaps after a space, and ASCII marks but the apostrophe.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: White space other than single spaces and line breaks between other characters (RE2).
_ODD_SPACE = "[ \\n][ \\n]|[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes texts to ids; keeps the ids of recent chunks in bounded tables.

    A new chunk of one word and marks goes to the library's model word by word, any other
    through the whole library.
    """

    def __init__(self, path: str, drops_space: bool, kept: int = _KEPT_CHUNKS):
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        self.drops_space, self.kept = drops_space, kept
        self.letters = byte_letters()
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.line_break = _packed(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids of one whole text, as little-endian unsigned 32-bit integers."""
        if self.drops_space:
            return b"".join(map(self._piece, text.replace("\n", " ").split(" ")))
        return b"".join(map(self._plain, _SAFE_PLACE.split(text)))

    def encode_batch(self, texts):
        """Ids of an Arrow array of texts: (all ids as ``<u4``, the bounds of each text's ids)."""
        import numpy as np

        parts = [self._encode_slice(x) for _, x in text_slices(texts.fill_null(""), _SLICE_BYTES)]
        before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        flat = np.concatenate([ids for ids, _ in parts] or [np.empty(0, "<u4")])
        return flat, np.concatenate([[0], *(bounds[1:] + at for (_, bounds), at in zip(parts, before, strict=False))]).astype("i8")

    def _encode_slice(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.drops_space:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            odd = []
        else:
            odd = pc.match_substring_regex(texts, _ODD_SPACE)
            plain = pc.if_else(odd, "", texts)
            cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
            odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        cut = cut.cast(pa.list_(pa.string()))
        starts = cut.offsets.to_numpy().astype("i8")
        starts -= starts[0]
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype("i8")
        chunks = list(map(self._piece, coded.dictionary.to_pylist()))
        if not self.drops_space:  # the first chunk of a text has no space before it
            heads = cut.flatten().take(pa.array(starts[:-1])).to_pylist()
            codes[starts[:-1]] = len(chunks) + np.arange(len(heads))
            chunks += map(self._plain, heads)
            for i in odd:
                chunks[codes[starts[i]]] = self.encode(texts[i].as_py())
        ids = np.frombuffer(b"".join(chunks), "<u4")
        sizes = np.fromiter(map(len, chunks), "i8", len(chunks)) // 4
        first = np.cumsum(sizes) - sizes
        size = sizes[codes]
        ends = np.cumsum(size)
        out = ids[np.repeat(first[codes] - (ends - size), size) + np.arange(ends[-1])]
        return out, np.concatenate([[0], ends])[starts]

    def _piece(self, x: str) -> bytes:
        """Ids of a chunk between spaces; with its space, or its line break, if those count."""
        ids = self.table.get(x)
        if ids is None:
            ids = self.older.get(x)
            if ids is None:
                if self.drops_space:
                    ids = self._plain(x)
                else:
                    ids = self.line_break + self._plain(x[1:]) if x[:1] == "\n" else self._plain(" " + x)
            if len(x) <= _KEPT_CHARS:
                if len(self.table) >= self.kept:
                    self.older, self.table = self.table, {}
                self.table[x] = ids
        return ids

    def _plain(self, c: str) -> bytes:
        """Ids of a chunk."""
        if not c:
            return b""
        plain = _PLAIN.fullmatch(c)
        if plain and len(c) <= _KEPT_CHARS:
            word, marks = plain.groups()
            ids = self._pretoken(word.lower() if self.drops_space else word)
            return ids + self._pretoken(marks) if marks else ids
        return _packed(self.tokenizer.encode(c, add_special_tokens=False).ids)

    def _pretoken(self, x: str) -> bytes:
        """Ids of a run of letters, perhaps after a space, or of marks."""
        ids = self.pretokens.get(x)
        if ids is None:
            if not x.isascii():
                letters = x.encode().decode("latin-1").translate(self.letters)
            else:
                letters = self.letters[32] + x[1:] if x[0] == " " else x
            if len(self.pretokens) > self.kept:
                self.pretokens.clear()
            ids = self.pretokens[x] = _packed([t.id for t in self.model.tokenize(letters)])
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def chunk_encoder(path: str, drops_space: bool = False, kept: int = _KEPT_CHUNKS) -> ChunkEncoder:
    """One encoder for each worker process and file, so that its table serves all batches."""
    return ChunkEncoder(path, drops_space, kept)
