"""Token ids of whole texts by a public tokenizer with word ends, at the speed of a word cache.

The tokenizer drops white space and never joins across it, so the ids of a text are the ids of its
white-space-separated chunks in order. Arrow splits the texts and finds the distinct chunks of a
slice; each Python worker keeps the ids of the chunks it has seen (up to MAX_CACHED, then it starts
anew) and runs the tokenizer's own model only for new ones. Texts whose chunks aren't independent (strings of
special tokens, control characters that Arrow and the tokenizer split differently) go to the tokenizer whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MAX_CACHED = 200_000
#: ASCII signs between a letter or digit and white space are a pre-token of their own whatever stands around them.
LAST_SIGNS, APART = r"([\pL\pN])([!-/:-@\[-`{-~]+)(\s|\z)", r"\1 \2\3"

_cache: dict[str, "WordTokenizer"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a visible letter: itself where it is visible, else 256 and up in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """`path`: a tokenizers file: BPE, normalizer NFC + white space + lower case, a Split pattern, byte letters, no dropout."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(self.tok.to_str())
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] + [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError(f"not a tokenizer of this kind: {kinds}")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.letters = _byte_letters()
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=self.dtype)
        self.bounds = np.zeros(1 << 14, dtype=np.int32)  # chunk i has the ids from bounds[i] to bounds[i + 1]

    def encode_whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: str) -> list[int]:
        if chunk.isascii() and chunk.isalpha():
            return [t.id for t in self.model.tokenize(chunk.lower())]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
            if chunk.isalpha():  # letters only, one piece
                return [t.id for t in self.model.tokenize(chunk.lower().encode().decode("latin-1").translate(self.letters))] if chunk.lower().isalpha() else self._pieces(chunk)
        return self._pieces(chunk)

    def _pieces(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(chunk.lower()):
            out += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return out

    def _learn(self, chunks: list[str]) -> None:
        ids = [self._chunk(c) for c in chunks]
        lens = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        total, n = int(lens.sum()), len(self.index)
        used = int(self.bounds[n])
        while used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(chunks) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[used : used + total] = np.fromiter((i for x in ids for i in x), dtype=self.dtype, count=total)
        self.bounds[n + 1 : n + 1 + len(chunks)] = used + np.cumsum(lens)
        self.index.update(zip(chunks, range(n, n + len(chunks))))

    def encode_many(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after the other, and the number of ids of each text; without ids only the numbers."""
        if len(self.index) > MAX_CACHED:
            self._reset()
        texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
        odd = np.zeros(len(texts), dtype=bool)
        for s in [*self.special, *map(chr, range(0x1C, 0x20))]:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar(""), texts) if odd.any() else texts
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, LAST_SIGNS, APART))
        per_text = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        index = self.index
        if new := [c for c in chunks if c not in index]:
            self._learn(new)
        place = np.fromiter(map(index.__getitem__, chunks), dtype=np.int32, count=len(chunks))
        which = place[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else place
        ends = np.concatenate([[0], np.cumsum(np.diff(self.bounds)[which], dtype=np.int64)])
        counts = np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])
        if ids:
            known = pa.ListArray.from_arrays(pa.array(self.bounds[: len(index) + 1]), pa.array(self.flat))
            flat = known.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False)
        else:
            flat = self.flat[:0]
        if odd.any():
            cuts = np.concatenate([[0], np.cumsum(counts)])
            parts = [flat[cuts[k] : cuts[k + 1]] for k in range(len(texts))] if ids else []
            for k in np.flatnonzero(odd):
                own = np.array(self.encode_whole(texts[k].as_py()), dtype=self.dtype)
                counts[k] = len(own)
                if ids:
                    parts[k] = own
            flat = np.concatenate(parts) if ids else flat
        return flat, counts


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and path."""
    if path not in _cache:
        _cache[path] = WordTokenizer(path)
    return _cache[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
