"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once.

A tokenizer that splits at white space gives the same ids whether it sees a text or
its words, so a slice of texts is cut into words, the distinct words go through the
library, and the ids are laid out by array lookups.  Texts in which white space
follows white space are encoded whole where that could differ.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from famloom.llm.common import release_memory

#: Spark runs a task per core, so the library must not start threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_DOUBLE_SPACE = re.compile(r"\s\s")
_SUSPECT = (
    r"[\s\x0b\x1c-\x1f]{2}|\x00"
    r"|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Where a full stop or comma before white space may belong to a longer run of signs;
#: ``{}`` takes the letters that the tokenizer's normalizer turns into letter and mark.
_SIGNS = r"(?:[^\pL\pN]{})[.,][ \n]"
#: Distinct words kept per Python worker; beyond it those that were used once go.
CACHED_WORDS = 600_000
#: Text bytes cut into words at a time.
WORD_SLICE = 4 << 20
#: Words given to the library at a time; its results are large objects.
_BATCH = 16_384
_ENCODERS: dict[str, WordEncoder] = {}


def _ends_in_mark(tokenizer: Tokenizer) -> str:
    """Letters and numbers whose normalized form ends in neither."""
    if tokenizer.normalizer is None:
        return ""
    plain = lambda c: unicodedata.category(c)[0] in "LN"
    letters = filter(plain, map(chr, range(0x110000)))
    return "".join(c for c in letters if not plain((tokenizer.normalizer.normalize_str(c) or c)[-1]))


class WordEncoder:
    """Encodes columns of texts; ``path`` is a file of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            before = json.load(file).get("pre_tokenizer") or {}
        #: A leading space belongs to the word when the byte-level step cuts the text itself.
        self.spaced = before.get("type") == "ByteLevel"
        marked = "".join(f"\\x{{{ord(c):x}}}" for c in _ends_in_mark(self.tokenizer))
        self.signs = _SIGNS.format(f"|[{marked}]" if marked else "")
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _keep(self, rows: np.ndarray) -> None:
        """Only these rows of the store stay."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        self.ids, self.starts, self.sizes = self.ids[spots], ends - sizes, sizes
        self.words = self.words.take(pa.array(rows))
        self.uses = np.zeros(len(rows), np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Row of each distinct word in the store, after adding the missing ones."""
        if len(self.words) > CACHED_WORDS:
            often = np.flatnonzero(self.uses > 1)
            self._keep(often if len(often) <= CACHED_WORDS // 2 else often[:0])
        release_memory()
        place = pc.index_in(words, value_set=self.words)
        missing = words.filter(pc.is_null(place))
        rows = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            pieces = []
            gc.disable()  # nothing here is cyclic, and there are very many small lists
            for i in range(0, len(missing), _BATCH):
                found = self.tokenizer.encode_batch_fast(
                    missing.slice(i, _BATCH).to_pylist(), add_special_tokens=False
                )
                ids = [encoding.ids for encoding in found]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                pieces.append((np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes))
            gc.enable()
            flat = np.concatenate([ids for ids, _ in pieces])
            sizes = np.concatenate([sizes for _, sizes in pieces])
            rows[rows < 0] = len(self.words) + np.arange(len(missing))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.uses = np.concatenate([self.uses, np.zeros(len(missing), np.int64)])
            self.ids = np.concatenate([self.ids, flat])
            self.words = pa.concat_arrays([self.words, missing])
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, ids per text); texts hold no nulls."""
        texts = texts.cast(pa.string())
        apart = np.zeros(len(texts), bool)
        for i in np.flatnonzero(
            pc.match_substring_regex(texts, _SUSPECT).to_numpy(zero_copy_only=False)
        ):
            text = texts[int(i)].as_py()
            apart[i] = "\0" in text or (self.spaced and bool(_DOUBLE_SPACE.search(text)))
        marked = pc.if_else(pa.array(apart), "", texts) if apart.any() else texts
        signs = pc.match_substring_regex(marked, self.signs)
        for mark, cut in ((" ", "\0 "), ("\n", "\0\n\0")) if self.spaced else ((" ", "\0"), ("\n", "\0")):
            marked = pc.replace_substring(marked, mark, cut)
        split_off = pc.replace_substring(pc.replace_substring(marked, ".\0", "\0.\0"), ",\0", "\0,\0")
        parts = pc.split_pattern(pc.if_else(signs, marked, split_off), "\0")
        coded = parts.flatten().dictionary_encode()
        offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        distinct = self._rows(coded.dictionary)
        place = coded.indices.to_numpy(zero_copy_only=False)
        self.uses[distinct] += np.bincount(place, minlength=len(distinct))
        row = distinct[place]
        del marked, split_off, parts, coded
        sizes = self.sizes[row]
        total = np.zeros(len(row) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        spots = np.repeat(self.starts[row] - total[:-1], sizes)
        spots += np.arange(total[-1])
        ids = self.ids[spots]
        counts = np.diff(total[offsets])
        if apart.any():
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(apart):
                pieces[i] = self.whole(texts[int(i)].as_py())
                counts[i] = len(pieces[i])
            ids = np.concatenate(pieces).astype(np.uint32)
        return ids, counts


def encoder(path: str) -> WordEncoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to every text's ids."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    spots = np.ones(len(out), bool)
    spots[np.cumsum(counts + 1) - 1] = False
    out[spots] = ids
    return out, counts + 1
