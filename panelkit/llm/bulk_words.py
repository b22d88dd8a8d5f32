"""Token ids of many texts at once, for operators that only need the ids.

The pieces of a block of texts are encoded once each, not once per occurrence:
distinct pieces are split into words, all distinct words are encoded in one call
of a byte-pair encoder that works on a list of ranks, and every text is put
together from its pieces.  Nothing is kept from block to block, so memory is
bounded by a block.

The encoder merges the pair whose joint bytes have the least rank.  That equals
merging by the file's list of pairs if every entry of the vocabulary, taken by
itself, merges to itself (as long as no merge has reached over the ends of some
bytes, these merge as they do by themselves), which is checked when a file is
loaded.  The end-of-word mark is a byte behind each word; the pair of a last
byte and the mark ranks before all merges, so words start as in the file.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import BytePairCodec

MARK = "\x00"               # a word that holds it is encoded on its own
BLOCK_CHARS = 8_000_000     # bytes of text encoded together
_HIGH = "\u0530"
_ODD = re.compile("[\u0530-\U0010ffff\u03a3<]")


class BulkEncoder:
    """Encoder of one tokenizer file (JSON text) for blocks of texts."""

    def __init__(self, spec: str):
        import tiktoken
        self.codec = codec = BytePairCodec(spec, memo_entries=1)
        mark = MARK.encode()
        self.ids: list[int] = []                    # rank -> id
        ranks: dict[bytes, int] = {}
        raw_of = {i: self._raw(s, codec, mark) for i, s in codec.strings.items() if s not in codec.special}
        for i in chain(codec.inner, codec.final, codec.merged):
            ranks[raw_of[i]] = len(self.ids)
            self.ids.append(i)
        if len(ranks) != len(self.ids) or not all(self._stands(raw_of[i], i, codec, mark) for i in self.ids):
            raise ValueError("the vocabulary's entries don't merge to themselves")
        self.ids = np.array(self.ids, "<u4")
        ends = {i for i in self.ids.tolist() if raw_of[i].endswith(mark) and i not in codec.inner}
        self.ends = np.array([i in ends for i in range(int(self.ids.max()) + 1)])
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _raw(s: str, codec: BytePairCodec, mark: bytes) -> bytes:
        last = codec.suffix and s.endswith(codec.suffix)
        return bytes(codec.byte_of[c] for c in (s[:-len(codec.suffix)] if last else s)) + (mark if last else b"")

    @staticmethod
    def _stands(raw: bytes, want: int, codec: BytePairCodec, mark: bytes) -> bool:
        """Whether these bytes merge to ``want`` by the file's list of pairs."""
        if want in codec.inner or want in codec.final:
            return True
        sym = [codec.inner[b] for b in raw]
        if raw.endswith(mark):
            sym[-2:] = [codec.final[raw[-2]]]
        while len(sym) > 1:
            best = min((codec.rank_of[a].get(b, 1 << 30), i) for i, (a, b) in enumerate(zip(sym, sym[1:])))
            if best[0] == 1 << 30:
                return False
            sym[best[1]:best[1] + 2] = [codec.merged[best[0]]]
        return sym == [want]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian unsigned 32-bit."""
        plain = [w for w in words if MARK not in w]
        ids = self.ids[np.array(self.bpe.encode_ordinary(MARK.join([*plain, ""])), np.int64)]
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw = ids.tobytes()
        out = [raw[i:j] for i, j in zip([0, *stops], stops)]
        if len(plain) < len(words):
            rest = iter(out)
            out = [self.codec._word(w) if MARK in w else next(rest) for w in words]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, blank-free parts of texts.  Plain ones are
        normalised all at once: below U+0530, and apart from the final sigma,
        lower case and composition of a character don't depend on others."""
        words_of, split, number = self.codec.words_of, self.codec.words.findall, defaultdict()
        number.default_factory = number.__len__             # a new word gets the next number
        odd = {i: p for i, p in enumerate(pieces) if _ODD.search(p)}
        plain = pieces if not odd else [p for i, p in enumerate(pieces) if i not in odd]
        parts: list = []
        for w in unicodedata.normalize("NFC", " ".join(plain)).lower().split(" "):
            if w.isalpha():
                parts.append(number[w])
            elif w[-1:] in (",", ".") and w[:-1].isalpha():
                parts.append((number[w[:-1]], number[w[-1]]))
            else:
                parts.append([number[x] for x in split(w)])
        if odd or any(map(_ODD.search, number)):            # a character may become one from U+0530 on
            at = iter(parts)
            parts = [None if i in odd else next(at) for i in range(len(pieces))]
            spoiled = {n for w, n in number.items() if _ODD.search(w)}
            for i, p in enumerate(pieces):
                ws = parts[i]
                if ws is None or not spoiled.isdisjoint([ws] if isinstance(ws, int) else ws):
                    special = "<" in p and self.codec.special_split
                    parts[i] = self.codec._piece(p) if special else [number[x] for x in words_of(p)]
        words = self._words(list(number))
        return [words[ws] if isinstance(ws, int) else ws if isinstance(ws, bytes) else b"".join([words[n] for n in ws])
                for ws in parts]

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of every text (null: none) as :meth:`BytePairCodec.encode` gives
        them.  Pieces are found, numbered and put together as arrays."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")       # blanks to Arrow, not to the tokenizer
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        numbered = lists.flatten().dictionary_encode()
        ids = self._pieces(numbered.dictionary.to_pylist())
        sizes = np.array([len(b) // 4 for b in ids], np.int64)
        starts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        at = numbered.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = every[np.repeat(starts[at] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        stops = (4 * upto[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]).tolist()
        out = [raw[i:j] for i, j in zip(stops, stops[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.codec.encode(texts[i].as_py())
        return out


def blocks(texts: pa.Array, chars: int = BLOCK_CHARS):
    """(start, slice) of a column of texts, up to so many bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + chars, "right")))
        yield at, texts.slice(at, end - at)
        at = end


_ENCODERS: dict[str, BulkEncoder] = {}


def encoder_of(spec: str) -> BulkEncoder:
    """The encoder of a tokenizer file, built once per Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BulkEncoder(spec)
    return _ENCODERS[key]
