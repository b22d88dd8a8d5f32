"""Byte-pair encoding and decoding (operator 5).

A word is a doubly linked list of symbols.  Every adjacent pair that has a
merge enters a priority queue as (merge rank, position); the smallest is
popped, entries whose pair no longer stands are skipped as stale, the two
symbols become one, and the new pairs left and right of it are queued.
Decoding concatenates vocabulary strings.

The tokenizer file (its path is a parameter, the file is never copied) says
how a text becomes words: canonical composition, white space as one blank,
lower case, a split into contractions, letter runs, single numerals and other
runs, then bytes as printable characters with an end-of-word mark.  No rule
reaches over white space, so a text is a sequence of blank-separated pieces,
each encoded on its own and remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import columns_of, doc_columns

#: Unicode White_Space (what the tokenizer's ``\s`` matches).
WHITE_SPACE = "\t-\r \u0085   -     　"
#: Python's ``str.split`` also cuts at these four, the tokenizer does not.
EXTRA_SPLIT = regex.compile("[\x1c-\x1f]")
BLANKS = regex.compile(f"[{WHITE_SPACE}]+")

MEMO_ENTRIES = 250_000  # pieces, and words, in a generation of a Python worker's memory
MEMO_CHARS = 64         # longer ones are not remembered


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it is a visible
    Latin-1 character, else the next free character from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown, out = set(visible), []
    free = 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Memo:
    """A bounded table of two generations: when the young one is full it
    becomes the old one; what is asked for again moves back to the young."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def old_value(self, key):
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def get(self, key):
        got = self.young.get(key)
        return self.old_value(key) if got is None else got


class BytePairCodec:
    """Encoder and decoder of one tokenizer file (JSON text)."""

    def __init__(self, spec: str, memo_entries: int = MEMO_ENTRIES):
        data = json.loads(spec)
        model = data["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.spec, self._library = spec, None
        #: left id -> {right id: merge rank}
        self.rank_of: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.merged: list[int] = []             # merge rank -> id of the merged symbol
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of[vocab[a]][vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.special_split = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        split = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", WHITE_SPACE))
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + self.suffix] for c in alphabet]
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self._pieces, self._words = Memo(memo_entries), Memo(memo_entries)

    # -- encoding -------------------------------------------------------
    def merge_word(self, word: str) -> list[int]:
        """Ids of one word (already normalised)."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, rank_of = self.inner, self.rank_of
        sym = [inner[b] for b in raw]
        sym[-1] = self.final[raw[-1]]
        n = len(sym)
        if n == 1:
            return sym
        # an entry is rank and position in one integer, so the heap orders
        # by rank, then from left to right
        bits = n.bit_length()
        here = (1 << bits) - 1
        queue = []
        a = sym[0]
        for i in range(1, n):
            b = sym[i]
            r = rank_of[a].get(b)
            if r is not None:
                queue.append((r << bits) + i - 1)
            a = b
        if not queue:
            return sym
        heapq.heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pop, push, merged = heapq.heappop, heapq.heappush, self.merged
        while queue:
            entry = pop(queue)
            i = entry & here
            j = after[i]
            if j >= n or sym[i] < 0 or rank_of[sym[i]].get(sym[j]) != entry >> bits:
                continue                                   # stale
            sym[i] = new = merged[entry >> bits]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_of[new].get(sym[k])
                if r is not None:
                    push(queue, (r << bits) + i)
            h = before[i]
            if h >= 0:
                r = rank_of[sym[h]].get(new)
                if r is not None:
                    push(queue, (r << bits) + h)
        return [s for s in sym if s >= 0]

    def words_of(self, part: str) -> list[str]:
        """Normalise a blank-free part and split it into words.  Code points
        from U+0530 on follow the tokenizer library's own normaliser and
        splitter, whose Unicode tables are newer than Python's."""
        if part.isascii():
            part = part.lower()
        elif max(part) < "\u0530":
            part = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])  # no final-sigma rule
            if max(part) >= "\u0530":
                return self._library_words(part)
        else:
            return self._library_words(part)
        if part.isalpha():
            return [part]
        if part[-1] in ".," and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.words.findall(part)

    def _library_words(self, part: str) -> list[str]:
        from tokenizers import Tokenizer
        if self._library is None:
            self._library = Tokenizer.from_str(self.spec)
        text = self._library.normalizer.normalize_str(part)
        shown = self._library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in shown]

    def _word(self, word: str) -> bytes:
        got = self._words.get(word)
        if got is None:
            ids = self.merge_word(word)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= MEMO_CHARS:
                self._words.put(word, got)
        return got

    def _piece(self, piece: str) -> bytes:
        """Ids of one blank-free piece as little-endian unsigned 32-bit."""
        got = self._pieces.old_value(piece)
        if got is not None:
            return got
        if "<" in piece and self.special_split:
            out = []
            for part in self.special_split.split(piece):
                if part in self.special:
                    out.append(struct.pack("<I", self.special[part]))
                elif part:
                    out.extend(map(self._word, self.words_of(part)))
            got = b"".join(out)
        else:
            words = self.words_of(piece)
            got = self._word(words[0]) if len(words) == 1 else b"".join(map(self._word, words))
        if len(piece) <= MEMO_CHARS:
            self._pieces.put(piece, got)
        return got

    def encode(self, text: str | None) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit."""
        if not text:
            return b""
        pieces = [p for p in BLANKS.split(text) if p] if EXTRA_SPLIT.search(text) else text.split()
        get, miss = self._pieces.young.get, self._piece
        return b"".join([got if (got := get(p)) is not None else miss(p) for p in pieces])

    # -- decoding -------------------------------------------------------
    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined by blanks (the file has
        no decoder of its own); special tokens are kept."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, BytePairCodec] = {}


def codec_of(spec: str) -> BytePairCodec:
    """The codec of a tokenizer file, built once per Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BytePairCodec(spec)
    return _CODECS[key]


def read_spec(tokenizer_path: str) -> str:
    """The tokenizer file's text; a fixed public file of a few MB, which the
    driver reads and sends to the tasks."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids binary, n_tokens, decoded string`` of every whole text.

    Null text counts as empty (no tokens, empty decoded text); a null doc_id
    is passed through; repeated rows give repeated rows; other columns of
    ``docs`` are ignored.  One narrow pass, no shuffle.
    """
    return _map(docs, tokenizer_path, "doc_id long, ids binary, n_tokens long, decoded string",
                lambda d, ids, text: (d, ids, len(ids) // 4, text))


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The digest form of :func:`encode_documents` with the same treatment of
    nulls, repeats and extra columns; ids and texts stay inside the task.
    """
    return _map(docs, tokenizer_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                lambda d, ids, text: (d, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                      hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))


#: Arrow types of the columns these passes return.
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _map(docs, tokenizer_path, schema, row):
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    fields = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        codec = codec_of(spec.value)
        for ids_col, texts in columns_of(batches):
            rows = []
            for d, text in zip(ids_col, texts):
                ids = codec.encode(text)
                rows.append(row(d, ids, codec.decode(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)]
                                             if rows else [pa.array([], f.type) for f in fields], schema=fields)

    return doc_columns(docs).mapInArrow(run, schema)
