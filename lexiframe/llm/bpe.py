"""Byte-pair encoding and decoding from the vocabulary and merge list of a tokenizer file.

A word's symbols form a doubly linked list. All mergeable neighbours wait in a priority
queue by (rank, place); a popped entry whose pair has changed meanwhile is stale and is
skipped. Decoding looks up the vocabulary string of every ID and joins them.

Normalising and cutting a text into words are the tokenizer file's own rules, applied by
the library; for the file that drops white space they are applied once a distinct
white-space separated piece.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

# A generation of a worker's caches holds at most so many words or pieces, none longer than LONGEST.
CACHE_WORDS, CACHE_PIECES, LONGEST = 300_000, 50_000, 64
# Rows and bytes of text after which a result batch is handed on.
BATCH_ROWS, BATCH_BYTES = 1024, 8_000_000

# The rules of a tokenizer file whose words never reach across white space.
BY_PIECE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# The same rules for texts of ASCII, Latin letters and some marks: no such character composes, and
# each has one lower-case form.
_LETTERS = "\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_PLAIN = re.compile(f"[\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00de{_LETTERS}\u2010-\u2027\u20ac]*")
_ASCII_SPACE = re.compile("[\\t-\\r ]+")
_WORDS = re.compile(f"[a-z{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\t-\\r a-z0-9{_LETTERS}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is visible in Latin-1, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Recent:
    """A bounded cache of two generations: what is not asked for during one whole generation is forgotten."""

    def __init__(self, most: int):
        self.most, self.longest, self.young, self.old = most, LONGEST, {}, {}

    def find(self, key):
        """A value the young generation lacks, which it then takes over, or None."""
        found = self.old.pop(key, None)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(key) > self.longest:
            return
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Bpe:
    """One tokenizer file. Only files without other affixes than a word end, and plain added tokens, are taken."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or not plain:
            raise ValueError(f"not a byte-pair tokenizer of the known kind: {path}")
        self.ends = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        missing = [c for c in byte_alphabet() for s in {c, c + self.ends} if s not in self.vocab]
        if missing:
            raise ValueError(f"the vocabulary lacks the symbols of {len(missing)} bytes: {path}")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # A pair of IDs is looked up as one number.
        self.size = 1 + max(self.vocab.values())
        self.ranks = {self.vocab[a] * self.size + self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.whole_words = bool(model.get("ignore_merges"))
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.specials = re.compile(
            b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")"
        ) if added else None
        n = 1 + max([*self.vocab.values(), *self.added.values()])
        self.strings: list[str | None] = [None] * n
        for text, i in [*self.vocab.items(), *((t.decode(), i) for t, i in self.added.items())]:
            self.strings[i] = text
        self.gaps = None in self.strings
        self.path = path
        self.by_piece = all(spec[k] == v for k, v in BY_PIECE.items())
        self.decoder = (spec["decoder"] or {"type": None})["type"]
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.byte_of = {c: b for b, c in self.alphabet.items()}
        self.words, self.pieces = Recent(CACHE_WORDS), Recent(CACHE_PIECES)

    @cached_property
    def rules(self) -> Tokenizer:
        """The library's tokenizer, for its rules of cutting; a worker that only decodes has none."""
        return Tokenizer.from_file(self.path)

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols left after all merges, lowest rank first, leftmost first among equals.

        An entry of the queue is the number rank * n + place.
        """
        n, ids, size, rank_of = len(symbols), list(symbols), self.size, self.ranks.get
        queue = [
            r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a * size + b)) is not None
        ]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            a, j = ids[i], after[i]
            if a < 0 or j >= n or rank_of(a * size + ids[j]) != rank:
                continue  # stale
            ids[i] = merged = self.merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(merged * size + ids[k])) is not None:
                    heappush(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] * size + merged)) is not None:
                heappush(queue, r * n + h)
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        """IDs of a word, as little-endian unsigned 32-bit integers."""
        found = self.words.find(word)
        if found is None:
            text = word.encode().decode("latin-1").translate(self.alphabet)
            if self.whole_words and text + self.ends in self.vocab:
                ids = [self.vocab[text + self.ends]]
            else:
                ids = self.merge([*map(self.vocab.__getitem__, text[:-1]), self.vocab[text[-1] + self.ends]])
            found = struct.pack(f"<{len(ids)}I", *ids)
            self.words.put(word, found)
        return found

    def all_ids(self, words: list[str]) -> bytes:
        """The IDs of words in a row."""
        get, new = self.words.young.get, self._word
        return b"".join([get(w) or new(w) for w in words])

    def _cut(self, text: str) -> list[str]:
        """The words of a text without added tokens, by the file's own rules."""
        if self.rules.normalizer is not None:
            text = self.rules.normalizer.normalize_str(text)
        if self.rules.pre_tokenizer is None:
            return [text]
        # The rules write words in the byte alphabet.
        found = self.rules.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.byte_of.__getitem__, word)).decode("utf-8") for word, _ in found if word]

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.find(piece)
        if found is None:
            words = _WORDS.findall(piece.lower()) if _PLAIN.fullmatch(piece) else self._cut(piece)
            found = self.all_ids(words)
            self.pieces.put(piece, found)
        return found

    def plain_words(self, text: str) -> list[str] | None:
        """The words of a text that can be cut as a whole, else None."""
        if not self.by_piece or not _PLAIN.fullmatch(text) or ("<|" in text and self.specials.search(text.encode())):
            return None
        return _WORDS.findall(text.lower())

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return self.all_ids(self._cut(text))
        if _PLAIN.fullmatch(text):
            return self.all_ids(_WORDS.findall(text.lower()))
        get, new = self.pieces.young.get, self._piece
        return b"".join([new(p) if (f := get(p)) is None else f for p in _ASCII_SPACE.split(text) if p])

    def encode(self, text: bytes | None) -> bytes:
        """The IDs of a text in UTF-8, as little-endian unsigned 32-bit integers; null has none."""
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self._segment(text.decode("utf-8"))
        parts = self.specials.split(text)
        return b"".join(
            struct.pack("<I", self.added[p]) if at % 2 else self._segment(p.decode("utf-8")) for at, p in enumerate(parts)
        )

    def decode(self, ids: bytes | None) -> str:
        """The vocabulary strings of the IDs in a row; IDs outside the vocabulary are left out."""
        found = np.frombuffer(ids or b"", "<u4").tolist()
        if found and max(found) >= len(self.strings):
            found = [i for i in found if i < len(self.strings)]
        texts = map(self.strings.__getitem__, found)
        if self.gaps:
            texts = (t for t in texts if t is not None)
        if self.decoder is None:
            return " ".join(texts)
        if self.decoder == "ByteLevel":
            # A string with a character outside the byte alphabet (an added token) stays as it is.
            parts = (
                bytes(map(self.byte_of.__getitem__, t)) if all(c in self.byte_of for c in t) else t.encode() for t in texts
            )
            return b"".join(parts).decode("utf-8", "replace")
        raise ValueError(f"unknown decoder: {self.decoder}")


@lru_cache(maxsize=1)
def load(path: str) -> Bpe:
    """Kept by a worker from task to task, its caches too."""
    return Bpe(path)


def _mapped(df: DataFrame, source: str, target: str, kind: str, arrow: pa.DataType, path: str, how) -> DataFrame:
    """``df`` with the column ``target``, made from the bytes of ``source`` by ``how(bpe, value)``."""
    names = [c for c in df.columns if c.lower() != target.lower()]
    schema = df.select(*[f"`{c}`" for c in names]).schema.add(target, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = batch.schema.get_field_index(source)
            values = batch.column(at).cast(pa.binary())
            start, made, size = 0, [], 0
            for i, value in enumerate(values):
                value = value.as_py()
                made.append(how(bpe, value))
                size += len(value or b"")
                if i + 1 == len(values) or i + 1 - start >= BATCH_ROWS or size >= BATCH_BYTES:
                    rows = batch.slice(start, i + 1 - start)
                    columns = [rows.column(batch.schema.get_field_index(c)) for c in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow)], [*names, target])
                    start, made, size = i + 1, [], 0

    return df.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``: the IDs of ``text``, little-endian unsigned 32-bit integers in a binary.

    No special IDs are added; the string of a special token in a text is that token, as in
    the library. A null or empty text has no IDs. Rows are independent: ids may be null or
    repeated, no rows give no rows, and a column that is called as the result is replaced.
    Texts may be as long as a row allows; a word of n bytes takes n log n steps.
    """
    path = tokenizer_path or default_path()
    return _mapped(docs, text, ids, "binary", pa.binary(), path, Bpe.encode)


def decode_ids(df: DataFrame, tokenizer_path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``text``: the vocabulary strings of ``ids``, joined as the tokenizer file says.

    A file without a decoder joins by single spaces. Special tokens stay. Null ``ids`` and
    no IDs give an empty text; IDs outside the vocabulary are left out.
    """
    path = tokenizer_path or default_path()
    return _mapped(df, ids, text, "string", pa.string(), path, Bpe.decode)
