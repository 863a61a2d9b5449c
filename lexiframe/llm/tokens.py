"""Encoding of many texts with a public tokenizer, one distinct word at a time.

Texts are cut into words as the tokenizer file says (``bpe.Bpe``); words met for the first
time go to the tokenizer together, as one text. A worker keeps the IDs of recent words
from task to task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np

from lexiframe.llm.bpe import Bpe, default_path, load

__all__ = ["WordEncoder", "default_path"]

# So many texts are split at a time; their new words go to the tokenizer as one text.
GROUP = 64


def _places(ids: list[bytes | None]) -> list[int]:
    """Where None stands."""
    places, at = [], -1
    for _ in range(ids.count(None)):
        at = ids.index(None, at + 1)
        places.append(at)
    return places


class WordEncoder:
    """Texts to IDs as little-endian unsigned 32-bit integers; any file ``bpe.Bpe`` takes."""

    def __init__(self, path: str):
        self.bpe: Bpe = load(path)

    def _learn(self, words: list[str]) -> None:
        """Encode words as one text; should the tokenizer cut any of them further, each is encoded when met."""
        found = self.bpe.rules.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(found.ids, "<u4"), np.array(found.word_ids)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        if len(starts) != len(words):
            return
        data, at = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
        for w, a, b in zip(words, at[:-1], at[1:]):
            self.bpe.words.put(w, data[a:b])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The IDs of each text; a null text has none."""
        recent = self.bpe.words
        for group in batched(texts, GROUP):
            cut = [self.bpe.plain_words(text or "") for text in group]
            found = [None if words is None else list(map(recent.young.get, words)) for words in cut]
            lacking = [(words, ids, _places(ids)) for words, ids in zip(cut, found) if ids is not None and None in ids]
            new = {words[i] for words, _, places in lacking for i in places}
            new = [w for w in new if recent.find(w) is None and len(w) <= recent.longest]
            if new:
                self._learn(new)
            for words, ids, places in lacking:
                for i in places:
                    ids[i] = self.bpe.all_ids(words[i : i + 1])
            for text, ids in zip(group, found):
                yield self.bpe.encode(text.encode("utf-8", "surrogatepass")) if ids is None else b"".join(ids)
