"""Token ids of whole texts by a public tokenizer file, fast on repeated words."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

# Characters for which the quick way below equals the tokenizer's own normalising:
# printable ASCII, tab and line ends, and Latin letters and signs up to U+012F, which
# canonical composition leaves alone. Any other character sends a text the long way.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-į]")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-į"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+"
)
_CACHED_CHARS = 1 << 24


def read_vocabulary(path: str) -> str:
    """The tokenizer file's text, to be sent to the tasks."""
    return Path(path).read_text(encoding="utf-8")


@lru_cache(maxsize=2)
def word_tokenizer(vocabulary: str, by_words: bool = True) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker, with what it has learnt."""
    return WordTokenizer(vocabulary, by_words)


class WordTokenizer:
    """Ids as little-endian unsigned integers: 16 bits, or 32 if the vocabulary is larger.

    For a tokenizer that lower-cases, drops white space and merges inside words only
    (``by_words``), the ids between two spaces don't depend on what stands around, so each
    distinct stretch is encoded once and remembered, within a bound. Otherwise, and where
    a text holds an added token of the file literally, texts are encoded whole.
    """

    def __init__(self, vocabulary: str, by_words: bool = True):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.lower() for token in added]
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.by_words = by_words
        # What the model sees of each character: its bytes, as letters.
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        usual = (chr(i) for i in range(33, 0x130))
        self.shown = {ord(x): shown(x)[0][0] for x in usual if not _UNUSUAL.search(x)}
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _encode_word(self, word: str) -> bytes:
        """As ``_encode``, for a lower-case word that the model gets whole."""
        tokens = self.tokenizer.model.tokenize(word.translate(self.shown))
        return array(self.dtype.char, [token.id for token in tokens]).tobytes()

    def _learn(self, stretches: set[str]) -> None:
        """Remember the ids of texts without white space, and of the words in them."""
        known = self.known
        for x in stretches:
            words = _WORD_PIECES.findall(x)
            for word in words:
                if word not in known:
                    known[word] = self._encode_word(word)
                    self.chars += len(word) + 32
            if len(words) > 1:
                known[x] = b"".join([known[word] for word in words])
                self.chars += len(x) + 32

    def ids(self, text: str) -> bytes:
        if not self.by_words or _UNUSUAL.search(text):
            return self._encode([text])[0]
        lowered = text.lower()
        if any(token in lowered for token in self.added):
            return self._encode([text])[0]
        stretches = lowered.split()
        found = list(map(self.known.get, stretches))
        if None in found:
            if self.chars > _CACHED_CHARS:
                self.known.clear()
                self.chars = 0
            unknown = [i for i, ids in enumerate(found) if ids is None]
            self._learn({stretches[i] for i in unknown})
            for i in unknown:
                found[i] = self.known[stretches[i]]
        return b"".join(found)
