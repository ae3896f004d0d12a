"""Token ids of many texts, as the tokenizers library gives them, with each distinct word encoded once.

The vocabulary file's pre-tokenizer never joins text across white space, so a text's ids are its words' ids one after
the other. Words are kept with their ids until CACHE words are known. A word of plain Latin letters, digits and punctuation is cut as the
file's own pattern says and goes to the library's BPE model piece by piece, which gives the same ids several times as fast as
the library's whole pipeline; any other word, and any that could hold a special token, goes through that pipeline.
"""

from __future__ import annotations

from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Words whose ids a worker keeps: about 150 bytes each.
CACHE = 700_000

# fixed values of the vocabulary file: the pattern that it splits by
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# marks of ASCII: a run of them behind letters is one piece
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# letters of Latin-1 and Latin Extended-A without the dotted capital I, whose lower case is two code points
_PLAIN = regex.compile(r"[\x21-\x7eÀ-įı-ſ]+")


def _byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def gather(flat: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows flat[first[i]:first[i + 1]] for each i of pick, one after the other, and where each begins (one value more)."""
    sizes = (first[1:] - first[:-1])[pick]
    to = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(first[:-1][pick] - to[:-1], sizes) + np.arange(to[-1])], to


class Encoder(dict):
    """Maps a word to its number; numbers index the words' ids. Numbers hold until reset()."""

    def __init__(self, name: str):
        super().__init__()
        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pieces: dict[str, list[int]] = {}
        self.flat, self.first = array("i"), array("q", [0])
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def _learn(self) -> None:
        """The ids of the words that have a number only."""
        pieces, tokenize, flat, first = self.pieces, self.model.tokenize, self.flat, self.first
        for word in self.fresh:
            stem = word.rstrip(_MARKS)
            if stem.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)) and "<|" not in word:
                parts = (stem.lower(),) if len(stem) == len(word) else (stem.lower(), word[len(stem) :])
            elif not word:
                parts = ()
            elif _PLAIN.fullmatch(word) and "<|" not in word:
                parts = _PIECES.findall(word.lower())
            else:
                parts = ()
                flat.extend(self.whole.encode(word, add_special_tokens=False).ids)
            for piece in parts:
                if (ids := pieces.get(piece)) is None:
                    raw = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
                    ids = [t.id for t in tokenize(raw)]
                    if len(piece) < 8:  # longer ones rarely come again in another word
                        pieces[piece] = ids
                flat.extend(ids)
            first.append(len(flat))
        self.fresh.clear()

    def encode_many(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, each followed by end if it is given, and the index of each text's first id (n + 1 values)."""
        if len(self) > CACHE:
            self.reset()
        numbers = [array("i", map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]
        self._learn()
        words = np.concatenate([np.frombuffer(x, np.int32) for x in numbers]) if numbers else np.zeros(0, np.int32)
        of_text = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
        out, to = gather(np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.first, np.int64), words)
        first = to[of_text]
        if end is None:
            return out, first
        return np.insert(out, first[1:], end), first + np.arange(len(first))


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder for the vocabulary file."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
