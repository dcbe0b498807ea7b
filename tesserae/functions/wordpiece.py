"""WordPiece ids of texts and of pairs of texts, for models with a vocabulary of that kind."""

from __future__ import annotations

import json
import string
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.plans.errors import CorruptIndex, NotFound

_SPACES, _MARKS = b" \t\n\v\f\r", string.punctuation.encode()


@dataclass
class WordPiece:
    vocabulary: dict[bytes, int]

    def __post_init__(self):
        if not self.vocabulary:
            raise CorruptIndex("the vocabulary is empty")
        of = lambda name, default: self.vocabulary.get(name, default)
        self.start, self.end, self.unknown = of(b"[CLS]", 101), of(b"[SEP]", 102), of(b"[UNK]", 100)
        self.longest = max(map(len, self.vocabulary))

    @classmethod
    def load(cls, path: str) -> WordPiece:
        """From tokenizer.json, or a text file with a piece a line, numbered from 0."""
        at = Path(path)
        if not at.is_file():
            raise NotFound(path)
        if at.suffix == ".json":
            try:
                said = json.loads(at.read_text())
                found = said["model"]["vocab"] if "model" in said else said["vocab"]
                return cls({k.encode(): int(v) for k, v in found.items()})
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                raise CorruptIndex(path) from e
        return cls({line.rstrip(b"\r\n"): k for k, line in enumerate(at.read_bytes().splitlines())})

    def _words(self, text: str) -> list[bytes]:
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
        parted = b"".join(b" %c " % b if b in _MARKS else b" " if b in _SPACES else b"%c" % b for b in raw)
        return parted.split()

    def pieces(self, word: bytes) -> list[int]:
        """The longest known piece from the front, again and again; all of a word that can't be cut so is unknown."""
        out, at = [], 0
        while at < len(word):
            lead = b"##" if at else b""
            for end in range(min(len(word), at + self.longest), at, -1):
                found = self.vocabulary.get(lead + word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def _most(self, text: str, most: int) -> list[int]:
        out: list[int] = []
        for word in self._words(text):
            if len(out) >= most:
                break
            out += self.pieces(word)
        return out[:most]

    def encode(self, text: str, most: int = 512) -> list[int]:
        """Ids between start and end marks, `most` with them."""
        return [self.start, *self._most(text, max(most - 2, 0)), self.end]

    def encode_pair(self, a: str, b: str, most: int = 512) -> tuple[list[int], list[int]]:
        """Ids of both texts and, of each id, to which text it belongs. The first has a third of the room at most, the second what is left."""
        room = most - 3 if most > 3 else 1
        first = self._most(a, max(1, room // 3))
        second = self._most(b, room - len(first) if room > len(first) else 1)
        ids = [self.start, *first, self.end, *second, self.end]
        return ids, [0] * (len(first) + 2) + [1] * (len(second) + 1)


def wordpiece_ids(tokenizer: WordPiece, text: Column, most: int = 512) -> Column:
    """array<int> of each text; null for null."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tokenizer.encode(t, most) for t in column], dtype=object)

    return F.pandas_udf(run, "array<int>")(text)
