"""WordPiece tokens of the BERT kind: lower case, no accents, greedy longest pieces."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

#: Letters that have no decomposition but lose their stroke or ligature all the same (fixed values).
BARE = {"æ": "a", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ĳ": "j", "ĸ": "k", "ŀ": "l", "ł": "l", "ŉ": "n", "ŋ": "n", "œ": "o", "ŧ": "t"}
#: Blocks of ideographs, each a word of its own (fixed values).
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


@lru_cache(maxsize=200_000)
def _normal(ch: str) -> str:
    c = ord(ch)
    if ch in "\t\n\r\x0b\x0c" or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    if c == 0 or c == 0xFFFD or unicodedata.category(ch) in ("Cc", "Cf"):
        return ""
    if any(lo <= c <= hi for lo, hi in IDEOGRAPHS):
        return f" {ch} "
    return "".join(BARE.get(x) or "".join(y for y in unicodedata.normalize("NFD", x) if unicodedata.category(y) != "Mn") for x in ch.lower())


def normalize(text: str) -> str:
    """Controls dropped, white space as spaces, ideographs set apart, lower case, accents gone."""
    return "".join(map(_normal, text))


#: Controls that are dropped, but at which ``str.split`` would part a text.
UNSPLIT = re.compile("[\x1c-\x1f\x85]")
#: Characters of the longest piece between white space that is kept with its ids.
KEPT = 64


def is_punctuation(ch: str) -> bool:
    return (ch.isascii() and ch.isprintable() and not ch.isalnum() and ch != " ") or unicodedata.category(ch).startswith("P")


def words(normalized: str) -> list[str]:
    """Words between white space; every punctuation mark is one."""
    out: list[str] = []
    for part in normalized.split():
        begin = 0
        for i, ch in enumerate(part):
            if is_punctuation(ch):
                out += [w for w in (part[begin:i], ch) if w]
                begin = i + 1
        if begin < len(part):
            out.append(part[begin:])
    return out


class WordPiece:
    """``vocab``: id of each piece; pieces inside a word carry ``prefix``."""

    def __init__(self, vocab: dict[str, int], unknown: str = "[UNK]", prefix: str = "##", longest: int = 100):
        if not vocab:
            raise ValueError("the vocabulary is empty")
        if unknown not in vocab:
            raise ValueError(f"{unknown!r} is not in the vocabulary")
        self.vocab, self.unknown, self.prefix, self.longest = vocab, vocab[unknown], prefix, longest
        lengths = sorted(len(t.encode()) for t in vocab)
        self.median_bytes = max(1, lengths[len(lengths) // 2])
        self._keep()

    def _keep(self):
        self._word = lru_cache(maxsize=200_000)(self._pieces)
        self._chunk = lru_cache(maxsize=200_000)(self._bytes)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_word", "_chunk")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._keep()

    @classmethod
    def of_json(cls, raw: bytes | str) -> WordPiece:
        """From a tokenizer file: its ``model`` section."""
        model = json.loads(raw).get("model")
        if not isinstance(model, dict) or not isinstance(model.get("vocab"), dict):
            raise ValueError("the file has no model with a vocabulary")
        vocab = {t: i for t, i in model["vocab"].items() if isinstance(i, int)}
        most = model.get("max_input_chars_per_word")
        return cls(vocab, model.get("unk_token") or "[UNK]", model.get("continuing_subword_prefix") or "##", most if isinstance(most, int) and most > 0 else 100)

    def _pieces(self, word: str) -> tuple[int, ...]:
        """Longest pieces from the left; one unknown where any part has none, or the word is too long."""
        if len(word) > self.longest:
            return (self.unknown,)
        ids, at = [], 0
        while at < len(word):
            lead = self.prefix if at else ""
            end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in self.vocab), at)
            if end == at:
                return (self.unknown,)
            ids.append(self.vocab[lead + word[at:end]])
            at = end
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return [i for w in words(normalize(text)) for i in self._word(w)]

    def _bytes(self, text: str) -> bytes:
        return array("i", self.encode(text)).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers; what stands between white space is cut once."""
        if UNSPLIT.search(text):
            return self._bytes(text)
        return b"".join([self._chunk(x) if len(x) <= KEPT else self._bytes(x) for x in text.split()])
