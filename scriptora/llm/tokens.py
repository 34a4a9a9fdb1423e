"""Token ids of whole texts through the tokenizers library, remembered piece by piece."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Classes of the tokenizer file's split pattern within the characters of PLAIN (fixed values of that file's format).
_L, _N = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-į", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Characters that NFC leaves alone and that every library lower-cases and classes alike: ASCII and precomposed Latin.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-į]*")

#: What a tokenizer file says whose texts can be split here (fixed values of that file's format): its steps and its split pattern.
STEPS, MARKS, PATTERN = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: A text that both ways of encoding must give the same ids before the faster one is used.
SAMPLE = "It's 42 words, déjà-vu... ½ of\n\tnaïve <tags> they'll WE'VE यह \u0130 x² a_b 'tis {ok}"


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer file drops white space, lets no token cross it and splits by PATTERN."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x["type"] for x in steps] != STEPS or [x["type"] for x in cuts] != MARKS or spec.get("post_processor") or spec["model"].get("dropout"):
        return False
    split, level = cuts
    return steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " " and split["pattern"] == {"Regex": PATTERN} and split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]


class WordEncoder:
    """Ids of a text under a tokenizer that drops white space and lets no token cross it.

    Such a tokenizer gives a text the ids of its pieces, one after the other,
    and a piece has the same ids everywhere, so the library's BPE model has to
    see each different piece once. Texts of plain characters are split by the
    tokenizer file's own pattern; in any other text each word with another
    character goes through the whole library tokenizer. A memory holds at most
    about `remember` entries of at most LONG characters and then starts anew.
    Any other tokenizer file, by what it says and not by its name, is used as
    the library does it.
    """

    def __init__(self, path: str, remember: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = {x.content.encode()[:2] for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.words = _Memory(self._word, remember // 5)
        self.pieces = _Memory(self._piece, remember)
        with open(path, encoding="utf-8") as f:
            self.by_piece = splits_words(json.load(f))
        self.by_piece = self.by_piece and self.encode(SAMPLE.encode()) == self._library(SAMPLE)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():  # the library's byte-level step leaves printable ASCII as it is
            piece = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))
        return _packed([t.id for t in self.model.tokenize(piece)])

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text.lower())))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        return self._split(text) if PLAIN.fullmatch(text) and not any(s in word for s in self.special) else self._library(text)

    def _library(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return self._library(text.decode())
        self.words.trim()
        self.pieces.trim()
        if PLAIN.fullmatch(plain := text.decode()) and not any(s in text for s in self.special):
            return self._split(plain)
        return b"".join(map(self.words.__getitem__, text.split()))


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


#: Longer words are encoded each time, so that a memory is bounded in bytes too.
LONG = 64


class _Memory(dict):
    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= LONG and len(self) <= 2 * self.most:  # a single text can have very many different words
            self[key] = made
        return made


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
