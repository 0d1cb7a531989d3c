"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once per worker.

The vocabulary file's rules (NFC, white space, lower case, then a split whose pieces hold no white space) never
look across white space, so the ids of a text are those of its pieces in a row. ``Encoder`` keeps the ids of
pieces as little-endian bytes. Texts of plain characters only (ASCII and the letters of Latin-1, for which NFC
changes nothing and lower-casing is letter by letter) are split by the file's own pattern; other texts at white
space, and texts that might hold an added token's string are encoded as they are.
"""

from __future__ import annotations

import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split pattern of the vocabulary file for plain, lower-cased characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Anything else than: tab, line ends, space, ASCII signs, letters of Latin-1 and a few signs that are no letters or numbers.
UNPLAIN = re.compile("[^\\t\\n\\r -~¡-©«-±´¶-¸»¿À-ÿ]")
LIMIT = 700_000


class Encoder(dict):
    """piece of a plain text -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # Plain pieces are normal and split already: without those steps the same model is three times as fast.
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = _Words(self)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= LIMIT:
            self.clear()
        out = self[piece] = _packed(self.pieces.encode(piece, add_special_tokens=False).ids)
        return out

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self.whole(text)
        if UNPLAIN.search(text):
            return b"".join(map(self.words.__getitem__, re.split(r"[ \t\n\r]+", text)))
        return b"".join(map(self.__getitem__, PIECES.findall(text.lower())))


class _Words(dict):
    """word between blanks, as it stands -> its ids."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= LIMIT // 4:
            self.clear()
        out = self[word] = self.encoder.whole(word)
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
