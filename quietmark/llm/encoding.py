"""Token ids of a public byte-level BPE file, with a bounded memo of words.

A text is cut before every space that another word follows.  The tokenizer's own
splitting pattern always begins a new unit there, so the ids of the text are the
ids of these parts one after another, and a part seen before need not be merged
again.  The memo is emptied when it is full; it changes nothing but the time.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

MEMO_ENTRIES = 600_000
#: A space inside or at the end of a longer stretch of white space.
_ODD = re.compile(r"\s (?!\S)")
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")
_ASCII_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_BEFORE_WORD = re.compile(r" (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of a byte-level BPE: printable Latin-1 stays, the rest follows from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Encoder:
    """``encode(text)``: little-endian unsigned 32-bit ids, as ``Tokenizer.encode`` gives them without added tokens."""

    def __init__(self, path: str):
        self._whole = Tokenizer.from_file(path)
        self._units = self._whole.pre_tokenizer
        self._model = self._whole.model
        self._letters = _byte_letters()
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._unit_memo: dict[str, bytes] = {}
        self._memo: dict[str, bytes] = {}

    def _unit(self, mapped: str) -> bytes:
        ids = self._unit_memo.get(mapped)
        if ids is None:
            if len(self._unit_memo) >= MEMO_ENTRIES:
                self._unit_memo.clear()
            ids = self._unit_memo[mapped] = self._ids(mapped)
        return ids

    def _ids(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of letters behind a space: one unit, kept among the parts only, as a part of its own has the same ids."""
        ids = self._memo.get(word)
        return self._keep(word, self._ids((" " + word).encode().decode("latin-1").translate(self._letters))) if ids is None else ids

    def _keep(self, part: str, ids: bytes) -> bytes:
        if len(self._memo) >= MEMO_ENTRIES:
            self._memo.clear()
        self._memo[part] = ids
        return ids

    def _plain(self, piece: str) -> bytes:
        """Ids of a piece whose ends are unit borders; only an ASCII piece is split here, with the tokenizer's pattern."""
        word, mark = (piece, "") if piece[-1:].isalpha() else (piece[:-1], piece[-1:])
        if (word[1:] if word[:1] == " " else word).isalpha() and mark in ("", ",", "."):  # one unit, and maybe a mark
            out = self._word(word[1:]) if word[:1] == " " else self._unit(word.encode().decode("latin-1").translate(self._letters))
            return out + self._unit(mark) if mark else out
        if piece.isascii():
            return b"".join([self._unit(u.translate(self._letters)) for u in _ASCII_UNITS.findall(piece)])
        return b"".join([self._unit(u) for u, _ in self._units.pre_tokenize_str(piece)])

    def _part(self, part: str) -> bytes:
        """Ids of a part that begins with a space; a lone line end is always a unit of its own."""
        if part[1:].isalpha():
            return self._word(part[1:])
        if "\n" in part:
            out = self._unit(self._letters[10]).join([self._plain(p) for p in _LINE_END.split(part)])
        else:
            out = self._plain(part)
        return self._keep(part[1:], out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self._special):
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        parts = text.split(" ")
        if "" in parts or _ODD.search(text):
            parts = _BEFORE_WORD.split(text)
        get = self._memo.get
        ids = [get(p) for p in parts]
        ids[0] = b"".join([self._unit(u) for u, _ in self._units.pre_tokenize_str(parts[0])]) if parts[0] else b""
        if None in ids:
            ids = [self._part(" " + p) if i is None else i for i, p in zip(ids, parts)]
        return b"".join(ids)
