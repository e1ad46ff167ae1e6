"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once by a worker.

A text is cut where the tokenizer's own pre-tokenisation always cuts, so the ids
of the pieces, one after another, are the ids of the text:

* ``spaced=False`` (white space only separates, case does not count): at blanks,
  tabs and newlines.
* ``spaced=True`` (a blank belongs to the word after it): before a blank or a
  newline that stands between two characters that are no white space. Texts with
  any other white space at such places are given to the library as a whole.
* between a letter and the punctuation marks that end a piece.

Ids are kept as bytes, little-endian unsigned 32-bit, so a document is a join of
byte strings.
"""

from __future__ import annotations

import os
import sys
from array import array

from . import memory

#: Pieces that a worker remembers, if not told otherwise; those met a second time only, for most pieces of a text collection occur once.
MAX_PIECES = 300_000
_SEEN = 1 << 22
#: Marks that, ending a piece after a letter, are a pre-token of their own.
_MARKS = ".,;:!?*#$%&+-/=_()[]{}\""


def _byte_letters() -> dict[int, str]:
    """Of byte-level tokenizers: the character that stands for each byte that does not stand for itself."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in same)}


_LETTERS = _byte_letters()
_BLANK = _LETTERS[32]


class _Pieces(dict):
    """Piece -> ids, or None where a piece alone does not tell.

    With ``spaced``, a piece stands for itself after a blank; one that begins with
    a newline stands for itself, one that begins with NUL for what comes after.
    """

    def __init__(self, tokenizer, spaced: bool, most: int):
        super().__init__()
        self.most = most
        self.tokenizer, self.spaced, self.seen, self.marked = tokenizer, spaced, bytearray(_SEEN), 0
        self.model = tokenizer.model

    def __missing__(self, piece: str) -> bytes | None:
        found = self._word(piece) if piece.isalpha() else self._other(piece)
        mark = hash(piece) & (_SEEN - 1)
        if self.seen[mark]:
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
        else:
            self.seen[mark] = 1
            self.marked += 1
            if self.marked > _SEEN // 4:
                self.seen, self.marked = bytearray(_SEEN), 0
        return found

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Letters are one pre-token, so the library's model alone tells their ids."""
        if self.spaced:
            text = _BLANK + (word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))
        elif word.isascii():
            text = word.lower()
        elif max(word) < "\u0250" and "\u0130" not in word:  # normal form already, and simple lower case
            text = word.lower().encode().decode("latin-1").translate(_LETTERS)
        else:
            return self.whole(word)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _other(self, piece: str) -> bytes | None:
        lead, body = " ", piece
        if not self.spaced:
            lead = ""
        elif piece[:1] == "\n":
            lead, body = "\n", piece[1:]
        elif piece[:1] == "\0":
            lead, body = "", piece[1:]
        if not body:
            return None if self.spaced and lead else b""
        if self.spaced and (body[0].isspace() or body[-1].isspace()):
            return None
        word = body.rstrip(_MARKS)
        if word and word != body and word[-1].isalpha() and word[-1] != "\u0130":  # its lower case ends with a mark
            marks = body[len(word) :]
            head, tail = self[piece[: -len(marks)]], self["\0" * self.spaced + marks]
            return None if head is None else head + tail
        return self.whole(lead + body)


class Encoder:
    def __init__(self, path: str, spaced: bool, most: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise ValueError("ids are kept in the machine's order, which must be little-endian")
        self.known = _Pieces(Tokenizer.from_file(path), spaced, most)
        self.spaced = spaced

    def encode(self, text: str) -> bytes:
        if not self.spaced:
            text = text.lower() if text.isascii() else text  # as the tokenizer does; so fewer pieces differ
            return b"".join(map(self.known.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))
        if " \n" in text or "  " in text or "\0" in text:
            return self.known.whole(text)
        try:
            return b"".join(map(self.known.__getitem__, ("\0" + text.replace("\n", " \n")).split(" ")))
        except TypeError:  # a None: white space where a piece can't tell what is next to it
            return self.known.whole(text)


def encoder(path: str, spaced: bool, most: int = MAX_PIECES) -> Encoder:
    """One encoder for each Python worker; it lives on from task to task and remembers ``most`` pieces."""
    known = memory.of("tokens")
    if (path, spaced) not in known:
        known[path, spaced] = Encoder(path, spaced, most)
    return known[path, spaced]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
