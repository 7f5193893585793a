r"""Byte-level BPE of whole texts through the tokenizers library, which sees each distinct piece once.

A pre-token of the byte-level pattern is ``'s``-like, `` ?letters``, `` ?digits``, `` ?others`` or white space, so:
  - no pre-token holds a non-space followed by white space, and
  - a blank before a non-space starts a pre-token, however long the white space run that it ends.
Cuts at such places never change the ids. White space is judged by Python's wider class, which includes the
pattern's; where the two differ no cut is made. A text with an added token's string, or with U+0001, is encoded whole.
New pieces go to the library as one text, a piece after a piece, and are told apart by the tokens that start with a
blank.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain, compress, filterfalse
from operator import not_

import numpy as np

#: Distinct pieces that a worker remembers, in two halves of which the older is dropped when the younger is full.
#: Pieces and texts in a call.
PIECES_HELD, PIECES_A_CALL, TEXTS_A_CALL = 1_200_000, 4_000, 300
_BLANK_CUT = re.compile(r" (?=\S)")
_MARKS = frozenset(string.punctuation)
#: White space but for blanks and line ends.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class BytePieces:
    """Keeps for each piece its number of ids or, with a dtype, their bytes."""

    def __init__(self, path: str, dtype: str | None = None, held: int = PIECES_HELD) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype, self.held, self.known, self.older = dtype, held, {}, {}
        size = self.library.get_vocab_size()
        tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.blank = np.array([t.startswith("Ġ") for t in tokens])
        self.line = np.array([t == "Ċ" for t in tokens])

    def pieces(self, text: str) -> list[str] | None:
        """Piece codes of a text: ``\\x01x`` is x, a line end is itself, other x are a blank and x."""
        if "\x01" in text or any(a in text for a in self.added):
            return None
        if not text:
            return []
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _RARE.search(text):
            first, *rest = _BLANK_CUT.split(text)
            return ["\x01" + first, *rest] if first else rest
        return ("\x01" + text).replace("\n", " \n \x01").split(" ")

    def _value(self, ids: list[int]) -> int | bytes:
        return len(ids) if self.dtype is None else np.array(ids, dtype=self.dtype).tobytes()

    def _raw(self, code: str) -> str:
        return code[1:] if code[0] == "\x01" else code if code == "\n" else " " + code

    def _together(self, codes: list[str], text: str, starts: np.ndarray) -> None:
        """Codes whose pieces make up the text, told apart by the flagged tokens."""
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
        at = np.flatnonzero(starts[ids])
        if len(at) != len(codes):
            for c in codes:
                self.known[c] = self._value(self.library.encode(self._raw(c), add_special_tokens=False).ids)
            return
        first = at + 1 if starts is self.line else at
        ends = np.append(at[1:], len(ids))
        if self.dtype is None:
            self.known.update(zip(codes, (ends - first).tolist()))
            return
        data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        self.known.update(zip(codes, [data[a:b] for a, b in zip((first * width).tolist(), (ends * width).tolist())]))

    def _learn(self, new: set[str]) -> None:
        """A letter followed by ASCII marks up to the piece's end: the marks are a pre-token of their own."""
        marked = [c for c in new if c[-1] in _MARKS]
        wanted, joined = new.difference(marked), []
        for c in marked:
            stem = c.rstrip(string.punctuation)
            if stem and stem[-1] < "\u0250" and stem[-1].isalpha():
                tail = "\x01" + c[len(stem) :]
                joined.append((c, stem, tail))
                wanted.add(stem)
                wanted.add(tail)
            else:
                wanted.add(c)
        wanted = list(filterfalse(self.known.__contains__, wanted))
        plain = [c for c in wanted if c[0] != "\x01" and c.split() == [c]]
        fresh = [c for c in wanted if c[0] == "\x01" and c[1:].split() == [c[1:]]]
        odd = set(wanted).difference(plain, fresh)
        for at in range(0, len(plain), PIECES_A_CALL):
            part = plain[at : at + PIECES_A_CALL]
            self._together(part, " " + " ".join(part), self.blank)
        for at in range(0, len(fresh), PIECES_A_CALL):
            part = fresh[at : at + PIECES_A_CALL]
            self._together(part, "".join("\n" + c[1:] for c in part), self.line)
        for c in odd:
            self.known[c] = self._value(self.library.encode(self._raw(c), add_special_tokens=False).ids)
        for c, stem, tail in joined:
            self.known[c] = self.known[stem] + self.known[tail]

    def _some(self, texts: list[str]) -> list[list]:
        cut = [self.pieces(t) for t in texts]
        rows = [list(map(self.known.get, codes)) if codes else [] for codes in cut]
        missed = [list(compress(codes, map(not_, values))) if codes else [] for codes, values in zip(cut, rows)]  # no piece is without ids
        new = set(chain.from_iterable(missed))
        if new:
            if len(self.known) + len(new) > self.held // 2:
                self.older, self.known = self.known, {}
            back = {c: v for c in new if (v := self.older.get(c)) is not None}
            self.known.update(back)
            self._learn(new.difference(back) if back else new)
        known = self.known
        out = []
        for t, codes, values, gone in zip(texts, cut, rows, missed):
            if codes is None:
                out.append([self._value(self.library.encode(t, add_special_tokens=False).ids)])
            else:
                out.append([v or known[c] for c, v in zip(codes, values)] if gone else values)
        return out

    def totals(self, texts: list[str]) -> list[int] | list[bytes]:
        """For each text the number of its ids, or their bytes."""
        out: list = []
        for at in range(0, len(texts), TEXTS_A_CALL):
            out += [sum(v) if self.dtype is None else b"".join(v) for v in self._some(texts[at : at + TEXTS_A_CALL])]
        return out
