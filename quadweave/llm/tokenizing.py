"""Whole texts to ids with the tokenizers library, one dictionary lookup per word.

Both public vocabularies cut a text into words before any merge, so the ids of a text are the ids
of its words in a row. ``WordEncoder`` cuts at places where the tokenizer cuts too, asks the library
for words it has not met, and keeps the answers of recent words. Tests compare it with the library
on whole texts. Strings of special tokens inside a text are ordinary text.
"""

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

from quadweave.llm.common import KEPT_BY_WORKERS

# Unicode white space, and letters that no other character joins or follows from.
_SPACE = r"\t-\r \x85\xa0  -     　"
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
# A run of such letters is a word of its own before white space, the end, or ASCII punctuation but "'".
_ENDS = rf"(?![^{_SPACE}!-&(-/:-@\[-`{{-~])"

#: Words with the blank before them, and white space as the byte-level vocabulary cuts it.
SPACED = rf" ?[{_LETTER}]++{_ENDS}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words alone, for a vocabulary that drops white space.
PLAIN = rf"[{_LETTER}]++{_ENDS}|[^{_SPACE}]+"

KEPT_WORDS = 100_000


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones stand for themselves."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_BLANK = chr(_BYTE_LETTERS[0x20])
_LETTERS = re.compile(f" ?[{_LETTER}]+").fullmatch


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers; memory is bounded by two generations of words."""

    def __init__(self, path, pattern, kept_words=KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cut = re.compile(pattern).findall
        # The vocabulary that keeps blanks keeps case too; the other folds it before it cuts.
        self.keeps_case = pattern == SPACED
        self.kept_words = kept_words
        self.known, self.older = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        new = set(chain.from_iterable(cuts)).difference(self.known)
        if new:
            if len(self.known) > self.kept_words:
                new.update(chain.from_iterable(cuts))
                self.known, self.older = {}, self.known
            again = new.intersection(self.older)
            self.known.update((w, self.older[w]) for w in again)
            self._learn(new.difference(again))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cuts]

    def _learn(self, words):
        """Runs of letters need no cutting: the library's model takes them as bytes. Others go the whole way."""
        others, tokenize = [], self.tokenizer.model.tokenize
        for w in words:
            if w.isascii() and w.lstrip(" ").isalpha():
                # ASCII letters stand for themselves; the blank before them has a letter of its own.
                plain = w.replace(" ", _BLANK) if self.keeps_case else w.lower()
                self.known[w] = array("I", [t.id for t in tokenize(plain)]).tobytes()
            elif _LETTERS(w):
                plain = w.encode() if self.keeps_case else w.lower().encode()
                tokens = tokenize(plain.decode("latin-1").translate(_BYTE_LETTERS))
                self.known[w] = array("I", [t.id for t in tokens]).tobytes()
            else:
                others.append(w)
        for i in range(0, len(others), 5_000):
            part = others[i : i + 5_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, found))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, kept_words: int = KEPT_WORDS) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    return WordEncoder(path, pattern, kept_words)


KEPT_BY_WORKERS.append(encoder.cache_clear)
