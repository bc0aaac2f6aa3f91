"""Word splitting for the two public BPE vocabularies.

Both split a text by a regular expression before any merge, so a word's ids
can be kept and used again.  Where a text has letters of Latin-1 and Latin
Extended-A only, the standard library's faster expressions with the letters
written out are the same; other texts take the ``regex`` module's properties.
"""

from __future__ import annotations

import re

import regex

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_SPACE = r"\t-\r "
PLAIN = re.compile(f"[^\x00-\x1b\x20-\x7f{_LETTERS[6:]}]")  # finds what is not plain; \x1c-\x1f differ between engines
ODD_STOP = re.compile(f"(?<![{_LETTERS}])[,.]")  # a comma or full stop that does not follow a letter
ODD_SPACE = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x01")
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PLAIN = re.compile(f"{_TAILS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}0-9{_LETTERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
BYTE_ANY = regex.compile(rf"{_TAILS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
WORD_PLAIN = re.compile(f"{_TAILS}|[{_LETTERS}]+|[0-9]|[^{_SPACE}0-9{_LETTERS}]+")


#: Words that a worker keeps in each of two generations.
KEPT = 200_000


class Kept(dict):
    """What is known of a word, computed when first asked for; words not used for two generations go."""

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.find(word)
        self[word] = value
        return value

    def recall(self) -> Kept:
        """Itself, after dropping the older generation if this one is full; between two texts."""
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()
        return self


def is_plain(text: str) -> bool:
    return not PLAIN.search(text)


def byte_words(text: str) -> list[str]:
    return (BYTE_PLAIN if is_plain(text) else BYTE_ANY).findall(text)


def byte_stretches(text: str) -> list[str]:
    """The text cut where a word of ``byte_words`` surely begins or ends, most often into single words.

    With single spaces and line feeds only, a word begins at each space, a line
    feed is a word, and a comma or full stop behind a letter begins one.  A
    text of another shape is returned whole.
    """
    if not text or any(x in text for x in ODD_SPACE) or ODD_STOP.search(text) or not is_plain(text) or text[-1] in " \n":
        return [text]
    cut = text.replace(" ", "\x01 ").replace(",", "\x01,").replace(".", "\x01.").replace("\n", "\x01\n\x01")
    return cut.split("\x01")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest is numbered from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
