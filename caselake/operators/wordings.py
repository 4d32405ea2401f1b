"""Vocabularies of up to MOST_ENTRIES wordings found in one pass over a text, by an automaton in Arrow batches.

The automaton holds the first words; where one is met, its word is split into what stands before and after, and the rest of the wording is
followed word by word. The cost of a text does not depend on the size of the vocabulary, and neither does the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick

from ..functions import text as X

MOST_ENTRIES = 5_000

# Letters that may be attached before a word, one of each group, and the article with its form after lam.
CONJUNCTIONS, PREPOSITIONS, ARTICLE, LAM_ARTICLE = ("", "و", "ف"), ("", "ب", "ل", "ك"), "ال", "لل"
# Endings that a word may take.
ENDINGS = (
    "ين", "ون", "ان", "ات", "تين", "تان", "تي", "تك", "ته", "تها", "تهم", "تنا", "يه", "يها", "يهم", "نا", "ها", "هم", "هما", "هن", "كم", "كما", "وا", "تا", "ي", "ه", "ا", "ى", "ت", "ك",
)
#: What may stand before a noun of a phrase, and before a name that keeps its own article.
PARTICLES = frozenset("".join(p) for p in product(CONJUNCTIONS, PREPOSITIONS, ("", ARTICLE))) | frozenset(c + LAM_ARTICLE for c in CONJUNCTIONS)
NAME_PARTICLES = frozenset("".join(p) for p in product(CONJUNCTIONS, PREPOSITIONS))
LAM_PARTICLES = frozenset(c + LAM_ARTICLE for c in CONJUNCTIONS)
_ANY_ENDING, _SOME_ENDING, _NO_ENDING = frozenset(ENDINGS) | {""}, frozenset(ENDINGS), frozenset({""})

_FOLD = dict(zip(X.FOLD_FROM, X.FOLD_TO, strict=True)) | dict.fromkeys(X.TATWEEL + X.MARKS + X.BIDI, "")
WORD = re.compile(r"\w+")


def folded(phrase: str) -> str:
    """The search form of a vocabulary entry, as ``functions.text.normalize`` gives it."""
    return " ".join("".join(_FOLD.get(ch, ch) for ch in phrase).split())


@dataclass(frozen=True)
class Form:
    """One way to write a word: a stem between one of some beginnings and one of some endings."""

    stem: str
    before: frozenset[str]
    after: frozenset[str]

    def fits(self, word: str) -> bool:
        at = word.find(self.stem)
        while at >= 0:
            if word[:at] in self.before and word[at + len(self.stem) :] in self.after:
                return True
            at = word.find(self.stem, at + 1)
        return False


def inflected(raw: str) -> list[Form]:
    """The forms of a word of a phrase: its article is one of the particles, and a final taa marbuta opens into a taa before an ending."""
    word = folded(raw)
    if word.startswith(ARTICLE) and len(word) > 4:
        word = word[len(ARTICLE) :]
    forms = [Form(word, PARTICLES, _ANY_ENDING)]
    return [*forms, Form(word[:-1] + "ت", PARTICLES, _SOME_ENDING)] if raw.endswith("ة") else forms


def as_name(raw: str) -> list[Form]:
    """The forms of a name's first word: particles before it, of which lam swallows the alif of an article."""
    word = folded(raw)
    return [Form(word, NAME_PARTICLES, _NO_ENDING), *([Form(word[len(ARTICLE) :], LAM_PARTICLES, _NO_ENDING)] if word.startswith(ARTICLE) else [])]


def exact(raw: str) -> list[Form]:
    return [Form(folded(raw), _NO_ENDING, _NO_ENDING)]


def bounded(entries: list) -> None:
    """Refuse a vocabulary that is too large for one pass, before a row is read."""
    if len(entries) > MOST_ENTRIES:
        raise ValueError("too many wordings for one pass")


@dataclass
class Finder:
    """Finds wordings, each a list of words with their forms, in texts in search form."""

    wordings: list[list[list[Form]]]
    first: ahocorasick.Automaton = field(init=False)

    def __post_init__(self):
        bounded(self.wordings)
        by: dict[str, list[tuple[int, Form]]] = {}
        for i, words in enumerate(self.wordings):
            for form in words[0]:
                by.setdefault(form.stem, []).append((i, form))
        self.first = ahocorasick.Automaton()
        for stem, entries in by.items():
            self.first.add_word(stem, (len(stem), entries))
        if by:
            self.first.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(wording, start, end) of whole-word matches, by place."""
        if not len(self.first):
            return
        found = set()
        for last, (n, entries) in self.first.iter(text):
            begin = last + 1 - n
            start, end = edge(text, begin, -1), edge(text, last + 1, 1)
            before, after = text[start:begin], text[last + 1 : end]
            for i, form in entries:
                if before in form.before and after in form.after and (stop := self._rest(text, end, self.wordings[i][1:])) is not None:
                    found.add((start, stop, i))
        for start, stop, i in sorted(found):
            yield i, start, stop

    @staticmethod
    def _rest(text: str, at: int, words: list[list[Form]]) -> int | None:
        """Where the rest of a wording ends, each word after white space; None if it does not follow."""
        for forms in words:
            m = WORD.search(text, at)
            if not m or m.start() == at or text[at : m.start()].strip() or not any(f.fits(m[0]) for f in forms):
                return None
            at = m.end()
        return at


def edge(text: str, at: int, step: int) -> int:
    """The end of the word around a place, backwards or forwards."""
    while (0 < at if step < 0 else at < len(text)) and ((ch := text[at - 1 if step < 0 else at]).isalnum() or ch == "_" or WORD.match(ch)):
        at += step
    return at


def words_before(text: str, at: int, most: int = 3) -> list[str]:
    """Up to ``most`` words that stand before a place, nearest first, each followed by white space only."""
    out: list[str] = []
    while len(out) < most:
        end = len(text[max(0, at - 80) : at].rstrip()) + max(0, at - 80)
        start = edge(text, end, -1)
        if end == at or start == end:
            break
        out.append(text[start:end])
        at = start
    return out


def next_word(text: str, at: int, adjacent: bool = False) -> str:
    """The next word; ``adjacent``: only if white space alone lies between."""
    m = WORD.search(text, at)
    return "" if not m or m.start() == at or (adjacent and text[at : m.start()].strip()) else m[0]


def cached(build: Callable[[], object]) -> Callable[[], object]:
    """A value that each worker builds once, at its first use."""
    made: list[object] = []

    def get() -> object:
        if not made:
            made.append(build())
        return made[0]

    return get
