"""Words of texts for the operators: a batch of texts as numbered tokens, lines and pieces; folding and print shapes.

Operators that only need counts and sums over a text look at each distinct token of a task once and add up
numbers: a batch of texts becomes one array of token codes, and what is known of a token is a row of a table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd

#: A word: a run of letters of any script.
WORD = re.compile(r"[^\W\d_]+")
#: A word of the readability counts: a run of Spanish letters (fixed by the problem statement).
SPANISH_WORD = r"[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]+"
#: A rough piece ends with a token that ends in a mark and closing quotes if the next token starts with a capital, and at a line's end.
_ENDS = re.compile(r"[.!?…][\"'”»)\]]*$")
_STARTS = re.compile(r"[\"“«¿¡(—-]*[A-ZÁÉÍÓÚÑ]")
#: Characters handled at once and tokens remembered, so that memory stays bounded.
PART, REMEMBERED = 4_000_000, 300_000


class Memo(dict):
    """What a function gives for each token, computed once; emptied when it holds too many."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) > REMEMBERED:
            self.clear()
        got = self[key] = self.of(key)
        return got


@dataclass
class Parsed:
    """Texts as one array of token codes."""

    n: int  # texts
    tokens: np.ndarray  # distinct tokens
    codes: np.ndarray  # of all tokens in order
    per_line: np.ndarray  # tokens of each line that isn't blank
    per_text: np.ndarray  # such lines of each text

    @cached_property
    def line_ends(self) -> np.ndarray:
        return np.cumsum(self.per_line)

    @cached_property
    def owner(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.repeat(np.arange(self.n), self.per_text), self.per_line)

    def table(self, memo: Memo, kind=np.int64) -> np.ndarray:
        """A row of numbers for each distinct token."""
        return np.array([memo[t] for t in self.tokens], dtype=kind)

    @cached_property
    def piece(self) -> np.ndarray:
        """The number of the rough piece each token is in; pieces don't cross lines."""
        if not len(self.codes):
            return np.zeros(0, dtype=np.int64)
        marks = self.table(_BOUNDS, bool)
        ends, starts = marks[self.codes, 0], marks[self.codes, 1]
        new = np.zeros(len(self.codes), dtype=bool)
        new[1:] = ends[:-1] & starts[1:]
        new[self.line_ends[:-1]] = True
        return np.cumsum(new)


_BOUNDS = Memo(lambda t: (_ENDS.search(t) is not None, _STARTS.match(t) is not None))


def totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` over consecutive groups of the given sizes; 0 for groups of none."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def parse(texts: list[str | None]) -> Parsed:
    tokens: list[str] = []
    per_line: list[int] = []
    per_text = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            before = len(per_line)
            for line in t.split("\n"):
                own = line.split()
                if own:
                    tokens += own
                    per_line.append(len(own))
            per_text[i] = len(per_line) - before
    flat = np.empty(len(tokens), dtype=object)
    flat[:] = tokens
    codes, distinct = pd.factorize(flat)
    return Parsed(len(texts), distinct, codes.astype(np.int64), np.array(per_line, dtype=np.int64), per_text)


def parts(frame: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """A frame in stretches of rows of at most PART characters, or a single longer one."""
    size = frame[column].str.len().fillna(0).to_numpy(dtype=float)
    group = np.floor(np.cumsum(size) / PART)
    cuts = [0, *np.flatnonzero(np.diff(group) > 0) + 1, len(frame)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield frame.iloc[a:b]


_COMBINING = {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text.lower()).translate(_COMBINING)


#: Letters that scans confuse, each spelt out as the narrowest shapes it can fall apart into: m as rn, n as ri,
#: d as cl, h as li, u as ii, and l, 1, j, | as i. Spelling out, unlike joining, gives the same whatever came first.
_SHAPES = str.maketrans({"m": "rri", "n": "ri", "d": "ci", "h": "ii", "u": "ii", "l": "i", "1": "i", "j": "i", "|": "i", "!": "i", "0": "o", "5": "s", "$": "s", "6": "b", "9": "g", "q": "g", "f": "t", "y": "v", "e": "c", "@": "a", "(": "c"})


def print_shape(text: str) -> str:
    """A folded text in which letters that scans confuse look the same."""
    return text.translate(_SHAPES)


class Languages:
    """Which of some languages a token is of: log-odds of its letter trigrams, counted in sample texts with add-one smoothing.

    The table is bounded by the samples, a fixed small set of texts.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        counts: list[dict[str, int]] = []
        for name in self.names:
            own: dict[str, int] = {}
            for text in samples[name]:
                for w in WORD.findall((text or "").lower()):
                    for g in self._grams(w):
                        own[g] = own.get(g, 0) + 1
            counts.append(own)
        known = sorted(set().union(*counts))
        size = [sum(c.values()) + len(known) + 1 for c in counts]
        self.table = {g: [float(np.log((c.get(g, 0) + 1) / s)) for c, s in zip(counts, size)] for g in known}
        self.unseen = [float(np.log(1 / s)) for s in size]

    @staticmethod
    def _grams(word: str) -> list[str]:
        padded = f"^{word}$"
        return [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]

    def evidence(self, token: str) -> list[float]:
        """Log-likelihood of the token's words under each language."""
        rows = [self.table.get(g, self.unseen) for w in WORD.findall(token.lower()) for g in self._grams(w)]
        return [sum(x) for x in zip(*rows)] if rows else [0.0] * len(self.names)
