"""Syllables by hyphenation rules: where the vowels of a word part, and how the consonants between them are shared out.

Spanish: two neighbouring strong vowels part, as does an accented weak one beside a strong one; other
vowels in a row are one syllable. English: vowels in a row are one syllable but for a few pairs that part,
and a final e, -es or -ed that isn't spoken makes none. Consonants: one goes with the vowel after it; of
several the last, or the last two if they belong together, go with it.
"""

from __future__ import annotations

import re

_WEAK_BESIDE_STRONG = re.compile(r"[aeoáéíóú](?=[aeoáéíóú])")
_SPANISH_VOWELS = re.compile(r"[aeiouáéíóúü]+|(?<=[^\Waeiouáéíóúü])y$|^y$")
_ENGLISH_VOWELS = re.compile(r"[aeiou]+y?|(?<!^)y|^y(?![aeiou])")
#: Pairs of vowels that part: ``i`` before a or o (not after t, s, c, g: ``nation``), ``e`` before um, ``u`` before a or o (not after q, g), ``y`` before i.
_ENGLISH_PARTS = re.compile(r"(?<![tscg])i(?=[ao])|e(?=um)|(?<![qg])u(?=[ao](?!y))|y(?=i)")
_SILENT = re.compile(r"(?<=[^aeiouy])e$|(?<=[^aeiouysxzcg])(?<![cs]h)es$|(?<=[^aeiouytd])ed$")
_LE = re.compile(r"[^aeiouy]les?$")
#: Consonants that stay together before a vowel.
_SPANISH_TOGETHER = frozenset("pr br tr dr cr gr fr pl bl cl gl fl ll rr ch qu gu".split())
_ENGLISH_TOGETHER = frozenset("pr br tr dr cr gr fr pl bl cl gl fl ch qu th sh ph wh st sp sc".split())


def _cut(word: str, nuclei: list[tuple[int, int]], together: frozenset[str]) -> list[str]:
    """The word cut between its nuclei (start and end of each)."""
    cuts = []
    for (_, a), (b, _) in zip(nuclei, nuclei[1:]):
        n = b - a  # consonants between two nuclei
        cuts.append(b - (2 if n > 1 and word[b - 2 : b] in together else min(n, 1)))
    return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]


def spanish(word: str) -> list[str]:
    """Syllables of a word in lower case, at least one."""
    nuclei = []
    for m in _SPANISH_VOWELS.finditer(word):
        at = m.start()
        for p in _WEAK_BESIDE_STRONG.finditer(word, m.start(), m.end()):
            nuclei.append((at, p.end()))
            at = p.end()
        nuclei.append((at, m.end()))
    return _cut(word, nuclei, _SPANISH_TOGETHER) if nuclei else [word]


def english(word: str) -> list[str]:
    """Syllables of a word in lower case, at least one."""
    silent = None if _LE.search(word) else _SILENT.search(word)
    end = silent.start() if silent else len(word)
    nuclei = []
    for m in _ENGLISH_VOWELS.finditer(word, 0, end):
        at = m.start()
        for p in _ENGLISH_PARTS.finditer(word, m.start(), m.end()):
            if p.end() < m.end():
                nuclei.append((at, p.end()))
                at = p.end()
        nuclei.append((at, m.end()))
    if not nuclei:
        return [word]
    return _cut(word, nuclei, _ENGLISH_TOGETHER)
