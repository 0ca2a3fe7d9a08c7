"""Problem 3: sentence boundaries across languages and scripts.

A hidden-event n-gram model: a boundary token <S> may stand in each gap where a sentence could end (after a
run of sentence marks with its closing quotes, or at a space of a script without marks). For each gap the
model compares P(<S> | words before) x P(word after | <S>, kind of mark) with P(no <S> | words before) x P(word after | no <S>,
kind of mark), where words before back off from the last two words to the last word to its shape. A
two-state chain over the gaps of a paragraph (is there a boundary; how many words since the gap before)
is solved by forward-backward, and a boundary stands where its posterior exceeds one half.

Training needs no labelled text: blank lines, ends of texts and ends of stored units are sure boundaries,
and a first estimate of P(<S> | words before) is how often these words stand at a sure boundary. Rounds of
expectation-maximization over all texts then count the expected events.

The gaps of all texts are found once and written as numbers; training and decoding read only these, a
batch at a time, as arrays. Counts are of all gaps; the model keeps those of the MOST_CONTEXTS most frequent
contexts, so what is collected and broadcast has a fixed bound, and rarer contexts back off to shorter ones.

Structure that isn't left to the model: a blank line always ends a sentence; inside a quote or bracket
that is closed in its paragraph none ends; at a space beside a numeral of a script without marks none ends.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sacbe.llm.words import Memo, parts
from sacbe.storage import materialize, table

#: Contexts the model keeps, the most frequent ones.
MOST_CONTEXTS = 1 << 21
ROUNDS = 2
#: Weights with which less specific counts enter more specific ones.
BACK_OFF, KIND_BACK_OFF = 3.0, 300.0
#: The first estimate leans more on the shape: a word seen few times may stand at no sure boundary by chance.
FIRST_BACK_OFF = 8.0
#: Weight of the prior that a bare space of a script without marks is a boundary.
BARE = 100.0

_CLOSE = "\"'”’»）)\\]】」』›"
_OPEN = "“«„「『（(\\[【‹‘"
#: Marks that can end a sentence in some script (the model decides whether they do).
_MARKS = ".!?…。！？।॥؟۔；;։።፧፨᙮‽⁇⁈⁉។៕၊။"
_WIDE = "。！？；…」』）】”’»"
#: Letters of scripts that put spaces between sentences and use no marks: Thai, Lao, Khmer, Tibetan.
_UNMARKED = "฀-๿຀-໿ក-ៜ"
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: A run of marks and what closes with it, then a gap: spaces, or none before a capital, an opening mark or in scripts without spaces.
_GAP = re.compile(rf"[{_MARKS}]+(?:[^\S\n]?[{_CLOSE}]|[{_MARKS}])*(?P<space>\s*)(?=(?P<next>\S))")
_BARE = re.compile(rf"(?<=[{_UNMARKED}])\s+(?=[^\s\d])")
_ANY_UNMARKED = re.compile(rf"[{_UNMARKED}]")
_LAST_RUN = re.compile(rf"[{_MARKS}]+(?:[^\S\n]?[{_CLOSE}]|[{_MARKS}])*$")
_TOKEN = re.compile(r"\S+")
_QUOTES = re.compile(r"[“”„«»「」『』（）()\[\]\"]")
_PAIR = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", '"': '"'}
_ROMAN = re.compile(r"[IVXLC]+\W*")
_OPENING, _CLOSING = _OPEN.replace("\\", ""), _CLOSE.replace("\\", "")
_EDGES = "¿¡" + _OPENING + _CLOSING + "—–-•·"
_LEADS = frozenset("¿¡“«„「『（(—–-•")


def _h(*parts: str) -> int:
    """A hash of 31 bits."""
    return xxhash.xxh64_intdigest("\x00".join(parts)) >> 33


SHAPES = ("mark", "number", "capital1", "roman", "capital", "lower1", "lower4", "lower", "other")
SHAPE = {s: k for k, s in enumerate(SHAPES)}


def _shape(word: str) -> str:
    """Case and kind of a word: what n-grams back off to."""
    core = word.strip(_EDGES)
    if not core:
        return "mark"
    c = core[0]
    if c.isdigit():
        return "number"
    if c.isupper():
        return "capital1" if len(core.rstrip(_MARKS)) == 1 else "roman" if _ROMAN.fullmatch(core) else "capital"
    if c.islower():
        n = len(core.rstrip(_MARKS))
        return "lower1" if n == 1 else "lower4" if n <= 4 else "lower"
    return "other" if c.isalpha() else "mark"


#: What a run ends with: an ellipsis in either width, a mark of one sentence, a mark with a closing quote, none.
ENDINGS = ("none", "ellipsis", "stop", "call", "quoted", "wide", "half")
N_SHAPES = len(SHAPES) * len(ENDINGS)


def _ending(run: str) -> int:
    if not run:
        return 0
    if run[-1] in "\"'”’»）)]】」』›":
        return ENDINGS.index("quoted")
    if "…" in run or run.endswith(".."):
        return ENDINGS.index("ellipsis")
    if run[-1] in ";；":
        return ENDINGS.index("half")
    if run[-1] in "。！？।॥؟۔":
        return ENDINGS.index("wide")
    return ENDINGS.index("call" if run[-1] in "!?" else "stop")


_RUNS = Memo(lambda run: (re.sub(r"\s", "", run), _ending(re.sub(r"\s", "", run))))


def _opened(word: str) -> int:
    """Hash of what a sentence would begin with: the shape of a word in scripts with case, else its first two letters."""
    shape = _shape(word)
    lead = word[:1] if word[:1] in _LEADS else ""
    if shape == "other":
        return _h("a", lead, word.lstrip("“«„「『（(—–-• ")[:2])
    if len(word) == 1 and not word.isalnum():  # an opening mark set apart by a space
        return _h("a", lead, "apart")
    return _h("a", lead, shape, word.lower() if shape.startswith("lower") and len(word) <= 4 else "")


def _ended(word: str) -> tuple[str, int]:
    """A word as the context of a gap, and the place of its shape."""
    shape = SHAPE[_shape(word)]
    if SHAPES[shape] == "other" and len(word) > 6:
        word = word[-2:]
    return "9" if SHAPES[shape] == "number" else word.lower().lstrip("¿¡" + _OPENING), shape


def _earlier(word: str) -> str:
    """A word as the wider context of a gap."""
    word = word.lower()
    if word.rstrip(",;:)")[-1:].isdigit():
        return "9"
    return word[-2:] if ord(word[-1]) > 0x2E7F else word


_AFTER, _BEFORE, _EARLIER = Memo(_opened), Memo(_ended), Memo(_earlier)


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Offsets of the parts between blank lines, white space left out."""
    out, at = [], 0
    for m in [*_PARAGRAPH.finditer(text), None]:
        a, b = at, (len(text) if m is None else m.start())
        while a < b and (text[a].isspace() or text[a] in "​﻿"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in "​﻿"):
            b -= 1
        if a < b:
            out.append((a, b))
        if m is not None:
            at = m.end()
    return out


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotes and brackets of a paragraph that are closed in it; those never closed don't count, nor do those inside."""
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}  # how many on the stack wait for each closing mark
    found: list[tuple[int, int]] = []
    for m in _QUOTES.finditer(text, a, b):
        c = m[0]
        if open_.get(c):
            while True:  # what was opened inside and not closed is forgotten
                want, s = stack.pop()
                open_[want] -= 1
                if want == c:
                    break
            while found and found[-1][0] > s:
                found.pop()
            found.append((s, m.start()))
        elif c in _PAIR:
            stack.append((_PAIR[c], m.start()))
            open_[_PAIR[c]] = open_.get(_PAIR[c], 0) + 1
    return found


class _Words:
    """The white-space tokens of a paragraph, and the words on both sides of a place; a word also begins where a gap ends."""

    def __init__(self, text: str, a: int, b: int):
        self.text, self.a = text, a
        self.starts, self.ends = [], []
        for m in _TOKEN.finditer(text, a, b):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def number(self, at: int) -> int:
        """Which token a place is in, or the one before it."""
        return bisect_right(self.starts, at) - 1

    def after(self, at: int, until: int) -> int:
        """Hash of the word that begins at a place; its letters count up to ``until`` (the next mark may be far in scripts without spaces)."""
        return _AFTER[self.text[at : min(self.ends[self.number(at)], max(until, at + 1))]]

    def before(self, mark: int, gap: int, gap_before: int) -> tuple[str, str, int]:
        """The last two words before the marks at a place, and the shape of the last; ``gap``: where the part after the last gap begins."""
        k = self.number(mark - 1)
        start = max(self.starts[k], gap) if k >= 0 and self.ends[k] >= mark else mark
        word, shape = _BEFORE[self.text[start:mark]]
        if start > self.starts[k] and k >= 0:  # a gap without a space lies inside the token
            return _EARLIER[self.text[max(self.starts[k], gap_before) : start]] if start > max(self.starts[k], gap_before) else "^", word, shape
        if k < 1:
            return "^", word, shape
        return _EARLIER[self.text[max(self.starts[k - 1], min(gap_before, self.ends[k - 1] - 1)) : self.ends[k - 1]]], word, shape


#: Numbers of a gap: end of the marks, start of what follows, hashes of two words and of one word before, shape with ending, hash of what follows, words since the gap before (3 for more), is it inside a quote.
GAP = ("fin", "inicio", "dos", "una", "forma", "sigue", "palabras", "dentro")


def gaps(text: str, a: int, b: int, words: _Words) -> list[tuple]:
    """The places of a paragraph where a sentence may end, as tuples of GAP."""
    found = [(m.start(), m.start("space"), m.end("space"), m["next"]) for m in _GAP.finditer(text, a, b)]
    if _ANY_UNMARKED.search(text, a, b):
        found = sorted(found + [(m.start(), m.start(), m.end(), "") for m in _BARE.finditer(text, a, b)])
    if not found:
        return []
    spans = _spans(text, a, b)
    out = []
    k = 0
    last = previous = a
    for i, (mark, end, start, nxt) in enumerate(found):
        if end == start:
            wide = text[end - 1] in _WIDE and (ord(nxt) > 0x2E7F or nxt in "“「『（«")
            loose = text[end - 1] not in ";；" and (nxt.isupper() or nxt in "¿¡“«„" or (ord(nxt) > 0x52F and nxt.isalpha())) and mark > a and (text[mark - 1].isalpha() or text[mark - 1].isdigit() or text[mark - 1] in _CLOSE)
            if not (wide or loose):
                continue
        while k < len(spans) and spans[k][1] < end - 1:
            k += 1
        inside = k < len(spans) and spans[k][0] < mark and end - 1 < spans[k][1]
        run, ending = _RUNS[text[mark:end]]
        earlier, word, shape = words.before(mark, last, previous)
        since = words.number(end - 1) - words.number(last) + 1
        until = found[i + 1][1] if i + 1 < len(found) else b
        out.append((end, start, _h("3", earlier, word, run), _h("2", word, run), shape * len(ENDINGS) + ending, words.after(start, until), min(max(since, 1), 3), inside))
        previous, last = last, start
    return out


#: Numbers of a paragraph: its offsets, how many gaps it has, and the context of its sure end (-1 if it has none) and of its beginning.
PARAGRAPH = ("desde", "hasta", "cuantos", "fin_dos", "fin_una", "fin_forma", "comienzo")


def analysed(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """The paragraphs (PARAGRAPH) and gaps (GAP) of a text."""
    text = text or ""
    out, every = [], []
    for a, b in paragraphs(text):
        words = _Words(text, a, b)
        own = gaps(text, a, b, words)
        last = own[-1][1] if own else a
        previous = own[-2][1] if len(own) > 1 else a
        tail = _LAST_RUN.search(text, max(last, a), b)
        end = (-1, -1, -1)
        if tail or _ANY_UNMARKED.match(text, b - 1):
            mark = tail.start() if tail else b
            run, ending = _RUNS[text[mark:b]]
            earlier, word, shape = words.before(mark, last, previous)
            end = (_h("3", earlier, word, run), _h("2", word, run), shape * len(ENDINGS) + ending)
        out.append((a, b, len(own), *end, words.after(a, b if not own else own[0][0])))
        every += own
    return out, every


def find_gaps(rows: DataFrame) -> DataFrame:
    """tabla, registro, texto and, as arrays, the paragraphs and gaps of each text. One pass; texts are read whole."""
    names = [*(f"p_{c}" for c in PARAGRAPH), *(f"g_{c}" for c in GAP)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for x in parts(whole, "texto"):
                got: list[list] = [[] for _ in names]
                for t in x["texto"]:
                    p, g = analysed(t)
                    for k, c in enumerate([*(zip(*p) if p else [()] * len(PARAGRAPH)), *(zip(*g) if g else [()] * len(GAP))]):
                        got[k].append(np.array(c, dtype=np.int32))
                yield pd.DataFrame({**{c: x[c].to_numpy() for c in ("tabla", "registro", "texto")}, **dict(zip(names, got))})

    return rows.select("tabla", "registro", "texto").mapInPandas(run, "tabla string, registro bigint, texto string, " + ", ".join(f"{c} array<int>" for c in names))


@dataclass
class Batch:
    """Gaps and paragraphs of a batch of texts, each number of them in one array."""

    gap: dict[str, np.ndarray]
    paragraph: dict[str, np.ndarray]

    @staticmethod
    def of(x: pd.DataFrame) -> Batch:
        def flat(prefix: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
            return {c: np.concatenate([*x[f"{prefix}_{c}"], np.zeros(0, np.int32)]).astype(np.int64) for c in names}

        return Batch(flat("g", GAP), flat("p", PARAGRAPH))


#: Kinds of counts: contexts of two words, of one, of a shape with its ending; what follows a gap by the ending before it; the chain.
TWO, ONE, FORM, NEXT, CHAIN = range(5)
#: What begins a paragraph, in place of an ending.
BEGIN = len(ENDINGS)


def _keys(level: int, value: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
    """One number for each counted thing; sorted by level, then value, then kind."""
    return (np.int64(level) << 40) | (np.asarray(value, dtype=np.int64) << 4) | kind


@dataclass
class Model:
    """Expected counts under sorted keys: how often each thing was seen, and how often with a boundary."""

    keys: np.ndarray
    seen: np.ndarray
    cut: np.ndarray
    sure: float = 0.4  # part of all boundaries that are sure
    back_off: float = BACK_OFF
    unread: bool = False  # nothing is known yet of the words after

    def __post_init__(self):
        w, e = np.divmod(np.arange(6), 2)
        n, s = self.counts(_keys(CHAIN, w, e))
        t = np.stack([n - s, s], axis=-1).reshape(3, 2, 2) + 5.0  # (words since the gap before, boundary there, boundary here)
        base = t.sum(axis=1)[:, 1] / t.sum(axis=(1, 2))
        self.link = (t[:, :, 1] / t[:, :, 0]) / (base / (1 - base))[:, None]  # factor on the odds of a boundary
        a, b = np.searchsorted(self.keys, [NEXT << 40, (NEXT + 1) << 40])
        kind, word = self.keys[a:b] & 15, (self.keys[a:b] - (NEXT << 40)) >> 4
        yes, no = self.cut[a:b], self.seen[a:b] - self.cut[a:b]
        self.yes_of, self.no_of = (np.bincount(kind, x, minlength=BEGIN + 1) for x in (yes, no))
        self.words, at = np.unique(word, return_inverse=True)
        self.yes_all, self.no_all = (np.bincount(at, x, minlength=len(self.words)) for x in (yes, no))

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key was seen, and how often with a boundary; 0 for unknown ones."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.seen[at], 0.0), np.where(known, self.cut[at], 0.0)

    def before(self, g: dict[str, np.ndarray]) -> np.ndarray:
        """P(<S> | words before) with back-off from shape to word to two words."""
        n, s = self.counts(_keys(FORM, g["forma"]))
        # without a mark: a space of a script without marks, which ends a sentence by the rule of the problem
        p = np.where(g["forma"] % len(ENDINGS) > 0, (s + 0.5) / (n + 1.0), (s + BARE) / (n + BARE + 0.01))
        for level, name in ((ONE, "una"), (TWO, "dos")):
            n, s = self.counts(_keys(level, g[name]))
            p = (s + self.back_off * p) / (n + self.back_off)
        return np.clip(p, 1e-5, 1 - 1e-5)

    def ratio(self, g: dict[str, np.ndarray]) -> np.ndarray:
        """P(word after | <S>) / P(word after | none)."""
        if self.unread or not len(self.words):
            return np.ones(len(g["fin"]))
        kind, after = g["forma"] % len(ENDINGS), g["sigue"]
        n, s = self.counts(_keys(NEXT, after, kind))
        at = np.minimum(np.searchsorted(self.words, after), len(self.words) - 1)
        known = self.words[at] == after

        def share(own: np.ndarray, of: np.ndarray, every: np.ndarray) -> np.ndarray:
            base = (np.where(known, every[at], 0.0) + 0.1) / (every.sum() + 0.1 * 200)
            return (own + KIND_BACK_OFF * base) / (of[kind] + KIND_BACK_OFF)

        return share(s, self.yes_of, self.yes_all) / share(n - s, self.no_of, self.no_all)

    def posteriors(self, x: Batch) -> np.ndarray:
        """Forward-backward over the gaps of each paragraph, all paragraphs side by side."""
        g, sizes = x.gap, x.paragraph["cuantos"]
        n = len(g["fin"])
        if not n:
            return np.zeros(0)
        p, r, inside = self.before(g), self.ratio(g), g["dentro"] > 0
        step = np.empty((n, 2, 2))
        for e in (0, 1):
            odds = p * self.link[g["palabras"] - 1, e]
            q = np.where(inside, 0.0, odds / (odds + 1 - p))
            step[:, e, 0], step[:, e, 1] = 1 - q, q * r
        start = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        start, length = start[order], sizes[order]
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # paragraphs with a t-th gap
        forward, out = np.empty((n, 2)), np.empty(n)
        state = np.tile([0.0, 1.0], (len(sizes), 1))  # a paragraph begins after a boundary
        for t, m in enumerate(alive):
            at = start[:m] + t
            state = np.einsum("pi,pij->pj", state[:m], step[at])
            state /= state.sum(axis=1, keepdims=True)
            forward[at] = state
        back = np.ones((len(sizes), 2))
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            at = start[:m] + t
            both = forward[at] * back[:m]
            out[at] = both[:, 1] / both.sum(axis=1)
            b = np.einsum("pij,pj->pi", step[at], back[:m])
            back[:m] = b / b.sum(axis=1, keepdims=True)
        return out


def _count(x: Batch, model: Model | None) -> pd.DataFrame:
    """k, n, s of a batch: without a model all events and the sure boundaries, with one the expected ones."""
    g, p = x.gap, x.paragraph
    free = g["dentro"] == 0
    post = model.posteriors(x) if model is not None else np.zeros(len(g["fin"]))
    has_end = p["fin_forma"] >= 0
    keys, seen, cut = [], [], []

    def add(k: np.ndarray, n: np.ndarray | float, s: np.ndarray | float) -> None:
        keys.append(k)
        seen.append(np.broadcast_to(n, k.shape))
        cut.append(np.broadcast_to(s, k.shape))

    for level, own, end in ((TWO, "dos", "fin_dos"), (ONE, "una", "fin_una"), (FORM, "forma", "fin_forma")):
        add(_keys(level, g[own][free]), 1.0, post[free])
        add(_keys(level, p[end][has_end]), 1.0, 1.0)
    add(_keys(NEXT, p["comienzo"], BEGIN), 1.0, 1.0)
    if model is not None:
        add(_keys(NEXT, g["sigue"][free], g["forma"][free] % len(ENDINGS)), 1.0, post[free])
        was = np.concatenate([[1.0], post[:-1]]) if len(post) else post
        was[(np.cumsum(p["cuantos"]) - p["cuantos"])[p["cuantos"] > 0]] = 1.0
        w = g["palabras"][free] - 1
        for e, pe in ((0, 1 - was[free]), (1, was[free])):
            add(_keys(CHAIN, w, e), pe, pe * post[free])
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return pd.DataFrame({"k": k, "n": np.bincount(at, np.concatenate(seen), minlength=len(k)), "s": np.bincount(at, np.concatenate(cut), minlength=len(k))})


def _gather(found: DataFrame, model: Model | None, most: int) -> pd.DataFrame:
    """Sums of the counts of all texts, added up on the executors, in the order of their keys.

    Contexts of words seen only once say nothing about other gaps and are left out; of the others, and of the
    words that follow, the ``most`` most frequent are kept (the rarest of them back off to shorter contexts).
    """
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield _count(Batch.of(x), shared.value)

    used = [*(f"p_{c}" for c in PARAGRAPH if c not in ("desde", "hasta")), *(f"g_{c}" for c in GAP if c != "inicio")]
    blank = [F.array().cast("array<int>").alias(c) for c in ("p_desde", "p_hasta", "g_inicio")]
    sums = found.select(*used, *blank).mapInPandas(run, "k bigint, n double, s double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = materialize(sums.filter((F.col("n") > 1) | (F.col("k") >= _keys(FORM, 0).item())), "counts")
    few = F.shiftright("k", 40).isin(FORM, CHAIN)
    got = [sums.filter(few).toPandas(), sums.filter(~few).orderBy(F.desc("n"), "k").limit(most).toPandas()]
    return pd.concat(got, ignore_index=True).sort_values("k", ignore_index=True)


def train(found: DataFrame, most: int = MOST_CONTEXTS) -> Model:
    """Fit the model on the gaps of all texts (a written table of ``find_gaps``)."""
    c = _gather(found, None, most)
    k, n, s = (c[x].to_numpy() for x in ("k", "n", "s"))
    # Long lower-case words before a single mark end sentences: how often they stand at sure boundaries tells which part of all boundaries is sure.
    plain = np.isin(k, _keys(FORM, [SHAPE["lower"] * len(ENDINGS) + ENDINGS.index(e) for e in ("stop", "call", "wide")]))
    sure = min(max(float(s[plain].sum() / max(1.0, n[plain].sum())), 0.02), 1.0)
    # An upper bound of the rate: words that never stand at a sure boundary stay at none, few chance misses don't count.
    grown = np.where(k < NEXT << 40, np.minimum(n, (s + 2 * np.sqrt(s)) / sure), s)
    model = Model(k, n, grown, sure, FIRST_BACK_OFF, unread=True)  # the first round rests on the words before alone
    for _ in range(ROUNDS):
        c = _gather(found, model, most)
        model = Model(c["k"].to_numpy(), c["n"].to_numpy(), c["s"].to_numpy(), sure)
    return model


def spans(x: Batch, post: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph, start and end of each sentence of a batch."""
    g, p = x.gap, x.paragraph
    number = np.repeat(np.arange(len(p["cuantos"])), p["cuantos"])
    cut = (post > 0.5) & (g["inicio"] < p["hasta"][number])
    begin = np.concatenate([p["desde"], g["inicio"][cut]])
    end = np.concatenate([p["hasta"], g["fin"][cut]])
    own = np.concatenate([np.arange(len(p["desde"])), number[cut]])
    a, b = np.lexsort((begin, own)), np.lexsort((end, own))
    return own[a], begin[a], end[b]


def sentence_spans(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Offsets (start, end exclusive) of the sentences of a text; none for null and blank texts."""
    p, g = analysed(text)
    x = Batch({c: np.array([r[k] for r in g], dtype=np.int64) for k, c in enumerate(GAP)}, {c: np.array([r[k] for r in p], dtype=np.int64) for k, c in enumerate(PARAGRAPH)})
    _, begin, end = spans(x, model.posteriors(x))
    return list(zip(begin.tolist(), end.tolist()))


def sentences(found: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """tabla, registro, inicio, fin and, if asked, texto of each sentence of the texts ``find_gaps`` went through."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            b = Batch.of(x)
            own, begin, end = spans(b, shared.value.posteriors(b))
            row = np.repeat(np.arange(len(x)), x["p_desde"].map(len))[own]
            out = {"tabla": x["tabla"].to_numpy()[row], "registro": x["registro"].to_numpy()[row], "inicio": begin, "fin": end}
            if with_text:
                texts = x["texto"].to_numpy()
                out["texto"] = [texts[k][i:j] for k, i, j in zip(row, begin, end)]
            yield pd.DataFrame(out)

    used = [*(f"p_{c}" for c in PARAGRAPH), *(f"g_{c}" for c in GAP)]
    text = ["texto"] if with_text else []
    return found.select("tabla", "registro", *text, *used).mapInPandas(run, "tabla string, registro bigint, inicio int, fin int" + (", texto string" if with_text else ""))


def page_and_unit_texts(spark, folder: str) -> DataFrame:
    """tabla, registro, texto of native pages and stored units, repeats still in it."""
    p = table(spark, folder, "paginas").filter("confianza is null").select(F.lit("paginas").alias("tabla"), F.col("pagina_id").alias("registro"), "texto")
    o = table(spark, folder, "oraciones").select(F.lit("oraciones").alias("tabla"), F.col("oracion_id").alias("registro"), "texto")
    return p.unionByName(o)


def page_and_unit_gaps(spark, folder: str) -> DataFrame:
    """The gaps of native pages and stored units; repeated ids are one record."""
    return materialize(find_gaps(page_and_unit_texts(spark, folder).dropDuplicates(["tabla", "registro"])), "gaps")


def p3_sentences(spark, folder: str) -> DataFrame:
    """Every sentence with its place and text."""
    found = page_and_unit_gaps(spark, folder)
    return sentences(found, train(found))


def p3_found(spark, folder: str) -> DataFrame:
    """Every sentence of native pages and stored units."""
    found = page_and_unit_gaps(spark, folder)
    return sentences(found, train(found), with_text=False).distinct()
