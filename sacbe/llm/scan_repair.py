"""Problem 5: noise of scanned pages.

Page furniture: edge lines are reduced to the skeleton of their letters and counted per book and over all
books; a short line without sentence marks that repeats, or is close to one that repeats in its book, or
carries the page's own number beside a title, is a running header or footer; a line that is only the
page's number, in step with the numbers of its book, is a folio. Only the few edge lines of each page are
shuffled, never texts.

Words: a form (a token in lower case, digits as 9) is known if a native page or an inspected text has it and
it isn't two words fused at a mark, or if scanned pages have it often enough and no form that explains it as
noise is far more frequent: one of the same skeleton, one it may be misread from, or words it may be split
from. These are ratios and absolute counts, so the rule doesn't change with the size of the corpus. The known
forms stay a table. Only the HOT_FORMS most frequent go to the tasks that read the texts; what isn't among
them is asked by joins of narrow rows, once per distinct form. A hyphen at a line's end vanishes if the
joined word is known or its hyphenated form is not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sacbe.llm.words import Memo, fold, print_shape
from sacbe.storage import materialize, table

#: How often scanned pages must have a form no native page has.
SCANNED_LEAST = 5
#: How many times as frequent a like form, or words that it may be a part of, must be to explain a form as noise.
RARER, PARTS_RARER = 4, 20
#: Known forms that are broadcast; all others are found by joins.
HOT_FORMS = 200_000
#: Pages of a book, or pages of all books, whose edges must show a line for it to be furniture, and the part
#: of the pages of those books it must be; greatest part of letters that may differ.
IN_BOOK, IN_ALL, PART_OF_BOOK, DIFFERENT = 2, 3, 0.12, 0.25
LONGEST_TITLE = 75

HYPHENS = "-‐‑­¬"
_HYPHEN = re.compile(rf"(\S*[^\W\d_]\S*)[{HYPHENS}]\s*$")
_HYPHEN_SET = frozenset(HYPHENS)
_STRANGE = re.compile(r"[^a-záéíóúüñ]")
_EDGE = "¿?¡!.,;:()«»“”\"'…—–[]‹›*_~=|^·" + HYPHENS
_ALNUM = re.compile(r"[^\W_]")
_LETTER = re.compile(r"[^\W\d_]")
_EXERCISE = re.compile(r"\s*(?:=\s*\S{1,6}|\S{1,4}\s*[+×x÷*-]\s*\S{1,4}|\S{1,3}\.?\s*_+)\s*$")
_FOLIO = re.compile(r"[^\w=]*(?:p[^\s\d]{0,5}\s*)?([\dlIiOoSBZ|!]+)\W*$", re.I)
_DIGITS = str.maketrans("lIi|!OoSsBZz", "111110055822")
#: Forms of scanned pages that can be words; two words fused at a mark.
_CLEAN = r"^[a-záéíóúüñàèìòùâêîôûäëïöçãõœæßª-º9\-./,°]+$"
_MIXED = r"\p{L}9|9\p{L}"
_FUSED = r"\p{L}{3,}[.!?…;:,]+\p{L}"
_LONGEST_AFFIXED = 40

#: What scans write for what is printed (pairs of the inspected pages and their like; fixed values).
CONFUSED = (
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("m", "rn"), ("fi", "ﬁ"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("0", "o"), ("0", "ó"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "ó"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("(", "c"), ("!", "i"), ("!", "í"), ("|", "l"),
    ("i", "l"), ("l", "i"), ("í", "i"), ("i", "í"), ("f", "t"), ("t", "f"), ("y", "v"), ("v", "y"), ("c", "e"), ("e", "c"), ("é", "e"), ("e", "é"), ("á", "a"), ("a", "á"), ("ó", "o"), ("o", "ó"), ("n", "ñ"), ("u", "ú"), ("h", "b"), ("b", "h"), ("j", "i"), ("o", "c"), ("q", "g"), ("$", "s"), ("m", "in"), ("fi", "ñ"),
)

def skeleton(text: str) -> str:
    """Letters of a text without case, accents and what scans confuse."""
    return print_shape(fold(text))


def line_key(line: str) -> str:
    """Skeleton of a line's letters; its numbers, read or misread, are left out."""
    words = [w for w in re.split(r"[\s|·—–\[\]]+", line) if w and not re.fullmatch(r"\W*[\dlIOoS]+\W*", w)]
    return re.sub(r"[^a-z]", "", skeleton("".join(words)))


def form(token: str) -> str:
    """A token as the vocabulary holds it: outer punctuation off, lower case, digits as 9."""
    return re.sub(r"\d", "9", token.strip(_EDGE).lower())


def core(token: str) -> str:
    """A token in lower case with outer punctuation off."""
    return token.strip(_EDGE).lower()


def _hash(form_: str) -> int:
    return xxhash.xxh64_intdigest(form_)


def text_lines(text: str | None) -> list[tuple[int, str]]:
    """Numbers (from 1) and contents of the lines that aren't blank."""
    return [(i, x) for i, x in enumerate((text or "").split("\n"), 1) if x.strip()]


def is_specks(line: str) -> bool:
    """Marks without a letter or digit."""
    return _ALNUM.search(line) is None


def title_like(line: str) -> bool:
    """Short, not starting in lower case, without sentence punctuation (``Pág.`` and the like don't count)."""
    s = re.sub(r"\b[Pp](?:[^\s\d.]{0,3}[gq9])?\.", "", line.strip())
    return len(s) <= LONGEST_TITLE and not re.search(r"[,;:?¿¡»«/]|[.!](?:\s|$)|…", s.rstrip("]")) and not s[:1].islower()


def own_number(line: str, page: int | None) -> bool:
    """Whether a title-like line carries the page's number set apart at one end."""
    if page is None:
        return False
    m = re.match(r"\s*([\dlIOoS]+)\s{2,}\S", line) or re.search(r"(?:\s{2,}|[|·]\s*(?:[Pp]\S{0,4}\.?\s*)?)([\dlIOoS]+)\s*$", line)
    return bool(m) and m[1].translate(_DIGITS) == str(page)


def edge_lines(pages: DataFrame) -> DataFrame:
    """The first and last two printed lines of each page, once for repeated pages: tabla, registro, libro, pagina, renglon, lugar, clave, parecida, numero, valor.

    ``lugar``: 0 and 1 from the top, -1 and -2 from the bottom; ``parecida``: it is like a title;
    ``numero``: it carries the page's number; ``valor``: the number it consists of.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tabla, reg, book, page, text in zip(b["tabla"], b["registro"], b["libro"], b["pagina"], b["texto"]):
                number = None if pd.isna(page) else int(page)
                rows = [(i, x) for i, x in text_lines(text) if not is_specks(x)]
                n = len(rows)
                for k in sorted({*range(min(2, n)), *range(max(0, n - 2), n)}):
                    i, x = rows[k]
                    place = k if k < 2 and k < n - 1 else k - n
                    m = _FOLIO.fullmatch(x)
                    value = m[1].translate(_DIGITS) if m and any(c.isdigit() or c in "lIO" for c in m[1]) else ""
                    out.append((tabla, reg, book, number, i, place, line_key(x), title_like(x), own_number(x, number) and title_like(x), int(value) if value.isdigit() and len(value) < 9 else None))
            got = pd.DataFrame(out, columns=["tabla", "registro", "libro", "pagina", "renglon", "lugar", "clave", "parecida", "numero", "valor"])
            for c in ("pagina", "valor"):
                got[c] = got[c].astype("Int64")
            yield got

    every = pages.select("tabla", "registro", "libro", "pagina", "texto").mapInPandas(run, "tabla string, registro bigint, libro string, pagina bigint, renglon int, lugar int, clave string, parecida boolean, numero boolean, valor bigint")
    return every.dropDuplicates(["tabla", "registro", "renglon"])


def furniture(edges: DataFrame) -> DataFrame:
    """tabla, registro, renglon, hallazgo (``cabecera`` or ``folio``) of edge lines (a written table)."""
    outer = edges.filter("lugar in (0, -1) and valor is not null and pagina is not null").withColumn("d", F.col("valor") - F.col("pagina"))
    steps = outer.groupBy("tabla", "libro", "d").agg(F.count("*").alias("n"))
    all_ = steps.groupBy("tabla", "libro").agg(F.sum("n").alias("todas"))
    usual = steps.join(all_, ["tabla", "libro"]).filter("d <> 0 and n >= 3 and 2 * n > todas").select("tabla", "libro", "d")
    folio = outer.filter("d = 0").select("tabla", "registro", "renglon").unionByName(outer.filter("d <> 0").join(usual, ["tabla", "libro", "d"], "left_semi").select("tabla", "registro", "renglon"))
    titles = edges.filter("parecida and length(clave) >= 4 and valor is null")
    per_book = titles.groupBy("tabla", "libro", "clave").agg(F.count("*").alias("n"), F.count_if("numero").alias("con_numero"))
    per_book = per_book.join(edges.groupBy("tabla", "libro").agg(F.count_if(F.col("lugar") == -1).alias("paginas")), ["tabla", "libro"])
    per_key = per_book.groupBy("clave").agg(F.sum("n").alias("m"), F.sum("paginas").alias("de"))
    here = (F.col("n") >= IN_BOOK) & (F.col("n") >= PART_OF_BOOK * F.col("paginas"))
    anywhere = (F.col("m") >= IN_ALL) & (F.col("m") >= PART_OF_BOOK * F.col("de"))
    known = materialize(per_book.join(per_key, "clave").withColumn("vale", here | anywhere | (F.col("con_numero") > 0)).select("tabla", "libro", "clave", "vale"), "keys")
    sure = known.filter("vale")
    near = known.filter("not vale").join(sure.select("tabla", "libro", F.col("clave").alias("otra")), ["tabla", "libro"]).filter(F.levenshtein("clave", "otra") <= F.greatest(F.length("clave"), F.length("otra")) * DIFFERENT).select("tabla", "libro", "clave").distinct()
    heads = titles.join(sure.select("tabla", "libro", "clave").unionByName(near), ["tabla", "libro", "clave"], "left_semi")
    return heads.select("tabla", "registro", "renglon", F.lit("cabecera").alias("hallazgo")).unionByName(folio.withColumn("hallazgo", F.lit("folio")))


@dataclass
class Vocabulary:
    """Sorted hashes of known forms: the most frequent ones, with what was asked for a page beside them."""

    known: np.ndarray

    def __post_init__(self):
        self._memo: dict[str, bool] = {}
        self._good: set[str] = set()
        self.answer((), (), {})

    def __getstate__(self):
        return {"known": self.known}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def answer(self, forms, compounds, fixes) -> Vocabulary:
        """Set what was found for one page: known forms, skeletons of hyphenated words, corrections."""
        self.forms, self.compounds, self.fixes = frozenset(forms), frozenset(compounds), dict(fixes)
        return self

    def hot(self, f: str) -> bool:
        got = self._memo.get(f)
        if got is None:
            if len(self._memo) > 500_000:
                self._memo.clear()
            h = np.uint64(_hash(f))
            i = int(np.searchsorted(self.known, h))
            got = self._memo[f] = i < len(self.known) and bool(self.known[i] == h)
        return got

    def has(self, f: str) -> bool:
        return f in self.forms or self.hot(f)

    def right(self, token: str) -> bool:
        """Whether a token is made of known forms. Tokens without letters are."""
        f = form(token)
        if not f or self.has(f):
            return True
        if not _LETTER.search(f):
            return True
        parts = re.split(r"[-/–]", f)
        return len(parts) > 1 and all(p and self.has(p) for p in parts)

    def wrong(self, tokens: list[str]) -> list[str]:
        """The tokens that aren't right by the frequent forms; those found right are remembered as they stand."""
        good = self._good
        if good.issuperset(tokens):
            return []
        if len(good) > 500_000:
            good.clear()
        out = []
        for t in tokens:
            if t not in good:
                if self.right(t):
                    good.add(t)
                else:
                    out.append(t)
        return out

    def compound(self, f: str) -> bool:
        return skeleton(f) in self.compounds


def _without_cut_words(text: str) -> str:
    """A text without the two halves of each word cut at a line's end."""
    lines = text.split("\n")
    for i, x in enumerate(lines):
        if x and (x[-1] in _HYPHEN_SET or x[-1] == " " and x.rstrip()[-1:] in _HYPHEN_SET) and _HYPHEN.search(x):
            lines[i] = x.rstrip().rpartition(" ")[0]
            k = i + 1
            while k < len(lines) and not lines[k].strip():
                k += 1
            if k < len(lines):
                lines[k] = lines[k].lstrip().partition(" ")[2]
    return "\n".join(lines)


def token_forms(rows: DataFrame) -> DataFrame:
    """forma, esqueleto, nativo, leido: how often each form occurs in native and in scanned texts (columns texto, leido).

    Counts cover all rows. Halves of words cut at line ends aren't counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = b["leido"].to_numpy(dtype=bool)
            texts = b["texto"].fillna("").to_numpy(dtype=object)
            got: dict[str, list[int]] = {}
            for k, own in enumerate((texts[~read], texts[read])):
                whole = "\n\n".join(own)
                if k:
                    whole = _without_cut_words(whole)
                for token, n in Counter(whole.split()).items():
                    got.setdefault(form(token), [0, 0])[k] += n
            got.pop("", None)
            if got:
                yield pd.DataFrame([(f, *n) for f, n in got.items()], columns=["forma", "nativo", "leido"])

    every = rows.select("texto", "leido").mapInPandas(run, "forma string, nativo bigint, leido bigint")
    return _with_skeletons(every.groupBy("forma").agg(F.sum("nativo").alias("nativo"), F.sum("leido").alias("leido")))


def _with_skeletons(forms: DataFrame) -> DataFrame:
    """``forms`` with ``esqueleto`` of each ``forma``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(esqueleto=[skeleton(f) for f in b["forma"]])

    return forms.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in forms.schema) + ", esqueleto string")


def _unconfused(forms: DataFrame, column: str) -> DataFrame:
    """``forms`` with ``otra``: each form reached by undoing one confusion."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            other = [sorted({f[:i] + y + f[i + len(x) :] for x, y in CONFUSED for i in range(len(f)) if f.startswith(x, i)}) for f in b[column]]
            yield b.assign(otra=other).explode("otra").dropna(subset=["otra"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in forms.schema) + ", otra string"
    return forms.mapInPandas(run, schema)


def known_forms(counts: DataFrame, inspected: list[str]) -> tuple[DataFrame, DataFrame]:
    """(known, compounds): forma, esqueleto, n of the known forms, and the skeletons (esqueleto) of hyphenated ones.

    ``counts``: a written table of ``token_forms``; ``inspected``: texts of small fixed tables. Parts of
    hyphenated forms are known too.
    """
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(f, skeleton(f), 0, 0, True) for f in sorted({form(t) for x in inspected for t in x.split()} - {""})], "forma string, esqueleto string, nativo bigint, leido bigint, fija boolean")
    every = counts.withColumn("fija", F.lit(False)).unionByName(fixed).groupBy("forma").agg(F.any_value("esqueleto").alias("esqueleto"), F.sum("nativo").alias("nativo"), F.sum("leido").alias("leido"), F.max("fija").alias("fija"))
    every = materialize(every.withColumn("n", F.col("nativo") + F.col("leido")).filter(F.col("fija") | ~F.col("forma").rlike(_FUSED)), "every")
    sure = every.filter("fija or nativo > 0").select("forma", "esqueleto", "n")
    maybe = every.filter("not fija and nativo = 0").filter((F.col("leido") >= SCANNED_LEAST) & F.col("forma").rlike(_CLEAN) & ~F.col("forma").rlike(_MIXED)).select("forma", "esqueleto", "n")
    maybe = materialize(maybe, "maybe")
    alike = every.groupBy("esqueleto").agg(F.max("n").alias("parecida"))
    cuts = F.sequence(F.lit(1), F.length("forma") - 1)
    halves = F.explode(F.flatten(F.transform(cuts, lambda k: F.array(F.substring("forma", F.lit(1), k), F.substring("forma", k + 1, F.length("forma"))))))
    wholes = every.filter(F.col("forma").rlike(r"^\p{L}+$") & F.length("forma").between(2, _LONGEST_AFFIXED)).select(halves.alias("forma"), F.col("n").alias("m"))
    wholes = wholes.join(maybe.select("forma"), "forma", "left_semi").groupBy("forma").agg(F.sum("m").alias("enteras"))
    misread = _unconfused(maybe.select("forma", "n"), "forma").join(every.select(F.col("forma").alias("otra"), F.col("n").alias("m")), "otra").filter(F.col("m") >= F.col("n") * RARER).select("forma").distinct()
    new = maybe.join(alike, "esqueleto").filter(F.col("n") * RARER >= F.col("parecida")).join(wholes, "forma", "left").filter(F.col("n") * PARTS_RARER >= F.coalesce("enteras", F.lit(0))).join(misread, "forma", "left_anti")
    words = materialize(sure.unionByName(new.select("forma", "esqueleto", "n")), "words")
    part = words.select(F.explode(F.split("forma", "[-/]")).alias("forma")).filter(F.col("forma").rlike(r"^\p{L}{2,}$")).join(words, "forma", "left_anti").distinct()

    known = materialize(words.unionByName(_with_skeletons(part.select("forma", F.lit(0).cast("bigint").alias("n")))), "known")
    return known, materialize(words.filter(F.col("forma").rlike(r"[^-]-+[^-]")).select("esqueleto").distinct(), "compounds")


def hot_forms(known: DataFrame, most: int = HOT_FORMS) -> Vocabulary:
    """The ``most`` most frequent known forms."""
    top = known.orderBy(F.desc("n"), "forma").limit(most).select("forma").toPandas()["forma"]
    return Vocabulary(np.sort(np.array([_hash(f) for f in top], dtype=np.uint64)))


def right_forms(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The forms (forma) of ``asked`` that are known or made of known parts."""
    parts = asked.filter(F.col("forma").rlike("[-/–]")).select("forma", F.explode(F.split("forma", "[-/–]")).alias("parte"))
    made = parts.join(known.select(F.col("forma").alias("parte"), F.lit(1).alias("si")), "parte", "left").groupBy("forma").agg(F.min(F.coalesce("si", F.lit(0))).alias("todas")).filter("todas = 1")
    return asked.join(known.select("forma"), "forma", "left_semi").unionByName(made.select("forma")).distinct()


def corrections(asked: DataFrame, known: DataFrame) -> DataFrame:
    """nucleo, arreglo: the most frequent known form that each word (nucleo, esqueleto) may be misread from."""
    own = asked.select("nucleo", "esqueleto").distinct()
    near = own.join(known.select("esqueleto", F.col("forma").alias("arreglo"), "n"), "esqueleto").select("nucleo", "arreglo", "n")
    undone = _unconfused(own.select("nucleo"), "nucleo").join(known.select(F.col("forma").alias("otra"), "n"), "otra").select("nucleo", F.col("otra").alias("arreglo"), "n")
    return near.unionByName(undone).groupBy("nucleo").agg(F.max_by("arreglo", F.struct("n", "arreglo")).alias("arreglo"))


def page_asks(text: str | None, v: Vocabulary) -> list[tuple]:
    """What a page has to say or ask: (renglon, tipo, siguiente, a, b, nucleo, mayuscula, culpa).

    ``mancha`` and ``guion`` are findings; ``palabra`` asks whether the form a is right; ``corte`` what becomes
    of the word cut into the forms a and b at the end of the line. ``mayuscula``: the second half starts with a
    capital; ``culpa``: the fault looks to be in the first half.
    """
    out: list[tuple] = []
    rows = []
    for i, x in text_lines(text):
        if is_specks(x):
            out.append((i, "mancha", None, None, None, None, None, None))
        elif len(x) > 24 or not _EXERCISE.match(x):
            rows.append((i, x))
    skip = False  # the first token of the line was judged with the line before
    for k, (i, x) in enumerate(rows):
        tokens = x.split()
        if skip:
            tokens = tokens[1:]
        skip = False
        if tokens and tokens[-1][-1] in _HYPHEN_SET and k + 1 < len(rows) and _HYPHEN.search(x):
            after = rows[k + 1][1].split()[0]
            last = tokens.pop()
            head, tail = form(last), form(after)
            skip = True
            if v.hot(head + tail):
                out.append((i, "guion", None, None, None, None, None, None))
            else:
                at = bool(_STRANGE.search(head)) or not _STRANGE.search(tail) and len(head) >= len(tail)
                out.append((i, "corte", rows[k + 1][0], head, tail, core(last) + core(after), after.lstrip(_EDGE)[:1].isupper(), at))
        out += [(i, "palabra", None, form(t), None, None, None, None) for t in v.wrong(tokens)]
    return out


def scanned_pages(spark, folder: str) -> DataFrame:
    """tabla, registro, libro, pagina, texto of every scanned page; repeats are still in it, so that no text is shuffled."""
    a = table(spark, folder, "paginas").filter("confianza is not null").select(F.lit("paginas").alias("tabla"), F.col("pagina_id").alias("registro"), F.col("libro").cast("string").alias("libro"), F.col("pagina").cast("bigint").alias("pagina"), "texto")
    b = table(spark, folder, "paginas_reconocidas").select(F.lit("paginas_reconocidas").alias("tabla"), F.col("reconocida_id").alias("registro"), F.col("trabajo").alias("libro"), F.col("numero").cast("bigint").alias("pagina"), "texto")
    return a.unionByName(b)


def page_forms(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Known forms and compounds of the pages of a folder."""
    native = table(spark, folder, "paginas").select("texto", F.col("confianza").isNotNull().alias("leido"))
    rows = native.unionByName(table(spark, folder, "paginas_reconocidas").select("texto", F.lit(True).alias("leido")))
    inspected = [r[0] for r in table(spark, folder, "evaluacion_ocr").select("referencia").collect() if r[0]]
    inspected += [r[0] for r in table(spark, folder, "muestra_etiquetada").filter("clase = 'prosa'").select("texto").collect() if r[0]]
    return known_forms(materialize(token_forms(rows), "forms"), inspected)


def faults(pages: DataFrame, known: DataFrame, compounds: DataFrame, hot: Vocabulary) -> DataFrame:
    """tabla, registro, renglon, hallazgo of the faults inside pages, in one pass over the texts; the rest are joins of what pages ask."""
    shared = pages.sparkSession.sparkContext.broadcast(hot)
    columns = ["tabla", "registro", "renglon", "tipo", "siguiente", "a", "b", "nucleo", "mayuscula", "culpa", "par", "esqueleto"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bones = Memo(skeleton)
        for x in batches:
            out = [(t, r, *q, *((bones[f"{q[3]}-{q[4]}"], bones[q[5]]) if q[1] == "corte" else (None, None))) for t, r, text in zip(x["tabla"], x["registro"], x["texto"]) for q in page_asks(text, shared.value)]
            yield pd.DataFrame(out, columns=columns).astype({"siguiente": "Int64"})

    schema = "tabla string, registro bigint, renglon int, tipo string, siguiente bigint, a string, b string, nucleo string, mayuscula boolean, culpa boolean, par string, esqueleto string"
    said = materialize(pages.select("tabla", "registro", "texto").mapInPandas(run, schema), "asked")
    place = ["tabla", "registro", "renglon"]
    sure = said.filter("tipo in ('mancha', 'guion')").select(*place, F.col("tipo").alias("hallazgo"))
    words, cuts = said.filter("tipo = 'palabra'"), said.filter("tipo = 'corte'")
    right = materialize(right_forms(words.select(F.col("a").alias("forma")).unionByName(cuts.select(F.explode(F.array("a", "b")).alias("forma"))).distinct(), known), "right")
    wrong = words.join(right.withColumnRenamed("forma", "a"), "a", "left_anti").select(*place)
    forms, yes = known.select("forma"), F.lit(True)
    c = cuts.withColumn("junta", F.concat("a", "b")).withColumn("partida", F.concat("a", F.lit("-"), "b"))
    c = c.join(forms.select(F.col("forma").alias("junta"), yes.alias("es_junta")), "junta", "left").join(forms.select(F.col("forma").alias("partida"), yes.alias("es_partida")), "partida", "left")
    c = c.join(compounds.select(F.col("esqueleto").alias("par"), yes.alias("es_par")), "par", "left")
    c = c.join(right.select(F.col("forma").alias("a"), yes.alias("bien_a")), "a", "left").join(right.select(F.col("forma").alias("b"), yes.alias("bien_b")), "b", "left")
    c = c.join(corrections(cuts, known), "nucleo", "left")
    kept = F.col("mayuscula") | F.coalesce("es_par", F.lit(False))
    n = F.length("a")
    first = F.coalesce(F.substring("arreglo", F.lit(1), n) != F.substring("nucleo", F.lit(1), n), F.col("culpa"))
    guion = F.array(F.struct("renglon", F.lit("guion").alias("hallazgo")))
    here, there = F.struct("renglon", F.lit("caracter").alias("hallazgo")), F.struct(F.col("siguiente").cast("int").alias("renglon"), F.lit("caracter").alias("hallazgo"))
    halves = F.filter(F.array(F.when(F.col("bien_a").isNull(), here), F.when(F.col("bien_b").isNull(), there)), lambda x: x.isNotNull())
    verdict = F.when(F.col("es_junta"), guion).when(F.col("es_partida").isNull(), F.when(kept, halves).otherwise(F.concat(guion, F.array(F.when(first, here).otherwise(there)))))
    cut = c.select("tabla", "registro", F.explode(verdict).alias("x")).select("tabla", "registro", "x.renglon", "x.hallazgo")
    return sure.unionByName(wrong.withColumn("hallazgo", F.lit("caracter"))).unionByName(cut)


def p5_found(spark, folder: str) -> DataFrame:
    """Furniture, specks, vanishing hyphens and wrong characters of every scanned page."""
    pages = scanned_pages(spark, folder)
    heads = materialize(furniture(materialize(edge_lines(pages), "edges")).distinct(), "furniture")
    known, compounds = page_forms(spark, folder)
    inner = materialize(faults(pages, known, compounds, hot_forms(known)).distinct(), "faults")
    text = inner.filter("hallazgo in ('guion', 'caracter')").join(heads.select("tabla", "registro", "renglon"), ["tabla", "registro", "renglon"], "left_anti")
    return heads.select("tabla", "registro", "renglon", "hallazgo").unionByName(text.select("tabla", "registro", "renglon", "hallazgo")).unionByName(inner.filter("hallazgo = 'mancha'").select("tabla", "registro", "renglon", "hallazgo"))


def paragraph_asks(text: str | None, v: Vocabulary) -> set[tuple[str, str]]:
    """What must be known to repair a page: (``forma``, a form that may be known), (``par``, skeleton of a hyphenated word), (``nucleo``, a word to correct)."""
    out: set[tuple[str, str]] = set()
    tokens: list[str] = []
    cut = None
    for _, x in text_lines(text):
        if is_specks(x):
            continue
        own = x.split()
        if cut is not None:
            a, b = form(cut), form(own[0])
            if not v.hot(a + b) or own[0].lstrip(_EDGE)[:1].isupper():
                out |= {("forma", a + b), ("forma", f"{a}-{b}"), ("par", skeleton(f"{a}-{b}"))}
            else:
                out.add(("forma", f"{a}-{b}"))
            own = [cut + own[0], *own[1:]]
        cut = own.pop().rstrip(HYPHENS) if own[-1][-1] in _HYPHEN_SET and _HYPHEN.search(x) else None
        tokens += own
    wrong = set(v.wrong(tokens))
    for k, t in enumerate(tokens):
        if t in wrong:
            near = [tokens[k - 1] + t] * (k > 0) + [t, *re.split(r"[-/–]", t)] + [t + x for x in tokens[k + 1 : k + 2]]
            out |= {("forma", form(x)) for x in near} | {("nucleo", core(t))}
    return {x for x in out if x[1] and not (x[0] == "forma" and v.hot(x[1]))}


def answers(pages: DataFrame, known: DataFrame, compounds: DataFrame, hot: Vocabulary) -> DataFrame:
    """tabla, registro and what was found of what the page asks: conocidas, pares, arreglos (an array of nucleo and arreglo)."""
    shared = pages.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bones = Memo(skeleton)
        for x in batches:
            out = [(t, r, k, q, bones[q] if k == "nucleo" else None) for t, r, text in zip(x["tabla"], x["registro"], x["texto"]) for k, q in paragraph_asks(text, shared.value)]
            yield pd.DataFrame(out, columns=["tabla", "registro", "tipo", "q", "esqueleto"])

    asked = materialize(pages.select("tabla", "registro", "texto").mapInPandas(run, "tabla string, registro bigint, tipo string, q string, esqueleto string").distinct(), "asked")
    page = ["tabla", "registro"]
    words = asked.filter("tipo = 'nucleo'").withColumnRenamed("q", "nucleo")
    found = asked.filter("tipo = 'forma'").join(known.select(F.col("forma").alias("q")), "q", "left_semi").select(*page, F.col("q").alias("conocida"))
    pairs = asked.filter("tipo = 'par'").join(compounds.select(F.col("esqueleto").alias("q")), "q", "left_semi").select(*page, F.col("q").alias("par"))
    fixes = words.join(corrections(words, known), "nucleo").select(*page, F.struct("nucleo", "arreglo").alias("arreglo"))
    every = found.unionByName(pairs, allowMissingColumns=True).unionByName(fixes, allowMissingColumns=True)
    return every.groupBy(*page).agg(F.collect_set("conocida").alias("conocidas"), F.collect_set("par").alias("pares"), F.collect_set("arreglo").alias("arreglos"))


def repaired(text: str | None, furniture_lines: set[int], v: Vocabulary) -> tuple[list[str], str | None]:
    """Paragraphs of one page, and the part of a word cut at its end.

    Furniture, specks and broken words are gone, wrong words corrected where the vocabulary tells how.
    """
    paragraphs: list[list[str]] = [[]]
    open_word = None
    blank = False
    for i, x in enumerate((text or "").split("\n"), 1):
        if not x.strip():
            blank = True
            continue
        if i in furniture_lines or is_specks(x):
            continue
        tokens = x.split()
        if open_word is not None:
            head, tail = open_word, tokens[0]
            kept = v.has(f"{form(head)}-{form(tail)}") or tail.lstrip(_EDGE)[:1].isupper() or (not v.has(form(head + tail)) and v.compound(f"{form(head)}-{form(tail)}"))
            tokens = [head + ("-" if kept else "") + tail, *tokens[1:]]
            open_word = None
        elif blank and paragraphs[-1]:
            paragraphs.append([])
        blank = False
        if tokens[-1][-1] in _HYPHEN_SET and _HYPHEN.search(x):
            open_word = tokens[-1].rstrip(HYPHENS)
            tokens = tokens[:-1]
        paragraphs[-1] += tokens
    if open_word is not None:
        paragraphs[-1].append(open_word + "-")
    return [" ".join(_corrected(p, v)) for p in paragraphs if p], open_word


def _corrected(tokens: list[str], v: Vocabulary) -> list[str]:
    wrong = set(v.wrong(tokens))
    if not wrong:
        return tokens
    out: list[str] = []
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t not in wrong:
            out.append(t)
        elif k + 1 < len(tokens) and v.has(form(t + tokens[k + 1])):
            out.append(t + tokens[k + 1])
            k += 1
        elif out and v.has(form(out[-1] + t)):
            out[-1] += t
        else:
            own = t.strip(_EDGE)
            word = v.fixes.get(own.lower(), own)
            if own[:1].isupper():
                word = word[:1].upper() + word[1:]
            out.append(t.replace(own, word, 1) if own else t)
        k += 1
    return out


_ENDED = r"[.!?…:;][\"'”»)\]]*$"


def across_pages(rows: DataFrame, known: DataFrame) -> DataFrame:
    """tabla, registro, parrafo, texto, continua of paragraphs (tabla, libro, pagina, registro, parrafo, ultimo, abierta, texto).

    A word cut at the end of a page is completed from the next page of its book, which loses that part.
    ``continua``: the paragraph goes on in the first one of the next page. Pages are neighbours by number; where
    a number occurs twice in a book nothing is joined across.
    """
    page = ["tabla", "libro", "pagina"]
    lead = F.regexp_extract("texto", r"^(\S+)", 1)
    heads = rows.filter("parrafo = 1 and pagina is not null").groupBy(*page).agg(F.count("*").alias("k"), F.any_value(lead).alias("cabeza")).filter("k = 1").drop("k")
    ends = rows.filter("ultimo and pagina is not null").join(heads.withColumn("pagina", F.col("pagina") - 1), page).select(*page, "registro", "parrafo", "abierta", "cabeza")
    own = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    ends = ends.withColumn("par", F.concat(own(F.col("abierta")), F.lit("-"), own(F.col("cabeza")))).join(known.select(F.col("forma").alias("par"), F.lit(True).alias("es_par")), "par", "left")
    ends = materialize(ends.select(*page, "registro", "parrafo", "abierta", "cabeza", (F.coalesce("es_par", F.lit(False)) | F.col("cabeza").rlike(r"^\P{L}*\p{Lu}")).alias("queda")), "ends")
    taken = ends.filter("abierta is not null").groupBy("tabla", "libro", (F.col("pagina") + 1).alias("pagina")).agg(F.count("*").alias("k")).filter("k = 1").select(*page, F.lit(True).alias("tomada"))
    out = rows.join(ends.select("tabla", "registro", "parrafo", F.col("abierta").alias("mitad"), "cabeza", "queda"), ["tabla", "registro", "parrafo"], "left")
    out = out.join(taken.withColumn("parrafo", F.lit(1)), [*page, "parrafo"], "left")
    text = F.when(F.col("tomada"), F.regexp_replace("texto", r"^\S+\s*", "")).otherwise(F.col("texto"))
    whole = F.when(F.col("mitad").isNotNull(), F.concat(F.regexp_replace(text, "-$", ""), F.when(F.col("queda"), "-").otherwise(""), F.col("cabeza"))).otherwise(text)
    goes_on = F.col("mitad").isNotNull() | (F.col("cabeza").rlike(r"^\p{Ll}") & ~F.col("texto").rlike(_ENDED))
    return out.select("tabla", "registro", "parrafo", whole.alias("texto"), F.coalesce(goes_on, F.lit(False)).alias("continua")).filter("texto <> ''")


def p5_paragraphs(spark, folder: str) -> DataFrame:
    """The text of every scanned page as continuous paragraphs: tabla, registro, parrafo, texto, continua."""
    pages = scanned_pages(spark, folder)
    heads = furniture(materialize(edge_lines(pages), "edges")).groupBy("tabla", "registro").agg(F.collect_set("renglon").alias("fuera"))
    known, compounds = page_forms(spark, folder)
    hot = hot_forms(known)
    shared = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: () if x is None else x
        for b in batches:
            out = []
            for t, book, page, r, x, off, forms, pairs, fixes in zip(*(b[c] for c in ("tabla", "libro", "pagina", "registro", "texto", "fuera", "conocidas", "pares", "arreglos"))):
                own, cut = repaired(x, set(some(off)), shared.value.answer(some(forms), some(pairs), {f["nucleo"]: f["arreglo"] for f in some(fixes)}))
                out += [(t, book, page, r, k, k == len(own), cut if k == len(own) else None, p) for k, p in enumerate(own, 1)]
            yield pd.DataFrame(out, columns=["tabla", "libro", "pagina", "registro", "parrafo", "ultimo", "abierta", "texto"]).astype({"pagina": "Int64"})

    found = answers(pages, known, compounds, hot)
    whole = pages.dropDuplicates(["tabla", "registro"]).join(heads.join(found, ["tabla", "registro"], "full"), ["tabla", "registro"], "left")
    rows = whole.select("tabla", "libro", "pagina", "registro", "texto", "fuera", "conocidas", "pares", "arreglos").mapInPandas(run, "tabla string, libro string, pagina bigint, registro bigint, parrafo int, ultimo boolean, abierta string, texto string")
    return across_pages(materialize(rows, "paragraphs"), known)
