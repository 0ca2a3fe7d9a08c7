"""Pages of books: confidence filter, defaults, and removal of running headers and footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.functions.text import fold, text, tokens
from sacbe.storage import materialize

#: Defaults of each kind of study material.
DEFAULT_COUNT = {"summary": 8, "glossary": 12, "flashcards": 10, "quiz": 5, "timeline": 14}
#: Words of a running phrase, part of the pages and number of pages that must show it (fixed values).
FEWEST_WORDS, MOST_WORDS = 3, 16
PART_OF_PAGES, FEWEST_PAGES, NEARLY_ALL = 0.3, 3, 0.9
PAGE_WORDS, BORDER_PART = 30, 0.25
_FOLIO = r"^[.\-–—·]*\d+[.\-–—·]*$"


def book_pages(df: DataFrame) -> DataFrame:
    """Valid pages (libro, pagina, pos, texto, confianza), repeats once: page numbers from 1, confidence null or within 0..1."""
    own = df.select("libro", "pagina", "pos", "texto", "confianza").distinct()
    return own.filter("libro is not null and pagina >= 1 and (confianza is null or confianza between 0 and 1)")


def confident(df: DataFrame, least: float | None = None) -> DataFrame:
    """Pages of native text, and scanned ones of at least the given confidence; all pages without one."""
    return df if least is None else df.filter(F.col("confianza").isNull() | (F.col("confianza") >= least))


def excluded_pages(df: DataFrame, least: float) -> DataFrame:
    """Per book the pages kept and left out by ``confident``."""
    keep = F.col("confianza").isNull() | (F.col("confianza") >= least)
    return df.groupBy("libro").agg(F.count_if(keep).alias("usadas"), F.count_if(~keep).alias("excluidas"))


def is_folio(c: Column) -> Column:
    return c.rlike(_FOLIO)


def _border(w: Column) -> Column:
    """Folded words of a page's border: its first words without the folios before them, up to the next folio."""
    edge = F.slice(w, 1, F.least(F.lit(2 * MOST_WORDS), F.floor(F.size(w) * BORDER_PART).cast("int")))
    flags = F.transform(edge, is_folio)
    start = F.array_position(flags, False).cast("int")
    rest = F.when(start > 0, F.slice(edge, start, 2 * MOST_WORDS)).otherwise(F.slice(edge, 1, 0))
    stop = F.array_position(F.transform(rest, is_folio), True).cast("int")
    return F.transform(F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest), fold)


def repeated_border(df: DataFrame, last: bool = False) -> DataFrame:
    """libro, frase (folded words), veces of each book whose pages share a phrase at their beginning (or end).

    Only pages with enough words count. Among phrases on nearly as many pages as the most frequent one the
    longest wins. Prefixes are counted with partial aggregation; a book is never gathered in one task.
    """
    w = tokens(text("texto"))
    pages = df.select("libro", (F.reverse(w) if last else w).alias("w")).filter(F.size("w") >= PAGE_WORDS).select("libro", _border(F.col("w")).alias("b"))
    books = pages.groupBy("libro").agg(F.count("*").alias("paginas")).filter(F.col("paginas") >= FEWEST_PAGES)
    lengths = F.explode(F.when(F.size("b") >= FEWEST_WORDS, F.sequence(F.lit(FEWEST_WORDS), F.least(F.size("b"), F.lit(MOST_WORDS))))).alias("largo")
    counted = pages.select("libro", "b", lengths).groupBy("libro", "largo", F.array_join(F.slice("b", 1, F.col("largo")), " ").alias("frase")).agg(F.count("*").alias("veces"))
    often = counted.join(books, "libro").filter(F.col("veces") >= F.greatest(F.lit(FEWEST_PAGES), F.ceil(F.col("paginas") * PART_OF_PAGES)))
    top = often.groupBy("libro").agg(F.max("veces").alias("tope"))
    best = often.join(top, "libro").filter(F.col("veces") >= F.col("tope") * NEARLY_ALL).groupBy("libro").agg(F.max(F.struct("largo", "veces", "frase")).alias("m"))
    return best.select("libro", F.col("m.frase").alias("frase"), F.col("m.largo").alias("largo"), F.col("m.veces").alias("veces"))


def _without(df: DataFrame, phrases: DataFrame, last: bool) -> DataFrame:
    w = tokens(text("texto"))
    j = df.join(phrases.select("libro", F.split("frase", " ").alias("_q")), "libro", "left").withColumn("_w", F.when(F.col("_q").isNotNull(), F.reverse(w) if last else w))
    at = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: ~is_folio(F.get("_w", i - 1)))
    j = j.withColumn("_at", F.when(F.size("_w") > 0, at).otherwise(F.array().cast("array<int>")))
    k = F.size("_q")
    starts = F.transform(F.slice("_at", 1, F.greatest(k, F.lit(0))), lambda i: fold(F.get("_w", i - 1))) == F.col("_q")
    drop = F.when(F.col("_q").isNull() | (F.size("_at") < k) | ~starts, 0).when(F.size("_at") > k, F.get("_at", k) - 1).otherwise(F.size("_w"))
    cut = F.concat(F.lit(r"(?:(?U)\s+\S+){"), F.col("_d").cast("string"), F.lit(r"}\s*$")) if last else F.concat(F.lit(r"^(?U)\s*(?:\S+\s+){"), F.col("_d").cast("string"), F.lit("}"))
    out = j.withColumn("_d", drop)
    return out.withColumn("texto", F.when(F.col("_d") == 0, F.col("texto")).when(F.col("_d") >= F.size("_w"), "").otherwise(F.regexp_replace("texto", cut, F.lit("")))).select(*df.columns)


def without_headers(df: DataFrame) -> DataFrame:
    """Pages without the header and footer their book repeats, with the folios beside them; line breaks stay.

    The footer is looked for once the header is gone, so the pages are written in between.
    """
    first = materialize(_without(df, materialize(repeated_border(df), "headers"), False), "pages")
    return _without(first, materialize(repeated_border(first, last=True), "footers"), True)
