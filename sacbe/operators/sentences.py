"""Sentences of a book: splitting, cleaning, predicates, first occurrences in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sacbe.functions.text import LETTERS, PIECE_EDGE, STUDY_WORD, count, fold, let, text, tokens
from sacbe.operators.pages import without_headers
from sacbe.storage import spread

FEWEST, MOST = 6, 60
LEGIBLE, LEGIBLE_WORDS = 0.85, 0.5

# Patterns whose words are fixed values of the method.
SPLIT = r"(?U)(?<=[.!?…])(?<!\ba\.)(?<!\bd\.)\s+(?=[A-ZÁÉÍÓÚÑ¿¡«\"(—\-–])|\n+"
SECTION_LABEL = r"(?U)\b(?:Relaciono|Relacionamos|Investigo|Investigamos|Organizo|Organizamos|Taller|Nota de inter[eé]s|Actividades adicionales|Evaluaci[oó]n del? proyecto)\b(?=\s+[A-ZÁÉÍÓÚÑ¿¡\d])"
CHAPTER = r"^(?U)(?:[IVXLC]{1,8}|(?iu:cap[íi]tulo|unidad|lecci[óo]n|tema|bloque|secci[óo]n|parte)\s+\S+(?:\s*[-–:.]\s*(?iu:p[áa]g(?:ina)?\.?)\s*\d+)?)\s*[-–:.]?\s+(?=[A-ZÁÉÍÓÚÑ¿¡«\"])"
LEADING_NUMBERS = r"^(?:\d{1,3}\s+)+(?=[A-ZÁÉÍÓÚÑ¿¡])"
DIALOGUE = r"(?U)^[—\-–¡¿\"«]|\s—\s?(?:dijo|preguntó|respondió|añadió|exclamó|contestó)\b"
PERSON = r"\b(?:yo|me|mi|mis|mio|mia|mios|mias|conmigo|soy|estoy|tu|tus|te|ti|contigo|eres)\b"
TASK = (
    r"\b(?:en (?:mi|el|tu|su) cuaderno|"
    r"(?:observ|copi|dibuj|coment|convers|investig|identific|complet|recort|pint|elabor|subray|anot|realiz|pregunt|organiz|compar|explic|clasific|dialog|reflexion|solicit|marc|busc)(?:o|amos)|"
    r"(?:escrib|describ)(?:o|imos)|(?:respond|le|hac)(?:o|emos)|peg(?:o|amos)|"
    r"el juego consiste|(?:lanz|tir)(?:ar|a|an) el dado|su turno|por turnos|gana (?:quien|el que)|participantes?|con el apoyo del maestro|cada uno marca)\b"
)
TASK_WE = r"(?U)^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:amos|emos|imos)\b|\b\w+(?:aremos|eremos|iremos)\b"
STANDARD = r"(?U)\(\s*[A-Z]{1,3}\s*\d+\s*\)|^Est[aá]ndar\s+\d|\b[Ee]l maestro o (?:la )?maestra\b"
#: A word of at least two plain letters, one a vowel, with at most one mark after it.
PLAIN_WORD = f"^(?=[{LETTERS}]{{2}})[{LETTERS}]*[aeiouyáéíóúüAEIOUYÁÉÍÓÚÜ][{LETTERS}]*[.,;:!?]?$"
WORKSHEET = r"(?iU)\b(?:palabras clave|materiales|instrucciones|procedimiento|hip[oó]tesis)\s*:"


def split_pieces(c: Column) -> Column:
    """Pieces of a page's text: cut after sentence marks before a capital or an opening mark, and at line breaks; then the words that say who speaks, after a dash and in lower case, go back to the piece before."""
    def edge(x: Column) -> Column:
        return F.regexp_replace(x, f"^[{PIECE_EDGE}]+|[{PIECE_EDGE}]+$", "")

    def follows(x: Column) -> Column:
        return x.rlike(r"^(?U)\s*[\-–—]") & edge(x).rlike(r"^\p{Ll}")

    def add(done: Column, x: Column) -> Column:
        glued = F.concat(F.regexp_replace(F.element_at(done, -1), r"(?U)\s+$", ""), F.lit(" "), F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        return F.when((F.size(done) > 0) & follows(x), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(glued))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.split(c, SPLIT), F.array().cast("array<string>"), add)


def piece_text(c: Column) -> Column:
    """A piece as a sentence: blanks collapsed, edges, leading numbers, chapter heading and title in capitals taken off."""
    one = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    one = F.regexp_replace(one, f"^[{PIECE_EDGE}]+|[{PIECE_EDGE}]+$", "")
    one = F.regexp_replace(one, LEADING_NUMBERS, "")
    return without_title(F.regexp_replace(one, CHAPTER, ""))


def _is_title_word(w: Column) -> Column:
    letters = F.regexp_replace(w, r"\P{L}", "")
    n = F.length(letters)
    small = n - F.regexp_count(letters, F.lit(r"\p{Lu}"))
    return ((n >= 2) & (small <= F.when(n >= 4, 1).otherwise(0)) & letters.rlike(r"^\p{Lu}")) | w.isin("Y", "DE", "—", "-", ":")


def without_title(c: Column) -> Column:
    """A sentence without the words in capitals before it, if there are at least two."""
    def rest(w: Column) -> Column:
        first = F.array_position(F.transform(w, _is_title_word), False).cast("int")
        return let(F.when(first == 0, F.size(w)).otherwise(first - 1), lambda k: F.when(k >= 2, F.array_join(F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0))), " ")))

    def titled(w: Column) -> Column:
        """Nothing is computed of the other words unless the first two are in capitals."""
        return F.when((F.size(w) >= 2) & _is_title_word(F.get(w, 0)) & _is_title_word(F.get(w, 1)), rest(w))

    return F.coalesce(let(tokens(c), titled), c)


def study_words(c: Column) -> Column:
    return count(c, STUDY_WORD)


def is_dialogue(c: Column) -> Column:
    return c.rlike(DIALOGUE)


def is_personal(c: Column) -> Column:
    return fold(c).rlike(PERSON)


def is_task(c: Column) -> Column:
    return c.contains("•") | c.contains("¿") | c.rlike(TASK_WE) | c.rlike(STANDARD) | c.rlike(WORKSHEET) | fold(c).rlike(TASK)


def is_capitals(c: Column) -> Column:
    n = count(c, r"\p{L}")
    return (n >= 6) & (count(c, r"\p{Lu}") >= 0.6 * n)


def explains(c: Column) -> Column:
    """Tells or explains: no dialogue, person or task, not beginning in lower case, fewer than three commas."""
    return ~(is_dialogue(c) | is_personal(c) | is_task(c) | c.rlike(r"^\p{Ll}") | (count(c, ",") >= 3))


def is_legible(c: Column) -> Column:
    """Enough of the pieces are words or numbers, and enough of them words."""
    def kind(x: Column) -> Column:
        """w: a word, n: a number, x: anything else; empty without a letter or digit."""
        word = x.rlike(r"^\p{L}+(?:[-'’]\p{L}+)*$") & F.when(F.length(x) == 1, F.lower(x).isin("a", "e", "o", "u", "y")).otherwise(x.rlike(r"(?iu)[aeiouáéíóúüy]"))
        return F.when(x == "", "").when(word, "w").when(x.rlike(r"^(?U)\d+(?:[.,]\d+)*%?$"), "n").otherwise("x")

    # most words are seen to be words by one plain pattern
    kinds = F.transform(tokens(c), lambda x: F.when(x.rlike(PLAIN_WORD), "w").otherwise(let(F.regexp_replace(x, r"(?U)^\W+|\W+$", ""), kind)))

    def enough(k: Column) -> Column:
        n, word = F.length(k), F.length(F.replace(k, F.lit("w"), F.lit("")))
        return let(F.struct(n.alias("n"), (n - word).alias("w"), (n - F.length(F.replace(k, F.lit("n"), F.lit("")))).alias("d")), lambda s: (s["n"] > 0) & (s["w"] + s["d"] >= LEGIBLE * s["n"]) & (s["w"] >= LEGIBLE_WORDS * s["n"]))

    return let(F.array_join(kinds, ""), enough)


def pieces(pages: DataFrame) -> DataFrame:
    """libro, pagina, pos, trozo, texto: cleaned pieces of each page, empty ones too.

    Pieces are cleaned before they become rows, so that no later filter cleans them again.
    """
    cut = F.regexp_replace(text("texto"), SECTION_LABEL, "\n")
    return pages.select("libro", "pagina", "pos", F.posexplode(F.transform(split_pieces(cut), piece_text)).alias("trozo", "texto"))


def usable(df: DataFrame) -> DataFrame:
    """Pieces that can be sentences: 6 to 60 words, no more digits than words, legible."""
    return df.filter(let(study_words(F.col("texto")), lambda n: n.between(FEWEST, MOST) & (count(F.col("texto"), r"(?U)\d") <= n))).filter(is_legible(F.col("texto")))


def sentences(pages: DataFrame, headers: bool = True) -> DataFrame:
    """libro, orden, pagina, texto: the sentences of each book in reading order, each once.

    A sentence counts as repeated if it is the same without case and accents; its first occurrence stays.
    First occurrences are found by aggregation, not by gathering a book. ``orden`` runs from 0 without gaps
    within a book: pages are numbered by running sums over the book's pages (a narrow table of counts).
    """
    own = without_headers(pages) if headers else pages
    own = spread(own, "libro", "pagina", "pos")
    found = usable(pieces(own)).withColumn("clave", fold(F.col("texto")))
    first = found.groupBy("libro", "clave").agg(F.min(F.struct("pagina", "pos", "trozo", "texto")).alias("m")).select("libro", "m.*")
    per_page = first.groupBy("libro", "pagina", "pos").agg(F.count("*").alias("n"))
    before = Window.partitionBy("libro").orderBy("pagina", "pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_page.select("libro", "pagina", "pos", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("libro", "pagina", "pos").orderBy("trozo")) - 1
    return first.withColumn("_r", rank).join(offset, ["libro", "pagina", "pos"]).select("libro", (F.col("_o") + F.col("_r")).cast("int").alias("orden"), "pagina", "texto")
