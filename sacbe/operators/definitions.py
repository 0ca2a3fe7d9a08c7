"""Definitions in sentences: a term, its sentence, and whether the verb really defines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.functions.text import STUDY_WORD, count, fold, let, strip
from sacbe.functions.vocabulary import LABEL_WORDS
from sacbe.operators.sentences import is_capitals, is_dialogue, is_personal, is_task
from sacbe.operators.terms import study_tokens

_ARTICLE = "(?:el |la |los |las |un |una |unos |unas )?"
# The verbs and participles that announce a definition, and the words that weaken or confirm it.
VERB = rf"(?iu)^{_ARTICLE}([^,;:()]{{2,45}}?)\s+(es|son|era|eran|consiste en|significa|quiere decir|se define como|se denomina|se llama|se refiere a|se conoce como|se entiende por|comprende|abarca)\s+(\S.{{15,}})$"
NAMED = rf"(?iu)^(.{{15,}}?)\b(?:se (?:llama|denomina|conoce como)|llamad[oa]s?|denominad[oa]s?|conocid[oa]s? como)\s+{_ARTICLE}([^,;:().]{{2,45}})\.?$"
COLON = r"(?u)^([^:]{2,45}):\s+(\S.{15,})$"
WEAK_REST = r"(?iuU)^(?:muy|tan|m[aá]s|menos|casi|s[oó]lo|bastante|demasiado|un poco|as[ií])\b"
CLASSIFIES = r"(?iuU)^(?:el|la|lo|los|las|un|una|unos|unas|uno de|una de|aquel|aquella|aquello)\b"
WEAK_VERBS, SINGULAR = ("es", "son", "era", "eran", "comprende", "abarca", ""), ("es", "era")


def _sound(term: Column, rest: Column) -> Column:
    t = study_tokens(term)
    return (
        (count(term, STUDY_WORD) <= 4) & ~rest.rlike(WEAK_REST) & ~is_capitals(term) & ~term.rlike(r"(?U)\d")
        & (F.size(t) > 0) & (F.coalesce(F.get(t, 0), F.lit("")) != "") & (F.coalesce(F.element_at(t, -1), F.lit("")) != "")
    )


def _is_list(rest: Column) -> Column:
    items = F.filter(F.split(rest, r"(?U),|\by\b"), lambda x: F.trim(x) != "")
    total = F.aggregate(F.transform(items, lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda p: p != ""))), F.lit(0), lambda a, x: a + x)
    return (F.size(items) >= 3) & (total <= 3 * F.size(items))


def definition(c: Column) -> Column:
    """struct(termino, fuerte) of a sentence that defines a term, else null."""
    s = strip(c)
    got = []
    for pattern, term_at, rest_at in ((VERB, 1, 3), (NAMED, 2, 1), (COLON, 1, 2)):
        hit = s.rlike(pattern)
        if pattern is NAMED:  # looked for at every letter, so only where a stem of its verbs is
            hit = (F.lower(s).contains("llama") | F.lower(s).contains("denom") | F.lower(s).contains("conoc")) & hit
        term = F.regexp_replace(F.regexp_extract(s, pattern, term_at), "^[ \"«»']+|[ \"«»']+$", "")
        rest = strip(F.regexp_extract(s, pattern, rest_at))
        ok = hit & _sound(term, rest)
        strong = F.lit(False)
        if pattern is VERB:
            verb = F.lower(F.regexp_extract(s, pattern, 2))
            ok = ok & (~verb.isin(*SINGULAR) | rest.rlike(CLASSIFIES))
            strong = ~verb.isin(*WEAK_VERBS)
        if pattern is COLON:
            ok = ok & ~_is_list(rest) & ~fold(term).isin(*LABEL_WORDS)
        got.append(F.when(ok, F.struct(term.alias("termino"), strong.alias("fuerte"))))
    return let(F.coalesce(*got), lambda x: F.when(x.isNotNull() & ~(is_dialogue(c) | is_personal(c) | is_task(c)), x))


def definitions(sentences: DataFrame) -> DataFrame:
    """libro, orden, pagina, clave, termino, fuerte, texto of every defining sentence."""
    # an exploded array of none or one: the patterns run once, not again in a filter
    d = sentences.select("libro", "orden", "pagina", "texto", F.explode(F.filter(F.array(definition(F.col("texto"))), lambda x: x.isNotNull())).alias("_d"))
    key = F.array_join(F.filter(study_tokens(F.col("_d.termino")), lambda t: t != ""), " ")
    return d.select("libro", "orden", "pagina", key.alias("clave"), "_d.termino", "_d.fuerte", "texto").filter("clave <> ''")


def first_definitions(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first definition of each key; weak ones only for keys among the book's candidates."""
    known = candidates.select("libro", "clave", F.lit(True).alias("_c")).distinct()
    fit = found.join(known, ["libro", "clave"], "left").filter("fuerte or _c").drop("_c")
    return fit.groupBy("libro", "clave").agg(F.min(F.struct("orden", "pagina", "termino", "fuerte", "texto")).alias("m")).select("libro", "clave", "m.*")
