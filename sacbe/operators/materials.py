"""Study materials of a book: concepts, glossary, summary, flashcards, quiz.

Concepts and the sentences that name them are found by native joins and aggregations; what is inherently
sequential (picks that exclude each other, shuffled options) runs per book over its few concepts.
"""

from __future__ import annotations

import random
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sacbe.functions.text import STUDY_WORD, contains_term, cut_at_word, hide_term, tokens, words
from sacbe.operators.definitions import definitions, first_definitions
from sacbe.operators.pages import DEFAULT_COUNT
from sacbe.operators.ranking import MATRIX_SENTENCES, central, content_words, fold, mmr, mmr_by_joins, prior, rows_of, sentence_scores, vectors
from sacbe.operators.sentences import explains
from sacbe.operators.terms import LEAST_TIMES, form_counts, most_frequent, ngrams, ranked_candidates, sentences_with, without_overlaps
from sacbe.storage import materialize

CONTEXTS, OPENING, CLOZE_WORDS, OPTIONS = 4, 6, 32, 4
BAND = (0.05, 0.85)
SUMMARY_TERMS = 12


def concept_keys(sentences: DataFrame) -> DataFrame:
    """libro, nivel (0 strong definition, 1 weak, 2 frequent term), lugar, clave, termino, veces, and the definition's texto and pagina."""
    seen = materialize(form_counts(ngrams(sentences)), "forms")
    counts = materialize(seen.groupBy("libro", "clave").agg(F.sum("n").cast("int").alias("veces")).filter(F.col("veces") >= LEAST_TIMES), "counts")
    kept = materialize(without_overlaps(ranked_candidates(counts)), "kept")
    defined = materialize(first_definitions(definitions(sentences), kept), "defined")
    forms = most_frequent(seen.join(kept.select("libro", "clave"), ["libro", "clave"], "left_semi"))
    a = defined.select("libro", F.when(F.col("fuerte"), 0).otherwise(1).alias("nivel"), F.col("orden").alias("lugar"), "clave", "termino", "texto", "pagina")
    b = kept.join(forms, ["libro", "clave"]).join(defined.select("libro", "clave"), ["libro", "clave"], "left_anti")
    b = b.select("libro", F.lit(2).alias("nivel"), F.col("puesto").alias("lugar"), "clave", F.col("forma").alias("termino"), F.lit(None).cast("string").alias("texto"), F.lit(None).cast("int").alias("pagina"))
    return a.unionByName(b).join(counts, ["libro", "clave"], "left").withColumn("veces", F.coalesce("veces", F.lit(1)))


def concepts(sentences: DataFrame, most: int = DEFAULT_COUNT["glossary"]) -> tuple[DataFrame, DataFrame]:
    """(concepts, uses): at most ``most`` concepts a book, and every sentence that names one.

    concepts: libro, puesto, termino, es_definicion, definicion, pagina, veces (definicion null for frequent
    terms until a context is chosen); uses: libro, puesto, orden, pagina, texto, explica, de_tema.
    """
    got, named = named_concepts(sentences, most)
    return got, with_texts(sentences, named)


def named_concepts(sentences: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(concepts, named): as ``concepts``, with each use as libro, orden, puesto, dicho (the term before it is shown), explica, without its text."""
    keys = materialize(concept_keys(sentences), "keys")
    said = sentences.withColumn("explica", explains(F.col("texto")))
    uses = materialize(sentences_with(said, keys.select("libro", "clave", "termino")).select("libro", "orden", "clave", "explica"), "uses")
    seen = uses.groupBy("libro", "clave").agg(F.count("*").alias("n"), F.bool_or("explica").alias("alguna"))
    fit = keys.join(seen, ["libro", "clave"], "left").filter("nivel < 2 or (n >= 2 and alguna)")
    place = F.row_number().over(Window.partitionBy("libro").orderBy("nivel", "lugar", "clave"))
    top = materialize(fit.withColumn("puesto", place).filter(F.col("puesto") <= most), "top")
    shown = F.when(F.col("termino").rlike(r"^\p{Lu}"), F.col("termino")).otherwise(F.lower("termino"))
    got = top.select("libro", "puesto", "clave", shown.alias("termino"), (F.col("nivel") < 2).alias("es_definicion"), F.col("texto").alias("definicion"), "pagina", F.greatest(F.coalesce("n", F.lit(0)), F.col("veces")).cast("int").alias("veces"))
    return got, materialize(uses.join(top.select("libro", "clave", "puesto", F.col("termino").alias("dicho")), ["libro", "clave"]).select("libro", "orden", "puesto", "dicho", "explica"), "named")


def with_texts(sentences: DataFrame, named: DataFrame) -> DataFrame:
    """Uses of concepts with the page and text of their sentence, and whether it opens with the term."""
    opening = F.array_join(F.slice(words(F.col("texto"), STUDY_WORD), 1, OPENING), " ")
    own = named.join(sentences.select("libro", "orden", "pagina", "texto"), ["libro", "orden"]).withColumn("de_tema", contains_term(opening, F.col("dicho")))
    return materialize(own.select("libro", "puesto", "orden", "pagina", "texto", "explica", "de_tema"), "chosen")


def with_contexts(got: DataFrame, uses: DataFrame, count: int = CONTEXTS) -> DataFrame:
    """Concepts with ``contextos`` (array of orden, pagina, texto; none if ``count`` is 0) and a chosen context as definition where there is none.

    The uses of a concept are ranked in one matrix; those of more than MATRIX_SENTENCES by joins.
    """
    rated = uses.withColumn("prior", prior(F.col("texto")))
    schema = "libro bigint, puesto int, mejor string, su_pagina int, contextos array<struct<orden:int,pagina:int,texto:string>>"

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("orden")
        tell = x[x["explica"]]
        tiers = [x[x["explica"] & x["de_tema"]], tell, x]
        pool = next(t for t in tiers if len(t))
        one = pool.iloc[central(list(pool["texto"]), list(pool["prior"]), None, 1)[0]]
        tell = tell if len(tell) else x
        picks = tell.iloc[central(list(tell["texto"]), list(tell["prior"]), None, count) if count else []]
        return pd.DataFrame({"libro": [x["libro"].iloc[0]], "puesto": [x["puesto"].iloc[0]], "mejor": [one["texto"]], "su_pagina": [one["pagina"]], "contextos": [[{"orden": int(o), "pagina": int(p), "texto": t} for o, p, t in zip(picks["orden"], picks["pagina"], picks["texto"])]]})

    key = ["libro", "puesto"]
    many = materialize(uses.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or("explica").alias("alguna"), F.bool_or(F.col("explica") & F.col("de_tema")).alias("tema")).filter(F.col("n") > MATRIX_SENTENCES), "many")
    if many.isEmpty():
        chosen = rated.groupBy(*key).applyInPandas(run, schema)
    else:
        chosen = rated.join(many, key, "left_anti").groupBy(*key).applyInPandas(run, schema).unionByName(_contexts_by_joins(rated, many, count))
    j = got.join(chosen, key, "left")
    return j.select("libro", "puesto", "termino", "es_definicion", F.coalesce("definicion", "mejor").alias("definicion"), F.coalesce("pagina", "su_pagina").alias("pagina"), "veces", "contextos")


def _contexts_by_joins(rated: DataFrame, many: DataFrame, most: int) -> DataFrame:
    """What ``with_contexts`` chooses for the concepts of ``many``, too many uses for a matrix."""
    own = rated.join(many.select("libro", "puesto", "alguna", "tema"), ["libro", "puesto"])
    tell = own.filter(F.col("explica") | ~F.col("alguna"))
    pool = tell.filter(F.col("de_tema") | ~F.col("tema"))

    def picks(some: DataFrame, count: int) -> DataFrame:
        group = F.xxhash64("libro", "puesto")  # a group takes the place of a book
        rows = materialize(some.select(group.alias("libro"), F.col("libro").alias("de"), "puesto", "orden", "pagina", "texto", "prior"), "group")
        scored = sentence_scores(rows.select("libro", "orden", "texto")).join(rows.select("libro", "orden", "prior"), ["libro", "orden"])
        got = mmr_by_joins(rows, materialize(scored.select("libro", "orden", (F.col("puntos") * F.col("prior")).alias("relevancia")), "relevance"), count)
        return rows.join(got, ["libro", "orden"], "left_semi").drop("libro").withColumnRenamed("de", "libro")

    best = picks(pool, 1).select("libro", "puesto", F.col("texto").alias("mejor"), F.col("pagina").alias("su_pagina"))
    if not most:
        return best.withColumn("contextos", F.array().cast("array<struct<orden:int,pagina:int,texto:string>>"))
    context = picks(tell, most).groupBy("libro", "puesto").agg(F.array_sort(F.collect_list(F.struct("orden", "pagina", "texto"))).alias("contextos"))
    return best.join(context, ["libro", "puesto"])


def glossary(sentences: DataFrame, most: int = DEFAULT_COUNT["glossary"]) -> DataFrame:
    got, uses = concepts(sentences, most)
    return with_contexts(got, uses)


def term_coverage(sentences: DataFrame, got: DataFrame) -> DataFrame:
    """libro, orden, cuantos: concepts of its book that each sentence names (sentences without any are left out)."""
    return sentences_with(sentences, got.select("libro", "termino")).groupBy("libro", "orden").agg(F.countDistinct("termino").cast("int").alias("cuantos"))


def summary(sentences: DataFrame, most: int = DEFAULT_COUNT["summary"]) -> DataFrame:
    """libro, puesto, orden, pagina, texto: central sentences in reading order.

    Scores come from all sentences of the book that don't end in a colon, and the picks are made among all of
    them: in one matrix per book, or by joins in books of more than MATRIX_SENTENCES sentences.
    """
    pool = materialize(sentences.filter(~F.rtrim("texto").endswith(":")), "pool")
    got, _ = concepts(sentences, SUMMARY_TERMS)
    covered = term_coverage(pool, got)
    scored = sentence_scores(pool).join(pool, ["libro", "orden"]).join(covered, ["libro", "orden"], "left")
    total = F.col("puntos") * prior(F.col("texto")) * (1 + F.lit(0.25) * F.coalesce("cuantos", F.lit(0)))
    rated = scored.select("libro", "orden", "pagina", "texto", total.alias("relevancia"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("orden").reset_index(drop=True)
        v = vectors(list(x["texto"]))
        y = x.iloc[sorted(mmr(v @ v.T, x["relevancia"].to_numpy(), most))]
        return pd.DataFrame({"libro": y["libro"].to_numpy(), "puesto": range(1, len(y) + 1), "orden": y["orden"].to_numpy(), "pagina": y["pagina"].to_numpy(), "texto": y["texto"].to_numpy()})

    def in_matrix(x: DataFrame) -> DataFrame:
        return x.groupBy("libro").applyInPandas(run, "libro bigint, puesto int, orden int, pagina int, texto string")

    long = materialize(pool.groupBy("libro").agg(F.count("*").alias("n")).filter(F.col("n") > MATRIX_SENTENCES).select("libro"), "long")
    if long.isEmpty():
        return in_matrix(rated)
    rated = materialize(rated, "rated")
    own = pool.join(long, "libro", "left_semi")
    picks = mmr_by_joins(own, rated.join(long, "libro", "left_semi").select("libro", "orden", "relevancia"), most)
    place = F.row_number().over(Window.partitionBy("libro").orderBy("orden"))
    by_joins = own.join(picks, ["libro", "orden"], "left_semi").select("libro", place.alias("puesto"), "orden", "pagina", "texto")
    return in_matrix(rated.join(long, "libro", "left_anti")).unionByName(by_joins)


def _book_rows(sentences: DataFrame, most: int) -> DataFrame:
    """One row a concept with all its uses: what the per-book steps need."""
    got, uses = concepts(sentences, most)
    told = with_contexts(got, uses)
    own = uses.join(got.select("libro", "puesto", "termino"), ["libro", "puesto"]).withColumn("prior", prior(F.col("texto"))).withColumn("hueco", hide_term(F.col("texto"), F.col("termino"))).withColumn("n", F.size(tokens(F.col("texto"))))
    lists = own.groupBy("libro", "puesto").agg(F.array_sort(F.collect_list(F.struct("orden", "pagina", "texto", "prior", "hueco", "n"))).alias("usos"))
    hidden = cut_at_word(hide_term(F.col("definicion"), F.col("termino")))
    return told.drop("contextos").join(lists, ["libro", "puesto"], "left").withColumn("descripcion", hidden)


def _cloze(uses, used: set) -> dict | None:
    fit = [u for u in (uses if uses is not None else []) if u["texto"] not in used and u["n"] <= CLOZE_WORDS]
    return fit[central([u["texto"] for u in fit], [u["prior"] for u in fit], None, 1)[0]] if fit else None


# The wording of questions and cards (here and below) is fixed.
def _question(row) -> str:
    if not row["es_definicion"]:
        return f"¿Qué dice el libro sobre {row['termino']}?"
    low = str(row["definicion"]).lower()
    return f"¿Qué {'significa' if ' significa ' in f' {low} ' or ' quiere decir ' in f' {low} ' else 'es'} {row['termino']}?"


def flashcards(sentences: DataFrame, most: int = DEFAULT_COUNT["flashcards"]) -> DataFrame:
    """libro, puesto, pregunta, respuesta, pagina, tipo: definitions, contexts and gaps in turn; no sentence is used twice."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out: list[tuple] = []
        for _, r in x.sort_values("puesto").iterrows():
            if len(out) < most and r["definicion"] not in used:
                used.add(r["definicion"])
                out.append((_question(r), r["definicion"], r["pagina"], "definicion" if r["es_definicion"] else "contexto"))
            u = _cloze(r["usos"], used) if len(out) < most else None
            if u is not None:
                used.add(u["texto"])
                out.append((f"Completa la frase: «{u['hueco']}»", r["termino"], u["pagina"], "cloze"))
        got = pd.DataFrame(out[:most], columns=["pregunta", "respuesta", "pagina", "tipo"])
        got.insert(0, "puesto", range(1, len(got) + 1))
        got.insert(0, "libro", x["libro"].iloc[0])
        return got

    return _book_rows(sentences, most).groupBy("libro").applyInPandas(run, "libro bigint, puesto int, pregunta string, respuesta string, pagina int, tipo string")


def nearest(similarity, k: int, options: list[str]) -> list[str]:
    """Other options by likeness to option k, those of the same subject but no synonyms first; equal texts once."""
    order = sorted((i for i in range(len(options)) if i != k), key=lambda i: (not BAND[0] <= similarity[k, i] <= BAND[1], -similarity[k, i], i))
    return [o for o in dict.fromkeys(options[i] for i in order) if o != options[k]]


def differing(right: str, others: list[str]) -> list[str] | None:
    """The right option and the first others that differ; None if too few do."""
    kept = {" ".join(right.casefold().split()): right}
    for o in others:
        if len(kept) < OPTIONS:
            kept.setdefault(" ".join(o.casefold().split()), o)
    return list(kept.values()) if len(kept) == OPTIONS else None


def shuffled(question: str, options: list[str]) -> tuple[list[str], int]:
    """Options in an order fixed by the question, and the place of the first one, which is right."""
    right, options = options[0], list(options)
    random.Random(sum(map(ord, question))).shuffle(options)
    return options, options.index(right)


def assemble(question: str, right: str, others: list[str]) -> tuple[list[str], int] | None:
    """Options in an order fixed by the question, and the place of the right one; None if too few differ."""
    kept = differing(right, others)
    return shuffled(question, kept) if kept else None


def quiz(sentences: DataFrame, pages: DataFrame, most: int = DEFAULT_COUNT["quiz"]) -> DataFrame:
    """libro, puesto, pregunta, opciones, correcta (from 0), pagina; none for books of fewer than four concepts.

    A distractor may not stand on the page of the gap: that page's text comes along with each use.
    """
    got, named = named_concepts(sentences, max(3 * most, 12))
    # what a concept is said to be is asked only where a definition is: it is a distractor of that definition
    defining = materialize(got.filter("es_definicion").select("libro").distinct(), "defining")
    told = with_contexts(got.join(defining, "libro", "left_semi"), with_texts(sentences, named.join(defining, "libro", "left_semi")), 0).drop("veces", "contextos")
    rows = materialize(told.unionByName(got.join(defining, "libro", "left_anti").select(told.columns)).withColumn("descripcion", cut_at_word(hide_term(F.col("definicion"), F.col("termino")))).drop("definicion"), "concepts")
    by_sentence = named.groupBy("libro", "orden").agg(F.collect_list("puesto").alias("puestos")).join(sentences.select("libro", "orden", "pagina", "texto"), ["libro", "orden"])
    uses = materialize(by_sentence.withColumn("prior", prior(F.col("texto"))).withColumn("n", F.size(tokens(F.col("texto")))), "said")
    needed = uses.select("libro", "pagina").distinct()
    around = pages.join(needed, ["libro", "pagina"], "left_semi").groupBy("libro", "pagina").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("texto", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("texto"))
    # which concepts a page names is found by joins, so that no page text goes to the per-book step
    there = sentences_with(around, rows.select("libro", "puesto", "termino")).groupBy("libro", "puesto").agg(F.collect_set("pagina").alias("paginas"))
    full = rows.join(there, ["libro", "puesto"], "left")

    kinds = pa.schema([("libro", pa.int64()), ("puesto", pa.int32()), ("termino", pa.string()), ("frase", pa.string()), ("opciones", pa.list_(pa.string())), ("pagina", pa.int32())])

    def holds(text: str, term: str) -> bool:
        return re.search(rf"(?<![a-z0-9]){re.escape(fold(term))}(?![a-z0-9])", fold(text)) is not None

    def pick(x: pa.Table, said: pa.Table) -> pa.Table:
        """Questions of a book: the term, the sentence of a gap, the options with the right one first."""
        out: list[tuple] = []
        if len(x) >= OPTIONS:
            c = x.sort_by("puesto").to_pydict()
            places, names, told, defined, at = c["puesto"], c["termino"], [d or "" for d in c["descripcion"]], c["es_definicion"], c["pagina"]
            on = [set(p or ()) for p in c["paginas"]]
            own: dict[int, list[dict]] = {p: [] for p in places}
            for u in said.sort_by("orden").to_pylist():
                for p in u["puestos"]:
                    own[p].append(u)
            v = rows_of([[w for u in own[p][:8] for w in content_words(u["texto"])] if own[p] else content_words(t) for p, t in zip(places, names)])
            sim = v @ v.T
            used: set = set()
            for k, p in enumerate(places):
                if len(out) >= most:
                    break
                if defined[k]:
                    kept = differing(told[k], [d for d in nearest(sim, k, told) if not holds(d, names[k])])
                    if kept and ("", names[k]) not in used:
                        used.add(("", names[k]))
                        out.append((names[k], None, kept, at[k]))
                        continue
                u = _cloze(own[p], used)
                if u is None:
                    continue
                used.add(u["texto"])
                near = {names[i] for i in range(len(names)) if u["pagina"] in on[i]}
                kept = differing(names[k], [d for d in nearest(sim, k, names) if d not in near])
                if kept:
                    out.append((names[k], u["texto"], kept, u["pagina"]))
        book = x["libro"][0].as_py() if out else None
        return pa.Table.from_pylist([dict(zip(kinds.names, (book, k, *o))) for k, o in enumerate(out, 1)], kinds)

    def order(batches):
        for x in batches:
            made = [shuffled(q, list(o)) for q, o in zip(x["pregunta"], x["opciones"])]
            yield pd.DataFrame({"libro": x["libro"], "puesto": x["puesto"], "pregunta": x["pregunta"], "opciones": [o for o, _ in made], "correcta": [c for _, c in made], "pagina": x["pagina"]})

    picked = full.groupBy("libro").cogroup(uses.groupBy("libro")).applyInArrow(pick, "libro bigint, puesto int, termino string, frase string, opciones array<string>, pagina int")
    gap = F.concat(F.lit("¿Qué palabra completa la frase? «"), hide_term(F.col("frase"), F.col("termino")), F.lit("»"))
    asked = F.when(F.col("frase").isNull(), F.concat(F.lit("¿Cuál de estas afirmaciones describe «"), "termino", F.lit("»?"))).otherwise(gap)
    return picked.select("libro", "puesto", asked.alias("pregunta"), "opciones", "pagina").mapInPandas(order, "libro bigint, puesto int, pregunta string, opciones array<string>, correcta int, pagina int")
