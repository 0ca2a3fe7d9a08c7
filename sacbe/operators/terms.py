"""Terms of a book: n-grams, ranking, overlap removal, TF-IDF weights, similarity, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sacbe.functions.text import STUDY_WORD, contains_folded, fold, fold_word, words
from sacbe.functions.vocabulary import LABEL_WORDS, STOP_STUDY
from sacbe.storage import materialize

LONGEST, LEAST_TIMES, RANKED, KEPT, ALIKE = 3, 2, 180, 60, 0.4
SAME_SENTENCE = 0.05
#: Terms of a book that are held against each of its sentences; more meet sentences on their first word.
PAIRED = 300


def study_tokens(c: Column) -> Column:
    """Folded words; stop words and words under three letters are empty, so that neighbours stay neighbours."""
    return F.transform(_split(fold_word(_joined(c))), lambda t: F.when((F.length(t) < 3) | t.isin(*sorted(set(STOP_STUDY))), "").otherwise(t))


def _joined(c: Column) -> Column:
    """The words of a text with one blank between: what is done to all of them is done once."""
    return F.array_join(words(c, STUDY_WORD), " ")


def _split(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def ngrams(sentences: DataFrame) -> DataFrame:
    """libro, orden, i, clave, forma: every run of one to three content words with its written form."""
    base = sentences.select("libro", "orden", study_tokens(F.col("texto")).alias("t"), _split(F.lower(_joined(F.col("texto")))).alias("w"))

    def runs(i: Column) -> Column:
        """The runs that begin at i, null from the first one on that a word without content breaks."""
        some, key, form, whole = [], None, None, F.lit(True)
        for n in range(LONGEST):
            k, w = F.get("t", i + n), F.get("w", i + n)
            key, form, whole = (k, w, k != "") if key is None else (F.concat(key, F.lit(" "), k), F.concat(form, F.lit(" "), w), whole & (k != ""))
            some.append(F.when(whole, F.struct(i.alias("i"), key.alias("clave"), form.alias("forma"))))
        return F.filter(F.array(*some), lambda x: x.isNotNull())

    at = F.filter(F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)), lambda i: F.get("t", i) != "")
    # rows are made of whole runs, so that no row carries the words of its sentence
    return base.select("libro", "orden", F.explode(F.flatten(F.transform(at, runs))).alias("x")).select("libro", "orden", "x.i", "x.clave", "x.forma")


def ngram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("libro", "clave").agg(F.count("*").cast("int").alias("veces"))


def form_counts(grams: DataFrame) -> DataFrame:
    """libro, clave, forma, n, p: how often each written form of an n-gram is there, and where first (sentence and word in one number)."""
    return grams.groupBy("libro", "clave", "forma").agg(F.count("*").alias("n"), F.min(F.col("orden").cast("bigint") * 2**31 + F.col("i")).alias("p"))


def most_frequent(forms: DataFrame) -> DataFrame:
    return forms.groupBy("libro", "clave").agg(F.max_by("forma", F.struct("n", (-F.col("p")).alias("a"))).alias("forma"))


def modal_forms(grams: DataFrame) -> DataFrame:
    """The most frequent written form of each n-gram; of equals the one read first."""
    return most_frequent(form_counts(grams))


def ranked_candidates(counts: DataFrame, most: int = RANKED) -> DataFrame:
    """libro, puesto, clave, veces, puntos: n-grams seen at least twice, longer ones weighing more."""
    points = F.col("veces") * (1 + F.lit(0.5) * F.regexp_count("clave", F.lit(" ")))
    some = counts.filter((F.col("veces") >= LEAST_TIMES) & ~F.col("clave").isin(*LABEL_WORDS)).withColumn("puntos", points)
    place = F.row_number().over(Window.partitionBy("libro").orderBy(F.desc("puntos"), F.desc("clave")))
    return some.withColumn("puesto", place).filter(F.col("puesto") <= most).select("libro", "puesto", "clave", "veces", "puntos")


def without_overlaps(ranked: DataFrame, most: int = KEPT) -> DataFrame:
    """libro, puesto (from 1, without gaps), clave, veces: candidates of which none contains another of about the same frequency.

    At most RANKED candidates of a book are folded in rank order.
    """
    row = ranked.groupBy("libro").agg(F.array_sort(F.collect_list(F.struct("puesto", "clave", "veces"))).alias("c"))

    def clash(done: Column, x: Column) -> Column:
        return F.exists(done, lambda s: (F.contains(s["clave"], x["clave"]) | F.contains(x["clave"], s["clave"])) & (F.abs(s["veces"] - x["veces"]) <= x["veces"] * F.lit(ALIKE)))

    kept = F.aggregate("c", F.slice("c", 1, 0), lambda done, x: F.when(clash(done, x), done).otherwise(F.concat(done, F.array(x))))
    return row.select("libro", F.posexplode(F.slice(kept, 1, most)).alias("p", "x")).select("libro", (F.col("p") + 1).alias("puesto"), "x.clave", "x.veces")


TERM = "[a-z]{3,}"


def tfidf(sentences: DataFrame) -> DataFrame:
    """libro, orden, termino, peso: weights (1 + ln tf)(1 + ln((1 + n)/(1 + df))) of unit length per sentence, n and df counted within the book."""
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_STUDY))])
    own = F.filter(F.regexp_extract_all(fold(F.col("texto")), F.lit(rf"(?<![a-z0-9_]){TERM}(?![a-z0-9_])"), F.lit(0)), lambda t: ~F.array_contains(stop, t))
    tf = sentences.select("libro", "orden", F.explode(own).alias("termino")).groupBy("libro", "orden", "termino").agg(F.count("*").alias("tf"))
    size = sentences.groupBy("libro").agg(F.count("*").alias("n"))
    df = tf.groupBy("libro", "termino").agg(F.count("*").alias("df"))
    raw = tf.join(df, ["libro", "termino"]).join(size, "libro").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("libro", "orden").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("z"))
    return raw.join(norm, ["libro", "orden"]).select("libro", "orden", "termino", (F.col("w") / F.col("z")).alias("peso"))


def similar_sentences(weights: DataFrame, least: float = SAME_SENTENCE) -> DataFrame:
    """libro, a, b, similitud (cosine) for a < b of pairs with at least ``least``; sentences meet on their shared terms."""
    a, b = weights.select("libro", F.col("orden").alias("a"), "termino", F.col("peso").alias("x")), weights.select("libro", F.col("orden").alias("b"), "termino", F.col("peso").alias("y"))
    pairs = a.join(b, ["libro", "termino"]).filter("a < b").groupBy("libro", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similitud"))
    return pairs.filter(F.col("similitud") >= least)


def sentences_with(sentences: DataFrame, terms: DataFrame, term: str = "termino") -> DataFrame:
    """Sentences, with all their columns, joined with the terms of their book they hold as whole words.

    The terms of a book are an array beside each of its sentences. In books of more than PAIRED terms, terms
    meet sentences on their first word, so that they aren't paired blindly.
    """
    t = terms.withColumn("_t", fold(F.col(term))).withColumn("_h", F.regexp_extract("_t", "[a-z0-9]+", 0)).filter("_h <> ''")
    s = sentences.withColumn("_f", fold(F.col("texto")))
    more = [c for c in terms.columns if c != "libro"]
    lists = t.groupBy("libro").agg(F.count("*").alias("_n"), F.slice(F.collect_list(F.struct("_t", *more)), 1, PAIRED).alias("_ts"))
    many = materialize(lists.filter(F.col("_n") > PAIRED).select("libro"), "many")
    held = F.filter("_ts", lambda x: F.contains(F.col("_f"), x["_t"]) & contains_folded(F.col("_f"), x["_t"]))
    paired = s.join(lists.filter(F.col("_n") <= PAIRED), "libro").select(*sentences.columns, F.explode(held).alias("_x")).select(*sentences.columns, *[F.col(f"_x.{c}").alias(c) for c in more])
    if many.isEmpty():
        return paired
    by_word = s.join(many, "libro", "left_semi").select("*", F.explode(F.array_distinct(F.regexp_extract_all("_f", F.lit("[a-z0-9]+"), F.lit(0)))).alias("_h"))
    met = by_word.join(t.join(many, "libro", "left_semi"), ["libro", "_h"]).filter(F.contains("_f", "_t") & contains_folded(F.col("_f"), F.col("_t")))
    return paired.unionByName(met.select(*sentences.columns, *more))
