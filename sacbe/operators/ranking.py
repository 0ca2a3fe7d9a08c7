"""Central sentences: TextRank over TF-IDF similarity, priors, coverage, and picks that differ (MMR)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.functions.text import tokens
from sacbe.functions.vocabulary import STOP_STUDY
from sacbe.operators.sentences import is_capitals, is_dialogue, is_task
from sacbe.operators.terms import SAME_SENTENCE, similar_sentences, study_tokens, tfidf
from sacbe.storage import materialize

# Fixed values of the method.
DAMPING, ROUNDS, NOVELTY = 0.85, 60, 0.7
FULL_LENGTH, CONTENT = 14, 4
PER_TERM = 0.25
#: Books of more sentences are ranked by joins instead of one matrix per book (200 MB at most).
MATRIX_SENTENCES = 5000
#: Rounds of ranks by joins between two writes.
AT_ONCE = 10
_STOP = frozenset(STOP_STUDY)
_TERM = re.compile(r"(?<![a-z0-9_])[a-z]{3,}(?![a-z0-9_])")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c < "\u0300" or not unicodedata.combining(c)).lower()


@lru_cache(4096)
def content_words(text: str) -> tuple[str, ...]:
    return tuple(t for t in _TERM.findall(fold(text)) if t not in _STOP)


def vectors(texts: list[str]) -> np.ndarray:
    """TF-IDF rows of unit length, sublinear counts, smooth idf; no columns if no text has a content word."""
    return rows_of([content_words(x) for x in texts])


def rows_of(texts: list) -> np.ndarray:
    """``vectors`` of texts given by their content words."""
    counts = [Counter(x) for x in texts]
    df = Counter(t for c in counts for t in c)
    place = {t: k for k, t in enumerate(sorted(df))}
    out = np.zeros((len(texts), len(place)))
    tf = {n: 1 + np.log(n) for n in {n for c in counts for n in c.values()}}
    idf = {k: np.log((1 + len(texts)) / (1 + k)) + 1 for k in set(df.values())}
    for i, c in enumerate(counts):
        out[i, [place[t] for t in c]] = [tf[n] * idf[df[t]] for t, n in c.items()]
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def textrank(similarity: np.ndarray, rounds: int = ROUNDS, overwrite: bool = False) -> np.ndarray:
    """Scores after some rounds of power iteration; weak links don't count, sentences without links vote for all alike."""
    n = len(similarity)
    w = similarity if overwrite else similarity.copy()
    w[w < SAME_SENTENCE] = 0.0
    np.fill_diagonal(w, 0.0)
    total = w.sum(axis=1)
    linked = total > 0
    share = np.where(linked, total, 1.0)
    score = np.full(n, 1.0 / n) if n else np.zeros(0)
    loose = np.flatnonzero(~linked)
    for _ in range(rounds if n else 0):  # links go both ways: w is its own transpose
        given = w @ (score / share)
        score = (1 - DAMPING) / n + DAMPING * (given + score[loose].sum() / n if len(loose) else given)
    return score


def mmr(similarity: np.ndarray, relevance: np.ndarray, count: int) -> list[int]:
    """Picks that are relevant and unlike the picks before; of equals the first."""
    if not len(relevance):
        return []
    rel = relevance / (relevance.max() or 1.0)
    near, free, out = np.zeros(len(rel)), np.ones(len(rel), bool), []
    while len(out) < min(count, len(rel)):
        score = np.where(free, NOVELTY * rel - (1 - NOVELTY) * near, -np.inf)
        k = int(score.argmax())
        out.append(k)
        free[k] = False
        near = np.maximum(near, similarity[k])
    return out


def mmr_by_joins(sentences: DataFrame, relevance: DataFrame, count: int) -> DataFrame:
    """libro, orden of the picks of ``mmr`` among all sentences of a book, for books too long for a matrix.

    ``relevance``: libro, orden, relevancia. Each round joins the terms of the last pick to all sentences of
    its book; the greatest similarity to a pick so far is written to the shared folder like scores are.
    """
    weights = materialize(tfidf(sentences), "weights")
    top = relevance.groupBy("libro").agg(F.max("relevancia").alias("m"))
    scaled = F.col("relevancia") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m"))
    free = materialize(relevance.join(top, "libro").select("libro", "orden", scaled.alias("rel"), F.lit(0.0).alias("near")), "free")
    cost = (1 - NOVELTY) * F.col("near") - NOVELTY * F.col("rel")
    picks = []
    for k in range(count):
        pick = materialize(free.groupBy("libro").agg(F.min(F.struct(cost.alias("c"), "orden"))["orden"].alias("orden")), "picks")
        picks.append(pick)
        if k + 1 < count:
            said = materialize(weights.join(pick, ["libro", "orden"], "left_semi").select("libro", "termino", F.col("peso").alias("y")), "said")
            sim = weights.join(said, ["libro", "termino"]).groupBy("libro", "orden").agg(F.sum(F.col("peso") * F.col("y")).alias("z"))
            rest = free.join(pick, ["libro", "orden"], "left_anti").join(sim, ["libro", "orden"], "left")
            free = materialize(rest.select("libro", "orden", "rel", F.greatest("near", F.coalesce("z", F.lit(0.0))).alias("near")), "free")
    return reduce(DataFrame.unionByName, picks, relevance.select("libro", "orden").limit(0))


def central(texts: list[str], prior: list[float], coverage: list[int] | None, count: int) -> list[int]:
    """Positions of the most representative texts, in their order."""
    if len(texts) <= count:
        return list(range(len(texts)))
    v = vectors(texts)
    sim = v @ v.T
    score = textrank(sim) * np.array(prior)
    if coverage is not None:
        score = score * (1 + PER_TERM * np.array(coverage))
    return sorted(mmr(sim, score, count))


def prior(c: Column) -> Column:
    """Weight of a sentence before its links: short ones, dialogue, titles and tasks weigh less."""
    content = F.size(F.filter(study_tokens(c), lambda t: t != ""))
    length = F.least(F.lit(1.0), F.size(tokens(c)) / FULL_LENGTH)
    return F.when(content < CONTENT, 0.02).otherwise(length * F.when(is_dialogue(c), 0.6).otherwise(1.0) * F.when(is_capitals(c), 0.05).otherwise(1.0) * F.when(is_task(c), 0.2).otherwise(1.0))


def textrank_by_joins(sentences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """libro, orden, puntos by joins over the links alone, for books too long for a matrix.

    Links go both ways, so a sentence without links gets votes from such sentences only: all of them in a book
    have the same score, which follows from the number of rounds. A round is one join and one aggregation of
    the linked sentences; scores are written to the shared folder every AT_ONCE rounds.
    """
    links = similar_sentences(tfidf(sentences))
    both = links.select("libro", "a", "b", "similitud").unionByName(links.select("libro", F.col("b").alias("a"), F.col("a").alias("b"), "similitud"))
    both = materialize(both, "links")
    total = both.groupBy("libro", "a").agg(F.sum("similitud").alias("z"))
    size = sentences.groupBy("libro").agg(F.count("*").alias("n")).join(total.groupBy("libro").agg(F.count("*").alias("c")), "libro", "left")
    size = materialize(size.select("libro", "n", (F.col("n") - F.coalesce("c", F.lit(0))).alias("m")), "sizes")
    step = materialize(both.join(total, ["libro", "a"]).select("libro", "a", "b", (F.col("similitud") / F.col("z")).alias("p")).repartition("libro", "a"), "steps")

    def alone(k: int) -> Column:
        """The score of a sentence without links after k rounds."""
        rate = DAMPING * F.col("m") / F.col("n")
        return (1 - DAMPING) / F.col("n") * (1 - F.pow(rate, F.lit(k))) / (1 - rate) + F.pow(rate, F.lit(k)) / F.col("n")

    score = total.join(size, "libro").select("libro", F.col("a").alias("orden"), "n", "m", (1 / F.col("n")).alias("s"))
    for k in range(rounds):
        given = score.withColumnRenamed("orden", "a").join(step, ["libro", "a"]).groupBy("libro", F.col("b").alias("orden")).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum(F.col("s") * F.col("p")).alias("g"))
        score = given.select("libro", "orden", "n", "m", ((1 - DAMPING) / F.col("n") + DAMPING * (F.col("g") + F.col("m") * alone(k) / F.col("n"))).alias("s"))
        if k % AT_ONCE == AT_ONCE - 1:
            score = materialize(score, "scores")
    own = sentences.select("libro", "orden").join(size, "libro").join(score.select("libro", "orden", "s"), ["libro", "orden"], "left")
    return own.select("libro", "orden", F.coalesce("s", alone(rounds)).alias("puntos"))


def sentence_scores(sentences: DataFrame) -> DataFrame:
    """libro, orden, puntos: TextRank of every sentence.

    Books of at most MATRIX_SENTENCES sentences are ranked in one matrix per book, longer ones by joins.
    """
    size = materialize(sentences.groupBy("libro").agg(F.count("*").alias("n")), "sizes")
    small = sentences.join(size.filter(F.col("n") <= MATRIX_SENTENCES), "libro", "left_semi")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("orden")
        v = vectors(list(x["texto"]))
        return pd.DataFrame({"libro": x["libro"].to_numpy(), "orden": x["orden"].to_numpy(), "puntos": textrank(v @ v.T, overwrite=True)})

    out = small.select("libro", "orden", "texto").groupBy("libro").applyInPandas(run, "libro bigint, orden int, puntos double")
    if size.filter(F.col("n") > MATRIX_SENTENCES).isEmpty():
        return out
    return out.unionByName(textrank_by_joins(sentences.join(size.filter(F.col("n") > MATRIX_SENTENCES), "libro", "left_semi")))
