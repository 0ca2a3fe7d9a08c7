"""Problem 4: evaluation examples that also stand, as they are or little changed, in training.

Texts become sequences of word skeletons (no case, accents, punctuation; letters that scans confuse fall
together). Rows with the same sequence form a class and are handled once. Classes are minhashed over
shingles of five skeletons into banded buckets; only pairs with a training member on one side and an
evaluation member on the other become candidates; each is verified by its exact Jaccard similarity, on word
codes of 32 bits, and, where that leaves doubt, on the texts by the share of the longer one that stands in
common stretches of the other.

The bands are set for a Jaccard similarity of ``SURE_FOUND``: one misread word breaks five shingles, so a
pair that keeps 85 % of its words in stretches can come out near 0.4 (TESTDATA.md sets the cases here).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.llm.grouped_splits import source_key
from sacbe.llm.words import Memo, fold, parts, print_shape
from sacbe.storage import materialize, table

SHINGLE = 5
BANDS, PER_BAND = 48, 3
#: A class is hot with at least 1/HOT of all rows; its rows are dealt over SALTS tasks in joins.
HOT, SALTS = 1000, 64
#: At this similarity a pair shares a bucket with probability 1 - (1 - 0.45**3)**48 = 0.99.
SURE_FOUND = 0.45
#: Jaccard at or above which a pair is confirmed outright, and below which it is none.
CONFIRMED, REFUTED = 0.75, 0.2
#: Words of the longer text that must stand in common stretches, and the shortest stretch. The cases have 0.85, all other pairs less than 0.5.
LEAST_COMMON, STRETCH = 0.7, 3

_BETWEEN = re.compile(r"(?<=\w)[@(](?=\w)|(?<=\w)@|@(?=\w)")
_TOKEN = re.compile(r"[^\W_]+")


def skeletons(text: str | None) -> list[str]:
    """The words of a text with case, accents, punctuation and common misreadings taken out."""
    return _TOKEN.findall(print_shape(_BETWEEN.sub(lambda m: "a" if m[0] == "@" else "c", fold(text or ""))))


_HASHES = Memo(lambda token: [xxhash.xxh64_intdigest(w) for w in skeletons(token)])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each skeleton; each distinct token is looked at once per task."""
    return np.array([h for t in (text or "").split() for h in _HASHES[t]], dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of all runs of SHINGLE words; a shorter text is one shingle, an empty one none."""
    n = len(words) - min(SHINGLE, len(words)) + 1 if len(words) else 0
    x = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(words))):
        x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (words[k : n + k].astype(np.uint64) + np.uint64(k))
    return np.unique(x ^ (x >> np.uint64(31)))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    n = BANDS * PER_BAND
    return (r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)), r.integers(0, 2**63, n, dtype=np.uint64)


_A, _B = _coefficients()


def bucket_keys(own: np.ndarray) -> np.ndarray:
    """One signed 64-bit bucket per band."""
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 4096):  # long texts in pieces, so that memory stays bounded
        m = own[at : at + 4096, None] * _A
        m += _B
        np.minimum(least, m.min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(PER_BAND):
        key = (key ^ least[k::PER_BAND]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def common_share(a: list[str], b: list[str]) -> float:
    """Part of the longer word sequence that stands in stretches common to both.

    Between two stretches words at the same place count if they differ by little: a lost or misread letter.
    """
    if len(a) < len(b):
        a, b = b, a
    if not a:
        return 0.0
    blocks = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= STRETCH]
    n, i, j = 0, 0, 0
    for m in [*blocks, None]:
        x, y = (a[i:], b[j:]) if m is None else (a[i : m.a], b[j : m.b])
        if len(x) == len(y) and len(x) <= 4:
            n += sum(SequenceMatcher(None, p, q, autojunk=False).ratio() >= 0.6 for p, q in zip(x, y))
        if m is not None:
            n += m.size
            i, j = m.a + m.size, m.b + m.size
    return n / len(a)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def split_name(column: str) -> Column:
    """``entrenamiento``, ``validacion`` or ``prueba`` in any spelling, else null."""
    s = F.regexp_replace(F.translate(F.lower(F.col(column)), "áéíóú", "aeiou"), "[^a-z]", "")
    return F.when(s.isin("entrenamiento", "validacion", "prueba"), s)


def signatures(rows: DataFrame) -> DataFrame:
    """id, particion, fuente, clase, buckets, palabras (word codes) of each row with words, in one pass over the texts.

    Rows with the same skeletons share a class, named by a 128-bit hash of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in parts(whole, "texto"):
                words = [word_hashes(t) for t in b["texto"]]
                kept = np.array([len(w) > 0 for w in words])
                own = [w for w in words if len(w)]
                got = b.loc[kept, ["id", "particion", "fuente"]].reset_index(drop=True)
                got["clase"] = [xxhash.xxh128_hexdigest(w.tobytes()) for w in own]
                got["buckets"] = [bucket_keys(shingles(w)) for w in own]
                got["palabras"] = [(w >> np.uint64(32)).astype(np.uint32).view(np.int32) for w in own]
                yield got

    return rows.select("id", "particion", "fuente", "texto").mapInPandas(run, "id bigint, particion string, fuente string, clase string, buckets array<bigint>, palabras array<int>")


def _spread(many: DataFrame, few: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join on ``key``: rows of hot keys are dealt over SALTS tasks, to each of which the few rows of the key go."""
    hot = F.broadcast(hot.select(F.col(key).alias("_k")))
    left = many.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_s", F.when(F.col("_k").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)).drop("_k")
    right = few.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_s", F.explode(F.when(F.col("_k").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_k")
    return left.join(right, [key, "_s"]).drop("_s")


def overlaps(examples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, hot): links between class representatives (a: with a training row, b: with a held-out row; a = b within a class),
    with Jaccard and common share; members are id, rep, particion, fuente of every row; hot the rep of each
    class with at least 1/HOT of all rows, of which there are at most HOT, and which of its sides has so many.

    ``examples``: ejemplo_id, texto, particion, fuente; repeated ids are one record; rows whose split is
    unknown or whose text has no words take no part. Every class is linked by its own bucket rows; no
    bucket is capped. Candidates are verified on word codes; texts are read only of pairs left in doubt.
    """
    rows = examples.select(F.col("ejemplo_id").cast("bigint").alias("id"), "texto", split_name("particion").alias("particion"), "fuente").filter("particion is not null and id is not null")
    signed = materialize(signatures(rows), "signed")
    per_class = signed.groupBy("clase").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.count_if(F.col("particion") == "entrenamiento").alias("n_train"))
    reps = materialize(per_class.withColumn("train", F.col("n_train") > 0).withColumn("held", F.col("n") > F.col("n_train")), "reps")
    total = reps.agg(F.sum("n")).first()[0] or 0
    hot = materialize(reps.filter(F.col("n") * HOT >= total).filter("n > 1").select("clase", "rep", (F.col("n_train") * HOT >= total).alias("train"), ((F.col("n") - F.col("n_train")) * HOT >= total).alias("held")), "hot")
    members = _spread(signed.select("id", "particion", "fuente", "clase").dropDuplicates(["id"]), reps.select("clase", "rep"), "clase", hot).select("id", "rep", "particion", "fuente")
    # a representative's own row has the buckets of its class; classes that can't have a pair go no further
    buckets = signed.select(F.col("id").alias("rep"), "buckets").join(reps.select("rep", "train", "held"), "rep").dropDuplicates(["rep"]).select("rep", "train", "held", F.explode("buckets").alias("bucket"))
    a = buckets.filter("train").select(F.col("rep").alias("a"), "bucket")
    b = buckets.filter("held").select(F.col("rep").alias("b"), "bucket")
    pairs = materialize(a.join(b, "bucket").filter("a <> b").select("a", "b").distinct(), "pairs")
    own = reps.filter("train and held").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("comun"))
    # a pair that lies on both sides in both orders is verified once
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def of(side: str, every: DataFrame, column: str, to: str) -> DataFrame:
        return every.select(F.col("id").alias(side), F.col(column).alias(to)).join(wanted.select(side).distinct(), side, "left_semi").dropDuplicates([side])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            j = [jaccard(shingles(np.asarray(p)), shingles(np.asarray(q))) for p, q in zip(x["wa"], x["wb"])]
            yield pd.DataFrame({"a": x["a"].to_numpy(), "b": x["b"].to_numpy(), "jaccard": j})

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"a": x["a"].to_numpy(), "b": x["b"].to_numpy(), "jaccard": x["jaccard"].to_numpy(), "comun": [common_share(skeletons(p), skeletons(q)) for p, q in zip(x["ta"], x["tb"])]})

    wanted = once
    rated = once.join(of("a", signed, "palabras", "wa"), "a").join(of("b", signed, "palabras", "wb"), "b").mapInPandas(compare, "a bigint, b bigint, jaccard double")
    rated = materialize(rated.filter(F.col("jaccard") >= REFUTED), "rated")
    wanted = rated.filter(F.col("jaccard") < CONFIRMED)
    doubtful = wanted.join(of("a", rows, "texto", "ta"), "a").join(of("b", rows, "texto", "tb"), "b").mapInPandas(align, "a bigint, b bigint, jaccard double, comun double")
    sure = rated.filter(F.col("jaccard") >= CONFIRMED).withColumn("comun", F.lit(1.0))
    checked = materialize(sure.unionByName(doubtful.filter(F.col("comun") >= LEAST_COMMON)), "checked")
    back = checked.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard", "comun")
    links = pairs.join(checked.unionByName(back), ["a", "b"]).select("a", "b", "jaccard", "comun").unionByName(own)
    return links, members, hot


def p4_links(spark, folder: str) -> DataFrame:
    """The compact form: one row per example with its class, and how many classes of the other side its class is linked to."""
    links, members, hot = overlaps(table(spark, folder, "ejemplos"))
    links = materialize(links, "links")
    ends = links.select(F.col("a").alias("rep"), F.lit(True).alias("train"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.lit(False).alias("train"), F.col("a").alias("other")))
    counted = ends.groupBy("rep", "train").agg(F.count("*").alias("enlaces"))
    own = members.withColumn("train", F.col("particion") == "entrenamiento")
    every = counted.unionByName(materialize(own.select("rep", "train").distinct().withColumn("enlaces", F.lit(0).cast("bigint")), "sides")).groupBy("rep", "train").agg(F.max("enlaces").alias("enlaces"))
    return _spread(own, every.withColumnRenamed("train", "t"), "rep", hot.select("rep")).filter("train = t").select(F.col("id").alias("ejemplo_id"), F.col("rep").alias("clase"), "particion", F.col("enlaces").cast("int").alias("enlaces"))


def p4_report(spark, folder: str) -> DataFrame:
    """Held-out examples per split and source, those found in training, and the pairs they form, counted without expanding classes.

    Sources are compared by one spelling; rows that name none have a null source.
    """
    links, members, hot = overlaps(table(spark, folder, "ejemplos"))
    members = materialize(members.withColumn("fuente", source_key("fuente")), "members")
    training = members.filter("particion = 'entrenamiento'").groupBy("rep").agg(F.count("*").alias("n"))
    per = links.join(training, links["a"] == training["rep"]).groupBy("b").agg(F.sum("n").alias("pares")).withColumnRenamed("b", "rep")
    held = members.filter("particion <> 'entrenamiento'").groupBy("rep", "particion", "fuente").agg(F.count("*").alias("n"))
    return held.join(per, "rep", "left").groupBy("particion", "fuente").agg(F.sum("n").alias("ejemplos"), F.sum(F.when(F.col("pares").isNotNull(), F.col("n")).otherwise(0)).alias("repetidos"), F.sum(F.coalesce(F.col("pares") * F.col("n"), F.lit(0))).alias("pares"))


def p4_found(spark, folder: str) -> DataFrame:
    """All pairs of a training and a held-out example with the same or nearly the same text."""
    links, members, hot = overlaps(table(spark, folder, "ejemplos"))
    links, members = materialize(links.select("a", "b"), "links"), materialize(members.select("id", "rep", "particion"), "members")
    a = _spread(members.filter("particion = 'entrenamiento'"), links.withColumnRenamed("a", "rep"), "rep", hot.filter("train")).select(F.col("id").alias("x"), F.col("b").alias("rep"))
    pairs = _spread(members.filter("particion <> 'entrenamiento'"), a, "rep", hot.filter("held")).select("x", F.col("id").alias("y")).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("ejemplo_a"), F.greatest("x", "y").alias("ejemplo_b")).distinct()
