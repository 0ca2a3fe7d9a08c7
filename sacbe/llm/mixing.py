"""Problem 9: a mix in which each source has its target share of the tokens.

Soft membership: a document with a declared target source belongs to it; for one without a source a naive
Bayes classifier gives a posterior over the target sources. It is fitted on a bounded sample of the rows whose
source is declared (``SAMPLE`` ids with the smallest hash); hashed words and table columns are counted on the
executors, and only the table of counts, of a fixed size, is collected. Rates between 0 and the repeats
allowed are fitted by projected-gradient least squares, so that the expected tokens of each source match its
target. The gradient needs one small vector per round, and a document's rate follows from the vectors of the
rounds so far, so each round is one pass over a written table and nothing is kept per document. Rates become
whole copies by carrying the error in tokens from document to document inside bounded chunks of a source,
largest documents first, so that what is left at the end of a chunk is less than its smallest document.

The mix aims at as many tokens as the documents of the target sources have. Where repeats don't suffice, a
source contributes all it may, and the report shows its actual share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sacbe.llm.tokens import TOKENIZER, encoder
from sacbe.storage import materialize, table

SAMPLE = 4000
BITS = 12
ROUNDS, SETTLED = 12, 1e-4
CHUNK = 1000
OTHER = ""

_WORD = re.compile(r"[^\W\d_]+")
COLUMNS = ("lang", "materia", "grado")


def source_name(column: str):
    """A source as it is compared: lower case, outer blanks off; null for blanks."""
    s = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return F.when(F.length(s) > 0, s)


def word_counts(texts: list[str | None], columns: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and column value of a batch."""
    mask = np.uint64((1 << BITS) - 1)
    words = [_WORD.findall((t or "").lower()) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    flat = np.array([x for w in words for x in w], dtype=object)
    rows, codes = [], []
    if len(flat):
        at, unique = pd.factorize(flat)
        rows.append(row)
        codes.append((pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False) & mask)[at])
    for c in COLUMNS:
        v = (c + "=" + columns[c].fillna("").astype(str)).to_numpy(dtype=object)
        rows.append(np.arange(len(texts)))
        codes.append(pd.util.hash_array(v, categorize=False) & mask)
    return np.concatenate(rows), np.concatenate(codes).astype(np.int64)


def count_features(sample: DataFrame, sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each source, and counts (feature, source) of the sample (s, text and COLUMNS); rows of other sources don't count."""
    k = len(sources)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = pd.Categorical(b["s"], categories=sources).codes
            b, own = b[own >= 0].reset_index(drop=True), own[own >= 0].astype(np.int64)
            if len(b):
                row, code = word_counts(list(b["text"]), b)
                at, n = np.unique(np.concatenate([(code + 1) * k + own[row], own]), return_counts=True)
                yield pd.DataFrame({"at": at, "n": n})

    flat = np.zeros(((1 << BITS) + 1) * k)
    for at, n in sample.select("s", "text", *COLUMNS).mapInPandas(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect():
        flat[at] = n
    table_ = flat.reshape(-1, k)
    return table_[0], table_[1:]


def fit_classifier(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log prior and log likelihood (feature, source) of naive Bayes with add-one smoothing."""
    prior, like = rows + 1.0, counts + 1.0
    return np.log(prior / prior.sum()), np.log(like / like.sum(axis=0)).astype(np.float32)


def posteriors(texts: list[str | None], columns: pd.DataFrame, prior: np.ndarray, likelihood: np.ndarray) -> np.ndarray:
    """Posterior over the sources; the evidence of a text is averaged over its words and weighed by their square root, since words of a text depend on each other."""
    row, code = word_counts(texts, columns)
    order = np.argsort(row, kind="stable")
    row, code = row[order], code[order]
    size = np.bincount(row, minlength=len(texts))
    z = np.add.reduceat(likelihood[code], np.cumsum(size) - size, axis=0) / np.sqrt(size)[:, None] + prior if len(texts) else np.zeros((0, len(prior)))
    p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return p / p.sum(axis=1, keepdims=True) if len(z) else z


def memberships(docs: DataFrame, sources: list[str], repeats: list[int], prior: np.ndarray, likelihood: np.ndarray, tokenizer: str) -> DataFrame:
    """id, s (declared source), tokens, cap, p of each document that can take part; others have cap 0.

    One pass over the texts: they are tokenized and classified together.
    """
    model = docs.sparkSession.sparkContext.broadcast((prior, likelihood))
    at = {s: k for k, s in enumerate(sources)}
    most = np.array(repeats, dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoder(tokenizer).encode_ordinary
        for b in batches:
            texts = list(b["text"])
            n = [len(count(t)) if t else 0 for t in texts]
            q = posteriors(texts, b, *model.value)
            p = np.zeros_like(q)
            k = np.array([at.get(s, -1) for s in b["s"]], dtype=int)
            declared = k >= 0
            p[np.flatnonzero(declared), k[declared]] = 1.0
            open_ = b["s"].isna().to_numpy()
            p[open_] = q[open_]
            cap = np.where(declared, most[k], np.where(open_, np.minimum(q @ most, most.min() if len(most) else 0), 0.0))
            yield pd.DataFrame({"id": b["id"].to_numpy(), "s": b["s"].to_numpy(), "tokens": n, "cap": cap, "p": list(p.astype(np.float32))})

    return docs.mapInPandas(run, "id bigint, s string, tokens bigint, cap double, p array<float>")


def _rates(p: np.ndarray, cap: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the rounds whose step vectors are the rows of ``steps``: each round moves along the step and projects onto [0, cap]."""
    r = np.minimum(1.0, cap)
    for s in steps:
        r = np.clip(r + p @ s, 0.0, cap)
    return r


def fit_rates(members: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Step vectors of projected-gradient least squares on the expected tokens of each source.

    Gradients are scaled by the tokens a source has (a diagonal preconditioner), so that a round moves a
    source by about what it lacks.
    """
    k = len(wanted)
    steps = np.zeros((0, k))
    for _ in range(ROUNDS):
        now = steps

        def run(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros(3 * k)
            for b in batches:
                if len(b):
                    p = np.vstack(b["p"].to_numpy()).astype(float)
                    cap = b["cap"].to_numpy()
                    t = b["tokens"].to_numpy(float)
                    total[:k] += (t * _rates(p, cap, now)) @ p
                    total[k : 2 * k] += t @ p
                    total[2 * k :] += (t * cap) @ p
            yield pd.DataFrame({"at": np.arange(3 * k, dtype="int32"), "v": total})

        rows = members.select("tokens", "cap", "p").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(3 * k)
        for r in rows:
            v[r[0]] = r[1]
        have = v[k : 2 * k]
        gap = np.minimum(wanted, v[2 * k :]) - v[:k]  # no more than its repeats allow: else others would stand in for it
        step = np.where(have > 0, gap / np.maximum(have, 1e-9), 0.0)
        if len(steps) and np.abs(step - steps[-1]).max() < SETTLED:
            break
        if np.abs(gap).max() <= SETTLED * wanted.sum():
            break
        steps = np.vstack([steps, step])
    return steps


def mix(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, s, tokens, copias of the documents of the mix (copias of at least 1).

    ``targets`` is the fixed table of sources; sources not listed take no part; null and blank sources
    take part by their posterior, at the smallest number of repeats allowed. Repeated ids are one document.
    """
    listed = targets.select(source_name("source").alias("s"), "peso", "max_repeticiones").filter("s is not null and peso > 0").dropDuplicates(["s"]).orderBy("s").collect()
    sources, weight, repeats = [r[0] for r in listed], np.array([r[1] for r in listed], dtype=float), [int(r[2] or 0) for r in listed]
    empty = "id bigint, s string, tokens bigint, copias int"
    if not sources:
        return docs.sparkSession.createDataFrame([], empty)
    weight = weight / weight.sum()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), source_name(source_col).alias("s"), F.col(text_col).alias("text"), *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])
    ids = rows.filter(F.col("s").isin(*sources)).select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    prior, likelihood = fit_classifier(*count_features(rows.join(F.broadcast(ids), "id", "left_semi").dropDuplicates(["id"]), sources))
    part = rows.filter(F.col("s").isNull() | F.col("s").isin(*sources))
    members = materialize(memberships(part, sources, repeats, prior, likelihood, tokenizer).dropDuplicates(["id"]), "members")
    total = members.agg(F.sum("tokens")).first()[0] or 0
    steps = fit_rates(members, weight * total)
    size = {r[0]: r[1] for r in members.groupBy("s").count().collect()}  # at most one row a source
    chunks = F.coalesce(*[F.when(F.col("s").eqNullSafe(F.lit(s)), -(-n // CHUNK)) for s, n in size.items()], F.lit(1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = _rates(np.vstack(b["p"].to_numpy()).astype(float), b["cap"].to_numpy(), steps) if len(b) else np.zeros(0)
            yield pd.DataFrame({"id": b["id"].to_numpy(), "s": b["s"].to_numpy(), "tokens": b["tokens"].to_numpy(), "cap": b["cap"].to_numpy(), "rate": r})

    rated = members.mapInPandas(run, "id bigint, s string, tokens bigint, cap double, rate double").withColumn("_c", F.pmod(F.xxhash64("id"), chunks))

    def deal(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["tokens", "id"], ascending=[False, True], kind="stable")
        return x.assign(copias=whole_copies(x["tokens"].to_numpy(), x["rate"].to_numpy(), x["cap"].to_numpy()))[["id", "s", "tokens", "copias"]]

    return rated.groupBy("s", "_c").applyInPandas(deal, "id bigint, s string, tokens bigint, copias int").filter("copias > 0")


def whole_copies(tokens: np.ndarray, rate: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Whole numbers beside the rates, at most ``cap`` rounded up, whose tokens follow the sum of tokens x rate as closely as they can in this order."""
    out = np.zeros(len(tokens), dtype=np.int32)
    owed = 0.0
    for i, (t, r, c) in enumerate(zip(tokens.tolist(), rate.tolist(), np.ceil(cap - 1e-9).tolist())):
        owed += t * r
        low = int(r + 1e-9)
        n = low + (r > low + 1e-9 and owed - low * t > t / 2 and low < c)
        out[i] = n
        owed -= n * t
    return out


def p9_mix(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents of the mix with their copies."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mezcla_objetivo"), "doc_id", "text", "source", tokenizer).withColumnRenamed("id", "doc_id").withColumnRenamed("s", "source")


def p9_report(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per target source: share wanted, share reached, tokens, documents, copies, most repeats used; documents without a source in a row of their own (source null)."""
    got = p9_mix(spark, folder, tokenizer).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copias")).alias("tokens"), F.count("*").alias("documentos"), F.sum("copias").alias("copias"), F.max("copias").alias("repeticiones"))
    want = table(spark, folder, "mezcla_objetivo").withColumn("s", source_name("source")).filter("s is not null").groupBy("s").agg(F.max("peso").alias("peso"), F.max("max_repeticiones").alias("max_repeticiones"))
    both = want.join(got, F.col("s").eqNullSafe(F.col("source")), "full")
    all_ = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    return both.select(F.coalesce("s", "source").alias("source"), F.coalesce("peso", F.lit(0.0)).alias("peso"), (F.coalesce("tokens", F.lit(0)) / all_).alias("parte"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documentos", "copias", "repeticiones")], "max_repeticiones")
