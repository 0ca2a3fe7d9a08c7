"""Problem 1: text statistics of each document and a mixture model that names its kind.

``text_statistics`` measures all texts in one pass, batch by batch: what a token adds is looked up once per
distinct token, and sums over lines and texts are array operations. ``fit_mixture`` fits a Gaussian
mixture by expectation-maximization on the standardized statistics of *all* rows: each round is one
pass over a written table of statistics, which sends back one vector of sufficient statistics per
task, summed on the executors; its length depends on the number of components only. Components are
named by the inspected examples that fall into them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sacbe.llm.words import SPANISH_WORD, WORD, Memo, Parsed, parse, parts, totals
from sacbe.storage import materialize, table

KINDS = ("prosa", "lista", "tabla", "basura")
#: The statistics the mixture is fitted on.
MEASURES = ("mean_word_length", "symbol_share", "digit_share", "end_line_share", "common_share", "vowel_share", "plain_token_share", "end_word_share", "log_words_per_line")
#: Components started per kind: debris and lists come in more shapes than their share of rows shows.
STARTS = {"prosa": 4, "lista": 4, "tabla": 3, "basura": 6}
ROUNDS, RIDGE, TOLERANCE = 12, 0.03, 1e-3

_END = re.compile(r"[.!?…:。！？।؟][\"'”»)\]]*$")
_PLAIN = re.compile(r"[¿¡«“\"(—-]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…»”\")]*")
_VOWEL = re.compile(r"[aeiouáéíóúüàèìòùâêîôûãõ]", re.I)
_DIGIT = re.compile(r"\d")


def _token(token: str, common: frozenset[str]) -> tuple:
    """words, letters, characters, digits, vowels, common words, is plain, ends a line like a sentence."""
    words = WORD.findall(token)
    return (len(words), sum(map(len, words)), len(token), len(_DIGIT.findall(token)), len(_VOWEL.findall(token)), sum(w.lower() in common for w in words), _PLAIN.fullmatch(token) is not None, _END.search(token) is not None)


class Statistics:
    """words, lines and MEASURES of the texts of a batch; null and blank texts get zeros. Each distinct token is looked at once."""

    columns = ("words", "lines", *MEASURES)
    schema = "words int, lines int, " + ", ".join(f"{m} double" for m in MEASURES)

    def __init__(self, common: frozenset[str]):
        self.common = common
        self.memo: Memo | None = None

    def __getstate__(self):
        return {"common": self.common, "memo": None}

    def __call__(self, x: Parsed) -> pd.DataFrame:
        self.memo = self.memo if self.memo is not None else Memo(lambda t: _token(t, self.common))
        known = x.table(self.memo).reshape(-1, 8)
        per_line = totals(known[x.codes], x.per_line)
        ends = known[x.codes[x.line_ends - 1], 7]
        lines = np.column_stack([per_line[:, :7], ends, per_line[:, 0] * ends])
        n, letters, solid, digits, vowels, common, plain, closing, closed = totals(lines, x.per_text).T
        tokens = totals(x.per_line, x.per_text)
        k, some = x.per_text, solid > 0
        safe, words = np.maximum(solid, 1), np.maximum(n, 1)
        got = (
            letters / words, np.maximum(0, solid - letters - digits) / safe, digits / safe, closing / np.maximum(k, 1), common / words,
            vowels / np.maximum(letters, 1), plain / np.maximum(tokens, 1), closed / words, np.log((n + 0.5) / np.maximum(k, 1)),
        )
        return pd.DataFrame({"words": n, "lines": k, **{m: np.where(some, v, 0.0) for m, v in zip(MEASURES, got)}})


def measured(df: DataFrame, id_col: str, text_col: str, *measures) -> DataFrame:
    """id and the columns of the given measures of each row of ``df``, in one pass over the texts.

    A measure has ``schema`` and turns parsed texts into a frame. Other columns of ``df`` are left out, so
    that their names can't clash. Repeated rows give repeated results. Texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in parts(whole, "text"):
                x = parse(list(b["text"]))
                got = pd.concat([m(x) for m in measures], axis=1)
                got.insert(0, "id", b["id"].to_numpy())
                yield got

    schema = "id bigint, " + ", ".join(m.schema for m in measures)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def text_statistics(df: DataFrame, common: frozenset[str], id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: id, words, lines and MEASURES."""
    return measured(df, id_col, text_col, Statistics(common))


def common_words(df: DataFrame) -> frozenset[str]:
    """The words of the fixed table ``palabras_comunes`` (two languages, some dozens each)."""
    return frozenset(r[0].lower() for r in df.select("palabra").distinct().collect() if r[0])


@dataclass
class Mixture:
    """A Gaussian mixture on standardized statistics; ``share[k, c]``: how much of component k is kind c."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    share: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """log(weight x density) of each standardized row under each component."""
        out = np.empty((len(x), len(self.weight)))
        for k, (w, m, c) in enumerate(zip(self.weight, self.mean, self.cov)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = np.log(max(w, 1e-12)) - np.log(np.diag(low)).sum() - 0.5 * (z * z).sum(axis=0)
        return out

    def standardize(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.centre) / self.scale, -12, 12)

    def responsibility(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.log_density(x)
        top = d.max(axis=1, keepdims=True)
        p = np.exp(d - top)
        s = p.sum(axis=1, keepdims=True)
        return p / s, (top + np.log(s))[:, 0]

    def kinds(self, raw: np.ndarray) -> np.ndarray:
        """Probability of each kind for each row of raw statistics."""
        return self.responsibility(self.standardize(raw))[0] @ self.share


def _seeds(x: np.ndarray, k: int) -> np.ndarray:
    """k centres by farthest-first traversal and a few Lloyd rounds (deterministic)."""
    at = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmax(((x[:, None] - x[at]) ** 2).sum(axis=2).min(axis=1))))
    c = x[at]
    for _ in range(10):
        own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def _sums(model: Mixture, raw: np.ndarray) -> np.ndarray:
    """Sufficient statistics of a batch as one flat vector: per component mass, sum, sum of products; then log-likelihood and rows."""
    x = model.standardize(raw)
    r, ll = model.responsibility(x)
    second = np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
    return np.concatenate([np.hstack([r.sum(axis=0)[:, None], r.T @ x, second.reshape(len(second), -1)]).ravel(), [ll.sum(), len(x)]])


def fit_mixture(stats: DataFrame, examples: pd.DataFrame) -> Mixture:
    """EM over all rows of ``stats`` (which should be a written table) started from inspected examples.

    ``examples``: MEASURES and ``clase`` of the labelled rows, a fixed small table. Rows without words
    and digits take part like any other; rows of blank texts (0 lines) don't.
    """
    full = stats.filter("lines > 0")
    row = full.agg(*[F.avg(m).alias(f"m_{m}") for m in MEASURES], *[F.stddev_pop(m).alias(f"s_{m}") for m in MEASURES]).first()
    own = examples[list(MEASURES)].to_numpy(float)
    if row[0] is None:
        centre, scale = own.mean(axis=0), own.std(axis=0)
    else:
        centre, scale = np.array(row[: len(MEASURES)]), np.array(row[len(MEASURES) :])
    scale = np.where(scale > 1e-6, scale, 1.0)
    d = len(MEASURES)
    labelled = np.clip((own - centre) / scale, -12, 12)
    kind = examples["clase"].to_numpy()
    means = [_seeds(labelled[kind == c], STARTS[c]) for c in KINDS if (kind == c).any()]
    mean = np.vstack(means)
    model = Mixture(centre, scale, np.full(len(mean), 1 / len(mean)), mean, np.repeat(np.eye(d)[None] * 0.3, len(mean), axis=0), np.zeros((len(mean), len(KINDS))))
    before = -np.inf
    for _ in range(ROUNDS):
        total = _gather(full, model)
        total = total + _sums(model, own) if total is not None else _sums(model, own)
        ll, n = total[-2] / total[-1], total[-1]
        part = total[:-2].reshape(len(mean), -1)
        mass = part[:, 0] + 1e-6
        new_mean = part[:, 1 : 1 + d] / mass[:, None]
        second = part[:, 1 + d :].reshape(len(mean), d, d) / mass[:, None, None]
        cov = second - np.einsum("ki,kj->kij", new_mean, new_mean) + RIDGE * np.eye(d)
        few = mass < 2 * d  # too little to estimate a shape: keep the start
        model = Mixture(centre, scale, mass / mass.sum(), np.where(few[:, None], model.mean, new_mean), np.where(few[:, None, None], model.cov, cov), model.share)
        if ll - before < TOLERANCE:
            break
        before = ll
    r, _ = model.responsibility(labelled)
    share = np.array([r[kind == c].sum(axis=0) for c in KINDS]).T
    own_mass = share.sum(axis=1)
    for k in np.flatnonzero(own_mass < 0.5):  # no inspected example in it: named by the nearest component that has some
        named = np.flatnonzero(own_mass >= 0.5)
        share[k] = share[named[((model.mean[named] - model.mean[k]) ** 2).sum(axis=1).argmin()]]
    model.share = share / share.sum(axis=1, keepdims=True)
    return model


def _gather(stats: DataFrame, model: Mixture) -> np.ndarray | None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                part = _sums(model, b.to_numpy(float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total), dtype="int32"), "value": total})

    rows = stats.select(*MEASURES).mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    if not rows:
        return None
    out = np.zeros(len(rows))
    for r in rows:
        out[r[0]] = r[1]
    return out


def name_kinds(stats: DataFrame, model: Mixture) -> DataFrame:
    """``stats`` with ``clase`` (null for blank texts) and ``seguridad``, its probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.kinds(b[list(MEASURES)].to_numpy(float)) if len(b) else np.zeros((0, len(KINDS)))
            b["clase"] = np.where(b["lines"] > 0, np.array(KINDS)[p.argmax(axis=1)] if len(b) else "", None)
            b["seguridad"] = p.max(axis=1) if len(b) else 0.0
            yield b

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", clase string, seguridad double"
    return stats.mapInPandas(run, schema)


def labelled_statistics(examples: DataFrame, common: frozenset[str]) -> pd.DataFrame:
    """Statistics of the inspected examples (a fixed table of some hundred rows)."""
    rows = examples.select("texto", "clase").collect()
    got = Statistics(common)(parse([r[0] for r in rows]))
    got["clase"] = [r[1] for r in rows]
    return got[got["clase"].isin(KINDS)]


def examples_by_kind(spark, folder: str, *more) -> DataFrame:
    """Statistics and kind of each row of ``ejemplos``: columns id, words, lines, MEASURES, those of further measures taken in the same pass, clase, seguridad."""
    common = common_words(table(spark, folder, "palabras_comunes"))
    # Repeated rows are measured like any other and dropped from the narrow result: texts are never shuffled.
    stats = materialize(measured(table(spark, folder, "ejemplos"), "ejemplo_id", "texto", Statistics(common), *more).dropDuplicates(["id"]), "stats")
    model = fit_mixture(stats, labelled_statistics(table(spark, folder, "muestra_etiquetada"), common))
    return name_kinds(stats, model)


def p1_statistics(spark, folder: str) -> DataFrame:
    """Every example once with its statistics and kind."""
    return examples_by_kind(spark, folder).withColumnRenamed("id", "ejemplo_id")


def p1_found(spark, folder: str) -> DataFrame:
    """Examples that are no prose, and stored word counts that are wrong."""
    kinds = examples_by_kind(spark, folder).filter("clase in ('lista', 'tabla', 'basura')").select(F.col("id").alias("ejemplo_id"), F.col("clase").alias("hallazgo"))
    return kinds.unionByName(wrong_counts(table(spark, folder, "ejemplos"), table(spark, folder, "metricas_legibilidad"))).distinct()


def wrong_counts(examples: DataFrame, stored: DataFrame) -> DataFrame:
    """``recuento`` for each example with a stored word count that isn't the number of words of its text."""
    counted = examples.select("ejemplo_id", F.regexp_count(F.coalesce("texto", F.lit("")), F.lit(SPANISH_WORD)).alias("n"))
    return counted.join(stored.filter("palabras is not null").select("ejemplo_id", "palabras"), "ejemplo_id").filter("n <> palabras").select("ejemplo_id", F.lit("recuento").alias("hallazgo")).distinct()
