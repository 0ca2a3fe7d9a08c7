"""Problem 6: the subjects a text treats.

One-versus-rest linear classifiers on hashed word uni- and bigrams score each sentence, which treats the
subjects whose threshold its score reaches; a text treats a subject if such sentences hold at least a
fifth of its words. Thresholds of scores and shares are calibrated on labelled texts that the classifiers
weren't fitted on. The weak labels come from the path of each example's file (``..._mate_...``) where the declared subject agrees with it, and from the
labelled sample. The classifiers are fitted on at most ``TRAINING_ROWS`` weakly labelled rows, chosen by
the smallest hash of their id (a bounded sample, as for any fitted classifier); every row is classified.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.llm.quality import examples_by_kind, measured
from sacbe.llm.words import WORD, Memo, Parsed, parse
from sacbe.storage import materialize, table

SUBJECTS = ("matematicas", "ciencias_naturales", "ciencias_sociales", "comunicacion_lenguaje", "ingles", "otro")
#: How subjects are spelt in file paths (a tag may stand for two) and in section metadata (folded, letters only).
PATH_TAGS = {"mate": ("matematicas",), "cien": ("ciencias_naturales", "ciencias_sociales"), "soci": ("ciencias_sociales",), "comu": ("comunicacion_lenguaje",), "ingl": ("ingles",), "otro": ("otro",)}
DECLARED = {
    "matematicas": ("matematicas", "matematica", "mate"),
    "ciencias_naturales": ("cienciasnaturales", "csnaturales", "ccnn"),
    "ciencias_sociales": ("cienciassociales", "estudiossociales", "sociales"),
    "comunicacion_lenguaje": ("comunicacionlenguaje", "comunicacionylenguaje", "comunicacion", "lenguaje"),
    "ingles": ("ingles", "english"),
    "otro": ("otro", "otros", "varios", "general", "artes"),
}
BITS = 16
TRAINING_ROWS = 3000
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
#: Least part of the words of a text for a subject it treats (fixed by the problem), and what a passing
#: sentence with one misread neighbour may add to it.
LEAST_SHARE, MARGIN = 0.2, 0.03

#: Least words of a calibrated share that may be raised, and the part of texts of other subjects that may pass it.
HIGHEST_SHARE, WRONGLY = 0.3, 0.01


def _hash(word: str) -> int:
    """FNV-1a of a word, the same on every machine."""
    h = 2166136261
    for c in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h


_HASHES = Memo(lambda token: [_hash(w.lower()) for w in WORD.findall(token)])


@dataclass
class Features:
    """Hashed uni- and bigrams of the words of sentences: index and sentence of each, and words and owner (text) of each sentence."""

    index: np.ndarray
    sentence: np.ndarray
    words: np.ndarray
    owner: np.ndarray

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Summed weights of the features of each sentence, over the square root of their number."""
        size = np.bincount(self.sentence, minlength=len(self.words))
        return np.add.reduceat(w[self.index], np.cumsum(size) - size, axis=0) / np.sqrt(size)[:, None] if len(size) else np.zeros((0, w.shape[1]))


def features(x: Parsed) -> Features:
    """Features of each rough piece with words."""
    own = [_HASHES[t] for t in x.tokens]
    count = np.array([len(h) for h in own], dtype=np.int64)
    flat = np.array([v for h in own for v in h], dtype=np.uint64)
    per_token = count[x.codes]
    start = (np.cumsum(count) - count)[x.codes]
    at = np.repeat(start - (np.cumsum(per_token) - per_token), per_token) + np.arange(per_token.sum())
    h = flat[at]
    piece, owner = np.repeat(x.piece, per_token), np.repeat(x.owner, per_token)
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    sentence = np.cumsum(np.diff(piece, prepend=-1) != 0) - 1
    pair = (h[:-1] * np.uint64(31) + h[1:]) ^ (h[1:] >> np.uint64(7))
    within = sentence[:-1] == sentence[1:]
    index = np.concatenate([h ^ (h >> np.uint64(16)), pair[within]]) & np.uint64((1 << BITS) - 1)
    by = np.concatenate([sentence, sentence[:-1][within]])
    order = np.argsort(by, kind="stable")
    return Features(index[order].astype(np.int32), by[order], np.bincount(sentence, minlength=len(first)), owner[first])


def train(texts: list[str], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, subject) and biases of the one-versus-rest classifiers, by Adagrad on logistic loss."""
    k = len(SUBJECTS)
    w, b = np.zeros((1 << BITS, k)), np.full(k, -1.0)
    f = features(parse(texts))
    if not len(f.words):
        return w.astype(np.float32), b.astype(np.float32)
    y = np.eye(k)[np.array([SUBJECTS.index(x) for x in labels])[f.owner]]
    size = np.bincount(f.sentence, minlength=len(f.words))
    start = np.cumsum(size) - size
    seen = np.full_like(w, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(len(size)), max(1, len(size) // 256)):
            n = size[part]
            at = np.cumsum(n) - n
            flat = f.index[np.repeat(start[part] - at, n) + np.arange(n.sum())]
            z = np.add.reduceat(w[flat], at, axis=0) / np.sqrt(n)[:, None] + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            step = np.repeat(g / np.sqrt(n)[:, None], n, axis=0)
            touched, back = np.unique(flat, return_inverse=True)
            total = np.zeros((len(touched), k))
            np.add.at(total, back, step)
            total += DECAY * w[touched]
            seen[touched] += total**2
            w[touched] -= RATE * total / np.sqrt(seen[touched])
            b -= 0.1 * g.sum(axis=0)
    return w.astype(np.float32), b.astype(np.float32)


@dataclass
class Subjects:
    """Part of the words of a text in sentences of each subject.

    A sentence treats every subject whose score reaches the subject's threshold; one that reaches none
    counts for the subject it comes nearest to. Rows of zeros for texts without words.
    """

    weights: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray  # least score of a sentence, per subject

    schema = ", ".join(f"{s} double" for s in SUBJECTS)

    def shares(self, x: Parsed) -> np.ndarray:
        f = features(x)
        out = np.zeros((x.n, len(SUBJECTS)))
        if len(f.words):
            z = f.sums(self.weights) + self.bias - self.threshold
            treats = (z >= 0) | (z == z.max(axis=1, keepdims=True))
            for k in range(len(SUBJECTS)):
                out[:, k] = np.bincount(f.owner, f.words * treats[:, k], minlength=x.n)
            out /= np.maximum(np.bincount(f.owner, f.words, minlength=x.n), 1)[:, None]
        return out

    def __call__(self, x: Parsed) -> pd.DataFrame:
        return pd.DataFrame(self.shares(x), columns=list(SUBJECTS))


def calibrate_scores(texts: list[str], labels: list[str], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per subject the score that parts its sentences best from others (greatest F1) in texts the classifiers haven't seen.

    A score halfway to the next lower one is taken; 0 without sentences of the subject.
    """
    f = features(parse(texts))
    out = np.zeros(len(SUBJECTS))
    if not len(f.words):
        return out
    z = f.sums(w) + b
    own = np.array([SUBJECTS.index(x) for x in labels])[f.owner]
    for k in range(len(SUBJECTS)):
        order = np.argsort(-z[:, k], kind="stable")
        hit = np.cumsum(own[order] == k)
        if hit[-1]:
            f1 = 2 * hit / (np.arange(1, len(order) + 1) + hit[-1])
            at = int(f1.argmax())
            here = z[order[at], k]
            out[k] = (here + z[order[at + 1], k]) / 2 if at + 1 < len(order) else here
    return out


def calibrate_shares(texts: list[str], labels: list[str], model: Subjects) -> np.ndarray:
    """Least measured share per subject, from texts of a single subject the classifiers haven't seen.

    They show how large the share of a subject they don't treat comes out: the threshold is LEAST_SHARE +
    MARGIN, raised (to HIGHEST_SHARE at most) where more than WRONGLY of them would pass it.
    """
    got = model.shares(parse(texts))
    least = np.full(len(SUBJECTS), LEAST_SHARE + MARGIN)
    for k, s in enumerate(SUBJECTS):
        other = got[[label != s for label in labels], k]
        if len(other):
            least[k] = min(HIGHEST_SHARE, max(LEAST_SHARE + MARGIN, float(np.quantile(other, 1 - WRONGLY)) + 0.01))
    return least


def fit(weak: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> tuple[Subjects, np.ndarray]:
    """Classifiers fitted on the weakly labelled texts and half of the labelled ones; thresholds from the other half, which they haven't seen."""
    own = weak + [x for x in labelled if _hash(x[0]) % 2]
    held = [x for x in labelled if not _hash(x[0]) % 2]
    w, b = train([x[0] for x in own], [x[1] for x in own])
    texts, names = [x[0] for x in held], [x[1] for x in held]
    model = Subjects(w, b, calibrate_scores(texts, names, w, b).astype(np.float32))
    return model, calibrate_shares(texts, names, model)


def declared_subject(column: str) -> Column:
    """Code of a declared subject in any of its spellings, else null."""
    plain = F.regexp_replace(F.translate(F.lower(F.col(column)), "áéíóúüñ", "aeiouun"), "[^a-z]", "")
    return F.coalesce(*[F.when(plain.isin(*names), code) for code, names in DECLARED.items()])


def path_subjects(column: str) -> Column:
    """Codes of the subjects that the tag in a file's path may stand for, else null."""
    name = F.lower(F.col(column))
    return F.coalesce(*[F.when(name.rlike(f"[_-]{tag}[_-]"), F.array(*map(F.lit, codes))) for tag, codes in PATH_TAGS.items()])


def weak_labels(examples: DataFrame, prose: DataFrame, limit: int = TRAINING_ROWS) -> list[tuple[str, str]]:
    """Texts and subjects of at most ``limit`` prose rows whose path names the subject they declare.

    Rows are chosen by their narrow columns; only then the texts of the chosen ones, at most ``limit``, are read.
    """
    agreed = examples.filter("texto is not null").select("ejemplo_id", path_subjects("archivo").alias("por_ruta"), declared_subject("materia").alias("declarada"))
    agreed = agreed.filter("array_contains(por_ruta, declarada)").dropDuplicates(["ejemplo_id"]).join(prose, "ejemplo_id", "left_semi")
    chosen = agreed.orderBy(F.xxhash64("ejemplo_id"), "ejemplo_id").limit(limit).select(F.col("ejemplo_id").alias("_i"), "declarada")
    rows = examples.join(F.broadcast(chosen), F.col("ejemplo_id") == F.col("_i")).select("ejemplo_id", "texto", "declarada").dropDuplicates(["ejemplo_id"]).collect()
    return [(r[1], r[2]) for r in sorted(rows)]


def subject_shares(df: DataFrame, id_col: str, text_col: str, model: Subjects) -> DataFrame:
    """id and one share per subject of each row. The classifiers have a fixed size (2**BITS x subjects)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    class Shared:
        schema = Subjects.schema

        def __call__(self, x: Parsed) -> pd.DataFrame:
            return shared.value(x)

    return measured(df, id_col, text_col, Shared())


def prose_subjects(spark, folder: str) -> tuple[DataFrame, np.ndarray]:
    """Shares of each prose example, and the calibrated least share of each subject."""
    examples = table(spark, folder, "ejemplos")
    prose = materialize(examples_by_kind(spark, folder).filter("clase = 'prosa'").select(F.col("id").alias("ejemplo_id")), "prose")
    labelled = [(r[0], r[1]) for r in table(spark, folder, "muestra_etiquetada").filter("materia is not null and texto is not null").select("texto", "materia").collect()]
    model, least = fit(weak_labels(examples, prose), [x for x in labelled if x[1] in SUBJECTS])
    # All rows are scored where they are read; the narrow results meet the prose rows, not the texts.
    return subject_shares(examples, "ejemplo_id", "texto", model).dropDuplicates(["id"]).join(prose.select(F.col("ejemplo_id").alias("id")), "id", "left_semi"), least


def p6_shares(spark, folder: str) -> DataFrame:
    """Share of each subject in each prose example."""
    return prose_subjects(spark, folder)[0].withColumnRenamed("id", "ejemplo_id")


def p6_found(spark, folder: str) -> DataFrame:
    """The subjects that at least a fifth of each prose example treats."""
    got, least = prose_subjects(spark, folder)
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("materia"), (F.col(s) >= float(t)).alias("trata")) for s, t in zip(SUBJECTS, least)])).alias("x")
    return got.select(F.col("id").alias("ejemplo_id"), pairs).filter("x.trata").select("ejemplo_id", "x.materia").distinct()
