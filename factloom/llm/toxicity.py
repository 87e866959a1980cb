"""op7: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, scratch, stage
from .labels import held_out, new_name, training_rows

#: Labelled documents that lexicon and weights are learned from, at most.
SAMPLE = 20_000
#: Words of the lexicon, at most; fewer pass the test of significance.
LEXICON = 2_000
#: Least log-likelihood ratio (G2) of a word with the label, and least log-odds.
SIGNIFICANCE, LEAST_WEIGHT = 26.0, 2.0
#: Phrases in which a word of the lexicon is harmless; folded like texts.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "pond scum", "scum of the pond", "clown fish", "circus clown", "sore loser", "pathetic fallacy")

#: Look-alikes of Latin letters, and digits and signs that stand for letters. i, l and 1 are one class.
_CYRILLIC, _FOR_CYRILLIC = "авекмнорстухіјѕԁԛԝһ", "abekmhopctyxijsdqwh"
_GREEK, _FOR_GREEK = "αβεικνορτυχγ", "abeiknoptuxy"
_SIGNS, _FOR_SIGNS = "0134578@$lıǀ€£", "oieastbasiiiei"
_WIDE = "".join(chr(0xFF41 + k) for k in range(26))
_LATIN = "".join(chr(97 + k) for k in range(26)).replace("l", "i")
_FROM, _TO = _CYRILLIC + _GREEK + _SIGNS + _WIDE, _FOR_CYRILLIC + _FOR_GREEK + _FOR_SIGNS + _LATIN
#: Characters that show nothing: removed.
_HIDDEN = "\xad\u200b\u200c\u200d\u2060\ufeff"
_TABLE = str.maketrans(_FROM, _TO, _HIDDEN)


def fold(text: str) -> str:
    return text.lower().translate(_TABLE)


def fold_column(text):
    """fold() by Spark's own functions."""
    return F.translate(F.lower(text), _FROM + _HIDDEN, _TO)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for phrase in map(fold, self.exceptions):
            out.add_word(phrase, (len(phrase), 0.0))
        for word, weight in self.weights.items():
            if word not in out:
                out.add_word(word, (len(word), weight))
        if len(out):
            out.make_automaton()
        return out


def evidence(automaton: ahocorasick.Automaton, text: str) -> tuple[float, float, float, int]:
    """(weight of the hits, distinct words hit, words of the text, hits); a hit is a whole word outside exception phrases."""
    folded = fold(text)
    n = folded.count(" ") + folded.count("\n") + 1
    if not len(automaton):
        return 0.0, 0.0, n, 0
    hits, spared = [], []
    size = len(folded)
    for end, (length, weight) in automaton.iter(folded):
        start = end + 1 - length
        if (start and folded[start - 1].isalpha()) or (end + 1 < size and folded[end + 1].isalpha()):
            continue
        (hits if weight else spared).append((start, end, weight))
    if spared:
        spared.sort()
        starts, reach = [a for a, *_ in spared], list(accumulate((b for _, b, _ in spared), max))
        # A hit lies in a phrase if one of those that start no later ends no sooner.
        hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or reach[k - 1] < h[1]]
    return sum(h[2] for h in hits), float(len({folded[a : b + 1] for a, b, _ in hits})), n, len(hits)


def inputs(found: list[tuple[float, float, float, int]]) -> np.ndarray:
    """The score's inputs: weight of the hits, the same by length, distinct words hit."""
    x = np.array(found, dtype=float).reshape(-1, 4)
    return np.stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(100 * x[:, 0] / np.maximum(x[:, 2], 1)), np.log1p(x[:, 1])], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Newton steps on the ridge logistic loss; without rows of both classes only the prior is learned."""
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * np.array([0, 1, 1, 1]) * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns words that mark toxic texts, their log-odds as weights, and the score, from at most `sample` labelled texts outside the held-out fold.

    Without documents or labels the lexicon is empty and the score is the prior. See training_rows() for repeated ids.
    """
    with scratch(docs.sparkSession):
        rows = stage(training_rows(docs, labels, "toxic", sample), "sample")
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
        words = rows.select("label", F.explode(F.array_distinct(F.split(fold_column("text"), r"[^\p{L}]+"))).alias("word")).where(F.length("word") >= 3)
        n1, n0 = float(total.t), float(total.n - total.t)
        k1, k0 = F.sum("label").cast("double"), F.sum(1 - F.col("label")).cast("double")
        seen = words.groupBy("word").agg(k1.alias("k1"), k0.alias("k0")).where("k1 >= 2")
        expect = (F.col("k1") + F.col("k0")) * (n1 / max(n1 + n0, 1.0))
        rest = (F.col("k1") + F.col("k0")) * (n0 / max(n1 + n0, 1.0))
        ratio = 2 * (F.col("k1") * F.log(F.col("k1") / expect) + F.when(F.col("k0") > 0, F.col("k0") * F.log(F.col("k0") / rest)).otherwise(0.0))
        odds = F.log((F.col("k1") + 0.5) / (n1 + 1)) - F.log((F.col("k0") + 0.5) / (n0 + 1))
        picked = seen.withColumns({"g2": ratio, "weight": odds}).where((F.col("g2") >= SIGNIFICANCE) & (F.col("weight") >= LEAST_WEIGHT))
        weights = {r.word: r.weight for r in picked.orderBy(F.desc("g2"), "word").limit(LEXICON).collect()}
        lexicon = Lexicon(weights, exceptions, np.zeros(4))

        def run(batches):
            automaton = lexicon.automaton()
            for b in batches:
                x = inputs([evidence(automaton, t or "") for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

        got = rows.mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
        x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, 4)
        lexicon.coefficients = fit_logistic(x, got.column("label").to_numpy().astype(float))
        return lexicon


def with_score(docs: DataFrame, lexicon: Lexicon, column: str) -> DataFrame:
    """docs with the score in a column that it does not have. A null text is scored as an empty one."""
    text, names = docs.columns.index("text"), docs.columns

    def run(batches):
        automaton = lexicon.automaton()
        for b in batches:
            z = inputs([evidence(automaton, t or "") for t in b.column(text).to_pylist()]) @ lexicon.coefficients
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: its columns, then score (0 to 1) and predicted; columns of docs by these names are replaced.

    Every row is scored by its own whole text, repeated rows and null ids included; a null text counts as empty; texts
    with equal words have equal scores; an empty table gives no rows.
    """
    scored = with_score(docs.drop("score", "predicted"), lexicon, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with their own columns only, that the score does not reject."""
    column = new_name(docs)
    return with_score(docs, lexicon, column).where(F.col(column) < threshold).select(docs.columns)


def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
