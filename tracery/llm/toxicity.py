"""Severity of toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, doc_runs, lean, text_only, words
from .langid import held_out

#: All ASCII but letters and digits parts words here; bytes of other letters belong to them.
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(x . weights - thresholds[k - 1]), x being which features occur, and last whether any telling one does."""

    features: np.ndarray  # sorted word hashes
    weights: np.ndarray  # one more than features
    thresholds: np.ndarray  # rising
    telling: np.ndarray  # which features half of whose documents or more are toxic

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(scores[:, None] - self.thresholds[None, :])))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int, l2: float = 3e-5, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood, less l2; (rows, cols) are the features that occur. Thresholds rise by positive steps."""
    n = max(1, len(grade))
    share = np.array([np.clip((grade >= k).mean() if len(grade) else 0.5, 1e-3, 1 - 1e-3) for k in range(1, n_grades)])
    start = np.log((1 - share) / share)
    free = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        w, t0, d = free[:n_features], free[n_features], np.exp(free[n_features + 1 :])
        theta = np.concatenate([[t0], t0 + np.cumsum(d)])
        z = np.bincount(rows, w[cols], len(grade)) if len(rows) else np.zeros(len(grade))
        p = 1 / (1 + np.exp(-(z[:, None] - theta[None, :])))
        up = np.concatenate([np.ones((len(grade), 1)), p, np.zeros((len(grade), 1))], 1)
        slope = np.concatenate([np.zeros((len(grade), 1)), p * (1 - p), np.zeros((len(grade), 1))], 1)
        own = np.arange(len(grade))
        chance = np.maximum(up[own, grade] - up[own, grade + 1], 1e-12)
        dz = -(slope[own, grade] - slope[own, grade + 1]) / chance / n
        dtheta = np.zeros(n_grades - 1)
        np.add.at(dtheta, (grade - 1)[grade > 0], (slope[own, grade] / chance / n)[grade > 0])
        np.add.at(dtheta, grade[grade < n_grades - 1], -(slope[own, grade + 1] / chance / n)[grade < n_grades - 1])
        g = np.concatenate([np.bincount(cols, dz[rows], n_features) + l2 * w, [dtheta.sum()], np.cumsum(dtheta[::-1])[::-1][1:] * d])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    t0, d = free[n_features], np.exp(free[n_features + 1 :])
    return free[:n_features], np.concatenate([[t0], t0 + np.cumsum(d)])


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<bigint>): hashes of the distinct words, lower case, of each whole text."""

    def run(batches):
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for i, j in doc_runs(offsets):
                _, _, h, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], True, PARTS)
                lists = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "features"])

    return text_only(docs).mapInArrow(lean(run), "doc_id bigint, features array<bigint>")


def fit(docs: DataFrame, graded: DataFrame, n_grades: int = 3, max_rows: int = 20_000, max_features: int = 4096, least_z: float = 4.0, least_docs: int = 5) -> Ordinal:
    """Learn from (doc_id, grade).

    Bounds: max_rows graded rows, by hash of doc_id, and max_features words, those whose share of
    documents differs most between grade 0 and the others, by at least least_z standard errors.
    Null grades are left out; without any the model gives every text the same grades.
    """
    spark = docs.sparkSession
    picked = graded.where("doc_id is not null and grade is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", F.col("grade").cast("int").alias("grade")).collect()
    ids = spark.createDataFrame([(r.doc_id, r.grade) for r in picked], "doc_id long, grade int")
    sample = document_features(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(ids), "doc_id")
    n1 = sum(r.grade > 0 for r in picked)
    n0 = len(picked) - n1
    counts = sample.select(F.explode("features").alias("f"), (F.col("grade") > 0).cast("int").alias("y")).groupBy("f").agg(F.sum("y").alias("c1"), F.count("y").alias("c"))
    share = F.col("c") / F.lit(max(1, n0 + n1))
    z = (F.col("c1") / F.lit(max(1, n1)) - (F.col("c") - F.col("c1")) / F.lit(max(1, n0))) / F.sqrt(share * (1 - share) * F.lit(1 / max(1, n1) + 1 / max(1, n0)) + 1e-12)
    top = counts.where(F.col("c") >= least_docs).withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "f").limit(max_features).select("f", (2 * F.col("c1") >= F.col("c")).alias("telling")).collect()
    features = np.array([r.f for r in top], np.int64).view(np.uint64)
    telling = np.array([r.telling for r in top], bool)[np.argsort(features)]
    features = np.sort(features)
    ids_ = np.array([r.doc_id for r in picked], np.int64)
    order = np.argsort(ids_)
    rows = cols = np.zeros(0, np.int64)
    if len(features):
        wanted = spark.createDataFrame([(int(f),) for f in features.view(np.int64)], "f long")
        hits = sample.select("doc_id", F.explode("features").alias("f")).join(F.broadcast(wanted), "f").select("doc_id", "f").distinct().toArrow()
        rows = order[np.searchsorted(ids_[order], hits.column(0).to_numpy())]
        cols = np.searchsorted(features, hits.column(1).to_numpy().view(np.uint64))
    grade = np.array([min(max(r.grade, 0), n_grades - 1) for r in picked], np.int64)
    # one telling word is much, more of them are little more: so that grades beyond the first don't hold the weights down
    some = np.unique(rows[telling[cols]]) if len(rows) else rows
    rows, cols = np.concatenate([rows, some]), np.concatenate([cols, np.full(len(some), len(features))])
    w, t = fit_ordinal(rows, cols, grade, len(features) + 1, n_grades)
    return Ordinal(features, w, t, telling)


def _scores(raw: np.ndarray, offsets: np.ndarray, m: Ordinal) -> np.ndarray:
    score = np.zeros(len(offsets) - 1)
    if len(m.features):
        _, _, h, first = words(raw, offsets, True, PARTS)
        at = np.minimum(np.searchsorted(m.features, h), len(m.features) - 1)
        hit = np.flatnonzero(m.features[at] == h)
        doc = np.searchsorted(first, hit, "right") - 1
        pair = np.unique(doc * len(m.features) + at[hit])
        doc, own = pair // len(m.features), pair % len(m.features)
        score = np.bincount(doc, m.weights[own], len(score)) + m.weights[-1] * (np.bincount(doc, m.telling[own], len(score)) > 0)
    return score


def predict(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, p_toxic, severity, grade) of every whole text: chance of grade 1 or more, expected grade, and the highest grade that is reached with a chance of one half.

    Null and empty texts have no features. Rows that repeat a doc_id, or have none, are graded one
    by one; an empty table gives none. No shuffle; the model, bounded by its features, travels
    with the function.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for i, j in doc_runs(offsets):
                p = model.at_least(_scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32))], ["doc_id", "p_toxic", "severity", "grade"])

    return text_only(docs).mapInArrow(lean(run), "doc_id bigint, p_toxic double, severity double, grade int")


def without_toxic(docs: DataFrame, model: Ordinal, most: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose chance of toxicity is below ``most``: no shuffle and no join."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            raw, offsets = column_bytes(batch.column(at))
            for i, j in doc_runs(offsets):
                p = model.at_least(_scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model))
                yield batch.slice(i, j - i).filter(pa.array(p[:, 0] < most))

    return docs.mapInArrow(lean(run), docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels (doc_id, toxic, quality). Grade 0: not toxic; 1: toxic, in bad text; 2: toxic in text that is good otherwise, which is read and passed on. Rows held out for testing are left out.

    The grades come from the labels alone, none from the text. A null toxic is no label; a null quality counts as bad.
    """
    worse = F.coalesce(F.col("quality").cast("int") > 0, F.lit(False)).cast("int")
    toxic = (F.col("toxic").cast("int") > 0).cast("int")
    return labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (toxic * (1 + worse)).alias("grade")).where(~held_out())


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Chance and expected severity of toxicity of every document; toxic where the chance is at least one half."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return predict(docs, model).withColumn("toxic", F.col("p_toxic") >= 0.5)
