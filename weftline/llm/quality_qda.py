"""Quality classification by a regularised quadratic discriminant.

Transformed document statistics (logs of sizes, arcsine roots of shares) are
computed once for every whole text and stored. Class means and covariances come
from sums over all labelled rows whose crc32(doc_id) mod 5 is not 0, added up
in partitions and then over them, so no row reaches the driver. Covariances are
shrunk twice: towards the pooled one by TO_POOLED, then towards a scaled
identity by TO_IDENTITY. The score is the posterior of label 1 from the
difference of the Mahalanobis log-densities, with Cholesky factors kept in the
model.

Defined results: null and empty texts have all statistics 0 and a score like
any other. A null doc_id counts as held out. Without rows of both labels the
score is the share of label 1 (0.5 without any). A label other than 0 or 1, or
a null one, is not used; a repeated label counts each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._worker import release
from weftline.llm.langid import holdout
from weftline.storage import stored, table

TO_POOLED = 0.1
TO_IDENTITY = 0.05
THRESHOLD = 0.3
_ROWS_OUT = 512

#: Classes of ASCII bytes whose shares are statistics, and the share each is drawn to in short texts.
_CLASSES = {
    "upper": (range(65, 91), 0.03),
    "symbol": (b"#*$%&<>", 0.0),
    "bar": (b"|", 0.0),
    "shout": (b"!", 0.0),
    "stop": (b".", 0.02),
    "comma": (b",", 0.01),
    "other": (b"\"'()/:;=?@[\\]^_`{}~+-", 0.003),
}
STATISTICS = (*_CLASSES, "words", "word_length", "distinct_words", "lines", "line_length", "repeated_lines", "low_entropy")
#: A text counts as if it had this many usual words, of this many bytes, more: short texts vary widely by chance.
USUAL_WORDS, USUAL_BYTES = 30, 6


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    more, n, ink = USUAL_WORDS * USUAL_BYTES, len(words), int(count.sum() - count[[9, 10, 11, 12, 13, 32]].sum())
    root = lambda x: float(np.arcsin(np.sqrt(min(max(x, 0.0), 1.0))))
    out = [root((count[list(c)].sum() + usual * more) / (ink + more)) for c, usual in _CLASSES.values()]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = count[count > 0] / count.sum()
    entropy = float(-(share * np.log2(share)).sum())
    return out + [
        float(np.log(n + USUAL_WORDS)),
        float(np.log((ink + more) / (n + USUAL_WORDS))),
        float(np.log((len(set(words)) + USUAL_WORDS) / (n + USUAL_WORDS) ** 0.9)),
        float(np.log(len(lines) + 2)),
        float(np.log((n + USUAL_WORDS) / (len(lines) + 2))),
        root((len(lines) - len(set(lines))) / (len(lines) + 5)),
        float(np.log1p(max(0.0, 4.5 - entropy)) * n / (n + USUAL_WORDS)),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS_OUT):
            part = batch.slice(lo, _ROWS_OUT)
            rows = [statistics(t.as_py()) for t in part.column(part.num_columns - 1)]
            yield pa.record_batch([*part.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*part.schema.names[:-1], "stats"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["quality", "sums"])


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Scale, class means, Cholesky factors, log determinants and the prior log odds."""
    d = len(STATISTICS)
    train = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    rows = stats.where(~F.col("held_out")).join(train, F.col("doc_id") == F.col("_id")).select("quality", "stats")
    #: one row a class and partition, then one a class
    parts = rows.mapInArrow(_moments, "quality int, sums array<double>").select("quality", F.posexplode("sums").alias("at", "x"))
    sums = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("quality", "at").agg(F.sum("x").alias("x")).collect():
        sums[r["quality"], r["at"]] = r["x"]
    n = sums[:, 0]
    if n.min() < 2:
        share = (n[1] / n.sum()) if n.sum() else 0.5
        return {"constant": float(share)}
    mean = sums[:, 1 : 1 + d] / n[:, None]
    cov = [sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    model = {"scale": scale, "mean": mean / scale, "factor": [], "log_det": [], "prior": float(np.log(n[1] / n[0]))}
    for c in (0, 1):
        s = (1 - TO_POOLED) * cov[c] + TO_POOLED * pooled
        s /= np.outer(scale, scale)
        s = (1 - TO_IDENTITY) * s + TO_IDENTITY * max(np.trace(s) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(s)
        model["factor"].append(factor)
        model["log_det"].append(float(2 * np.log(np.diag(factor)).sum()))
    return model


def _solved(factor: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows z with factor z = x for each row of x, by forward substitution."""
    z = np.empty_like(x)
    for k in range(len(factor)):
        z[:, k] = (x[:, k] - z[:, :k] @ factor[k, :k]) / factor[k, k]
    return z


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Posterior of label 1 of each row of statistics."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    log_density = [
        -0.5 * (_solved(model["factor"][c], x / model["scale"] - model["mean"][c]) ** 2).sum(1) - 0.5 * model["log_det"][c] for c in (0, 1)
    ]
    return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + model["prior"], -700, 700)))


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.record_batch([*batch.columns[:-1], pa.array(scores(model, x), pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), holdout().alias("held_out"), "text")
    stats = stored(docs.mapInArrow(_statistics, "doc_id long, held_out boolean, stats array<double>"), "statistics")
    out = stats.mapInArrow(_score(fit(stats, labels)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, in their own columns, that are not rejected. Statistics are
    computed again beside each row, so that no text is shuffled."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), holdout().alias("held_out"), "text").where(~F.col("held_out"))
    model = fit(stored(held.mapInArrow(_statistics, "doc_id long, held_out boolean, stats array<double>"), "statistics"), labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(lo, _ROWS_OUT)
                x = np.array([statistics(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]).reshape(-1, len(STATISTICS))
                yield part.filter(pa.array(scores(model, x) >= THRESHOLD))

    return docs.mapInArrow(good, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
