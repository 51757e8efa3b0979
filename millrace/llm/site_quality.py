"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import checkpoint, join_small, labelled_sample, ship, split_words

#: Labelled documents that the classifier is fitted on at most.
FIT_DOCS = 2000
UPPER, DIGITS, SYMBOLS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>"
N_FEATURES = 13
#: A document's log odds stay within these bounds.
CLIP = 12.0


def features(text: bytes) -> list[float]:
    """What a whole text looks like, in numbers that don't grow with its length."""
    words = split_words(text)
    n, size = max(len(words), 1), max(len(text), 1)
    drop = lambda chars: size - len(text.translate(None, chars)) if text else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    twice = sum(map(bytes.__eq__, words, words[1:]))
    stops = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    return [
        1.0, np.log1p(len(words)) / 10, min(size / n, 20) / 20, drop(UPPER) / size, drop(SYMBOLS) / size, drop(DIGITS) / size, text.count(b"!") / n, text.count(b"|") / n,
        len(set(words)) / n ** 0.8, twice / n, 1 - len(set(lines)) / max(len(lines), 1), stops / n, text.count(b",") / n,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised features. Returns weights, means and deviations."""
    mean, dev = x.mean(0), x.std(0)
    mean[0], dev[dev < 1e-9] = 0.0, 1.0
    z = (x - mean) / dev
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, dev


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Fit on at most ``limit`` labelled documents; None unless labels of both kinds are found."""
    sample = labelled_sample(docs, labels, "quality", limit)
    y = np.array([label for _, _, label in sample], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return fit_logistic(np.array([features(t.encode()) for _, t, _ in sample]), y)


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and doc_logit; 0 without a model."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text_col, "doc_logit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or b"") for t in batch.column(0).cast(pa.binary())]).reshape(-1, N_FEATURES)
            if model is None:
                logit = np.zeros(len(x))
            else:
                w, mean, dev = model
                logit = np.clip((x - mean) / dev @ w, -CLIP, CLIP)
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(others))), pa.array(logit)], names=[*others, "doc_logit"])

    types = dict(docs.dtypes)
    return docs.select(text_col, *others).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in others), "doc_logit double"]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(stats: DataFrame, parent: str) -> float:
    """The beta prior's weight in documents, by the method of moments: the spread of site means beyond what chance gives."""
    m = F.col("total") / F.col("n")
    row = stats.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (m - F.col(parent)) ** 2).alias("between"),
        F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("unit"),
    ).first()
    if not row["n"]:
        return 1.0
    spread = max((row["between"] - row["chance"]) / row["n"], 1e-6)
    return float(min(max(row["unit"] / row["n"] / spread - 1, 1.0), 1000.0))


def classify(docs: DataFrame, model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, doc_prob, host_prior, path_prior, quality, kept) of every document.

    The classifier gives each document a probability. Its mean over a host, and over a path of a host, shrinks towards the level
    above: (sum + m * parent) / (n + m), the weight m estimated for either level from grouped sums. A document's own probability is
    left out of its site's sums. The site then replaces the global prior: logit(quality) = doc_logit + logit(path_prior) - logit(global).
    Sites are found by grouped aggregation with partial sums; the site table is joined back (broadcast only if
    small). Null hosts or paths are a site of their own; null and empty texts are scored like an empty one; repeated rows count each.
    Only id, text, host and path are read, so other columns' names don't clash. An empty table gives none.
    """
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col), F.coalesce(F.concat(F.lit("="), host), F.lit("~")).alias("__host"), F.coalesce(F.concat(F.lit("="), path), F.lit("~")).alias("__path"))
    scored = checkpoint(score(slim, model, text_col).withColumn("p", 1 / (1 + F.exp(-F.col("doc_logit")))))
    sites = checkpoint(scored.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")))
    row = sites.agg(F.sum("total"), F.sum("n")).first()
    overall = min(max(row[0] / row[1], 1e-4), 1 - 1e-4) if row[1] else 0.5
    hosts = sites.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    m_host = _strength(hosts.withColumn("parent", F.lit(overall)), "parent")
    hosts = hosts.select("__host", F.col("n").alias("host_n"), F.col("total").alias("host_total"))
    paths = sites.join(hosts, "__host")
    m_path = _strength(paths.withColumn("parent", (F.col("host_total") + m_host * overall) / (F.col("host_n") + m_host)), "parent")
    out = join_small(scored, checkpoint(paths), ["__host", "__path"])
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    host_prior = inside((F.col("host_total") - F.col("p") + m_host * overall) / (F.col("host_n") - 1 + m_host))
    out = out.withColumn("host_prior", host_prior)
    out = out.withColumn("path_prior", inside((F.col("total") - F.col("p") + m_path * F.col("host_prior")) / (F.col("n") - 1 + m_path)))
    logit = F.col("doc_logit") + _logit(F.col("path_prior")) - F.lit(float(np.log(overall / (1 - overall))))
    out = out.withColumn("quality", 1 / (1 + F.exp(-logit)))
    return out.select(id_col, F.col("p").alias("doc_prob"), "host_prior", "path_prior", "quality", (F.col("quality") >= threshold).alias("kept"))


def filter_documents(docs: DataFrame, model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, whole. Rows are told apart by what their verdict depends on (id, text, host and path), so repeated
    and null ids do no harm; the rejected ones, usually few, are the small side of a join."""
    key = F.xxhash64(F.col(id_col), F.col(text_col), host, path)
    judged = classify(docs.select(F.struct(F.col(id_col).alias("id"), key.alias("key")).alias("__row"), F.col(text_col), host.alias("__h"), path.alias("__p")), model, F.col("__h"), F.col("__p"), "__row", text_col, threshold)
    gone = checkpoint(judged.where(~F.col("kept")).select(F.col("__row.id").alias("__id"), F.col("__row.key").alias("__key")).distinct())
    return join_small(docs.withColumn("__id", F.col(id_col)).withColumn("__key", key), gone, ["__id", "__key"], "left_anti").select(*docs.columns)
