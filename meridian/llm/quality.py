"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path posteriors.

Evidence: the log odds of a logistic regression on whole-text shape features. A host is a `source`, a path is a host's
part in one language; null is a host or path of its own, apart from the empty one. Hosts shrink to the global mean and
paths to their host. How strongly is estimated from all sites by moments (variance within sites over variance between
them), so sparse sites stay near their parents. A document's own evidence is left out of its site's sums. Null texts
count as empty; without labels every document's own odds are even. Rows of one doc_id are judged by their own texts;
documents labelled both ways teach nothing; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meridian.llm.common import by_slices, pick, plain, small, stored

#: Labelled documents per class that the classifier is fitted on; the least posterior kept.
SAMPLE_DOCS, KEEP = 2000, 0.5
#: Strengths stay finite: sites that don't differ at all shrink as if their parent had this many documents.
STRONGEST = 1e6
FEATURES = 13


def features(text: str | None) -> list[float]:
    t = text or ""
    raw = np.bincount(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    upper, lower, high = raw[65:91].sum(), raw[97:123].sum(), raw[128:].sum()
    words, lines = t.split(), t.split("\n")
    k = max(1, len(words))
    return [np.log1p(n), upper / max(1, upper + lower), raw[48:58].sum() / n, raw[32] / n, raw[33] / n, raw[124] / n, raw[35] / n, (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / n, high / n, min(30.0, n / k), len(set(words)) / k, len(set(lines)) / len(lines), float(not words)]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Features and labels of a bounded sample, the same for the same rows, and the share of good labels."""
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    ids = {}
    for y in (0, 1):
        ids |= {r[0]: y for r in known.where(F.col("quality") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()}
    if not ids:
        return np.zeros((0, FEATURES)), np.zeros(0), 0.5
    # Of rows that share a doc_id the first text counts.
    rows = shape(pick(docs, "doc_id", "text").where(F.col("doc_id").isin(sorted(ids)))).groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    rows = sorted((r.doc_id, list(r.x)) for r in rows)
    return np.array([x for _, x in rows]).reshape(-1, FEATURES), np.array([ids[i] for i, _ in rows], float), counts.get(1, 0) / max(1, sum(counts.values()))


def shape(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


class Classifier:
    """Logistic regression on standardised features and their squares, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        self.const = None
        if not len(y) or y.min() == y.max():
            self.const = 0.0 if not len(y) else float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
            return
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        z = self.expand(x)
        # Classes are weighted as in all labels.
        w = np.where(y > 0, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        b = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            hess = (z * (w * p * (1 - p))[:, None]).T @ z + 1.0 * np.eye(len(b))
            b = b + np.linalg.solve(hess, z.T @ (w * (y - p)) - b)
        self.b = b

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, z * z])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.const) if self.const is not None else np.clip(self.expand(x) @ self.b, -12, 12)


def evidence(docs: DataFrame, model: Classifier, keep: bool = False) -> DataFrame:
    """The rows' doc_id, source and lang (or all their columns) and the classifier's log odds."""
    names = docs.columns
    at = names.index("text")
    out = [i for i in range(len(names)) if keep or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_slices(batches):
            x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in out], pa.array(model.odds(x))], [*[names[i] for i in out], "__odds"])

    return docs.mapInArrow(run, StructType([*[docs.schema.fields[i] for i in out], StructField("__odds", DoubleType())]))


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def strength(within: float, free: float, between: float, weight: float, groups: float) -> float:
    """Prior counts: the variance within groups over that between them, both by moments.

    within: squares around the groups' means; free: their degrees of freedom; between: squares of those means around
    their parents'; weight: the documents between counts, corrected; groups: the groups less their parents.
    """
    v = within / free if free > 0 else 0.0
    a = (between - groups * v) / weight if weight > 0 else 0.0
    return min(STRONGEST, v / a) if a > 0 else STRONGEST


class Sites:
    """Sums of all paths and hosts, the global mean and the two strengths."""

    def __init__(self, judged: DataFrame) -> None:
        p = probability(F.col("__odds"))
        paths = stored(judged.select("source", "lang", p.alias("p")).groupBy("source", "lang").agg(F.sum("p").alias("s"), F.count("*").alias("n"), F.sum(F.col("p") * F.col("p")).alias("ss")))
        hosts = stored(paths.groupBy("source").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"), F.sum("ss").alias("host_ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k")))
        n, total = F.col("host_n"), F.col("host_s")
        # One row of sums over hosts.
        t = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n"), F.sum("host_ss").alias("ss"), F.sum("q").alias("q"), F.sum(total * total / n).alias("hq"), F.sum(n * n).alias("hnn"), F.sum(F.col("nn") / n).alias("pnn"), F.sum("k").alias("k"), F.count("*").alias("h")).first()
        self.sum, self.n = (float(t.s), float(t.n)) if t.n else (0.0, 0.0)
        self.of_host = self.of_path = STRONGEST
        if t.n:
            mean = self.sum / self.n
            self.of_path = strength(t.ss - t.q, t.n - t.k, t.q - t.hq, t.n - t.pnn, t.k - t.h)
            self.of_host = strength(t.ss - t.hq, t.n - t.h, t.hq - self.n * mean * mean, t.n - t.hnn / t.n, t.h - 1)
        joined = paths.join(hosts, paths.source.eqNullSafe(hosts.source))
        self.table = stored(joined.select(paths.source.alias("__source"), paths.lang.alias("__lang"), "s", paths.n.alias("n"), "host_s", "host_n"))

    def join(self, judged: DataFrame) -> DataFrame:
        """judged with host_mean, path_mean and __post (log odds), each without the document itself."""
        size = int(self.table.agg(F.max(F.coalesce(F.octet_length("__source"), F.lit(0)) + F.coalesce(F.octet_length("__lang"), F.lit(0)))).first()[0] or 0)
        out = judged.join(small(self.table, size + 100), judged.source.eqNullSafe(F.col("__source")) & judged.lang.eqNullSafe(F.col("__lang")), "left")
        p = probability(F.col("__odds"))
        rest = F.lit(self.n) - 1
        mean = F.when(rest > 0, (F.lit(self.sum) - p) / rest).otherwise(F.lit(0.5))
        host = (F.col("host_s") - p + self.of_host * mean) / (F.col("host_n") - 1 + self.of_host)
        path = (F.col("s") - p + self.of_path * F.col("host_mean")) / (F.col("n") - 1 + self.of_path)
        bounded = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
        out = out.withColumn("__mean", bounded(mean)).withColumn("host_mean", bounded(host)).withColumn("path_mean", bounded(path))
        log_odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
        return out.withColumn("__post", F.col("__odds") + log_odds("path_mean") - log_odds("__mean"))


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, document probability, host and path means, posterior and keep of every row."""
    judged = stored(evidence(pick(docs, "doc_id", "source", "lang", "text"), Classifier(*sample(docs, labels))))
    out, posterior = Sites(judged).join(judged), probability(F.col("__post"))
    return out.select("doc_id", probability(F.col("__odds")).alias("doc_p"), "host_mean", "path_mean", posterior.alias("posterior"), (posterior >= KEEP).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose posterior is KEEP or more, with the columns of docs. The texts aren't shuffled: evidence is computed twice instead."""
    model = Classifier(*sample(docs, labels))
    sites = Sites(evidence(pick(docs, "source", "lang", "text"), model))
    flat = plain(docs, "doc_id", "source", "lang", "text")
    good = sites.join(evidence(flat, model, keep=True)).where(probability(F.col("__post")) >= KEEP)
    return good.select(*flat.columns).toDF(*docs.columns)
