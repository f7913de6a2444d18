"""Hierarchical empirical Bayes for document quality.

A small classifier turns each document into evidence: the log likelihood ratio of good against bad. Grouped sums of
its probabilities give every path and host a Beta posterior: paths are shrunk towards their host, hosts towards the
corpus, the more the fewer documents they have. How strongly is estimated from the corpus itself, from the spread of
rates between hosts, and between paths of one host, beyond what chance explains. A document's posterior is its path's
posterior without the document itself, plus its own evidence, on the logit scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import sliced, text_bytes, written
from gaugeworks.llm.quality_rules import one_text_each

FEATURES = ("letters", "capitals", "digits", "symbols", "shouts", "gaps", "lines", "size")


# --- sites ----------------------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without www.; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """The host and the first part of the path."""
    return F.concat(url_host(url), F.lit("/"), F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^/?#]*)", 1))


# --- the classifier -------------------------------------------------------------------------------------


def character_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text: shares of its bytes by class, and the logarithm of its length."""
    return np.concatenate([np.zeros((0, len(FEATURES))), *map(_character_features, sliced(column))])


def _character_features(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    kinds = np.zeros(256, np.uint8)
    for kind, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b"#*$%&|<>~^=_{}[]@\\", b"!", (9, 11, 12, 13, 32), (10,)), 1):
        kinds[list(members)] = kind
    kinds[128:] = 1
    found = kinds[data]
    size = np.diff(offsets)
    shares = [np.diff(np.concatenate(([0], np.cumsum(found == k)))[offsets]) / np.maximum(1, size) for k in range(1, 8)]
    return np.stack([*shares, np.log1p(size) / 10], axis=1)


def fit_evidence(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most: int) -> dict:
    """Logistic regression by Newton steps on at most `most` labelled rows, drawn by a hash of the id.

    The driver gets their features only. Without rows of both labels there is no evidence: all ratios are 0.
    """
    ids, label = F.col(id_column), F.col(label_column)
    drawn = labels.where(ids.isNotNull() & label.isin(0, 1)).groupBy(ids.alias("id")).agg(F.max(label).alias("label"))
    drawn = drawn.orderBy(F.xxhash64(F.col("id"), F.lit("site sample")), "id").limit(most)
    texts = docs.where(F.col(text_column).isNotNull()).select(ids.alias("id"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in batches:
            values = character_features(batch.column("text"))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("id"), batch.column("label"), rows], names=["id", "label", "x"])

    sample = one_text_each(texts.join(F.broadcast(drawn), "id"))
    rows = sample.select("id", F.col("label").cast("int"), "text").mapInArrow(run, "id long, label int, x array<double>").toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return {"weights": np.zeros(len(FEATURES)), "bias": 0.0}
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    x = np.array(rows.column("x").to_pylist())[order]
    y = y[order]
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ridge = np.diag([1e-2] * len(FEATURES) + [1e-9])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ np.r_[w[:-1], 0])
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    # The ratio is the fitted logit less that of the share of good rows.
    return {"weights": w[:-1], "bias": float(w[-1] - np.log(y.mean() / (1 - y.mean())))}


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """(id, host, path, ratio) of rows (id, host, path, text): log likelihood ratios between -12 and 12."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            ratio = np.clip(character_features(texts) @ shared.value["weights"] + shared.value["bias"], -12, 12)
            ratio = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0.0, ratio)
            yield pa.record_batch([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(ratio)], names=["id", "host", "path", "ratio"])

    return docs.select("id", "host", "path", "text").mapInArrow(run, "id long, host string, path string, ratio double")


# --- the hierarchy --------------------------------------------------------------------------------------


def strength(total, groups, spread, chance) -> float:
    """Prior counts from the spread of group rates (a weighted variance) beyond chance, by the method of moments."""
    beyond = max(spread / total - chance * (groups - 1) / total, 1e-6) if total else 1e-6
    return float(min(max(chance / beyond - 1, 1.0), 1e6))


def quality_posteriors(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", most: int = 20_000, threshold: float = 0.5,
) -> DataFrame:
    """(id, host, path, evidence, host_quality, path_quality, quality, kept) for every row of `docs`.

    `host` and `path` are columns; null counts as the site ''. A null text has evidence 0 and so its site's quality; an
    empty text is judged like others. Equal rows, null and equal ids all come back and all count. Other columns are
    ignored. kept: quality >= `threshold`. `most` bounds the labelled rows that the classifier is fitted on.
    """
    model = fit_evidence(docs, labels, id_column, text_column, label_column, most)
    source = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"), F.col(text_column).alias("text"),
    )
    rows = written(evidence(source, model), "evidence")

    # The share of good documents that equals the mean probability it leads to, approached in passes over one column.
    share = 0.5
    logistic = lambda x: 1.0 / (1.0 + F.exp(-x))
    for _ in range(4):
        mean = rows.agg(F.avg(logistic(F.col("ratio") + float(np.log(share / (1 - share)))))).first()[0]
        share = min(max(mean if mean is not None else 0.5, 1e-3), 1 - 1e-3)
    p = logistic(F.col("ratio") + float(np.log(share / (1 - share))))

    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood")), "hosts")
    of = hosts.agg(
        F.sum("hn").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("hgood").alias("good"),
        F.sum(F.col("hn") * F.pow(F.col("hgood") / F.col("hn") - share, F.lit(2))).alias("spread"),
    ).first()
    both = paths.join(hosts, "host")
    rate = F.col("hgood") / F.col("hn")
    within = both.agg(
        F.sum("n").alias("n"), (F.count(F.lit(1)) - F.countDistinct("host") + 1).alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, F.lit(2))).alias("spread"),
        F.avg(rate * (1 - rate)).alias("chance"),
    ).first()
    k_host = strength(of["n"] or 0, of["groups"], of["spread"] or 0.0, share * (1 - share))
    k_path = strength(within["n"] or 0, within["groups"], within["spread"] or 0.0, max(within["chance"] or 0.25, 1e-4))

    sites = written(both, "sites")
    joined = rows.join(sites.toDF(*[f"site_{c}" if c in ("host", "path") else c for c in sites.columns]), (F.col("host") == F.col("site_host")) & (F.col("path") == F.col("site_path")))
    own = joined.withColumn("p", p)
    host_without = (F.col("hgood") - F.col("p") + k_host * share) / (F.col("hn") - 1 + k_host)
    host_quality = (F.col("hgood") + k_host * share) / (F.col("hn") + k_host)
    path_quality = (F.col("good") + k_path * host_quality) / (F.col("n") + k_path)
    prior = (F.col("good") - F.col("p") + k_path * host_without) / (F.col("n") - 1 + k_path)
    prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    quality = logistic(F.col("ratio") + F.log(prior / (1 - prior)))
    return own.select(
        F.col("id").alias(id_column), "host", "path", F.col("ratio").alias("evidence"), host_quality.alias("host_quality"),
        path_quality.alias("path_quality"), quality.alias("quality"), (quality >= threshold).alias("kept"),
    )
