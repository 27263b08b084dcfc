"""URL filter: rules first, else logistic regression on hashed character n-grams.

The model is trained from a small labelled table: urls that a rule decides
carry the rule's verdict as label, and a bounded number of them fits the model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
FIT_ROWS = 4_000  # bound of the labelled sample
GRAMS = (3, 4, 5)
WIDTH = 1 << 16
STEPS = 200
STRENGTH = 1e-4


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host up to ``? #`` or the end; empty if there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or nulls.

    A rule fits its host and all subdomains where the path starts with its path.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name = F.when(fits, at + start).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def gram_rows(hosts: Sequence[str], paths: Sequence[str]) -> list[np.ndarray]:
    """Distinct hashed n-grams of ``host + path`` for each url, with marks at both ends."""
    rows = []
    for host, path in zip(hosts, paths, strict=True):
        data = np.frombuffer(b"^" + (host + path).encode("utf-8", "surrogatepass") + b"$", np.uint8).astype(np.uint64)
        found = [np.empty(0, np.uint64)]
        for n in GRAMS:
            if len(data) >= n:
                h = np.full(len(data) - n + 1, n, np.uint64)
                for i in range(n):
                    h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                found.append(h)
        rows.append(np.unique(np.concatenate(found) % np.uint64(WIDTH)).astype(np.int64))
    return rows


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        rows = gram_rows(hosts, paths)
        scores = np.array([self.weights[r].sum() / np.sqrt(max(1, len(r))) for r in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(scores, -40, 40)))


def fit(hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[bool]) -> UrlModel:
    """Full-batch Adam.  Without rows every url is allowed; with one label all get it."""
    y = np.array(blocked, np.float64)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(WIDTH), 20.0 if len(y) and y[0] else -20.0)
    rows = gram_rows(hosts, paths)
    index, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = np.repeat([1 / np.sqrt(max(1, len(r))) for r in rows], [len(r) for r in rows])
    theta = np.zeros(WIDTH + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, weights=theta[index] * value, minlength=len(y)) + theta[WIDTH]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(index, weights=error[owner] * value, minlength=WIDTH) + STRENGTH * theta[:WIDTH], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return UrlModel(theta[:WIDTH].copy(), float(theta[WIDTH]))


def labelled_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``host, path, blocked`` of the urls that a rule decides."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    _, verdict = rule_of(host, path, rules)
    return pages.select(host.alias("host"), path.alias("path"), (verdict == "block").alias("blocked")).where("blocked IS NOT NULL")


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> UrlModel:
    """Fits on at most ``fit_rows`` rows, those whose hash comes first."""
    rows = labelled.orderBy(F.xxhash64("host", "path"), "host", "path").limit(fit_rows).collect()
    return fit([r.host for r in rows], [r.path for r in rows], [r.blocked for r in rows])


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` of every url.

    A null url, or one without ``://``, has empty host and path and is left to
    the model, like every url without a rule.  A map without shuffle: repeated
    rows give repeated rows, no rows none; other columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)  # WIDTH weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.block_probability(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "block_probability"])

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = parts.mapInArrow(run, StructType([*parts.schema.fields, StructField("block_probability", DoubleType())]))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "block_probability")


def url_filter(pages: DataFrame) -> DataFrame:
    """Trains on the urls that rules decide and judges every url."""
    return judge(pages, train(labelled_by_rules(pages)))
