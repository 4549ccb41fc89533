"""URL filters: allow and block rules by host and path, and a logistic regression for what no rule decides.

The regression sees hashed character n-grams of host and path. It is trained on the driver from a small labelled table
of URLs: at most ``MAX_LABELLED`` rows, those with the smallest hash, so that reruns choose the same. Its weights have a
fixed size (2**BITS numbers) and are broadcast; scoring is one pass over Arrow batches without an exchange.

Null URLs and those without ``://`` have empty hosts and paths; no rule fits them and the regression judges the empty
strings. Without labelled rows, or with one class only, everything gets that class (allow without any). Repeated rows
are judged each for itself; extra columns stay, but for those named like results, which are replaced. URLs are read
whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: Rules and verdicts of the query.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Most labelled rows to learn from, logarithm of the number of weights, lengths of n-grams.
MAX_LABELLED, BITS, ORDERS = 8_000, 18, (3, 4, 5)


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    picked = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        picked = F.when(fits, F.lit(rule)) if picked is None else picked.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if picked is None else picked


def buckets(texts: list[str], seed: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row number and bucket of every character n-gram of the texts, in one sweep over their joined bytes."""
    parts = [b"\x02" + t.encode("utf-8", "surrogatepass") + b"\x03" for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    rows, found = [], []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 1469598103934665603 + seed * 1000003 + n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ data[j : j + m]) * np.uint64(1099511628211)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        inside = row[:m] == row[n - 1 :]
        rows.append(row[:m][inside])
        found.append((h[inside] >> np.uint64(64 - bits)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature; a row's values have length 1."""
    with np.errstate(over="ignore"):
        (r1, b1), (r2, b2) = buckets(hosts, 1), buckets(paths, 2)
    row, bucket = np.concatenate([r1, r2]), np.concatenate([b1, b2])
    count = np.bincount(row, minlength=len(hosts))
    return row, bucket, 1.0 / np.sqrt(np.maximum(count, 1))[row]


def fit(hosts: list[str], paths: list[str], blocked: np.ndarray, steps: int = 80, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated full-batch gradient steps; the same rows give the same weights.

    Both classes weigh alike, so that the verdict on what no rule decides does not lean to the more frequent one.
    """
    w, b = np.zeros(1 << BITS), 0.0
    y = np.asarray(blocked, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return w, (20.0 if len(y) and y[0] else -20.0)
    row, bucket, value = grams(hosts, paths)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    v, vb, last, last_b = w.copy(), b, w, b
    for t in range(steps):
        z = np.bincount(row, value * v[bucket], minlength=len(y)) + vb
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        new = v - 4.0 * (np.bincount(bucket, value * gap[row], minlength=len(w)) * 1.0 + l2 / len(y) * v)
        new_b = vb - 2.0 * gap.sum()
        m = t / (t + 3)
        v, vb = new + m * (new - last), new_b + m * (new_b - last_b)
        last, last_b = new, new_b
    return last, float(last_b)


def score(df: DataFrame, host: str, path: str, model: tuple[np.ndarray, float], out: str) -> DataFrame:
    """Add the probability that a URL is to be blocked."""
    common.worker_imports(df.sparkSession)
    weights = df.sparkSession.sparkContext.broadcast(model[0].astype(np.float32))
    bias = model[1]

    @F.pandas_udf("double")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in batches:
            row, bucket, value = grams(list(h), list(p))
            z = np.bincount(row, value * weights.value[bucket].astype(float), minlength=len(h)) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return df.withColumn(out, blocked(F.col(host), F.col(path)))


def judge(df: DataFrame, url: str = "url", rules: dict[str, str] | None = None, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` and ``verdict``; they replace columns of these names.

    ``labelled`` has ``url`` and ``verdict``; without it the rows that a rule decides are the labelled ones.
    """
    rules = RULES if rules is None else rules
    u = F.col(url).cast("string")
    parts = df.withColumns({"host": host_of(u), "path": path_of(u)}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
    by_rule = F.get(F.map_values(F.map_filter(verdicts, lambda k, _: k == F.col("rule"))), F.lit(0)) if rules else F.lit(None).cast("string")
    if labelled is None:
        known = parts.where("rule is not null").select("host", "path", (by_rule == "block").alias("y"))
    else:
        lu = F.col("url").cast("string")
        known = labelled.where("verdict is not null").select(host_of(lu).alias("host"), path_of(lu).alias("path"), (F.col("verdict") == "block").alias("y"))
    known = known.distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(max_labelled).toPandas()
    model = fit(list(known["host"]), list(known["path"]), known["y"].to_numpy(dtype=float))
    return score(parts, "host", "path", model, "score").withColumn("verdict", F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
