"""Quality classifier by hierarchical empirical Bayes: a document's own evidence, its path and its host.

A naive Bayes classifier over binned text counts gives each document a log likelihood ratio. Expected good documents are
summed per host and per path; each host is shrunk toward the global rate and each path toward its host, by strengths
estimated from the spread between sites. A document's prior is its path's posterior, without its own share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import broadcast_if_small, materialize
from tickloom.llm.quality_rules import document_counts

#: Binned features: name -> SQL of a value in hundredths; bins are its powers of two.
FEATURES = {
    "words": "n_words",
    "word_length": "10 * word_chars / n_words",
    "symbols": "1000 * n_symbols / n_words",
    "lines": "100 * n_dup_lines / n_lines",
    "windows": "100 * n_repeat_words / n_words",
    "capitals": "100 * n_upper / n_letters",
    "letters": "100 * (n_words - n_alpha_words) / n_words",
    "variety": "100 * n_distinct_words / n_words",
}
STRENGTH = (1.0, 1000.0)


def bins() -> list[Column]:
    """0 for nothing (or nothing to divide by), else 1 + floor(log2(1 + value))."""
    value = {n: F.coalesce(F.expr(f"try_divide({a.strip()}, {b.strip()})") if "/" in e else F.expr(e), F.lit(0)) for n, e in FEATURES.items() for a, _, b in [e.partition("/")]}
    return [F.when(v <= 0, 0).otherwise(1 + F.floor(F.log2(1 + v))).cast("int").alias(f"bin_{n}") for n, v in value.items()]


def learn(binned: DataFrame, labels: DataFrame, smoothing: float = 2.0) -> tuple[float, dict[str, dict[int, float]]]:
    """Log odds of label 1 and, for each feature and bin, its log likelihood ratio, by one grouped count.

    labels (doc_id, label 0 or 1). The result has at most as many numbers as there are features and bins."""
    usable = labels.filter("doc_id is not null and label in (0, 1)").dropDuplicates(["doc_id"])
    pairs = F.explode(F.array(F.struct(F.lit("").alias("f"), F.lit(0).alias("b")), *[F.struct(F.lit(n).alias("f"), F.col(f"bin_{n}").alias("b")) for n in FEATURES])).alias("x")
    rows = binned.join(usable, "doc_id").select("label", pairs).groupBy("x.f", "x.b", "label").count().collect()
    seen = {(r["f"], r["b"], r["label"]): r["count"] for r in rows}
    good, bad = (seen.get(("", 0, k), 0) for k in (1, 0))
    ratios: dict[str, dict[int, float]] = {n: {} for n in FEATURES}
    for f, b in {k[:2] for k in seen if k[0]}:
        kinds = len({k[1] for k in seen if k[0] == f})
        p, q = ((seen.get((f, b, k), 0) + smoothing) / (n + smoothing * kinds) for k, n in ((1, good), (0, bad)))
        ratios[f][b] = float(np.log(p / q))
    return float(np.log((good + 1) / (bad + 1))), ratios


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sites(pages: DataFrame) -> DataFrame:
    """pages (url) -> doc_id, host, path: the number that ends a URL's path names the document.

    host in small letters, path its first segment (empty if there is none). One row for each document, the smallest URL's;
    URLs without such a number, and null ones, are no use."""
    doc_id = F.expr("try_cast(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?([0-9]+)(?:[.][a-z]+)?/?(?:[?#].*)?$', 1), '') as bigint)")
    first = pages.select(doc_id.alias("doc_id"), "url").filter("doc_id is not null").groupBy("doc_id").agg(F.min("url").alias("url"))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return first.select("doc_id", host.alias("host"), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+/([^/?#]+)/", 1).alias("path"))


def strength(groups: DataFrame, mean: Column) -> float:
    """Weight, in documents, of the level above: by the method of moments from groups (n, good, squares).

    The spread of group means around `mean`, less what the spread of documents within groups explains, is what sites
    differ by; without groups of two or more the largest weight is returned."""
    within = F.greatest(F.lit(0.0), (F.col("squares") - F.col("good") * F.col("good") / F.col("n")) / (F.col("n") - 1))
    gap = F.col("good") / F.col("n") - mean
    row = groups.filter("n > 1").agg(F.avg(gap * gap - within / F.col("n")).alias("between"), F.avg(within).alias("within")).first()
    if row["between"] is None or row["between"] <= 0:
        return STRENGTH[1]
    return float(np.clip(row["within"] / row["between"], *STRENGTH))


def classify(docs: DataFrame, pages: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, quality (posterior) and kept of every document.

    docs (doc_id, text, source), pages (url), labels (doc_id, label). A document without a page belongs to the host
    `source:` and its source (null: empty). Null and empty texts have the evidence of empty counts; very long ones are
    counted whole; a posterior equal to the threshold keeps. Rows that share a doc_id are judged one by one; an empty table gives no rows; without labels every ratio is 0 and the odds are even.
    Sites are small sums, made in map-side parts, so a host with a third of all documents is one row like any other.
    """
    counted = materialize(document_counts(docs, "source").select("doc_id", "source", *bins()), "site-bins")
    odds, ratios = learn(counted, labels)
    evidence = F.lit(0.0)
    for n, by_bin in ratios.items():
        one = F.lit(0.0)
        for b, ratio in by_bin.items():
            one = F.when(F.col(f"bin_{n}") == b, ratio).otherwise(one)
        evidence = evidence + one
    found = counted.select("doc_id", "source", evidence.alias("evidence")).join(sites(pages), "doc_id", "left")
    own = F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))
    found = found.select("doc_id", F.coalesce("host", own).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "evidence", (1 / (1 + F.exp(-(F.col("evidence") + odds)))).alias("p"))
    found = materialize(found, "site-evidence")

    sums = F.count("*").alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("squares")
    paths = materialize(found.groupBy("host", "path").agg(*sums), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    k_host = strength(hosts, F.lit(rate))
    host_rate = (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host)
    both = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host")
    k_path = strength(both, host_rate)
    table = broadcast_if_small(materialize(both.select("host", "path", "n", "good", "host_n", "host_good"), "site-table"))

    joined = found.join(table, ["host", "path"], "left")
    others = lambda k: F.greatest(F.lit(0.0), F.col(k) - F.col("p"))  # noqa: E731  the document's own share is left out
    host_rate = (others("host_good") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    path_rate = (others("good") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    safe = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    out = joined.withColumn("host_rate", safe(host_rate)).withColumn("path_rate", safe(path_rate))
    out = out.withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_rate"))))))
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("kept"))
