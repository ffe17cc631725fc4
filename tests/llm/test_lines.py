"""Line deduplication against a plain version."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tickloom.llm import lines

SCHEMA = "doc_id long, text string, `a.b` string, key string"
LONG, OTHER = "The licence of this text is free.", "Überall gilt: öffentlich und frei, für alle."


def plain(rows, min_chars=20, min_docs=3):
    """(n_lines, n_dropped, kept text) of every row."""
    strip = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    at = lambda i: -(1 << 63) if i is None else i
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            docs[strip(line)].add(at(doc))
    gone = {k: max(v) for k, v in docs.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if gone.get(strip(x), at(doc)) == at(doc)]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def run(spark, rows, partitions=3, batch=4, **more):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
        done = lines.kept_text(lines.dedup_lines(docs, **more))
        assert done.columns == ["doc_id", "text", "a.b", "key", "_lines", "_kept"]
        return [(r.doc_id, r._lines.n_lines, r._lines.n_dropped, r._kept) for r in done.collect()], done
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def order(rows):
    return sorted(rows, key=repr)


def test_edge_cases(spark):
    rows = [
        (1, f"{LONG}\nown line of one\n {LONG.upper()} "), (2, f"\t{LONG}\r\nshort\n\n{OTHER}"), (3, LONG), (4, None), (5, ""), (6, "\n\n"), (7, f"{OTHER}\nshort"),
        (7, f"{OTHER}\nshort"), (7, f"another text of seven\n{OTHER}"), (None, LONG), (None, OTHER), (8, OTHER.replace("Ü", "ü")), (9, OTHER), (10, "short"), (11, "short"),
    ]
    found, done = run(spark, rows)
    assert order(found) == order(plain(rows))
    bits = {r.doc_id: r._lines.keep for r in done.collect()}
    assert bits[4] is None and np.unpackbits(np.frombuffer(zlib.decompress(bits[1]), np.uint8), count=3).tolist() == [0, 1, 0]


def test_code_points_not_bytes(spark):
    rows = [(i, "ж" * 19 + f"\n{'ж' * 20}") for i in range(4)]
    found, _ = run(spark, rows)
    assert order(found) == order(plain(rows)) and sum(f[2] for f in found) == 3


def test_empty_table_and_clashing_names(spark):
    assert run(spark, [])[0] == []


@pytest.mark.parametrize("partitions,batch", [(1, 3), (7, 1), (7, 10_000), (13, 2)])
def test_hot_keys_spread_over_tasks(spark, partitions, batch):
    """One key holds a third of the lines; it fills whole tasks and batches, others are cut by them."""
    rng = np.random.default_rng(partitions * batch)
    pool = [f"passage number {i} that documents share" for i in range(12)]
    rows = []
    for i in range(150):
        some = rng.choice(pool, rng.integers(0, 4)).tolist()
        rows.append((int(rng.integers(0, 90)), "\n".join([LONG] * int(rng.integers(0, 3)) + some + [f"own line of document {i}, long enough"])))
    rows += [(200, LONG), (200, LONG), (200, LONG + "\nmore")]  # repeated and different rows of the largest
    assert order(run(spark, rows, partitions, batch)[0]) == order(plain(rows))


def test_two_documents_stay_and_parameters_hold(spark):
    rows = [(1, LONG), (2, LONG), (3, "abc\nabc"), (4, "abc"), (5, "x")]
    assert sum(f[2] for f in run(spark, rows)[0]) == 0
    found, _ = run(spark, rows, min_chars=3, min_docs=2)
    assert order(found) == order(plain(rows, 3, 2)) and sum(f[2] for f in found) == 3


def test_very_long_text(spark):
    big = "\n".join(f"line {i % 5000} of the long text, repeated" for i in range(60_000))
    rows = [(1, big), (2, big), (3, big + "\n" + "w" * 300_000)]
    assert order(run(spark, rows, batch=1000)[0]) == order(plain(rows))
