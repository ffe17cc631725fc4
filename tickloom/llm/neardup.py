"""Near-duplicates by MinHash with odd sketches.

Each text becomes its set of five-word shingles; the set becomes MinHash samples, bands of them (candidate buckets) and
an odd sketch: the samples folded into a parity bitmap. The XOR population count of two bitmaps estimates the
similarity of two sets; it rejects most candidates, and what it lets through is confirmed on the full sets.

Equal sets are one class from the start. In a bucket every member is first held against one centre only; a second pass
takes the pairs of members that are still in different components. So no group of copies is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import append_from_text, bounded_batches, broadcast_if_small, materialize

SHINGLE = 5
#: A pair of similarity 0.8 escapes all bands with probability (1 - 0.8 ** 6) ** 40 = 5e-6, one of 0.85 with 6e-9.
BANDS, ROWS = 40, 6
#: Samples, bits of the parity bitmap, and how far below the wanted similarity an estimate may lie before the pair is
#: rejected (about five standard errors): for every set, and for the sets that a second pass looks at.
COARSE, FINE = (BANDS * ROWS, 1024, 0.15), (1024, 4096, 0.07)

#: Members of a bucket that meet at once in the second pass.
BLOCK = 512

_rng = np.random.default_rng(20240601)
_A = (_rng.integers(0, 1 << 32, FINE[0], dtype=np.uint32) | np.uint32(1))[None, :]
_B = _rng.integers(0, 1 << 32, FINE[0], dtype=np.uint32)[None, :]
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.arange(FINE[0], dtype=np.uint64) << np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: words are split at the blank and TAB to CR, A-Z made small.

    Fewer words than a shingle has make one shingle of all; no word makes none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _MUL + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(found: np.ndarray, samples: int) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(samples, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        permuted = x[k : k + 512, None] * _A[:, :samples]
        permuted ^= _B[:, :samples]
        np.minimum(low, permuted.min(axis=0), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        key = mix(key * _MUL + column)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """bits / 64 words: bit i is the parity of the number of samples that fall on it."""
    at = mix(_PLACES[: len(samples)] | samples) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def differing_bits(similarity: float, samples: int, bits: int) -> float:
    """The XOR population count to expect from two sketches at this similarity."""
    return bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))


FEATURES = "struct<n_shingles: long, print: binary, bands: array<long>, sketch: array<long>>"


def _features():
    import pyarrow as pa

    known = WordHashes()
    longs = pa.list_(pa.int64())
    kind = pa.struct([("n_shingles", pa.int64()), ("print", pa.binary()), ("bands", longs), ("sketch", longs)])

    def make(texts: list[str | None]) -> pa.Array:
        rows = []
        for text in texts:
            if len(found := shingles(text, known)):
                samples = signature(found, COARSE[0])
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(samples), odd_sketch(samples, COARSE[1])))
            else:
                rows.append((0, None, None, None))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    return make


def _confirm(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        last, kept = None, np.zeros(0, np.uint64)
        for frame in frames:
            linked = np.zeros(len(frame), bool)
            for i, (a, text_a, text_b) in enumerate(zip(frame["a"], frame["text_a"], frame["text_b"], strict=True)):
                if a != last:
                    last, kept = a, shingles(text_a, known)
                other = shingles(text_b, known)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                linked[i] = 100 * both >= percent * (len(kept) + len(other) - both)
            yield frame.loc[linked, ["a", "b"]]

    return run


def _fine_sketches():
    import pyarrow as pa

    known = WordHashes()

    def make(texts: list[str | None]) -> pa.Array:
        return pa.array([odd_sketch(signature(shingles(t, known), FINE[0]), FINE[1]) for t in texts], pa.list_(pa.int64()))

    return make


def similar_sketches(x: Column, y: Column, percent: int, kind: tuple[int, int, float]) -> Column:
    samples, bits, margin = kind
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda s, v: s + v)
    return differing <= differing_bits(percent / 100 - margin, samples, bits)


def blocks_of(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def texts_of(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """reps (doc_id, distinct) -> their texts, one row each."""
    needed = broadcast_if_small(materialize(reps, "dup-needed"))
    return materialize(docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "dup-texts")


def confirmed(near: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs near (a < b, representatives) whose full sets have the similarity."""
    text = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"text_{n}"))
    both = near.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    return materialize(bounded_batches(both).mapInPandas(_confirm(percent), "a long, b long"), "dup-links")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that can be reached, for every node with a link.

    Alternating large and small stars: each round points nodes to smaller neighbours until nothing changes, in a number
    of rounds that grows with the logarithm of the longest path. Every round is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        edges = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = materialize(edges, "dup-components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of percent / 100 or more), kept.

    Reads doc_id and text. A null or wordless text has no shingle and is linked with nothing; so is a row without
    doc_id (its component is null and it is kept). Rows that share a doc_id are one document: each gets the row of that
    document, and the text of any one of them confirms its links. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    features = materialize(append_from_text(docs, "_f", FEATURES, _features).select("doc_id", "_f.*"), "dup-features")
    usable = features.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "dup-classes")
    reps = materialize(usable.join(classes.select("print", F.col("rep").alias("doc_id")), ["print", "doc_id"]).select(F.col("doc_id").alias("rep"), "bands", "sketch").dropDuplicates(["rep"]), "dup-reps")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(buckets, "dup-buckets")
    grouped = materialize(members.join(buckets, "bucket").filter("rep <> centre"), "dup-members")
    star = grouped.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda n: reps.select(F.col("rep").alias(n), F.col("sketch").alias(f"sketch_{n}"))
    near = star.join(side("a"), "a").join(side("b"), "b").filter(similar_sketches(F.col("sketch_a"), F.col("sketch_b"), percent, COARSE))
    near = materialize(near.select("a", "b"), "dup-near")
    links = confirmed(near, texts_of(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs), percent)
    found = components(links)

    # Members other than the centre that are still apart; the centre has met all of them. Their sketches are made anew,
    # finer, and compared within the join, which lets only close pairs out, each from the first bucket that both are in.
    # A bucket's largest component is apart from the others only; those and the others are dealt into blocks, and every
    # two blocks meet by themselves, so no bucket is one task's and one large component stays in proportion.
    placed = grouped.filter("n > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("bucket", "component").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("main"))
    apart = sizes.filter(F.col("n") > F.col("main.count")).select("bucket", F.col("main.component").alias("main"), blocks_of(F.col("main.count")).alias("mains"), blocks_of(F.col("n") - F.col("main.count")).alias("others"))
    still = materialize(placed.join(broadcast_if_small(materialize(apart, "dup-mixed")), "bucket"), "dup-apart")
    texts = texts_of(still.select(F.col("rep").alias("doc_id")).distinct(), docs)
    fine = append_from_text(texts, "sketch", "array<long>", _fine_sketches).select(F.col("doc_id").alias("rep"), "sketch")
    still = still.join(materialize(fine, "dup-fine"), "rep").join(reps.select("rep", "bands"), "rep")
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("rep"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    key = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    up_to = lambda n: F.sequence(F.lit(0), n)
    with_others = F.transform(up_to(F.col("others") - 1), lambda h: key(1, own, h))
    one = F.when(is_main, with_others).otherwise(F.transform(F.sequence(own, F.col("others") - 1), lambda h: key(0, own, h)))
    two = F.concat(F.transform(up_to(own), lambda x: key(0, x, own)), F.transform(up_to(F.col("mains") - 1), lambda x: key(1, x, own)))
    a = still.select("bucket", F.explode(one).alias("key"), F.col("rep").alias("a"), "component", "sketch", "bands")
    b = still.filter(~is_main).select(F.col("bucket").alias("bucket_b"), F.explode(two).alias("key_b"), F.col("rep").alias("b"), F.col("component").alias("component_b"), F.col("sketch").alias("sketch_b"), F.col("bands").alias("bands_b"))
    same = (F.col("bucket") == F.col("bucket_b")) & (F.col("key") == F.col("key_b"))
    close = (F.col("component") != F.col("component_b")) & similar_sketches(F.col("sketch"), F.col("sketch_b"), percent, FINE)
    first = F.col("bucket") == F.array_min(F.array_intersect("bands", "bands_b"))
    near = a.join(b, same & close & first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = confirmed(materialize(near, "dup-near"), texts, percent)
    if not more.isEmpty():
        found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    joined = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").filter("copies > 1 or component is not null").select("print", F.coalesce("component", "rep").alias("_component"))
    out = features.select("doc_id", "n_shingles", "print").join(joined, "print", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
