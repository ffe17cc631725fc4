"""Alignment of two tokenizers: a byte-level BPE (A) and a SentencePiece model (B) over the same bytes.

Every A id is mapped once to the B id of the same bytes. Groups of one A and one B token, which then are each other's
images, are counted in vectors as long as A's vocabulary; only the links of other groups are shuffled as pairs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import append_from_text, fresh, materialize, numbered
from tickloom.llm.spm import BYTE, MARK, MODEL_PATH, Spec

BYTE_LEVEL_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Stands between the segments of a text; a text that holds it is one segment.
GAP = "\x1c"
#: White space in the widest sense: no text is cut after it.
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != GAP]
ASCII_WHITE = [c for c in WHITE if c.isascii()]
#: Segments that a task remembers, by number and by characters of their groups.
REMEMBERED, REMEMBERED_CHARS = 150_000, 20_000_000
#: Irregular pairs, the most frequent first, whose counts are sent to all tasks; all others are joined.
FREQUENT = 100_000
KIND = "struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, same: array<int>, same_n: array<int>, pairs: array<long>, pairs_n: array<int>{}>"


def byte_level_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for. Printable characters of Latin-1 are their own bytes; the
    characters from 256 on stand for the other bytes in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(map(table.__getitem__, piece)) if all(c in table for c in piece) else piece.encode()
    return out


def piece_bytes(spec: Spec) -> list[bytes]:
    """What each id of a SentencePiece model stands for; the marker is a blank."""
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in spec.pieces]


def identity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id of the same bytes, -1 where there is none; of several the last (pieces come after bytes)."""
    place = {x: i for i, x in enumerate(b) if x}
    return np.array([place.get(x, -1) for x in a], np.int64)


def segments(text: str) -> list[str]:
    """A blank and the text, cut before each blank that follows anything but white space.

    Neither tokenizer has a token across such a place, and what is before it doesn't bear on what is after it."""
    whole = " " + text
    if GAP in text:
        return [whole]
    cut = whole.replace(" ", GAP + " ")[1:]
    for c in ASCII_WHITE if text.isascii() else WHITE:
        if c in cut:
            cut = cut.replace(c + GAP, c)
    out = cut.split(GAP)
    if out[-1] == " " and len(out) > 1:  # B has no text for a last blank alone
        out[-2:] = [out[-2] + " "]
    return out


class Aligner:
    """Both tokenizers, and what it remembers of segments: counts, groups as text, links as codes.

    A link's code is -1 - a where b is a's image, else a * (B ids) + b."""

    def __init__(self, a_json: str, b_model: bytes, threads: int = 1) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ |= {"TOKENIZERS_PARALLELISM": "true" if threads > 1 else "false", "RAYON_NUM_THREADS": str(threads)}
        self.a, self.b, self.threads = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model), threads
        self.a.encode_special_tokens = True
        spec = Spec.parse(b_model)
        self.bytes_a, self.bytes_b = byte_level_bytes(self.a.get_vocab()), piece_bytes(spec)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.image = identity(self.bytes_a, self.bytes_b)
        self.by_segment = spec.dummy_prefix and not spec.remove_extra_whitespaces and not any(MARK in p.lstrip(MARK) for p, _, _ in spec.pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.spelled: list[str] = []
        self.chars = 0
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups; 1 where the bytes differ
        self.codes, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a blank."""
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=self.threads)

    def learn(self, texts: list[str]) -> None:
        """Encode, align and remember texts that aren't known yet."""
        all_a, all_b = self.encode(texts)
        raw = [t.encode() for t in texts]
        join = lambda table, ids: b"".join(map(table.__getitem__, ids))
        right = np.array([join(self.bytes_a, a) == r == join(self.bytes_b, b) for a, b, r in zip(all_a, all_b, raw, strict=True)], bool)
        good = np.flatnonzero(right)
        flat_a = np.fromiter(itertools.chain.from_iterable(all_a[i] for i in good), np.int64)
        flat_b = np.fromiter(itertools.chain.from_iterable(all_b[i] for i in good), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        many_a, many_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        a, b = flat_a[last_a], flat_b[last_b]
        code = np.where((many_a == 1) & (many_b == 1) & (self.image[a] == b), -1 - a, a * len(self.bytes_b) + b)

        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append(f"{','.join(text_a[i:x])}|{','.join(text_b[j:y])}")
            i, j = x, y
        n_groups = np.zeros(len(texts), np.int64)
        n_groups[good] = np.diff(np.searchsorted(shared, np.cumsum([len(raw[g]) for g in good]), "right"), prepend=0) if len(good) else 0
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        spelled = [";".join(groups[x:y]) for x, y in itertools.pairwise(at)]
        self.known |= {t: len(self.spelled) + k for k, t in enumerate(texts)}
        self.spelled += spelled
        self.chars += sum(map(len, spelled)) + sum(map(len, texts))
        per_text = lambda ids: np.array([len(x) for x in ids], np.int64)
        self.counts = np.concatenate([self.counts, np.stack([per_text(all_a), per_text(all_b), n_groups, ~right], axis=1)])
        self.codes = np.concatenate([self.codes, code])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_groups)])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(A tokens, B tokens, groups) and groups as text of each text; then all links' codes, and where each text's end.

        Empty texts, and texts whose tokens don't spell them, have none."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        parts = [([] if not t else segments(t) if self.by_segment else [" " + t]) for t in texts]
        new = {s for p in parts for s in p if s not in self.known}
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[flat], axis=0)])[edges], axis=0)
        wrong = sums[:, 3] > 0
        if wrong.any():
            flat, sums = flat[~np.repeat(wrong, sizes)], np.where(wrong[:, None], 0, sums)
            edges = np.concatenate([[0], np.cumsum(np.where(wrong, 0, sizes))])
        own = flat.tolist()
        spelled = [";".join([self.spelled[s] for s in own[x:y]]) for x, y in itertools.pairwise(edges.tolist())]
        n = self.counts[flat, 2]
        last = np.cumsum(n)
        codes = self.codes[np.repeat(self.ends[flat] - (last - n), n) + np.arange(last[-1] if len(last) else 0)]
        return sums[:, :3], spelled, codes, np.cumsum(sums[:, 2])


@functools.lru_cache(maxsize=2)
def worker_aligner(a_json: str, b_model: bytes, threads: int) -> Aligner:
    return Aligner(a_json, b_model, threads)


def per_text_counts(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of each text, texts in order and codes rising: number of the text, code, how often."""
    shift = np.int64(1 << 40)  # above any code's size, as vocabularies have less than a million ids
    text = np.repeat(np.arange(len(ends), dtype=np.int64), np.diff(ends, prepend=0))
    both, n = np.unique(text * 2 * shift + codes + shift, return_counts=True)
    return both // (2 * shift), both % (2 * shift) - shift, n


def linked(docs: DataFrame, a_json, b_model, threads: int = 1, spell: bool = False) -> DataFrame:
    """The columns of docs and _align: counts and links of each whole text; with spell also its groups as text."""

    def start():
        import pyarrow as pa

        aligner = worker_aligner(a_json.value, b_model.value, threads)

        def lists(text: np.ndarray, values: np.ndarray, counts: np.ndarray, n: int, kind) -> list:
            offsets = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))]

        def make(texts: list[str | None]) -> pa.Array:
            sums, spelled, codes, ends = aligner.align([t or "" for t in texts])
            text, code, n = per_text_counts(codes, ends)
            same = code < 0
            digests = pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled], pa.string())
            columns = [*map(pa.array, (sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 2])), digests]
            columns += lists(text[same], -1 - code[same], n[same], len(texts), np.int32) + lists(text[~same], code[~same], n[~same], len(texts), np.int64)
            names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pairs", "pairs_n"]
            return pa.StructArray.from_arrays(columns + ([pa.array(spelled, pa.string())] if spell else []), names + (["groups"] if spell else []))

        return make

    return append_from_text(docs, "_align", KIND.format(", groups: string" if spell else ""), start)


def pair_counts(links: DataFrame, image: np.ndarray, n_b: int) -> DataFrame:
    """links (_align) -> pair (a * n_b + b), n, best and image of every linked id pair: how many links have it, whether no
    other pair of its B id has more, and whether b is a's image (`image` is the identity map).

    Pairs of images are summed in vectors within tasks; no more rows than A has ids leave a task for them."""
    size = len(image)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.zeros(size, np.int64)
        for batch in batches:
            a, n = (batch.column(k).flatten().to_numpy() for k in (0, 1))
            held += np.bincount(a, n, size).astype(np.int64)
        a = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(a * n_b + image[a]), pa.array(held[a])], ["pair", "n"])

    same = links.select("_align.same", "_align.same_n").mapInArrow(count, "pair long, n long").withColumn("image", F.lit(True))
    other = links.select(F.explode(F.arrays_zip("_align.pairs", "_align.pairs_n")).alias("x"))
    other = other.select(F.col("x.pairs").alias("pair"), F.col("x.pairs_n").cast("long").alias("n"), F.lit(False).alias("image"))
    counts = materialize(same.unionByName(other).groupBy("pair").agg(F.sum("n").alias("n"), F.max("image").alias("image")), "align-pairs")
    b = F.pmod(F.col("pair"), F.lit(n_b))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each B id at most
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "image")


def scored(links: DataFrame, known) -> DataFrame:
    """links and _best, _sum over the links that known has counts of, and _rest, _rest_n: the pairs that it lacks.

    known: the counts and whether they are best by A id for images, then pairs in order, their counts and whether best."""
    place = links.columns.index("_align")
    held, restored = numbered(links)
    fields = T.StructType.fromDDL("_best long, _sum long, _rest array<long>, _rest_n array<int>").fields

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        same_n, same_best, pair, pair_n, pair_best = known.value

        def by_row(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])

        for batch in batches:
            links = batch.column(place)
            get = lambda name: links.field(name).flatten().to_numpy()
            edges = lambda name: np.concatenate([[0], np.cumsum(pc.list_value_length(links.field(name)).to_numpy())])
            a, m, at = get("same"), get("same_n").astype(np.int64), edges("same")
            best, total = by_row(at, m * same_best[a]), by_row(at, m * same_n[a])
            code, m, at = get("pairs"), get("pairs_n").astype(np.int64), edges("pairs")
            found = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
            hit = pair[found] == code if len(pair) else np.zeros(len(code), bool)
            best += by_row(at, np.where(hit, m * pair_best[found], 0) if len(pair) else 0 * m)
            total += by_row(at, np.where(hit, m * pair_n[found], 0) if len(pair) else 0 * m)
            offsets = pa.array(np.concatenate([[0], np.cumsum(~hit)])[at].astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (code[~hit], m[~hit].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(total), *rest], [*batch.schema.names, *[f.name for f in fields]])

    return restored(held.mapInArrow(run, T.StructType([*held.schema.fields, *fields])))


def align_documents(
    docs: DataFrame, a_path: str = BYTE_LEVEL_PATH, b_path: str = MODEL_PATH, threads: int = 1, frequent: int = FREQUENT, spell: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the columns of docs without text and _align of every row; and the corpus-wide pairs (a, b, n, best).

    _align: n_a, n_b tokens of either tokenizer for a blank and the whole text, without special tokens; n_groups between
    places where tokens of both end; n_links, one at each such place; groups_sha256 of the groups (`a1,a2|b1;a3|b2,b3`,
    with spell also as text in groups); n_best and count_sum over its links: how many have the highest count of their B
    id, ties included, and the sum of the counts. A null or empty text, or one whose tokens spell anything else (a
    marker of its own, say), has zeros and an empty digest, and links nothing. Repeated rows count and stay; an empty
    table gives empty tables; long texts are encoded whole; other columns, whatever their names, pass through (only
    _align is replaced). Both files' sizes don't grow with the data; they are read on the driver and sent to all tasks.

    What is linked is written once, as distinct links of each row with their numbers. The counts of images (as many as A
    has ids) and of the `frequent` most frequent other pairs are sent to all tasks; a pair beyond them, which no large
    share of the rows can have, meets its count in a join."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        a_json, b_model = f.read(), g.read()
    pieces = piece_bytes(Spec.parse(b_model))
    image, n_b, row = identity(byte_level_bytes(json.loads(a_json)["model"]["vocab"]), pieces), len(pieces), fresh(docs, "_row")
    done = linked(docs, spark.sparkContext.broadcast(a_json), spark.sparkContext.broadcast(b_model), threads, spell)
    links = materialize(done.drop("text").withColumn(row, F.monotonically_increasing_id()), "align-links")
    pairs = materialize(pair_counts(links, image, n_b), "align-counts")

    columns = ("pair", "n", F.col("best").cast("int").alias("best"))
    images = pairs.filter("image").select(*columns).toArrow()  # as many rows as A has ids at most
    others = pairs.filter("not image").orderBy(F.desc("n"), "pair").limit(frequent).select(*columns).toArrow()
    vectors = np.zeros((2, len(image)), np.int64)
    vectors[:, images["pair"].to_numpy() // n_b] = images["n"].to_numpy(), images["best"].to_numpy()
    others = others.sort_by("pair")
    known = spark.sparkContext.broadcast((*vectors, *[others[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best")]))
    told = scored(links, known)
    best, total = F.col("_best"), F.col("_sum")
    if others.num_rows == frequent:
        rest = told.select(row, F.explode(F.arrays_zip("_rest", "_rest_n")).alias("x")).select(row, F.col("x._rest").alias("pair"), F.col("x._rest_n").alias("_m"))
        more = rest.join(pairs, "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("_m")).otherwise(0)).alias("_b"), F.sum(F.col("_m") * F.col("n")).alias("_s"))
        told = told.join(more, row, "left")
        best, total = best + F.coalesce("_b", F.lit(0)), total + F.coalesce("_s", F.lit(0))
    shown = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if spell else [])]
    align = F.struct(*[F.col(f"_align.{c}").alias(c) for c in shown], best.alias("n_best"), total.alias("count_sum"))
    kept = [F.col(f"`{c}`") for c in links.columns if c not in ("_align", row)]
    return told.select(*kept, align.alias("_align")), pairs.select(F.floor(F.col("pair") / n_b).alias("a"), F.pmod(F.col("pair"), F.lit(n_b)).alias("b"), "n", "best")
