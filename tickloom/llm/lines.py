"""Line deduplication: hashes of lines are range-partitioned and sorted by document, first occurrences are streamed, and
what comes back are bitmaps of the lines that each document keeps, not texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bounded_batches, materialize, numbered, pieces, tidy_worker

BLANKS = b" \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Stands for a null doc_id, which so is one document and the smallest.
NO_ID = -(1 << 63)
#: Verdicts of the stream: the lines go; they wait for what other tasks hold of their key; documents of such a key.
DROP, WAIT, DOCUMENTS = 1, 2, 3
#: A document's lines of one key.
ROW = "key binary, doc long, text_key binary, n_lines int, lines array<int>"


def line_keys(raw: bytes, min_chars: int = MIN_CHARS) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the places of each key of min_chars code points or more."""
    lines = raw.split(b"\n")
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        key = line.strip(BLANKS)
        if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode(errors="replace")) < min_chars):
            continue
        found.setdefault(key.lower(), []).append(i)  # of bytes, lower() changes A-Z alone
    return len(lines), found


def keyed_lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """texts (doc, text_key, text as binary) -> ROW: one row for each document and key, with the digest of the key."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in pieces(batches, 2):
            keys, rows, n_lines, counts, places = [], [], [], [], []
            for row, raw in enumerate(part.column(2).to_pylist()):
                if raw is None or len(raw) < min_chars:
                    continue
                n, found = line_keys(raw, min_chars)
                for key, at in found.items():
                    keys.append(hashlib.md5(key, usedforsecurity=False).digest())
                    rows.append(row)
                    n_lines.append(n)
                    counts.append(len(at))
                    places += at
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lines = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places, pa.int32()))
            owner = part.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), owner.column(0), owner.column(1), pa.array(n_lines, pa.int32()), lines],
                ["key", "doc", "text_key", "n_lines", "lines"],
            )
        tidy_worker()

    return bounded_batches(texts).mapInArrow(run, ROW)


class Stream:
    """Walks rows sorted by key and falling document; says which lines go.

    A key's first document is its largest and keeps its lines; with min_docs documents or more, those of all others go.
    A task sees its first and last key in part, as other tasks may hold more of them. There only what is certain is
    said: a document after a portion's first can't be the key's largest. The rest waits, and so do rows at the end of a
    batch whose key has too few documents so far. Of every key with waiting rows the portion's first min_docs documents
    are told, which is enough to know the largest and whether there are min_docs."""

    def __init__(self, min_docs: int) -> None:
        self.min_docs = min_docs
        self.key: bytes | None = None
        self.doc = self.nth = 0
        self.partial = True  # the open key is the task's first
        self.tell = True  # the open key's documents are to be told
        self.docs: list[int] = []

    def step(self, keys: np.ndarray, docs: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, list[tuple[bytes, list[int]]]]:
        """keys: two unsigned words a row; raw: the keys themselves. The verdict of every row (0: stays), and documents
        of keys that end here."""
        n = len(docs)
        new_key = np.ones(n, bool)
        new_key[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        goes_on = raw[0] == self.key
        new_key[0] = not goes_on
        new_doc = new_key.copy()
        new_doc[1:] |= docs[1:] != docs[:-1]
        new_doc[0] |= docs[0] != self.doc
        starts = np.flatnonzero(new_key)
        if goes_on:
            starts = np.concatenate([[0], starts])
        group = np.cumsum(new_key) - (0 if goes_on else 1)
        ordinal = np.cumsum(new_doc)
        before = ordinal[starts] - new_doc[starts]
        if goes_on:
            before[0] -= self.nth
        ordinal = ordinal - before[group]
        total = ordinal[np.concatenate([starts[1:], [n]]) - 1]
        first_partial = self.key is None or (goes_on and self.partial)

        verdict = np.where((ordinal > 1) & (total[group] >= self.min_docs), DROP, 0)
        last = len(starts) - 1
        if first_partial:
            verdict[(group == 0) & (verdict == 0)] = WAIT
        open_rows = (group == last) & (ordinal > 1) & (verdict == 0)
        verdict[open_rows] = WAIT

        told = []
        if self.key is not None and not goes_on:
            told += self.end()
        for g in sorted({0, last}):
            if g > 0 or not goes_on:
                self.docs, self.tell = [], False
            self.partial = first_partial and g == 0
            stop = starts[g + 1] if g < last else n
            rows = np.arange(starts[g], stop)
            rows = rows[new_doc[rows] & (ordinal[rows] <= self.min_docs)]
            self.docs += docs[rows].tolist()
            self.key = raw[starts[g]]
            self.tell |= self.partial or bool((g == last) and open_rows.any())
            if g < last:
                told += self.end()
        self.doc, self.nth = int(docs[-1]), int(ordinal[-1])
        return verdict, told

    def end(self, of_task: bool = False) -> list[tuple[bytes, list[int]]]:
        return [(self.key, self.docs)] if self.key is not None and (self.tell or of_task) else []


def verdicts(sorted_lines: DataFrame, min_docs: int) -> DataFrame:
    """ROW sorted by key, falling doc and text_key in each task -> the rows that go or wait, with verdict, and rows of
    DOCUMENTS with the documents of keys that have waiting rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["key", "doc", "text_key", "n_lines", "lines", "verdict", "docs"]
        stream = Stream(min_docs)

        def documents(told: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
            n, docs = len(told), pa.list_(pa.int64())
            empty = [pa.nulls(n, k) for k in (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in told], pa.binary()), *empty, pa.array([DOCUMENTS] * n, pa.int32()), pa.array([d for _, d in told], docs)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(0).to_pylist()
            words = np.frombuffer(b"".join(raw), ">u8").reshape(-1, 2)
            verdict, told = stream.step(words, batch.column(1).to_numpy(), raw)
            keep = pa.array(np.flatnonzero(verdict))
            rows = batch.take(keep)
            yield pa.RecordBatch.from_arrays([*rows.columns, pc.take(pa.array(verdict.astype(np.int32)), keep), pa.nulls(len(keep), pa.list_(pa.int64()))], names)
            if told:
                yield documents(told)
        if told := stream.end(of_task=True):
            yield documents(told)

    return sorted_lines.mapInArrow(run, f"{ROW}, verdict int, docs array<long>")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, text_key, n_lines, lines: the places of the lines that go, one row for each document that loses any."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.unhex(F.md5("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    keyed = materialize(keyed_lines(texts, min_chars), "line-keys")
    # Ranges of (key, doc, text): a key that a third of all lines have is spread over many tasks.
    order = [F.asc("key"), F.desc("doc"), F.asc("text_key")]
    walked = materialize(verdicts(keyed.repartitionByRange(*order).sortWithinPartitions(*order), min_docs), "line-verdicts")
    told = walked.filter(F.col("verdict") == DOCUMENTS).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))  # some ids a task
    told = told.filter(F.size("docs") >= min_docs).select("key", F.array_max("docs").alias("_first"))
    settled = walked.filter(F.col("verdict") == WAIT).join(told, "key").filter(F.col("doc") != F.col("_first"))
    gone = walked.filter(F.col("verdict") == DROP).select("key", "doc", "text_key", "n_lines", "lines").unionByName(settled.select("key", "doc", "text_key", "n_lines", "lines"))
    once = gone.dropDuplicates(["doc", "text_key", "key"])  # repeated rows say the same
    return once.groupBy("doc", "text_key").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("lines")).alias("lines"))


@F.arrow_udf(T.BinaryType())
def _packed(n_lines, lines):
    """A bit for each line, 1 where it stays, first line in the highest bit, zlib over it."""
    import pyarrow as pa

    out = []
    for n, at in zip(n_lines.to_pylist(), lines.to_pylist(), strict=True):
        bits = np.ones(n, np.uint8)
        bits[at] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes()))
    return pa.array(out, pa.binary())


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of docs and _lines struct<n_lines: long, n_dropped: long, keep: binary> of every row.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of min_chars code points or more that
    min_docs documents or more have lose all their lines but those of the largest doc_id; keep is the bitmap of the lines
    that stay (zlib, a bit for each line from the highest on), null where all stay. Keys meet by 128 bits of their MD5.
    A null or empty text is one empty line. Rows with one doc_id are one document, also with different texts; null ids
    are one document, the smallest (with the smallest long, which stands for it). Repeated rows stay and lose the same
    lines; an empty table gives no rows; long texts are cut whole; other columns, whatever their names, pass through
    (only _lines is replaced)."""
    docs = docs.drop("_lines")
    found = dropped_lines(docs, min_chars, min_docs)
    found = found.select("doc", "text_key", F.size("lines").cast("long").alias("_n"), _packed("n_lines", "lines").alias("_keep"))
    found = materialize(found, "line-bitmaps")
    held, restored = numbered(docs)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    same = (F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(NO_ID)) == F.col("doc")) & (F.unhex(F.md5(at["text"])) == F.col("text_key"))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    out = held.join(found, same, "left").withColumn("_lines", F.struct(n_lines.cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"), F.col("_keep").alias("keep")))
    return restored(out.drop(*found.columns))


@F.arrow_udf(T.StringType())
def _kept(texts, keeps):
    import pyarrow as pa

    def cut(text: str, keep: bytes) -> str:
        lines = text.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
        return "\n".join([lines[i] for i in np.flatnonzero(bits)])

    made = [cut(t.as_py(), k.as_py()) if k.is_valid else None for t, k in zip(texts, keeps, strict=True)]
    return pa.array(made, pa.string())


def kept_text(deduped: DataFrame, name: str = "_kept") -> DataFrame:
    """deduped (text, _lines) and `name`: the lines that stay, joined by line feeds; a null text is empty. Only texts that
    lose lines go through Python workers."""
    bits = F.col("_lines.keep")
    cut = _kept(F.when(bits.isNotNull(), F.col("text")), bits)
    return bounded_batches(deduped).withColumn(name, F.when(bits.isNull(), F.coalesce("text", F.lit(""))).otherwise(cut))
