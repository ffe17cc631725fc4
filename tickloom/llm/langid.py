"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built: its paths from the root spell exactly the substrings of
that text. A document is parsed greedily into longest matches (phrases); the language that needs the fewest phrases,
normalised as bits per character (phrases x log2 of the sample's length / characters), wins.

Spark samples whole labelled texts and builds one automaton in each language's group. The walk needs the transitions
only. It runs over many segments of many documents at once: one NumPy step moves every segment by one character. The
parse of a long document is then joined from its segments': a walk goes on over a segment's end until it begins a phrase
where the next segment's walk began one too; from there both are the same.
"""

from __future__ import annotations

import functools
import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import append_from_text, broadcast_if_small, chunks, materialize, tidy_worker

#: Bounds of the labelled sample of each language: whole texts, and their characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 32, 300_000
#: Characters of a segment, and characters in hand at once in a task.
SEGMENT, CHUNK = 1024, 500_000
#: Bytes of automata that workers hold at once; more languages than fit are tried in groups.
MODEL_BYTES = 64_000_000
#: Automata of at most this many codes hold a state's transitions as the bits of one word; larger ones look them up.
BITS_WIDTH = 64
UNKNOWN = "und"
BLANK, OTHER = 0, 1


@functools.cache
def small_letters() -> np.ndarray:
    """The lower-case letter of every code point that is a letter, else 0."""
    out = np.zeros(0x110000, np.int32)
    for x in range(0x110000):
        if (c := chr(x)).isalpha():
            out[x] = ord(c.lower()[0])
    return out


def letters_lut(alphabet: str) -> np.ndarray:
    """Code of every code point: 2 + its lower-case letter's place in alphabet, OTHER for further letters, else BLANK."""
    codes = np.full(0x110000, OTHER, np.uint16 if len(alphabet) < 65_000 else np.uint32)
    codes[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
    codes[0] = BLANK
    return codes.take(small_letters())


def encode(text: str, lut: np.ndarray) -> np.ndarray:
    """Codes of a text: lower-case letters, and one BLANK for each run of anything else; none at the ends."""
    codes = lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != BLANK
    keep[1:] |= codes[:-1] != BLANK
    codes = codes[keep]
    return codes[:-1] if len(codes) and codes[-1] == BLANK else codes


ARRAYS = {"root": np.int32, "target": np.int32, "present": np.uint64, "first": np.int32, "keys": np.int64}


@dataclass
class Automaton:
    """The transitions of a suffix automaton. Its codes: BLANK, OTHER (no state has it), then the letters.

    Up to BITS_WIDTH codes, `present` has a bit for each code that a state can be left with and target[first[state]],
    target[first[state] + 1], .. are where its codes, in order, lead. Else `keys` has state * width + code, sorted, of
    every transition and `target` where each leads. root: where each code leads from the root; a code that no text
    starts a substring with leads to a last state, from which nothing leads on."""

    letters: str
    chars: int
    root: np.ndarray
    target: np.ndarray
    present: np.ndarray
    first: np.ndarray
    keys: np.ndarray

    @property
    def width(self) -> int:
        return len(self.letters) + 2

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, k).nbytes for k in ARRAYS)

    def packed(self) -> bytes:
        """All of it, compressed."""
        arrays = [getattr(self, k) for k in ARRAYS]
        head = json.dumps([self.letters, self.chars, [x.nbytes for x in arrays]]).encode()
        return zlib.compress(len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in arrays), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        raw = zlib.decompress(data)
        at = 4 + int.from_bytes(raw[:4], "little")
        letters, chars, sizes = json.loads(raw[4:at])
        parts = {}
        for (name, kind), size in zip(ARRAYS.items(), sizes, strict=True):
            parts[name] = np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at).copy()  # aligned
            at += size
        return cls(letters, chars, **parts)

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a code, and whether a phrase ended before it and the next one began."""
        if len(self.keys):
            at = state * np.int64(self.width) + code
            place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
            ended = self.keys.take(place) != at
        else:
            bits, bit = self.present.take(state), np.uint64(1) << code.astype(np.uint64)
            ended = (bits & bit) == 0
            place = self.first.take(state) + np.bitwise_count(bits & (bit - np.uint64(1)))
        return np.where(ended, self.root.take(code), self.target.take(place, mode="clip")), ended

    def walker(self):
        """The same for one state and code, as plain integers."""
        target, root = memoryview(self.target), memoryview(self.root)
        if len(self.keys):
            known, width = dict(zip(self.keys.tolist(), self.target.tolist(), strict=True)), self.width

            def step(state: int, code: int) -> tuple[int, bool]:
                to = known.get(state * width + code)
                return (root[code], True) if to is None else (to, False)

        else:
            present, first = memoryview(self.present), memoryview(self.first)

            def step(state: int, code: int) -> tuple[int, bool]:
                bits = present[state]
                return (target[first[state] + (bits & ((1 << code) - 1)).bit_count()], False) if bits >> code & 1 else (root[code], True)

        return step

    def codes(self, alphabet: str) -> np.ndarray:
        """Own code of every code of a larger alphabet."""
        own = {c: i + 2 for i, c in enumerate(self.letters)}
        return np.array([BLANK, OTHER, *[own.get(c, OTHER) for c in alphabet]], np.uint8 if self.width <= 256 else np.uint16)


def automaton(texts: list[str]) -> Automaton:
    """The suffix automaton of texts, one after the other with a blank between them."""
    letters = "".join(sorted({c for t in texts for x in t.lower() if (c := x[0]).isalpha()}))
    lut = letters_lut(letters)
    sample = [c for t in texts for c in [*encode(t, lut).tolist(), BLANK]]
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at != -1:
            to = moves[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at != -1 and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    width, none = len(letters) + 2, len(moves)
    moves.append({})
    root = np.array([moves[0].get(c, none) for c in range(width)], np.int32)
    target = np.fromiter((out[c] for out in moves for c in sorted(out)), np.int32)
    empty = np.zeros(0, np.int64)
    if width <= BITS_WIDTH:
        present = np.fromiter((sum(1 << c for c in out) for out in moves), np.uint64, len(moves))
        sizes = np.fromiter(map(len, moves), np.int32, len(moves))
        return Automaton(letters, len(sample), root, target, present, (np.cumsum(sizes) - sizes).astype(np.int32), empty)
    keys = np.fromiter((state * width + c for state, out in enumerate(moves) for c in sorted(out)), np.int64, len(target))
    return Automaton(letters, len(sample), root, target, empty.astype(np.uint64), empty.astype(np.int32), keys)


@dataclass
class Model:
    """tables: language -> automaton, in the order of the languages' names."""

    tables: dict[str, Automaton]

    def __post_init__(self) -> None:
        self.alphabet = "".join(sorted({c for t in self.tables.values() for c in t.letters}))
        self.lut = letters_lut(self.alphabet)
        self.own = {lang: t.codes(self.alphabet) for lang, t in self.tables.items()}


def phrases(encoded: list[np.ndarray], table: Automaton, own: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Number of phrases that each encoded text needs with one automaton, whose codes of the model's are own."""
    lengths = np.array([len(x) for x in encoded], np.int64)
    pieces = -(-lengths // segment)
    if not pieces.sum():
        return np.zeros(len(encoded), np.int64)
    first = np.cumsum(pieces) - pieces  # a text's first lane
    lanes = np.zeros((int(pieces.sum()), segment), own.dtype)
    for i, x in enumerate(encoded):
        lanes.reshape(-1)[first[i] * segment : first[i] * segment + len(x)] = own.take(x)
    used = np.full(len(lanes), segment)
    used[(first + pieces - 1)[pieces > 0]] = (lengths - (pieces - 1) * segment)[pieces > 0]
    order = np.argsort(-used, kind="stable")
    columns, live = np.ascontiguousarray(lanes[order].T), np.searchsorted(-used[order], -np.arange(segment), "left")
    state, starts = np.zeros(len(lanes), np.int32), np.zeros((segment, len(lanes)), bool)
    for k in range(segment):
        if not (n := live[k]):  # segments with more than k characters come first
            break
        state[:n], starts[k, :n] = table.step(state[:n], columns[k, :n])
    starts[0] = True  # a phrase begins with the segment
    place = np.argsort(order)
    count = starts.sum(axis=0)[place]
    out = np.where(pieces > 0, count[np.minimum(first, len(lanes) - 1)], 0)
    if (long := np.flatnonzero(pieces > 1)).size:
        step, begun, ends = table.walker(), np.ascontiguousarray(starts.T), state[place].tolist()
        for i in long:
            codes = memoryview(lanes[first[i] : first[i] + pieces[i]].reshape(-1))
            out[i] += joined(codes, int(lengths[i]), int(first[i]), segment, step, begun, place, count, ends)
    return out


def joined(codes, length: int, first: int, segment: int, step, begun: np.ndarray, place: np.ndarray, count: np.ndarray, ends: list[int]) -> int:
    """Phrases of a text of several segments, without those of its first one."""
    total, at = 0, segment
    state = ends[first]
    while at < length:
        state, ended = step(state, codes[at])
        if ended:
            total += 1
            lane, k = divmod(at, segment)
            row = begun[place[first + lane]]
            if row[k]:  # from here on the lane's own walk
                total += int(count[first + lane] if k == 0 else row[k:].sum()) - 1
                at, state = (lane + 1) * segment, ends[first + lane]
                continue
        at += 1
    return total


def parse_bits(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character of each language (rows) and text (columns), and which texts have no letter."""
    encoded = [encode(t or "", model.lut) for t in texts]
    lengths = np.array([max(1, len(x)) for x in encoded])
    none = np.array([not len(x) for x in encoded], bool)
    bits = [phrases(encoded, t, model.own[lang]) * math.log2(t.chars + 1) / lengths for lang, t in model.tables.items()]
    return np.array(bits).reshape(len(bits), len(texts)), none


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float, float]]:
    """Language, its bits and the best other language's bits of each text; infinite where there is none."""
    bits, none = parse_bits(texts, model)
    langs = [*model.tables, UNKNOWN, UNKNOWN]
    ranked = np.concatenate([bits, np.full((2, len(texts)), np.inf)])
    best, ranked = ranked.argmin(axis=0), np.sort(ranked, axis=0)
    return [(UNKNOWN, math.inf, math.inf) if x else (langs[i], a, b) for x, i, a, b in zip(none, best, ranked[0].tolist(), ranked[1].tolist(), strict=True)]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, draw, text: at most `rows` distinct whole texts for each language, those with the smallest hashes.

    A text that would take a language's characters over `chars` is left out; a language whose texts are all longer has
    its shortest sampled one. Each language's distinct texts are estimated first, by their hashes; then only rows whose
    hash is below the language's share travel, so no group is larger than the bounds, whatever the language's size.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    counts = usable.groupBy("lang").agg(F.approx_count_distinct(draw, 0.03).alias("n"))
    shares = broadcast_if_small(materialize(counts.select("lang", (2.0 * rows / F.col("n")).alias("share")), "lang-shares"))
    found = usable.withColumn("draw", draw).join(shares, "lang").filter("draw < share").select("lang", "draw", "text").distinct()
    by_draw = W.partitionBy("lang").orderBy("draw", "text")
    ranked = found.withColumn("place", F.row_number().over(by_draw)).filter(F.col("place") <= rows)
    size = F.length("text")
    ranked = ranked.withColumn("total", F.sum(F.when(size <= chars, size)).over(by_draw.rowsBetween(W.unboundedPreceding, 0)))
    shortest = F.row_number().over(W.partitionBy("lang").orderBy(size, "place")) == 1
    ranked = ranked.withColumn("taken", (size <= chars) & (F.col("total") <= chars)).withColumn("shortest", shortest)
    ranked = ranked.withColumn("some", F.max("taken").over(W.partitionBy("lang")))
    return ranked.filter("taken or (shortest and not some)").select("lang", "draw", "text")


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, bytes (of the automaton in memory) and packed: each language's automaton, in the shared folder.

    docs (lang, text): rows without a language or a letter are no use; without any the result is empty. Built from a
    bounded sample (see sample), each language in a group of its own."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw", "text"])
        made = automaton(frame["text"].tolist())
        row = {"lang": frame["lang"].iloc[0], "bytes": made.nbytes, "packed": made.packed()}
        tidy_worker()
        return pd.DataFrame([row])

    return materialize(sample(docs, rows, chars).groupBy("lang").applyInPandas(build, "lang string, bytes long, packed binary"), "lang-automata")


def groups(models: DataFrame, most: int) -> list[list[str]]:
    """The languages in order, in groups whose automata have `most` bytes or are one alone."""
    out: list[list[str]] = []
    held = most
    for r in models.select("lang", "bytes").orderBy("lang").collect():
        if held + r["bytes"] > most:
            out.append([])
            held = 0
        out[-1].append(r["lang"])
        held += r["bytes"]
    return out


def loaded(models: DataFrame, langs: list[str]) -> list[tuple[str, bytes]]:
    """The packed automata of some languages, in their order: what a group's pass broadcasts."""
    return [(r["lang"], bytes(r["packed"])) for r in models.filter(F.col("lang").isin(langs)).orderBy("lang").collect()]


def with_predictions(docs: DataFrame, packed: list[tuple[str, bytes]], name: str) -> DataFrame:
    """docs and the struct `name` (pred, best, next) of predict."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def start():
        import pyarrow as pa

        model = Model({lang: Automaton.unpacked(x) for lang, x in shared.value})

        def make(texts: list[str | None]) -> pa.Array:
            found = [x for part in chunks(texts, CHUNK) for x in predict(part, model)]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            return pa.StructArray.from_arrays(columns, ["pred", "best", "next"])

        return make

    return append_from_text(docs, name, "struct<pred: string, best: double, next: double>", start)


def identify(docs: DataFrame, models: DataFrame, most: int = MODEL_BYTES) -> DataFrame:
    """The columns of docs, and _lang struct<pred, score>: the language of every whole text, by the models of learn.

    score: the losers' best bits against the winner's, from 0.5 up; 1 where only one language is known. Null texts,
    texts without a letter and, without models, all texts are `und` with score 0; equal bits go to the smaller language
    name. Rows are handled one by one, so repeated rows, an empty table and other columns, whatever their names, pass
    through (only _lang is replaced). Long texts are parsed whole. Languages whose automata have over `most` bytes
    together are tried in groups, one pass of all documents each.
    """
    name, other = "_lang", "_lang_next"
    while other in docs.columns:
        other += "_"
    out, known = docs.drop(name), groups(models, most)
    if not known:
        return out.withColumn(name, F.struct(F.lit(UNKNOWN).alias("pred"), F.lit(0.0).alias("score")))
    for i, langs in enumerate(known):
        if i:
            out = with_predictions(materialize(out, "lang-group"), loaded(models, langs), other)
            was, now = F.col(name), F.col(other)
            best = F.when(now["best"] < was["best"], now["pred"]).otherwise(was["pred"]).alias("pred"), F.least(was["best"], now["best"]).alias("best")
            second = F.least(F.greatest(was["best"], now["best"]), was["next"], now["next"]).alias("next")
            out = out.withColumn(name, F.struct(*best, second)).drop(other)
        else:
            out = with_predictions(out, loaded(models, langs), name)
    x = F.col(name)
    one = F.when(x["next"] == float("inf"), 1.0).when(x["best"] + x["next"] > 0, x["next"] / (x["best"] + x["next"])).otherwise(0.5)
    score = F.when(x["pred"] == UNKNOWN, 0.0).otherwise(one)
    return out.withColumn(name, F.struct(x["pred"].alias("pred"), score.alias("score")))
