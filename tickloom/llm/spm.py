"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, pieces with their scores (unigram) or the merges that
the scores imply (BPE) and byte fallback are rebuilt as a tokenizers pipeline. Batches are encoded by its threads, and
ids are held against the sentencepiece library and against a decoding round trip.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from tickloom.llm.common import append_from_text, chunks

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Values of the model format: types of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
#: Characters that the sentencepiece library encodes at once in a task.
CHUNK = 500_000
THREADS = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, 4 or 8 raw bytes, or the bytes of a nested value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
            yield key >> 3, value
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else varint(at)
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Spec:
    """What a model file says: pieces (text, score, type) by id, and the settings that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Spec:
        out = cls()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                out.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                out.kind, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
                if trainer.get(24):
                    raise ValueError("white space as a suffix isn't supported")
            elif number == 3:
                norm = dict(fields(value))
                out.charsmap = norm.get(2, b"")
                out.dummy_prefix, out.remove_extra_whitespaces, out.escape_whitespaces = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return out


def implied_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, the best scores first.

    Pieces of one score (runs of the marker) grow from the left, as the leftmost pair wins a tie: longer lefts first."""
    scores = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    found = [(-s, -k, p[:k], p[k:]) for p, s in scores.items() for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores]
    return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[:2])]


def tokenizer(spec: Spec):
    """The tokenizers pipeline of a model, for texts that `normalised` has been over. Its ids are the model's."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next(i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN)
    if spec.kind == UNIGRAM:
        usable = [s for _, s, kind in spec.pieces if kind == NORMAL]
        out = Tokenizer(models.Unigram([(p, s if kind in (NORMAL, USER_DEFINED) else min(usable) - 100) for p, s, kind in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback))
    else:
        out = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, implied_merges(spec.pieces), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
    out.normalizer = normalizers.Precompiled(spec.charsmap) if spec.charsmap else None
    if not any(MARK in p.lstrip(MARK) for p, _, _ in spec.pieces):  # no piece spans the start of a word
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    out.encode_special_tokens = True
    return out


def normalised(spec: Spec, text: str, charsmap=None) -> str:
    """The text as the model's pieces spell it: the character map's work, white space and the marker."""
    if charsmap is not None:
        text = charsmap.normalize_str(text)
    if spec.remove_extra_whitespaces:
        text = re.sub(" {2,}", " ", text.strip(" "))
    if spec.dummy_prefix and text:
        text = " " + text
    return text.replace(" ", MARK) if spec.escape_whitespaces else text


def encode_batch(tok, texts: list[str]) -> list[list[int]]:
    return [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


#: Stands between the words of joined texts; a text that holds it is encoded by itself.
GAP = "\x1c"
#: Distinct words that are encoded as one text.
BLOCK = 1000


class Encoder:
    """Texts to ids: `normalised` in place of the pipeline's own normaliser, and each distinct word of a batch once.

    The pipeline's pre-tokenizer cuts a text where a run of markers begins and encodes the words alone, so a text's ids
    are its words' ids. Where pieces span words there is no pre-tokenizer, and whole texts are encoded."""

    def __init__(self, spec: Spec) -> None:
        self.spec, self.tok = spec, tokenizer(spec)
        self.charsmap, self.tok.normalizer = self.tok.normalizer, None
        self.by_word = self.tok.pre_tokenizer is not None

    def spelled(self, text: str) -> str:
        return normalised(self.spec, text, self.charsmap)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return encode_batch(self.tok, [self.spelled(t) for t in texts])

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, the number of each text's ids, and whether each text's words decode to it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = np.array([not self.by_word or GAP in t for t in texts], bool)
        cut = [None if w else self.spelled(t).replace(MARK, GAP + MARK).replace(MARK + GAP, MARK).removeprefix(GAP) for t, w in zip(texts, whole, strict=True)]
        words = pc.split_pattern(pa.array(cut, pa.large_string()), GAP)
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        place, known_ids, known_counts, right = self.encode_known(coded.dictionary)
        at = place.take(coded.indices.to_numpy()) if len(place) else place
        alone = [encode_batch(self.tok, [self.spelled(texts[i])])[0] for i in np.flatnonzero(whole)]

        per_word = known_counts.take(at) if len(at) else np.zeros(0, np.int64)
        begin = (np.cumsum(known_counts) - known_counts).take(at) if len(at) else per_word
        ends = np.cumsum(per_word)
        flat = known_ids.take(np.repeat(begin - (ends - per_word), per_word) + np.arange(ends[-1] if len(ends) else 0))
        last = np.cumsum(counts)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], last])])
        n_ids, good = sums(per_word), sums(~right[at] if len(at) else per_word) == 0
        if alone:
            parts, place = np.split(flat, np.cumsum(n_ids)[:-1]), iter(alone)
            parts = [np.array(next(place), np.int32) if w else x for x, w in zip(parts, whole, strict=True)]
            flat, n_ids, good = np.concatenate(parts), np.array([len(x) for x in parts]), good & ~whole
        return flat, n_ids, good & np.array([MARK not in t for t in texts], bool)  # a marker of the text's own decodes to a blank

    def encode_known(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words (a large_string array): each word's place in what follows; then ids of all words in one array, the
        number of each word's, and whether each word's ids decode to it.

        Words are encoded in blocks: each begins with a marker and ends with none, so the pre-tokenizer cuts the block
        into them again. Where the bytes of the ids' pieces are the block's, a word's ids are those within its bytes.
        Other words, and those of a block of which that doesn't hold, are encoded one by one."""
        import pyarrow.compute as pc

        plain = pc.and_not(pc.starts_with(words, MARK), pc.ends_with(words, MARK))
        mask = plain.to_numpy(zero_copy_only=False)
        inner, rest = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        place = np.empty(len(words), np.int64)
        place[mask], place[~mask] = np.arange(len(inner)), np.arange(len(inner), len(words))
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(inner).to_numpy())]).astype(np.int64)
        raw = inner.buffers()[2].to_pybytes() if len(inner) else b""  # the words' bytes, one after the other

        pieces, sizes = self.bytes_of_pieces()
        joined = lambda found: b"".join(map(pieces.__getitem__, found))
        begins = range(0, len(inner), BLOCK)
        blocks = [edges[i : i + BLOCK + 1] for i in begins]
        parts, counts, right = [], [], []

        def one_by_one(texts: list[str]) -> None:
            for t, found in zip(texts, encode_batch(self.tok, texts), strict=True):
                parts.append(np.array(found, np.int32))
                counts.append(np.array([len(found)]))
                right.append(np.array([joined(found) == t.encode()]))

        for first, e, found in zip(begins, blocks, encode_batch(self.tok, [raw[e[0] : e[-1]].decode() for e in blocks]), strict=True):
            ids = np.array(found, np.int32)
            reached = e[0] + np.cumsum(sizes.take(ids))
            cuts = np.searchsorted(reached, e[1:])
            if len(ids) and reached[-1] == e[-1] and (reached.take(cuts) == e[1:]).all() and joined(found) == raw[e[0] : e[-1]]:
                parts.append(ids)
                counts.append(np.diff(cuts + 1, prepend=0))
                right.append(np.ones(len(cuts), bool))
            else:
                one_by_one(inner.slice(first, BLOCK).to_pylist())
        one_by_one(rest)
        both = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        return place, both(parts, np.int32), both(counts, np.int64), both(right, bool)

    def bytes_of_pieces(self) -> tuple[list[bytes], np.ndarray]:
        """What each id stands for, and the number of its bytes."""
        if not hasattr(self, "pieces"):
            found = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() for p, _, kind in self.spec.pieces]
            self.pieces = found, np.array([len(x) for x in found], np.int64)
        return self.pieces


@functools.lru_cache(maxsize=2)
def worker_encoder(model: bytes, threads: int) -> tuple:
    """The encoder and the sentencepiece library's processor of a model, once for each worker process."""
    import sentencepiece

    os.environ |= {"TOKENIZERS_PARALLELISM": "true" if threads > 1 else "false", "RAYON_NUM_THREADS": str(threads)}
    return Encoder(Spec.parse(model)), sentencepiece.SentencePieceProcessor(model_proto=model)


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, verify: bool = True, threads: int = THREADS) -> DataFrame:
    """The columns of docs and _spm struct<ids, tokens_sha256, round_trip, parity> of every whole text.

    ids: as the sentencepiece library gives them, without begin and end; tokens_sha256: hex digest of the ids as 4-byte
    little-endian integers; round_trip: decoding gives the text again (for a normaliser that changes nothing, else what
    the library decodes); parity: the sentencepiece library gives the same ids (null without verify). A null text has
    null ids and digest and counts as true; an empty one has no ids. Rows are handled one by one, so repeated rows and
    other columns, whatever their names, pass through (only _spm is replaced). The model file (its size doesn't grow
    with the data) is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        import pyarrow as pa

        encoder, peer = worker_encoder(model.value, threads)
        spec = encoder.spec
        plain = not spec.charsmap and not spec.remove_extra_whitespaces

        def make(texts: list[str | None]) -> pa.Array:
            given = [t or "" for t in texts]
            flat, counts, good = encoder.encode_words(given)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            own = lambda i: flat[offsets[i] : offsets[i + 1]]
            back = [bool(g) and plain or encoder.tok.decode(own(i).tolist(), skip_special_tokens=False) == (given[i] if plain else peer.decode(own(i).tolist())) for i, g in enumerate(good)]
            same: list[bool | None] = [None] * len(given)
            if verify:
                at = 0
                for part in chunks(given, CHUNK):
                    for other in peer.encode(part, num_threads=threads):
                        same[at] = len(other) == counts[at] and bool((np.array(other, np.int32) == own(at)).all())
                        at += 1
            null = np.array([t is None for t in texts], bool)
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()), mask=pa.array(null))
            raw = memoryview(flat.astype("<i4").tobytes())
            digests = [None if n else hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for n, a, b in zip(null, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return pa.StructArray.from_arrays([ids, pa.array(digests, pa.string()), pa.array(back, pa.bool_()), pa.array(same, pa.bool_())], ["ids", "tokens_sha256", "round_trip", "parity"])

        return make

    return append_from_text(docs, "_spm", "struct<ids: array<int>, tokens_sha256: string, round_trip: boolean, parity: boolean>", start)


def decode_documents(encoded: DataFrame, model_path: str = MODEL_PATH, threads: int = THREADS) -> DataFrame:
    """The columns of encoded and _text: ids (array<int>) decoded; null for null ids, empty for none."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    encoded = encoded.drop("_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = worker_encoder(model.value, threads)[0].tok
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = tok.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            made = pa.array([None if i is None else t for i, t in zip(ids, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "_text"])

    return encoded.mapInArrow(run, f"{schema}, _text string")
