"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A BPE encoding has one useful property: the encoding of every prefix of a text ends
with exactly one token, and the encoding of the whole text is the chain of these last
tokens.  The encoder therefore walks an Aho-Corasick automaton over the vocabulary once,
stores for every prefix the only matching token that is compatible with the last token
of the prefix it leaves, and then reads the ids backwards.  Two tokens are compatible if
merging the text of both gives those two tokens again; the test runs the merges on that
short text and is remembered.

A text falls apart where no piece can span the gap (before a word mark that follows another
character, around line feeds, before some punctuation); these parts repeat, so their ids are kept in a
bounded cache.  Everything else streams: one Arrow batch at a time, no shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import free_name

MARK = "▁"
CACHE_ENTRIES = 300_000
PAIR_ENTRIES = 500_000
CACHE_PART_CHARS = 64
ROWS_PER_BATCH = 256


class PieceCodec:
    """Encoder and decoder for one SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        self.byte_ids = [0] * 256
        self.out = [b""] * n  # what each id decodes to
        self.is_byte = bytearray(n)
        self.rank: dict[str, int] = {}  # normal pieces; a smaller rank merges first
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = 1
                self.out[i] = bytes([value])
            elif sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.ids[piece] = i
                scores[piece] = sp.get_score(i)
                self.out[i] = piece.replace(MARK, " ").encode()
        for k, (piece, _) in enumerate(sorted(scores.items(), key=lambda x: -x[1])):
            self.rank[piece] = k
        self.pieces = pieces
        self.length = [len(x) for x in pieces]
        self._fits: dict[int, bool] = {}
        self._automaton: ahocorasick.Automaton | None = None  # built by the first text; decoding needs none
        self._cache: dict[str, bytes] = {}
        before: dict[str, set[str]] = {c: set() for c in ",.;:!?|)"}  # word characters that a piece joins to these
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                if b in before and re.match(r"\w", a):
                    before[b].add(a)
        gaps = "|".join((f"(?<![{''.join(sorted(x))}])" if x else "") + f"(?={re.escape(c)})" for c, x in before.items())
        ends = f"{MARK}*\\w++(?:{gaps})|"
        self._parts = re.compile(f"{ends}{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")

    def _merge(self, text: str) -> list[str]:
        """The merges themselves, for texts as short as two pieces."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for piece, i in self.ids.items():
                if self._merge(piece) == [piece]:  # others never come out of the merges
                    made.add_word(piece, (i, len(piece)))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def fits(self, left: int, right: int) -> bool:
        """Whether the text of both pieces encodes to these two pieces."""
        if len(self._fits) > PAIR_ENTRIES:
            self._fits.clear()
        a, b = self.pieces[left], self.pieces[right]
        ok = self._fits[left << 32 | right] = self._merge(a + b) == [a, b]
        return ok

    def prefix_table(self, text: str) -> list[int]:
        """For each prefix, by its length, the last id of its encoding; -1: a character without a piece."""
        last, known, fits = [-1] * (len(text) + 1), self._fits.get, self.fits
        for end, (i, n) in self.automaton.iter(text):
            if last[end + 1] < 0:
                before = last[end + 1 - n]
                if before < 0:
                    last[end + 1] = i
                else:
                    ok = known(before << 32 | i)
                    if ok or (ok is None and fits(before, i)):
                        last[end + 1] = i
        return last

    def _encode_part(self, text: str) -> bytes:
        table, length, out, at = self.prefix_table(text), self.length, [], len(text)
        while at:
            i = table[at]
            if i < 0:
                out += [self.byte_ids[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                out.append(i)
                at -= length[i]
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as an int32 array; null and empty texts give none."""
        if not text:
            return np.empty(0, np.int32)
        cache, found = self._cache, []
        for part in self._parts.findall(MARK + text.replace(" ", MARK)):
            ids = cache.get(part)
            if ids is None:
                ids = self._encode_part(part)
                if len(part) <= CACHE_PART_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[part] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def decode(self, ids) -> str:
        """Text of the ids; one leading space is the encoder's own. Stray bytes become U+FFFD each."""
        ids = np.asarray(ids, dtype=np.int64).tolist()
        raw = b"".join(map(self.out.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_stray(ids)
        return text[1:] if text[:1] == " " and not (ids and self.is_byte[ids[0]]) else text

    def _decode_stray(self, ids: list[int]) -> str:
        out, at = [], 0
        while at < len(ids):
            if not self.is_byte[ids[at]]:
                out.append(self.out[ids[at]].decode())
                at += 1
                continue
            end = at
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1
            raw = b"".join(map(self.out.__getitem__, ids[at:end]))
            while raw:
                for width in range(1, 5):
                    try:
                        out.append(raw[:width].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    width = 1
                raw = raw[width:]
            at = end
        return "".join(out)


_CODECS: dict[int, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    """One codec for each worker process and model."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def _model_bytes(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``token_ids array<int>`` to the columns ``keep`` (default: all but clashing ones).

    Null and empty texts give an empty array; a text of any length is encoded whole; repeated
    rows are encoded each; an empty table gives an empty table. Other columns pass through;
    an input column that is itself called token_ids is replaced.
    The model file (under 1 MB) is read on the driver and travels with the tasks.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != "token_ids"]
    model = df.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    src = df.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)])
    return src.mapInArrow(_encoder(model, keep), schema)


def _encoder(model: Broadcast, keep: list[str], decoded: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a text and the columns ``keep`` to these and its ids, and, where asked for, the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                part = whole.slice(at, ROWS_PER_BATCH)
                ids = [codec.encode(t) for t in part.column(0).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                field = pa.field("element", pa.int32(), nullable=False)
                lists = pa.ListArray.from_arrays(pa.array(ends), flat, type=pa.list_(field))
                back = [pa.array([codec.decode(x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, *back], names=[*keep, "token_ids"] + ["decoded"] * decoded)

    return run


def round_trip(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode``, then ``decode``, with one Python worker a task, not two that hold the model's tables each."""
    new = ["token_ids", "decoded"]
    keep = [c for c in (keep if keep is not None else df.columns) if c not in new]
    model = df.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    src = df.select(F.col(f"`{text_col}`").alias(free_name(keep, "__text")), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])
    return src.mapInArrow(_encoder(model, keep, True), schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded string`` to the columns ``keep`` (default: all). Null ids give an empty text."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != "decoded"]
    model = df.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    src = df.select(F.col(f"`{ids_col}`").alias("__ids"), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                part = whole.slice(at, ROWS_PER_BATCH)
                ids = part.column(0)
                texts = [codec.decode(ids[i].values.to_numpy(zero_copy_only=False)) if ids[i].is_valid else "" for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return src.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the length and digest of its ids and the digest of the text decoded from them.

    Null and empty texts have no ids and decode to an empty text; texts are encoded whole; repeated rows are repeated, a null doc_id
    stays null; other columns are ignored; an empty table gives an empty table.
    """
    both = round_trip(docs, model_path, "text", keep=["doc_id"])
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
