"""Byte-level BPE through a sentencepiece model that is written from the vocabulary."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import arrow_map, batch, broadcast, texts

#: Character that stands for byte 0 in a piece; the other bytes follow it.
FIRST_CHARACTER = 0x100
#: Pre-tokens a worker remembers before it starts anew, and the longest one it remembers.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
#: Neither letter, number nor white space in any Unicode version.
PLAIN_CHARACTER = "\ue000"
# Fields and enumeration numbers of the sentencepiece model format.
MODEL_PIECE, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
TRAINER_MODEL_TYPE, TRAINER_VOCAB_SIZE, TRAINER_UNK, TRAINER_BOS, TRAINER_EOS, TRAINER_PAD, BPE = 3, 4, 40, 41, 42, 43, 2
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5

_TO_CHARACTERS = {b: FIRST_CHARACTER + b for b in range(256)}
_TO_BYTES = {FIRST_CHARACTER + b: b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_piece(token: bytes) -> str:
    """Bytes as characters, one each, none of them white space."""
    return token.decode("latin-1").translate(_TO_CHARACTERS)


def as_bytes(piece: str) -> bytes:
    """Inverse of :func:`as_piece`."""
    return piece.translate(_TO_BYTES).encode("latin-1")


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model of ``tokens`` in rank order.

    Every token is a piece of one character per byte, scored by its negative rank, so
    that the best pair is the one of lowest rank; the unknown piece comes last. Text is
    not normalised: no prefix, no white space removed or replaced.
    """

    def piece(text: str, score: float, kind: int) -> bytes:
        body = _block(PIECE_TEXT, text.encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score) + _number(PIECE_TYPE, kind)
        return _block(MODEL_PIECE, body)

    pieces = [piece(as_piece(token), -float(rank), NORMAL) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", -float(len(tokens)), UNKNOWN))
    trainer = (
        _number(TRAINER_MODEL_TYPE, BPE) + _number(TRAINER_VOCAB_SIZE, len(pieces)) + _number(TRAINER_UNK, len(tokens))
        + _number(TRAINER_BOS, -1) + _number(TRAINER_EOS, -1) + _number(TRAINER_PAD, -1)
    )
    normalizer = _block(NORMALIZER_NAME, b"identity") + b"".join(
        _number(field, 0) for field in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES)
    )
    return b"".join(pieces) + _block(MODEL_TRAINER, trainer) + _block(MODEL_NORMALIZER, normalizer)


def later_characters() -> str:
    """Letters and numbers to ``regex`` that tiktoken, of an earlier Unicode version, takes for neither."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = []
    for kind in (r"\p{L}", r"\p{N}"):
        matches = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        known = set(matches.decode(matches.encode_ordinary(every)))
        found.extend(c for c in regex.findall(kind, every) if c not in known)
    return "".join(sorted(found))


class Vocabulary:
    """Ranks and the model made of them; its size is that of the vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(set(ranks.values())) < len(ranks) or len(ranks) >= 1 << 24 or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("a vocabulary holds every single byte and fewer than 2^24 tokens of different ranks")
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = np.array([ranks[t] for t in tokens], "<u4")
        self.model = sentencepiece_model(tokens)
        self.later = later_characters()

    def processor(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.model)


class Encoder:
    """Token ids of pre-tokens; short ones are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.pieces, self.ids = vocabulary.processor(), vocabulary.ids
        self.pattern = regex.compile(pattern)
        self.later = dict.fromkeys(map(ord, vocabulary.later), PLAIN_CHARACTER)
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Matches of the pattern, characters of later Unicode versions counting as unassigned."""
        if text.isascii() or self.later.keys().isdisjoint(map(ord, set(text))):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.later))]

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.split(t) for t in texts]
        new = list({p for words in parts for p in words if p not in self.known})
        mapped = [as_piece(p.encode()) for p in new]
        # a pre-token that is a token itself is not merged
        whole = self.pieces.piece_to_id(mapped) if new else []
        unknown = len(self.ids)
        merged = iter(self.pieces.encode([m for m, w in zip(mapped, whole) if w == unknown]))
        once = {p: self.ids[[w] if w != unknown else next(merged)].tobytes() for p, w in zip(new, whole)}
        known = self.known | once if len(self.known) < len(once) else self.known
        known.update(once)
        for words in parts:
            yield b"".join(map(known.__getitem__, words))
        for p in [p for p in once if len(p) > REMEMBERED_LENGTH]:
            del known[p]
        self.known = known if len(known) <= REMEMBERED else {}


def encode_texts(
    transcripts: DataFrame, ranks_path: str, pattern: str, id_col: str = "video_id", text_col: str = "ocr_text"
) -> DataFrame:
    """Byte-level BPE tokens of OCR transcripts.

    A text is cut into the matches of ``pattern`` (pre-tokens). Each becomes the token
    equal to it or else what a sentencepiece BPE model, serialised from the ranks, makes
    of its bytes: the adjacent pair of lowest rank is merged first, the leftmost on a tie.
    No special tokens. Letters and numbers are those of tiktoken's Unicode version.

    Returns id_col, n_tokens and token_ids, the ids as little-endian unsigned 32-bit
    integers (``np.frombuffer(token_ids, "<u4")``). Null and empty texts have no tokens;
    bytes that are no UTF-8 count as U+FFFD; repeated rows and null ids stay as they are;
    an empty table gives an empty result; other columns are ignored. The vocabulary,
    whose size no input changes, is sent to the workers.
    """
    sent = broadcast(transcripts.sparkSession, Vocabulary(read_ranks(ranks_path)))
    rows = transcripts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, pattern)
        for b in batches:
            packed = list(encoder.packed([t.decode(errors="replace") for t in texts(b.column(1))]))
            yield batch(["id", "n_tokens", "token_ids"], b.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()))

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, encode, f"id {kind}, n_tokens bigint, token_ids binary").withColumnRenamed("id", id_col)


def decode_tokens(
    tokens: DataFrame, ranks_path: str, id_col: str = "video_id", tokens_col: str = "token_ids", carry_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Bytes behind the token ids of transcripts, through the pieces of the model.

    Returns id_col, ``carry_cols`` (unread) and decoded (binary: cut sequences may end
    inside a character). Null ids decode to no bytes; an id that the vocabulary does not
    hold fails the job.
    """
    sent = broadcast(tokens.sparkSession, Vocabulary(read_ranks(ranks_path)))
    rows = tokens.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"), F.struct(F.lit(0).alias("_"), *carry_cols).alias("carry"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        pieces = vocabulary.processor()
        table = dict(zip(vocabulary.ids.tolist(), (as_bytes(pieces.id_to_piece(i)) for i in range(len(vocabulary.ids)))))
        for b in batches:
            out = [b"".join(map(table.__getitem__, np.frombuffer(t or b"", "<u4").tolist())) for t in b.column(1).to_pylist()]
            yield batch(["id", "carry", "decoded"], b.column(0), b.column(2), pa.array(out, pa.binary()))

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("id", "carry"))
    told = arrow_map(rows, decode, f"{kinds}, decoded binary")
    return told.select(F.col("id").alias(id_col), *(F.col(f"carry.{c}") for c in carry_cols), "decoded")
