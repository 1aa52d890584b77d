"""Byte-level BPE through a sentencepiece model serialised from the vocabulary.

Each of the 256 bytes is one letter of a contiguous block, each vocabulary entry a piece
of such letters scored by its negative rank, and normalisation is the identity. The BPE
of sentencepiece then merges in rank order, as a byte-level BPE does.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from postsieve.llm.common import lean, pieces

# Byte b is written as the letter with code point 0x100 + b (letters, none special).
FIRST_LETTER = 0x100
CACHE_ENTRIES = 200_000  # in two generations, about 180 bytes each
BATCH_CHARS = 2_000_000


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """The lines of a rank file: a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}


def letters(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_LETTERS)


_TO_LETTERS = {b: FIRST_LETTER + b for b in range(256)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; one unknown piece follows."""
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in ordered] != list(range(len(ordered))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2, ... and cover all single bytes")
    model = model_pb2.ModelProto()
    for rank, token in enumerate(ordered):
        model.pieces.add(piece=letters(token), score=-float(rank), type=model_pb2.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=model_pb2.ModelProto.SentencePiece.UNKNOWN)
    trainer, plain = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size, trainer.unk_id = model_pb2.TrainerSpec.BPE, len(model.pieces), len(ordered)
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    plain.name = "identity"
    plain.add_dummy_prefix = plain.remove_extra_whitespaces = plain.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes whole texts to ids and back. ``packed`` ids are little-endian uint32."""

    def __init__(self, blob: bytes, pattern: str):
        self.ranks = read_ranks(blob)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.pattern = regex.compile(pattern)
        # decoding inverts the mapping of each piece's letters
        size = self.model.get_piece_size() - 1
        self.bytes_of = [bytes(ord(c) - FIRST_LETTER for c in self.model.id_to_piece(i)) for i in range(size)]
        self.known = _Known(self)

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        return np.array(self.model.encode(letters(raw)), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        known = self.known
        if len(known) > CACHE_ENTRIES // 2:
            known.age()
        return b"".join([known[piece] for piece in self.pattern.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


class _Known(dict):
    """Packed ids by pre-token, filled on demand. What a generation has not asked for again is
    forgotten with the next, so frequent pre-tokens stay though few are kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self.codec.encode_piece(piece)
        self[piece] = packed
        return packed

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


@lru_cache(maxsize=2)
def _codec(blob: bytes, pattern: str) -> Codec:
    """One codec per Python worker, kept over tasks."""
    return Codec(blob, pattern)


def rank_file(path: str) -> bytes:
    """The bytes of a vocabulary file (under a megabyte; sent along with the tasks)."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, blob: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ids (binary, little-endian uint32), n_tokens, ids_sha256
    and decoded_sha256 (of the bytes decoded from the ids).

    Row-local: no shuffle, and each row's memory follows its own text. A null text counts
    as empty: zero ids, hash of nothing. Repeated rows stay rows. Columns of ``docs`` that
    carry one of the new names are replaced.
    """
    added = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = docs.drop(*added)
    names = kept.columns
    at = names.index(text_col)
    schema = StructType(list(kept.schema.fields)).add("ids", "binary").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(blob, pattern)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for part in pieces(np.array([len(t or "") for t in texts]), BATCH_CHARS):
                ids = [codec.encode(t or "") for t in texts[part]]
                back = [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids]
                new = [
                    pa.array(ids, pa.binary()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array(back, pa.string()),
                ]
                old = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*old.columns, *new], names=[*names, *added])

    return kept.mapInArrow(lean(run), schema)


def token_rows(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    out = encode_texts(docs.select("doc_id", "text"), rank_file(path), pattern)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def ids_of(packed: bytes) -> list[int]:
    """A packed value as a list."""
    return np.frombuffer(packed, dtype="<u4").tolist()


def decode_frame(frame: DataFrame, blob: bytes, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``frame`` plus ``decoded`` (string): the text of each ids value; null stays null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        codec = _codec(blob, pattern)
        return column.map(lambda p: None if p is None else codec.decode(bytes(p)).decode("utf-8", errors="replace"))

    return frame.withColumn("decoded", decoded(ids_col))
