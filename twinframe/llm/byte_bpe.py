"""Byte-level BPE by way of a sentencepiece model that is serialised from a rank file.

Each byte stands as one letter, so a token's bytes are a piece; its score is its negative rank, so that
sentencepiece merges what the ranks would merge first; the normalisation is the identity. Pre-tokens are
encoded one by one, and decoding looks up each id's bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, as_strings, slices

#: Byte b is the letter chr(LETTERS + b): no white space and no space mark among them.
LETTERS = 0x100
_codecs: dict[tuple[str, str], ByteCodec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


_LETTERS = {b: chr(LETTERS + b) for b in range(256)}


def letters(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTERS)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: <unk> as piece 0, then the tokens in the order of their ranks."""
    from sentencepiece import sentencepiece_model_pb2 as model

    spec = model.ModelProto()
    spec.trainer_spec.model_type = model.TrainerSpec.BPE
    spec.trainer_spec.vocab_size = len(ranks) + 1
    spec.trainer_spec.unk_id, spec.trainer_spec.bos_id, spec.trainer_spec.eos_id, spec.trainer_spec.pad_id = 0, -1, -1, -1
    spec.normalizer_spec.name = "identity"
    spec.normalizer_spec.add_dummy_prefix = False
    spec.normalizer_spec.remove_extra_whitespaces = False
    spec.normalizer_spec.escape_whitespaces = False
    spec.pieces.add(piece="<unk>", score=0.0, type=model.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        spec.pieces.add(piece=letters(token), score=float(-rank), type=model.ModelProto.SentencePiece.NORMAL)
    return spec.SerializeToString()


class ByteCodec:
    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.pieces = SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self.id_bytes = [b"", *(rank.to_bytes(4, "little") for rank in sorted(self.ranks.values()))]
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.words = Cache(lambda word: self.encode_words([word])[0])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each pre-token's ids, as little-endian unsigned 32-bit integers; a whole token needs no merge."""
        raw = [w.encode() for w in words]
        found = self.pieces.encode([letters(x) for x in raw], num_threads=1) if raw else []
        return [self.ranks[x].to_bytes(4, "little") if x in self.ranks else b"".join(map(self.id_bytes.__getitem__, ids)) for x, ids in zip(raw, found, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        self.words.learn(set().union(*split), self.encode_words)
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        self.words.trim()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> ByteCodec:
    """One for each worker process, vocabulary and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteCodec(path, pattern)
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids, binary: the little-endian unsigned 32-bit token ids of each text; null counts as empty, which has none."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(ranks, pattern)
        for texts in batches:
            yield pa.array([x for part in slices(texts) for x in own.encode(as_strings(part))], pa.binary())

    return docs.select("doc_id", ids("text").alias("ids"))


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encoded with one more column, decoded: the bytes that its ids stand for."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = codec(ranks, pattern).decode
        for ids in batches:
            yield pa.array([decode(x or b"") for part in slices(ids) for x in part.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", decoded("ids"))


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, by encoding each whole text and decoding its ids.

    ranks is the path, on every executor, of a rank file. Null counts as empty: 0 tokens, and the digests of no
    bytes. A null doc_id stays null; repeated rows are encoded each; an empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    digest_of = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(ranks, pattern)
        for texts in batches:
            out = []
            for ids in (x for part in slices(texts) for x in own.encode(as_strings(part))):
                out.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(own.decode(ids)).hexdigest()})
            yield pa.array(out, digest_of)

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
