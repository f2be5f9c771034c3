"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a chunk form a doubly linked list; a heap holds its adjacent pairs that make a piece. The pair
of the lowest rank, leftmost among equals, is popped and merged again and again. The count is the initial
symbols less the merges; no identifiers are made.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, as_strings, slices

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts a text's tokens under a sentencepiece BPE model with byte fallback and identity normalisation.

    No piece has a space mark behind another character, so no merge crosses from a word into the space before
    the next: a text's count is the sum over its chunks, each some space marks and what follows, and chunks
    that recur are counted once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        spec.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        kind = model.ModelProto.SentencePiece
        norm = spec.normalizer_spec
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type == kind.NORMAL}
        crossing = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        if any(p.type == kind.USER_DEFINED for p in spec.pieces):
            raise ValueError("the model has pieces of the user's own, which are matched before any merge")
        if spec.trainer_spec.model_type != model.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or crossing:
            raise ValueError("the model isn't BPE with byte fallback, identity normalisation, a space before the text, and spaces only at the start of pieces")
        self.letters = frozenset(p for p in self.rank if len(p) == 1)
        self.chunks = Cache(self.count_chunk)

    def count_chunk(self, chunk: str) -> int:
        """Symbol i is chunk[i:end[i]], and before[i] is where the one on its left starts."""
        n, rank = len(chunk), self.rank
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(chunk[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, mid, stop = heapq.heappop(heap)
            if end[left] != mid or end[mid] != stop:
                continue  # one of the two has been merged since
            merges += 1
            end[left], end[mid] = stop, 0
            if stop < n:
                before[stop] = left
                if (r := rank.get(chunk[left : end[stop]])) is not None:
                    heapq.heappush(heap, (r, left, stop, end[stop]))
            if (first := before[left]) >= 0 and (r := rank.get(chunk[first:stop])) is not None:
                heapq.heappush(heap, (r, first, left, stop))
        tokens = n - merges
        if not self.letters.issuperset(chunk):  # a letter that is no piece and stays is as many tokens as it has bytes
            tokens += sum(len(chunk[i].encode("utf-8", "surrogatepass")) - 1 for i in range(n) if end[i] == i + 1 and chunk[i] not in self.letters)
        return tokens

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] == " " or "  " in text or SPACE in text:
            chunks = _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        else:
            chunks = (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        return sum(map(self.chunks.__getitem__, chunks))


def counter(path: str) -> PieceCounter:
    """One for each worker process and model."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    model is the path, on every executor, of a sentencepiece model. Null counts as empty, with 0 tokens; a null
    doc_id stays null; repeated rows are counted each; an empty table gives no rows. Columns other than doc_id
    and text are not read.
    """

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(model)
        for texts in batches:
            out = []
            for part in slices(texts):
                out += [own.count(t) for t in as_strings(part)]
                own.chunks.trim()
            yield pa.array(out, pa.int64())

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
