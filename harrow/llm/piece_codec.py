"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a character before a white-space marker, so no merge crosses from
a character to a marker and every run ``markers + characters`` is segmented on its own. A
task keeps a table of the distinct chunks it has met: each is segmented once by the
library, and the ids of a text are the table's entries joined by position. A model whose
pieces do cross markers (or that rewrites text) has whole texts as its chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import slices, text_or_empty

MARK = "▁"
# Entries a task's table holds before it starts anew, and the longest chunk kept in it: bounds of memory only.
TABLE_ENTRIES = 300_000
KEPT_CHARS = 64


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def chunks_are_independent(path: str) -> bool:
    """Whether no piece crosses a marker and the model takes text as it is."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, spec = _model(path), pb.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    norm = spec.normalizer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
    plain = plain and not norm.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
    plain = plain and spec.trainer_spec.model_type == pb.TrainerSpec.BPE
    own = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces)
    crossing = (re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return bool(plain) and not own and model.piece_to_id(MARK) != model.unk_id() and not any(crossing)


class ChunkTable:
    """Segments of distinct chunks: ids as decimal text, and the text they decode to."""

    def __init__(self, path: str):
        self.model, self.split = _model(path), chunks_are_independent(path)
        self._begin()

    def _begin(self) -> None:
        # a marker at the end of a text is a chunk without characters
        self.ids: dict[str, str] = {"": str(self.model.piece_to_id(MARK))}
        self.decoded: dict[str, str] = {"": ""}

    def cut(self, text: str) -> list[str]:
        """Chunks of ``text`` without their first marker (the model's own prefix for the first)."""
        if not text or not self.split:
            return [text] if text else []
        marked = text.replace(MARK, " ")
        if "  " not in marked and marked[0] != " " and marked[-1] != " ":
            return marked.split(" ")
        return [run[1:] for run in re.findall(" +[^ ]*", " " + marked)]

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > TABLE_ENTRIES:
            self._begin()
            new = [c for c in chunks if c]
        ids = self.model.encode(new, num_threads=1)
        texts = self.model.decode(ids, num_threads=1) if new else []
        for chunk, own, text in zip(new, ids, texts):
            self.ids[chunk] = ",".join(map(str, own))
            self.decoded[chunk] = chunk if text == chunk else text

    def forget_long(self) -> None:
        for chunk in [c for c in self.ids if len(c) > KEPT_CHARS]:
            del self.ids[chunk], self.decoded[chunk]

    def code(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Ids (decimal, joined by commas) and decoded text of each text."""
        parts = [self.cut(t) for t in texts]
        self.learn(set().union(*parts))
        ids, decoded = self.ids, self.decoded
        for own in parts:
            yield ",".join([ids[c] for c in own]), " ".join([decoded[c] for c in own])
        if any(len(c) > KEPT_CHARS for own in parts for c in own):
            self.forget_long()


@lru_cache(maxsize=1)
def chunk_table(path: str) -> ChunkTable:
    """One table for all tasks of a Python worker."""
    return ChunkTable(path)


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``ids`` array<int>, ``decoded``): each whole text as the library encodes and decodes it.

    A null text counts as empty, an empty text has no ids and decodes to an empty text; repeated rows
    stay, a null id stays null. Other columns of ``docs`` take no part.
    """

    def code(batches):
        table = chunk_table(model)
        for part in slices(batches):
            both = list(table.code(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([[int(i) for i in ids.split(",")] if ids else [] for ids, _ in both], pa.list_(pa.int32())),
                    pa.array([d for _, d in both], pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(code, "doc_id long, ids array<int>, decoded string")


def encoding_digest(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``) of ``encode_texts``, digested inside the task."""

    def digest(batches):
        table = chunk_table(model)
        for part in slices(batches):
            counts, of_ids, of_text = [], [], []
            for ids, decoded in table.code(part.column("text").to_pylist()):
                counts.append(ids.count(",") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
