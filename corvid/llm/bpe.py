"""Byte-level BPE encoding and decoding with the tiktoken library (operator 8)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from corvid.llm.safe_split import pieces

#: Longer texts are encoded piece by piece, cut where no match of the pattern can be cut.
PIECE_CHARS = 1 << 16


class Codec:
    """A tiktoken encoding of a local rank file, and tables from ids to decimals and bytes."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.decimals = np.array([b"%d " % i for i in range(top)], dtype=f"S{len(str(top)) + 1}")

    def encode(self, text: str, piece: int = PIECE_CHARS) -> np.ndarray:
        found = [self.encoding.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, piece)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return self.decimals[ids].tobytes().translate(None, b"\0")[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes; they need not be valid UTF-8 where ids come from elsewhere."""
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, rank_file: str, pattern: str, piece: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (the raw bytes of the ids) for every row of docs.

    rank_file has to lie at the same place on every executor. A null text counts as empty: no
    ids and no bytes. Null or repeated doc_ids and repeated rows each give a row of their own;
    other columns are dropped, whatever their names; an empty table gives an empty one. Special
    strings are ordinary text. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [c.encode(t or "", piece) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, n_tokens long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, piece: int = PIECE_CHARS) -> DataFrame:
    """As encode(), with SHA-256 digests of the decimal ids and of the decoded bytes in place of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or "", piece)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(c.decimal(ids)).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) for rows of doc_id, ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            out = [c.encoding.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_id_type(encoded)}, decoded binary")
