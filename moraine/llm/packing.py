"""Operator 10: token ids packed in fixed-length rows.

Documents are tokenised (a public byte-level BPE; its file is a parameter, read on the driver and broadcast), an end
token closes each, and documents longer than a row are split in pieces without loss.  A task collects about
``shard_tokens`` tokens, then packs: full pieces fill rows of their own, the others go best-fit-decreasing, the row
with the least room that is enough being found in a segment tree over capacities.  A shard row holds

* ``ids``: the matrix, ``n_rows`` x ``seq_len`` little-endian uint16 (uint32 for larger vocabularies), padded,
* ``cu_seqlens``: cumulative segment lengths over the matrix's rows, the padding of a row being its last segment,
* ``resets``: offsets in the flat matrix at which position ids start at 0 again,
* ``pieces``: document, piece number, row, column and length of each piece.

A document's pieces share a shard.  Nothing is shuffled; a lost task is run again and gives the same shard.

Runs of white space of ``LONG_RUN`` characters or more are cut out before the splitting pattern, which would backtrack
over them, where that pattern cuts anyway; ids are those of the plain tokeniser.

Defined results: null and empty texts are the end token alone; ids of any type, null included, are carried as they are
(integers as long); repeated rows are packed each; pieces of equal length are placed in the order of their documents;
an empty table gives no shard; texts of any length are packed whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_dir, ship
from .textkit import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern of that vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN, SHARD_TOKENS = 2048, 1 << 21
#: What the pattern takes for white space (a fixed set), and the length from which a run is cut out.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 1 << 14


class CapacityTree:
    """Counts of rows by the room left; finds the least room that is enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The least room >= need of any row, or -1."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Row and column of every piece and the number of rows; pieces are at most ``capacity`` long."""
    tree, rows_of = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    row, col, n = [0] * len(sizes), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need = sizes[i]
        room = tree.least(need)
        if room < 0:
            r, room, n = n, capacity, n + 1
        else:
            r = rows_of[room].pop()
            tree.add(room, -1)
        row[i], col[i] = r, capacity - room
        if room > need:
            rows_of[room - need].append(r)
            tree.add(room - need, 1)
    return row, col, n


def pack(docs: list[np.ndarray], seq_len: int, pad: int, kind: str) -> dict:
    """The packed matrix of a shard, its segments and the place of every piece."""
    doc, part, begin, size = [], [], [], []
    for d, ids in enumerate(docs):
        for k, a in enumerate(range(0, len(ids), seq_len)):
            doc.append(d)
            part.append(k)
            begin.append(a)
            size.append(min(seq_len, len(ids) - a))
    row, col, n = best_fit_decreasing(size, seq_len)
    matrix = np.full((n, seq_len), pad, kind)
    used = np.zeros(n, np.int64)
    for d, a, m, r, c in zip(doc, begin, size, row, col, strict=True):
        matrix[r, c : c + m] = docs[d][a : a + m]
        used[r] += m
    starts = np.unique(np.concatenate([np.array(row, np.int64) * seq_len + np.array(col, np.int64), (np.arange(n) * seq_len + used)[used < seq_len]]))
    return {"matrix": matrix, "starts": starts, "doc": doc, "part": part, "row": row, "col": col, "size": size}


SHARD = (
    "shard string, seq_len int, n_rows int, dtype string, ids binary, cu_seqlens array<int>, resets array<int>, "
    "pieces array<struct<doc:int,part:int,row:int,col:int,len:int>>, doc_ids array<{id}>"
)


def _encoder(raw: bytes):
    import tiktoken

    cached = getattr(tiktoken, "_moraine", None)
    if cached is None or cached[0] != len(raw):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        cached = (len(raw), tiktoken.Encoding("moraine", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        tiktoken._moraine = cached
    return cached[1]


def encode(enc, text: str) -> np.ndarray:
    """Token ids of a text; the pattern never sees a run of ``LONG_RUN`` white-space characters.

    The pattern takes such a run as one piece, but for its last character where other characters follow.
    """
    if len(text) < LONG_RUN:
        return enc.encode_to_numpy(text, disallowed_special=())
    ids, at = [], 0
    for m in SPACE.finditer(text):
        a, b = m.start(), m.end() - (m.end() < len(text))
        if b - a >= LONG_RUN:
            ids += [enc.encode_to_numpy(text[at:a], disallowed_special=()), np.array(enc._core_bpe.encode_single_piece(text[a:b].encode()), np.uint32)]
            at = b
    ids.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(ids)


def _pack_task(vocabulary, seq_len: int, shard_tokens: int, id_type: pa.DataType):
    def run(batches):
        enc = _encoder(vocabulary.value)
        end = enc.n_vocab  # free in this vocabulary
        kind = "<u2" if end < 1 << 16 else "<u4"
        ids, docs, tokens, serial = [], [], 0, 0
        where = TaskContext.get().partitionId() if TaskContext.get() else 0

        def shard():
            p = pack(docs, seq_len, end, kind)
            pieces = [{"doc": a, "part": b, "row": c, "col": d, "len": e} for a, b, c, d, e in zip(p["doc"], p["part"], p["row"], p["col"], p["size"], strict=True)]
            out = {
                "shard": f"{where:06d}-{serial:05d}", "seq_len": seq_len, "n_rows": len(p["matrix"]), "dtype": kind, "ids": p["matrix"].tobytes(),
                "cu_seqlens": [*p["starts"].tolist(), p["matrix"].size], "resets": p["starts"].tolist(), "pieces": pieces, "doc_ids": ids,
            }
            return pa.RecordBatch.from_pylist([out], schema=schema)

        piece = pa.struct([(k, pa.int32()) for k in ("doc", "part", "row", "col", "len")])
        ints = pa.list_(pa.int32())
        schema = pa.schema([
            ("shard", pa.string()), ("seq_len", pa.int32()), ("n_rows", pa.int32()), ("dtype", pa.string()), ("ids", pa.binary()),
            ("cu_seqlens", ints), ("resets", ints), ("pieces", pa.list_(piece)), ("doc_ids", pa.list_(id_type)),
        ])
        for b in slices(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = np.append(encode(enc, text or ""), end).astype(kind)
                ids.append(i)
                docs.append(got)
                tokens += len(got)
                if tokens >= shard_tokens:
                    yield shard()
                    ids, docs, tokens, serial = [], [], 0, serial + 1
        if docs:
            yield shard()

    return run


def write_packed(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pack ``docs`` (doc_id, text), write the shards to ``path`` and return them as read back."""
    ship(texts=True)
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # about a megabyte, fixed
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    src = docs.select(F.col("doc_id").cast("long") if whole else "doc_id", F.col("text").cast("string"))
    kind = src.schema["doc_id"].dataType
    schema = SHARD.format(id=kind.simpleString())
    src.mapInArrow(_pack_task(vocabulary, seq_len, shard_tokens, to_arrow_type(kind)), schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def position_ids(resets: np.ndarray, size: int) -> np.ndarray:
    """Position ids of a flat matrix: they count up and start at 0 at every reset."""
    at = np.arange(size)
    return at - np.maximum.accumulate(np.where(np.isin(at, resets), at, 0))


def _read_task(id_type: pa.DataType):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                flat = np.frombuffer(r["ids"], r["dtype"])
                of: dict[int, list] = {}
                for p in r["pieces"]:
                    of.setdefault(p["doc"], []).append((p["part"], p["row"] * r["seq_len"] + p["col"], p["len"]))
                out = {"doc_id": [], "n_tokens": [], "n_pieces": [], "ids_sha256": [], "shard": []}
                for d, pieces in of.items():
                    ids = np.concatenate([flat[a : a + m] for _, a, m in sorted(pieces)])
                    out["doc_id"].append(r["doc_ids"][d])
                    out["n_tokens"].append(len(ids))
                    out["n_pieces"].append(len(pieces))
                    out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    out["shard"].append(r["shard"])
                yield pa.record_batch([pa.array(v) if k != "doc_id" else pa.array(v, id_type) for k, v in out.items()], list(out))

    return run


def read_packed(shards: DataFrame) -> DataFrame:
    """Per document, put together again from the matrices: tokens, pieces and a digest of the ids (uint32 each)."""
    ship(texts=True)
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, n_pieces long, ids_sha256 string, shard string"
    return shards.select("shard", "seq_len", "dtype", "ids", "pieces", "doc_ids").mapInArrow(_read_task(to_arrow_type(kind)), schema)


def pack_documents(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str = TOKENIZER) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/moraine/packed-{uuid.uuid4().hex}"
    return read_packed(write_packed(docs, path, seq_len, tokenizer))


def op10_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
