"""Token ids in per-document zstandard frames with a shared dictionary.

Texts are encoded by a public tokenizer; each document's ids, with the end id,
are serialised as little-endian integers and compressed as a frame of its own,
with a dictionary trained on serialised id arrays of a bounded sample.  Frames
are laid out in ascending id order, in blocks:

    magic "TWTK" | width u8 | 3 zero bytes | sha256 of the dictionary (32 bytes)
    | n_docs u64 | doc ids i64[n] | null flags u8[n] | token counts u64[n]
    | frame offsets u64[n + 1] | frames

A block's header is the offset index: one document is read by decompressing its
frame alone.  Blocks are rows of a Parquet table (so the writer's commit makes
lost executors harmless), with first and last id as columns for pruning; the
dictionary is a one-row table beside it.

Documents are dealt to parts by id quantiles; an id that spans several quantiles
is spread over all of them by row position.  Only the token totals of the parts
are gathered to number the documents' starts.

Defined cases: null and empty texts are the end id alone; null ids come last;
rows with equal ids lie next to each other in some order; an empty table gives
no blocks and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pieces

END_ID = 2
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 1 << 16, 112 << 10
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
LEVEL = 3
_NO_ID = (1 << 63) - 1
_MAGIC = b"TWTK"
_ENCODED = T.StructType([T.StructField("n", T.LongType()), T.StructField("frame", T.BinaryType())])
_BLOCK = ("part int, block int, part_start long, first_id long, last_id long, n_docs long, n_tokens long, "
          "dict_sha256 string, payload binary")


def _ids(path: str, end_id: int, texts: pa.Array):
    enc = pieces.byte_encoder(path)
    end = np.array([end_id], enc.model.dtype).tobytes()
    for _, chunk in pieces.chunks(texts):
        ids, bounds = enc.encode(chunk)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[lo:hi].tobytes() + end


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES].ljust(8, b"\0")


def train(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int = END_ID) -> bytes:
    """A dictionary from about ``SAMPLE_DOCS`` documents chosen by hash, each id array cut at ``SAMPLE_BYTES``."""
    place = F.pmod(common.row_hash(F.col(id_col), F.substring(F.col(text_col), 1, 64)), F.lit(1_000_000))
    n = docs.count()

    @F.arrow_udf("binary")
    def serialise(texts: pa.Array) -> pa.Array:
        return pa.array([x[:SAMPLE_BYTES] for x in _ids(path, end_id, texts)], pa.binary())

    some = docs.where(place < 1_000_000 * min(1.0, SAMPLE_DOCS / max(1, n)))
    rows = some.select(serialise(F.col(text_col)).alias("b")).limit(2 * SAMPLE_DOCS).collect()  # bounded: training sample
    return _dictionary(sorted(bytes(r.b) for r in rows))


def _compress_udf(path: str, end_id: int, dictionary: bytes):
    @F.arrow_udf(_ENCODED)
    def compress(texts: pa.Array) -> pa.Array:
        shared = zstandard.ZstdCompressionDict(dictionary)
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        width = pieces.byte_encoder(path).model.dtype.itemsize
        n, frames = [], []
        for ids in _ids(path, end_id, texts):
            n.append(len(ids) // width)
            frames.append(z.compress(ids))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["n", "frame"])

    return compress.asNondeterministic()


def pack(ids: list[int | None], counts: list[int], frames: list[bytes], width: int, dict_hash: bytes) -> bytes:
    n = len(ids)
    offsets = np.append(0, np.cumsum([len(f) for f in frames])).astype("<u8")
    return b"".join([
        _MAGIC, struct.pack("<B3x", width), dict_hash, struct.pack("<Q", n),
        np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
        np.array([i is None for i in ids], np.uint8).tobytes(),
        np.array(counts, "<u8").tobytes(), offsets.tobytes(), *frames])


def unpack(payload: bytes):
    """(width, dictionary hash, ids, counts, frame(k)) of a block."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a token block")
    width, dict_hash = payload[4], payload[8:40]
    n, at = struct.unpack_from("<Q", payload, 40)[0], 48
    ids = np.frombuffer(payload, "<i8", n, at)
    nulls = np.frombuffer(payload, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(payload, "<u8", n, at + 9 * n)
    offsets = np.frombuffer(payload, "<u8", n + 1, at + 17 * n).astype(np.int64)
    data = at + 17 * n + 8 * (n + 1)
    return (width, dict_hash, [None if z else int(i) for i, z in zip(ids, nulls)], counts.astype(np.int64),
            lambda k: payload[data + offsets[k] : data + offsets[k + 1]])


def _blocks(width: int, dict_hash: bytes):
    def build(batches):
        part, block, before, ids, counts, frames, size = None, 0, 0, [], [], [], 0

        def flush():
            nonlocal block, before, ids, counts, frames, size
            known = [i for i in ids if i is not None] or [_NO_ID]
            last = _NO_ID if None in ids else known[-1]
            row = [part, block, before, known[0], last, len(ids), sum(counts), dict_hash.hex(),
                   pack(ids, counts, frames, width, dict_hash)]
            block, before, ids, counts, frames, size = block + 1, before + sum(counts), [], [], [], 0
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                              names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for p, i, n, f in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame"))):
                if ids and (p != part or size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield flush()
                if p != part:
                    part, block, before = p, 0, 0
                ids.append(i)
                counts.append(n)
                frames.append(f)
                size += len(f)
        if ids:
            yield flush()
    return build


def _part(ident: Column, bounds: list[int]) -> Column:
    """Quantile range of an id; an id equal to several bounds is spread over their ranges by position."""
    b = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<bigint>")
    below = F.size(F.filter(b, lambda x: x < ident))
    equal = F.size(F.filter(b, lambda x: x == ident))
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), equal + 1)
    return (below + draw).cast("int")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, parts: int | None = None) -> None:
    """Write blocks to ``path/blocks`` and the dictionary to ``path/dictionary``."""
    spark = docs.sparkSession
    common.prepare(spark, common.SMALL_BATCH_BYTES)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dictionary = train(docs, tokenizer, id_col, text_col, end_id)
    dict_hash = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(dict_hash.hex(), bytearray(dictionary))], "dict_sha256 string, data binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    cuts = docs.agg(F.percentile_approx(ident, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] \
        if parts > 1 else None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ident.alias("ident"),
                       _part(ident, cuts or []).alias("part"),
                       _compress_udf(tokenizer, end_id, dictionary)(F.col(text_col)).alias("e"))
    (rows.select("doc_id", "ident", "part", "e.n", "e.frame").repartition(parts, "part")
     .sortWithinPartitions("part", "ident")
     .select("part", "doc_id", "n", "frame")
     .mapInArrow(_blocks(pieces.byte_encoder(tokenizer).model.dtype.itemsize, dict_hash), _BLOCK)
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def _decode(dictionary: bytes, with_ids: bool, wanted: frozenset | None):
    def rows(batches):
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        expected = hashlib.sha256(dictionary).digest()
        for batch in batches:
            for base, start, payload in zip(*(batch.column(c).to_pylist() for c in ("base", "part_start", "payload"))):
                width, dict_hash, ids, counts, frame = unpack(payload)
                if dict_hash != expected:
                    raise ValueError("block was written with another dictionary")
                starts = base + start + np.cumsum(counts) - counts
                out = ([], [], [], [], [])
                for k, doc in enumerate(ids):
                    if wanted is not None and doc not in wanted:
                        continue
                    tokens = np.frombuffer(z.decompress(frame(k)), f"<u{width}").astype("<u4")
                    values = (doc, int(starts[k]), len(tokens), zlib.crc32(tokens.tobytes()), tokens if with_ids else None)
                    for column, v in zip(out, values):
                        column.append(v)
                types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return rows


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``ids`` from the files.

    ``wanted`` ids (a short list) read only the blocks whose id range holds one, and only their frames.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().data)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))  # one row per part
    if wanted is not None:
        near = F.lit(False)
        for i in wanted:
            near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(near)
    return (blocks.join(common.broadcast_if_small(bases, 16), "part").select("base", "part_start", "payload")
            .mapInArrow(_decode(dictionary, with_ids, None if wanted is None else frozenset(wanted)),
                        "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Write to a fresh folder under the shared checkpoint folder and read back."""
    spark = docs.sparkSession
    path = common.fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return read_tokens(spark, path, with_ids)
