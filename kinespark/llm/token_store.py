"""Token-id files: a shared zstandard dictionary, one frame a document.

The dictionary is trained on the serialised ids of a bounded sample. Documents
are encoded and compressed one by one, sorted by id and packed into segments::

    magic 'TKS1' | 8 bytes dictionary hash | u4 width of an id | u4 documents |
    i8 doc ids | u1 1 where the id is null | u8 token counts | u8 frame offsets, one more than documents | frames

(little endian). A segment is the ``blob`` of one row of a Parquet table, with
its first and last id beside it, so that any store Spark writes to will do and a
reader of one document fetches one segment and unpacks one frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.llm import subwords
from kinespark.session import materialise, scratch_path

#: Documents of the dictionary's sample, its bytes, and the bytes and documents of a segment.
SAMPLE, DICT_BYTES, SEGMENT_BYTES, SEGMENT_DOCS = 1024, 65_536, 4 << 20, 4096
MAGIC = b"TKS1"
ROW = "doc_id long, seq long, n_tokens long, frame binary"
SEGMENT = "shard long, segment long, first_doc long, last_doc long, n_docs long, n_tokens long, blob binary"


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _encode(path: str, end_id: int):
    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.append(x, np.int32(end_id)) for x in subwords.word_ids(path, texts)]

    return ids_of


def _width(path: str) -> int:
    return 2 if subwords.load(path).get_vocab_size() <= 1 << 16 else 4


def train(docs: DataFrame, path: str, end_id: int, sample: int = SAMPLE, dict_bytes: int = DICT_BYTES) -> bytes:
    """Dictionary bytes from at most ``sample`` documents; empty if they are too few."""
    ids_of = _encode(path, end_id)

    def run(batches):
        width = _width(path)
        for b in batches:
            yield pd.DataFrame({"ids": [serialise(x, width) for x in ids_of(list(b["text"]))]})

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).select(F.coalesce("text", F.lit("")).alias("text")).limit(sample)
    rows = [bytes(r[0]) for r in some.mapInPandas(run, "ids binary").collect()]  # bounded by `sample`
    try:
        return zstandard.train_dictionary(dict_bytes, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dict(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def dict_hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:8]


def compress(docs: DataFrame, path: str, end_id: int, dictionary: bytes, level: int = 3, step: int = 256) -> DataFrame:
    """A row a document with its frame; ``seq`` tells rows with equal ids apart."""
    ids_of = _encode(path, end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, width = zstandard.ZstdCompressor(level=level, dict_data=_dict(dictionary)), _width(path)
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for i in range(0, len(b), step):
                part = b.iloc[i:i + step]
                ids = ids_of(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "seq": np.arange(row, row + len(part)), "n_tokens": [len(x) for x in ids],
                                    "frame": [packer.compress(serialise(x, width)) for x in ids]})
                row += len(part)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, ROW)


def pack(rows: pd.DataFrame, dictionary: bytes, width: int) -> bytes:
    sizes = np.array([len(f) for f in rows["frame"]], np.uint64)
    return b"".join([
        MAGIC, dict_hash(dictionary), struct.pack("<II", width, len(rows)),
        rows["doc_id"].fillna(0).to_numpy(np.int64).astype("<i8").tobytes(), rows["doc_id"].isna().to_numpy().astype("u1").tobytes(),
        rows["n_tokens"].to_numpy(np.int64).astype("<u8").tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(), *rows["frame"],
    ])


class Segment:
    """Reader of one blob; unpacks single documents by their place."""

    def __init__(self, blob: bytes, dictionary: bytes):
        if blob[:4] != MAGIC or blob[4:12] != dict_hash(dictionary):
            raise ValueError("not a segment of this dictionary")
        self.width, self.n = struct.unpack_from("<II", blob, 12)
        at = 20
        self.doc_ids = np.frombuffer(blob, "<i8", self.n, at)
        self.nulls = np.frombuffer(blob, "u1", self.n, at + 8 * self.n)
        self.n_tokens = np.frombuffer(blob, "<u8", self.n, at + 9 * self.n)
        self.offsets = np.frombuffer(blob, "<u8", self.n + 1, at + 17 * self.n)
        self.body = at + 25 * self.n + 8
        self.blob, self.unpacker = blob, zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def ids(self, i: int) -> np.ndarray:
        frame = self.blob[self.body + int(self.offsets[i]):self.body + int(self.offsets[i + 1])]
        return np.frombuffer(self.unpacker.decompress(frame), f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, out: str, end_id: int = 1) -> bytes:
    """Writes segments below ``out``/segments and the dictionary below ``out``/dictionary.

    Frames are written once before they are sorted, so that finding the ranges
    doesn't encode twice. Ids ascend, nulls last; rows with one id keep together."""
    spark = docs.sparkSession
    dictionary = train(docs, path, end_id)
    frames = materialise(compress(docs, path, end_id, dictionary), "frames")
    key = [F.col("doc_id").asc_nulls_last(), F.col("seq")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, width, held, size, k = TaskContext.get().partitionId(), _width(path), [], 0, 0

        def segment() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            return pd.DataFrame({"shard": [shard], "segment": [k], "first_doc": rows["doc_id"].iloc[:1].array, "last_doc": rows["doc_id"].iloc[-1:].array,
                                 "n_docs": [len(rows)], "n_tokens": [int(rows["n_tokens"].sum())], "blob": [pack(rows, dictionary, width)]})

        for b in batches:
            b["doc_id"] = b["doc_id"].astype("Int64")
            lengths = b["frame"].str.len().to_numpy()
            begin = 0
            for i in range(len(b)):
                size += int(lengths[i])
                if size >= SEGMENT_BYTES or sum(map(len, held)) + i + 1 - begin >= SEGMENT_DOCS:
                    held.append(b.iloc[begin:i + 1])
                    yield segment()
                    held, size, begin, k = [], 0, i + 1, k + 1
            if begin < len(b):
                held.append(b.iloc[begin:])
        if held:
            yield segment()

    ordered = frames.repartitionByRange(n, *key).sortWithinPartitions(*key)
    ordered.mapInPandas(run, SEGMENT).write.option("compression", "none").parquet(f"{out}/segments")
    spark.createDataFrame([(dict_hash(dictionary).hex(), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    return dictionary


def read(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds up shards, then segments of a shard, then documents of a segment."""
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])
    segments = spark.read.parquet(f"{out}/segments")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, k, blob in zip(b["shard"], b["segment"], b["blob"]):
                s = Segment(blob, dictionary)
                ids = [s.ids(i) for i in range(s.n)]
                n = np.array([len(x) for x in ids], np.int64)
                yield pd.DataFrame({"shard": shard, "segment": k, "doc_id": pd.Series(s.doc_ids).astype("Int64").mask(s.nulls == 1),
                                    "inside": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})

    docs = segments.select("shard", "segment", "blob").mapInPandas(run, "shard long, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sums = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row a shard
    before = sums.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("low"))
    inner = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("mid")).join(before, F.col("shard") == F.col("s")).select(
        "shard", "segment", (F.col("low") + F.col("mid")).alias("base"))
    return docs.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, out: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document: one segment is read and one frame unpacked."""
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])
    row = spark.read.parquet(f"{out}/segments").where((F.col("first_doc") <= doc_id) & ((F.col("last_doc") >= doc_id) | F.col("last_doc").isNull())).orderBy("shard", "segment").select("blob").take(1)
    for r in row:
        s = Segment(bytes(r["blob"]), dictionary)
        hit = np.flatnonzero((s.doc_ids == doc_id) & (s.nulls == 0))
        if len(hit):
            return s.ids(int(hit[0]))
    return None


def store(docs: DataFrame, path: str, end_id: int = 1, out: str | None = None) -> DataFrame:
    """Writes the files and reads them back. Null texts are empty (the end id alone);
    null ids come last; repeated rows are stored each; other columns aren't read."""
    out = out or scratch_path(docs.sparkSession, "tokens")
    write(docs, path, out, end_id)
    return read(docs.sparkSession, out)
