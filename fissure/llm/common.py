"""Vectorised text primitives and the packed exchange shared by the corpus operators.

Texts arrive as Arrow string columns; all hashing works on their byte buffers with numpy, in chunks
of documents of about ``CHUNK_BYTES`` so that a worker's memory does not follow the batch size.

The *packed exchange* moves millions of (hash, position) entries as a few binary values: a chunk
sorts its entries by bucket and sends one row for each bucket it touches.  A bucket is a slice of the
hash space; their number follows the input's bytes, so that one bucket stays about as large at any
scale.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
BATCH_ROWS = 1000
NULL_ID = (1 << 63) - 1  # the order of a null doc_id; the id itself stays null
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 5)
_MASK = (1 << 64) - 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.  Where none is set, one machine has a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints/fissure"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Folder:
    """Tables written under the shared folder, to be read by the next step of a job and then deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few_parts(df: DataFrame, n_rows: int, each: int = 20_000) -> DataFrame:
    """Rows whose number is known to be at most ``n_rows``, in as many partitions as they need, without a shuffle.
    Small tables then cost a few tasks at each step, not one for every shuffle partition."""
    return df.coalesce(max(1, -(-n_rows // each)))


def small_batches(spark: SparkSession) -> None:
    """Documents are long: fewer of them cross to Python at a time than by Spark's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text) of a documents table; rid gives the order, in which a null doc_id is the largest."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def text_key() -> Column:
    """32 bits of a hash of the text: tells rows that share an id apart."""
    return F.shiftrightunsigned(F.xxhash64("text"), 32).alias("tk")


def null_key() -> Column:
    """0, or for a null doc_id 64 bits of a hash of the text: rows without an id are not all under one key."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")).alias("nk")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: the size from which numbers of buckets follow."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def buckets(n_bytes: int, each: int) -> int:
    return max(1, -(-n_bytes // each))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LONG_SPAN = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans.  Eight bytes at a time pass a nonlinear step that keeps different ones
    apart, so no arrangement of equal parts cancels out; spans over ``LONG_SPAN`` bytes go through blake2b."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, U64, padded, strides=(1,))  # the 8 bytes from each place on
    size = np.asarray(ends - starts, np.int64)
    h = mix(size.astype(U64) * BASE + U64(seed))
    short = np.where(size <= LONG_SPAN, size, 0)
    at = np.flatnonzero(short > 0)
    done = 0
    while len(at):
        left = short[at] - done
        part = eight[starts[at] + done]
        part &= ~U64(0) >> ((8 - np.minimum(left, 8)) * 8).astype(U64)
        h[at] = mix(h[at] ^ part)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of what ``a`` stands for followed by what ``b`` stands for."""
    return mix(a * BASE + b)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, at every start: runs of 1, 2, 4, ... values joined as k's bits ask."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, block, size, at = None, values, 1, 0
    while k:
        if k & 1:
            part = block[at : at + n]
            out = part if out is None else joined(out, part)
            at += size
        k >>= 1
        if k:
            block = joined(block[:-size], block[size:])
            size *= 2
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbouring values, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - first, lengths) + np.arange(total)


class Texts:
    """Documents of a chunk: ids, their bytes side by side, and offsets."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, offsets: np.ndarray, data: np.ndarray):
        self.batch, self.lo, self.hi = batch, lo, hi
        self.off = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        self.data = data[offsets[lo] : offsets[hi]]
        self.n = hi - lo

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.lo, self.n)

    def ids(self) -> np.ndarray:
        return self.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)

    def text_keys(self) -> np.ndarray:
        return self.column("tk").to_numpy(zero_copy_only=False).astype(np.uint32)

    def null_keys(self) -> np.ndarray:
        return self.column("nk").to_numpy(zero_copy_only=False).astype(np.int64)

    def runs(self, size: int) -> Iterator[tuple[int, int]]:
        """Bounds of runs of whole documents of about ``size`` bytes."""
        lo = 0
        while lo < self.n:
            hi = int(np.searchsorted(self.off, self.off[lo] + size, "right")) - 1
            hi = min(self.n, max(hi, lo + 1))
            yield lo, hi
            lo = hi

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word in the bytes, and the first word of each document (n + 1)."""
        return word_spans(self.data, self.off)

    def word_hashes(self, data: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = self.words()
        return span_hashes(self.data if data is None else data, starts, ends, seed), first


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs without space and \\t to \\r; they end at their document's end."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    now, before = inside[1:], inside[:-1]
    begin = now & ~before
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] |= now[cuts]
    ending = before & ~now
    ending[cuts] |= before[cuts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(ending)
    return starts, ends, np.searchsorted(starts, off)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_TUNED: list[bool] = []


def _tune() -> None:
    """In a worker, arrays over 8 MB go back to the system when freed, so no peak of an old task is kept."""
    if not _TUNED:
        _TUNED.append(True)
        if hasattr(ctypes.CDLL(None), "mallopt"):
            ctypes.CDLL(None).mallopt(-3, 8 << 20)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of whole documents of about ``size`` bytes; a null text counts as empty."""
    _tune()
    for batch in batches:
        col = batch.column(column)
        if col.null_count:
            col = col.fill_null("")
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        _, offs, values = col.buffers()
        n = len(col)
        if not n:
            continue
        offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield Texts(batch, lo, hi, offsets, data)
            lo = hi


def planes(a: np.ndarray) -> bytes:
    """Byte planes of an integer array: the shuffle's compression then removes the even ones."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def deltas(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def undeltas(b: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unplanes(b, dtype), dtype=dtype)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, the buckets that occur, and the bounds of their entries."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    count = np.bincount(bucket, minlength=0)
    found = np.flatnonzero(count)
    return order, found, np.r_[0, np.cumsum(count[found])]


PACK_BYTES = 12 << 20  # text whose entries are packed together


def gathered(parts: Iterator[tuple[Texts, dict[str, np.ndarray]]], size: int = PACK_BYTES) -> Iterator[dict[str, np.ndarray]]:
    """Entries of several chunks side by side, until their texts reach ``size`` bytes.

    Each part has ``ids`` (and any other ``doc_`` column) per document and the rest per entry; its
    ``doc`` numbers documents within the part.
    """
    held: list[dict[str, np.ndarray]] = []
    docs = n_bytes = 0
    for t, part in parts:
        if len(part["doc"]):
            held.append(part | {"doc": part["doc"] + docs})
            docs += len(part["ids"])
        n_bytes += len(t.data)
        if held and n_bytes >= size:
            yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            held, docs, n_bytes = [], 0, 0
    if held:
        yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}


def taken(entries: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """Some entries, with the columns of all documents."""
    return {k: v if k == "ids" or k.startswith("doc_") else v[at] for k, v in entries.items()}


def spread(entries: dict[str, np.ndarray], n_buckets: int) -> dict[str, np.ndarray]:
    """Entries that need no other ones, dealt by document: they are not in the way of a hot hash value."""
    return entries | {"bucket": (mix(entries["ids"][entries["doc"]].astype(U64)) % U64(n_buckets)).astype(np.int64)}


def packed(entries: dict[str, np.ndarray], n_buckets: int) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Entries by bucket: their order, the bounds of each packed row, and its columns.

    A row names only the documents that it has entries of, so rows stay as small as their entries
    however many buckets there are.
    """
    order, found, cut = by_bucket(entries["bucket"], n_buckets)
    doc, ids, pos = entries["doc"][order], entries["ids"], entries["pos"][order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    new[cut[:-1]] = True
    head = np.flatnonzero(new)
    count = np.diff(np.r_[head, len(doc)]).astype(np.uint32)
    step = np.diff(pos, prepend=0).astype(np.uint32)
    step[head] = pos[head]
    own = ids[doc[head]]
    edge = np.searchsorted(head, cut).tolist()
    out = {
        "bucket": pa.array(found, pa.int64()),
        "ids": pa.array([deltas(own[a:b]) for a, b in zip(edge, edge[1:])], pa.binary()),
        "count": pa.array([planes(count[a:b]) for a, b in zip(edge, edge[1:])], pa.binary()),
        "pos": pa.array([planes(step[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary()),
    }
    for name in ("tk", "nk"):
        if f"doc_{name}" in entries:
            of = entries[f"doc_{name}"][doc[head]]
            out[name] = pa.array([planes(of[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())
    return order, cut, out


PACKED = "bucket bigint, ids binary, count binary, pos binary"


def slices(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary())


def unpacked(table: pa.Table) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each packed row with its documents' ids, and each entry's document and position."""
    for batch in table.to_batches():
        for row in batch.to_pylist():
            count = unplanes(row["count"], np.uint32).astype(np.int64)
            step = unplanes(row["pos"], np.uint32).astype(np.int64)
            total = np.cumsum(step)
            head = np.cumsum(count) - count
            pos = total - np.repeat(total[head] - step[head], count)
            yield row, undeltas(row["ids"], np.int64), np.repeat(np.arange(len(count)), count), pos


def group_bounds(sorted_values: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.r_[0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in some [s, s + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(starts, 0, n), 1)
    np.add.at(step, np.clip(starts + lengths, 0, n), -1)
    return np.cumsum(step[:-1]) > 0
