"""Helpers shared by the training-data operators: scratch tables, chunked Arrow
maps, vectorised word and shingle hashing, ranking within hot groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)


#: Bytes of text that a task works on at a time, and of an Arrow batch on its way there.
CHUNK, BATCH = 1 << 18, 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows and by 64 MB as Spark comes; texts need less, or
    buffers on both sides of the pipe take much of an executor. A lower setting stays."""
    now = spark.sql(f"SET {_BATCH_CONF}").first()["value"].rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(_BATCH_CONF, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or the
    checkpoint directory already set on the context. A local session that has
    neither gets a temporary folder; a cluster session without one is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages then restart
    from files and not from lost executors, and Catalyst sees the real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote, when all that was made of them is written itself."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, getattr(df, "_table", None)
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes, one row at least,
    so that a task's memory doesn't depend on the length of an Arrow batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows, start + 8192)
            yield batch.slice(start, end - start)
            start = end


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = CHUNK) -> DataFrame:
    """mapInArrow over chunks; fn makes a batch from a batch."""
    small_batches(df.sparkSession)

    def run(batches):
        for chunk in chunks(batches, limit):
            yield fn(chunk)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw[1], kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _MUL
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_KEEP = np.arange(256, dtype=np.uint64)
#: Bytes whose sums are taken together; the tables of powers hold no more.
WINDOW = 1 << 18
_UP, _DOWN = (np.multiply.accumulate(np.array([1] + [x] * WINDOW, U64)) for x in (_BASE, _INV))


def _range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of data that are in order and don't overlap. Sums are taken a
    window at a time, so that memory beside the data doesn't grow with a text's length; a
    range that goes on in the next window adds up its parts."""
    raw = np.zeros(len(starts), U64)
    for lo in range(0, len(data), WINDOW):
        some = data[lo : lo + WINDOW]
        i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + len(some), "left")
        if i >= j:
            continue
        total = np.zeros(len(some) + 1, U64)
        np.cumsum((code[some] + U64(1)) * _UP[: len(some)], out=total[1:])
        s, e = np.maximum(starts[i:j] - lo, 0), np.minimum(ends[i:j] - lo, len(some))
        part = (total[e] - total[s]) * _DOWN[s]
        if starts[i] < lo:
            part[:1] *= U64(pow(_BASE, lo - int(starts[i]), 1 << 64))
        raw[i:j] += part
    return mix(raw ^ ((ends - starts).astype(U64) * _MUL))


def _word_edges(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and where they end, as flags a byte (of its last one)."""
    solid = ~_SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    starts[heads] = solid[heads]
    ends[heads[1:] - 1] = solid[heads[1:] - 1]
    return starts, ends


def word_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Words of each of the concatenated texts."""
    starts = np.flatnonzero(_word_edges(offsets, data)[0]) if len(data) else np.zeros(0, np.int64)
    return np.diff(np.searchsorted(starts, offsets))


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of concatenated texts.

    Returns the hash of each word (A-Z lower-cased if `lower`), the bounds of each
    text in that array (one more than texts), and the words' starts and ends in data.
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), empty, empty
    starts, ends = _word_edges(offsets, data)
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return _range_hashes(data, starts, ends, _LOWER if lower else _KEEP), np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and the bounds of each
    text among them. A text with fewer than k words has its whole sequence as one;
    one without words has none."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(out_bounds[-1], U64)
    total = len(hashes) - k + 1
    if total > 0:
        rolled = np.full(total, U64(k))
        for j in range(k):
            rolled = mix(rolled ^ hashes[j : j + total])
        owner = np.repeat(np.arange(len(counts)), sizes)
        at = bounds[:-1][owner] + np.arange(len(owner)) - out_bounds[:-1][owner]
        long = counts[owner] >= k
        out[long] = rolled[at[long]]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = U64(counts[d])
        for x in hashes[bounds[d] : bounds[d + 1]]:
            h = mix(np.array([h ^ x], U64))[0]
        out[out_bounds[d]] = h
    return out, out_bounds


def list_array(values: np.ndarray, bounds: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def salt(salts: int, *columns: str) -> Column:
    """A salt for `ranked`, to be written with the rows: a hash of columns and of a small
    part of the row's number, so that equal rows get several."""
    return F.pmod(F.xxhash64(*columns, F.pmod(F.monotonically_increasing_id(), F.lit(64))), F.lit(salts))


def ranked(df: DataFrame, key: list[str], order: list[str], salt: str, name: str = "rank") -> DataFrame:
    """Rank from 0 within a key that may hold a third of all rows: rows are numbered
    within (key, salt) and moved by the counts of the salts before; the salt is a column
    of df. Ranks are gapless; rows equal in `order` come in any order."""
    salted = df.withColumnRenamed(salt, "_salt")
    counts = salted.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy(*key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_row", F.row_number().over(own))
        .join(starts, [*key, "_salt"])
        .withColumn(name, (F.col("_from") + F.col("_row") - 1).cast("long"))
        .drop("_salt", "_from", "_row")
    )


def bounded_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """About the n rows that are least by a hash of their keys, at most n. Rows are
    counted and then passed by a threshold, so that no task sees more than a little over
    n of them; the rest of the order decides what is over."""
    total = df.count()
    h = F.xxhash64(*keys)
    if total > n:
        share = min(1.0, 1.2 * n / total + 100 / total)
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), *keys).limit(n)


def within_bytes(df: DataFrame, order: list[str], size: Column, limit: int) -> DataFrame:
    """Rows of a bounded sample, by a hash of `order`, as long as their sizes add up to
    `limit` at most; the sums run over the sample's sizes alone, in one task. Rows above a
    64th of the limit are left out. df must be a written table."""
    rank = F.pmod(F.xxhash64(*order), F.lit(1 << 40))
    sizes = df.select(*order, rank.alias("_rank"), size.cast("long").alias("_size")).where(F.col("_size") <= limit // 64)
    total = F.sum("_size").over(Window.orderBy("_rank", *order).rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("_total", total).where(F.col("_total") <= limit).select(*order)
    return df.join(kept, order, "left_semi")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a table that may have any others."""
    return df.select(*columns)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of data that are in order."""
    return _range_hashes(data, starts, ends, _KEEP)


def count_within(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags stand in each range of bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


SLOTS = 1 << 24


def slot(column: str, slots: int = SLOTS) -> Column:
    """The place of a value in a bitmap of so many bits."""
    return F.pmod(F.xxhash64(column), F.lit(slots))


def bitmap(df: DataFrame, place: Column, slots: int = SLOTS) -> np.ndarray:
    """Places as bits: slots / 8 bytes whatever the rows. It lets a map pass over most rows
    that a join would drop; the join still decides."""
    word = df.select(place.alias("p")).select(F.floor(F.col("p") / 64).alias("w"), (F.col("p") % 64).cast("int").alias("b"))
    word = word.select("w", F.expr("shiftleft(1L, b)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    rows = word.toArrow()  # slots / 64 rows at most
    out = np.zeros(slots // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1
