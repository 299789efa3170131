"""At-least-once deliveries: exactly one row of each message.

A store is a folder of sorted runs, hash-bucketed by message identifier, with a manifest that names
the files that count. A later job opens the same folder and goes on.

* **Upsert.** Each map task sorts its rows in chunks and keeps one candidate per identifier of a
  chunk, so an identifier that holds a third of all rows sends a row a chunk through the shuffle.
  The candidates are written as sorted runs, one file for each run and bucket.
* **Compaction.** One task a bucket reads the bucket's runs side by side and merges them in
  identifier order, with one batch of each run in memory; equal identifiers collapse to one row. The
  merged run takes the old ones' place when the manifest is written.

The order of rows is total, so upserting the same rows again changes nothing. Whatever a chunk or a
merge drops is reported, which tells superseded rows without another pass over the input.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions.keys import micros_of, uuid_key
from studyloom.staging import new_path, stage

_NEVER = 2**63 - 1
#: Rows that a map task sorts at once.
CHUNK_ROWS = 500_000
#: Sorted runs that one upsert writes for each bucket; a map task's chunks go to them in turn.
RUNS = 3
#: Rows of one run that a merge holds.
MERGE_ROWS = 65_536
_MANIFEST = "manifest.json"
_ROW = pa.schema([("key", pa.binary()), ("at_us", pa.int64()), ("row_id", pa.int64())])
_ORDER = [("key", "ascending"), ("at_us", "ascending"), ("row_id", "ascending")]
_FLUSHED = pa.schema([("run", pa.int32()), *_ROW, ("lost", pa.bool_())])
_MERGED = pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("n_rows", pa.int64()), ("row_id", pa.int64())])


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows in order; which is the first of its identifier; and which of the others differ from their first."""
    table = table.take(pc.sort_indices(table, sort_keys=_ORDER)).combine_chunks()
    key, ids = table.column("key").combine_chunks(), table.column("row_id").to_numpy()
    first = np.r_[True, pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)] if len(key) else np.empty(0, bool)
    kept = ids[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(key) else ids
    return table, first, ~first & (ids != kept)


def _flush(chunk: int, runs: int):
    """Map side of an upsert: ``run, key, at_us, row_id, lost``, where ``lost`` rows are superseded within their chunk."""

    def flush(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()

        def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, first, lost = _sorted(pa.Table.from_batches(held))
            shown = np.flatnonzero(first | lost)
            table = table.take(pa.array(shown)).add_column(0, "run", pa.array(np.full(len(shown), turn % runs, np.int32))).append_column("lost", pa.array(lost[shown]))
            yield from table.cast(_FLUSHED).combine_chunks().to_batches(MERGE_ROWS)

        held, size = [], 0
        for batch in it:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                yield from emit(held)
                held, size, turn = [], 0, turn + 1
        if size:
            yield from emit(held)

    return flush


def merge_runs(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Merge sorted runs of ``key, at_us, row_id``: blocks of kept rows in order, and ids of the rows they supersede.

    In each step the smallest of the runs' last loaded identifiers is the bound up to which every run
    is known, so rows up to it can be merged and given out.
    """

    def load(run: Iterator[pa.RecordBatch]) -> pa.Table | None:
        return next((pa.Table.from_batches([b]) for b in run if b.num_rows), None)

    def up_to(table: pa.Table, bound: bytes) -> int:
        low, high, keys = 0, table.num_rows, table.column("key")
        while low < high:
            half = (low + high) // 2
            low, high = (half + 1, high) if keys[half].as_py() <= bound else (low, half)
        return low

    open_ = [[t, run] for run in runs if (t := load(run)) is not None]
    last_key, last_id = None, None
    while open_:
        bound = min(t.column("key")[-1].as_py() for t, _ in open_)
        ready, rest = [], []
        for t, run in open_:
            n = up_to(t, bound)
            ready.append(t.slice(0, n))
            left = t.slice(n) if n < t.num_rows else load(run)
            if left is not None:
                rest.append([left, run])
        open_ = rest
        table, first, lost = _sorted(pa.concat_tables(ready))
        if last_key is not None:  # the last identifier may go on
            same = int(up_to(table, last_key))
            ids = table.column("row_id").to_numpy()[:same]
            first[:same], lost[:same] = False, ids != last_id
        gone = table.column("row_id").to_numpy()[lost]
        kept = table.filter(pa.array(first))
        if kept.num_rows:
            last_key, last_id = kept.column("key")[-1].as_py(), kept.column("row_id")[-1].as_py()
        yield kept, gone


def _compaction(files: dict[int, list[str]], folder: str):
    """Merge the files of each bucket in ``id`` into one; a row for each written file, and one for each superseded row."""

    def compact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        system, base = FileSystem.from_uri(folder)
        for batch in it:
            for bucket in batch.column(0).to_pylist():
                if not files.get(bucket):
                    continue
                name, count = f"{base}/{bucket}-{uuid.uuid4().hex}.parquet", 0  # a task that is run again writes another file
                sources = [system.open_input_file(f) for f in files[bucket]]
                runs = [pq.ParquetFile(s).iter_batches(MERGE_ROWS, columns=list(_ROW.names)) for s in sources]
                with system.open_output_stream(name) as out, pq.ParquetWriter(out, _ROW, compression="zstd") as writer:
                    for kept, gone in merge_runs(runs):
                        writer.write_table(kept.cast(_ROW))
                        count += kept.num_rows
                        if len(gone):
                            nulls = [pa.nulls(len(gone), f.type) for f in (_MERGED.field("bucket"), _MERGED.field("file"), _MERGED.field("n_rows"))]
                            yield pa.RecordBatch.from_arrays([*nulls, pa.array(gone, pa.int64())], schema=_MERGED)
                for s in sources:
                    s.close()
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((bucket, name, count, None), _MERGED)], schema=_MERGED)

    return compact


class MessageStore:
    """Sorted runs of ``key binary, at_us long, row_id long`` in hash buckets below ``path``; ``at_us`` null is kept as the largest long.

    A store that exists at ``path`` is opened as it is (its number of buckets too); one job may write at a
    time. Without a path the store lives in the shared folder and ends with the process.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None):
        from pyarrow.fs import FileSystem

        self.spark = spark
        path = path or new_path(spark, "messages")
        self.path = path if "://" in path else f"file://{path.removeprefix('file:')}"
        self._system, self._base = FileSystem.from_uri(self.path)
        self._system.create_dir(self._base, recursive=True)
        found = self._read()
        self.buckets: int = found["buckets"] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Files of each bucket, all of them sorted.
        self.files: dict[int, list[str]] = {int(b): f for b, f in found["files"].items()} if found else {}

    def _read(self) -> dict | None:
        from pyarrow.fs import FileType

        name = f"{self._base}/{_MANIFEST}"
        if self._system.get_file_info(name).type != FileType.File:
            return None
        with self._system.open_input_stream(name) as lines:
            return json.loads(lines.read())

    def _commit(self) -> None:
        """Name the present files in the manifest; what it doesn't name doesn't count."""
        fresh = f"{self._base}/{uuid.uuid4().hex}.new"
        with self._system.open_output_stream(fresh) as out:
            out.write(json.dumps({"buckets": self.buckets, "files": self.files}).encode())
        self._system.move(fresh, f"{self._base}/{_MANIFEST}")

    def upsert(self, rows: DataFrame, chunk: int = CHUNK_ROWS, runs: int = RUNS) -> DataFrame:
        """Add rows of ``key, at_us, row_id`` as sorted runs; rows without a key are left out.

        Returns ``row_id`` of those that a row of the same map task supersedes already. Input is read once.
        """
        from pyarrow.fs import FileSelector

        narrow = rows.where("key is not null").select("key", F.coalesce(F.col("at_us"), F.lit(_NEVER)).alias("at_us"), F.col("row_id").cast("long").alias("row_id"))
        flushed = stage(narrow.mapInArrow(_flush(chunk, runs), "run int, key binary, at_us long, row_id long, lost boolean"), "flushed")
        name = f"runs-{uuid.uuid4().hex}"
        bucket = F.pmod(F.hash("key"), F.lit(self.buckets)).alias("bucket")
        placed = flushed.where("not lost").select("run", bucket, "key", "at_us", "row_id").repartitionById(self.buckets, "bucket")
        placed.sortWithinPartitions("run", "bucket", "key", "at_us", "row_id").write.partitionBy("run", "bucket").parquet(f"{self.path}/{name}")
        for info in self._system.get_file_info(FileSelector(f"{self._base}/{name}", recursive=True)):
            if info.base_name.endswith(".parquet"):
                bucket_of = int(info.path.rsplit("/bucket=", 1)[1].split("/", 1)[0])
                self.files.setdefault(bucket_of, []).append(info.path)
        self._commit()
        return flushed.where("lost").select("row_id")

    def compact(self) -> DataFrame:
        """Merge each bucket's runs into one. Returns ``row_id`` of the rows that are superseded by it; old files stay until :meth:`vacuum`."""
        folder = f"{self.path}/merged-{uuid.uuid4().hex}"
        self._system.create_dir(f"{self._base}/{folder.rsplit('/', 1)[1]}", recursive=True)
        buckets = self.spark.range(0, self.buckets, 1, self.buckets)
        merged = stage(buckets.mapInArrow(_compaction(self.files, folder), "bucket int, file string, n_rows long, row_id long"), "merged")
        done = merged.where("file is not null").select("bucket", "file").collect()  # one row a bucket
        self.files = {r.bucket: [r.file] for r in done}
        self._commit()
        return merged.where("file is null").select("row_id")

    def rows(self) -> DataFrame:
        """All rows of the store, ``key, at_us, row_id``; one for each identifier after :meth:`compact`."""
        scheme = self.path.split("://", 1)[0]
        files = [f if "://" in f else f"{scheme}://{f}" for names in self.files.values() for f in names]
        schema = "key binary, at_us long, row_id long"
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def vacuum(self) -> None:
        """Remove files that the manifest doesn't name. DataFrames that read them must not be used afterwards."""
        from pyarrow.fs import FileSelector

        named = {f for names in self.files.values() for f in names} | {f"{self._base}/{_MANIFEST}"}
        for info in self._system.get_file_info(FileSelector(self._base, recursive=True)):
            if info.is_file and info.path not in named:
                self._system.delete_file(info.path)


def message_rows(submissions: DataFrame) -> DataFrame:
    """``key, at_us, row_id`` of each delivery; ``key`` is null where no message is identified."""
    at = F.coalesce(micros_of(submissions, "submitted_at"), F.lit(_NEVER))
    return submissions.select(uuid_key("submission_id").alias("key"), at.alias("at_us"), F.col("delivery_id").alias("row_id"))


def superseded_deliveries(submissions: DataFrame, store: MessageStore | None = None) -> DataFrame:
    """``delivery_id`` of every row that repeats a message and isn't the one to keep.

    The kept row has the earliest ``submitted_at`` (null last), then the smallest ``delivery_id``.
    Rows that identify no message never appear. Empty input gives no rows. ``delivery_id`` must be
    unique; columns besides the three used may have any name and content. With a ``store`` of earlier
    batches, rows of these that the new ones supersede are in the result too; rows that were upserted before
    (the same delivery again) aren't.
    """
    store = store or MessageStore(submissions.sparkSession)
    early = store.upsert(message_rows(submissions))
    return early.unionByName(store.compact()).withColumnRenamed("row_id", "delivery_id")


def unique_messages(submissions: DataFrame, store: MessageStore | None = None) -> DataFrame:
    """The input without superseded deliveries; rows that identify no message are all kept."""
    gone = superseded_deliveries(submissions, store)
    return submissions.join(gone, "delivery_id", "left_anti")


def message_identity(row_id: Column) -> Column:
    """Key for rows that identify no message: the row's own number, eight bytes, never equal to a UUID's sixteen."""
    return F.unhex(F.lpad(F.hex(row_id), 16, "0"))
