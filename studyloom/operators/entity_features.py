"""One row per entity with count, latest time and total of each of hundreds of event kinds.

Map tasks add up their own rows for each entity and kind, so an entity or kind that holds a third of
all rows reaches the shuffle as one cell a chunk, and raw rows are never shuffled. The cells of a
chunk go out in one row for each block of entities (a block is a range of the entity's hash).

The task that gets a block gives its entities dense ordinals. For each kind, counts and totals are
bit-sliced numbers: slice ``i`` is a bitmap over the ordinals that holds bit ``i`` of every entity's
value. Two such numbers are added by ripple carry over whole bitmaps (exclusive-or for the sum, and for
the carry), so adding costs the same for one entity as for a full block. Between additions bitmaps are
held compressed, as ordinals where few bits are set. Latest times are arrays aligned with the ordinals,
joined by maximum. In the end the slices are decoded into entity rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions.keys import iso_micros, joined_words

#: Entities that a block has on average.
BLOCK = 2048
#: Rows that a map task adds up at once.
CHUNK_ROWS = 1_000_000
#: Cells that a block collects before it adds them to its bit-sliced numbers.
FLUSH_CELLS = 500_000
#: Totals are whole numbers of this fraction, so that adding is exact in any order.
UNIT = 1_000_000
_NO_TIME = -(2**63)
#: Weights are carried in two parts of this many bits, so that the sums of a chunk stay exact.
_LOW_BITS = 31
_LOW = 2**_LOW_BITS - 1
_ARRAYS = ("ordinal", "kind", "count", "plus", "plus_high", "minus", "minus_high", "latest")
_CHUNK = "block long, entities array<string>, kinds array<string>, cells array<binary>"
_CHUNK_ARROW = pa.schema([("block", pa.int64()), ("entities", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("cells", pa.list_(pa.binary()))])
_ROWS = "entity string, counts map<string,bigint>, latest_us map<string,bigint>, totals map<string,double>"


# --- bit-sliced numbers: a list of Python integers, each a bitmap over the block's ordinals ---


def slices_of(ordinals: np.ndarray, values: np.ndarray) -> list[int]:
    """Bit slices of non-negative ``values`` at distinct ``ordinals``."""
    top = int(values.max()).bit_length() if len(values) else 0
    if not top:
        return []
    grid = np.zeros((top, int(ordinals.max()) + 1), np.uint8)
    grid[:, ordinals] = (values[None, :] >> np.arange(top)[:, None]) & 1
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(grid, axis=1, bitorder="little")]


def carry_add(into: list[int], other: list[int]) -> None:
    """Add the bit-sliced number ``other`` to ``into`` by carries over whole bitmaps."""
    carry = 0
    for i in range(max(len(into), len(other)) + 1):
        if i >= len(other) and not carry:
            return
        if i >= len(into):
            into.append(0)
        a, b = into[i], other[i] if i < len(other) else 0
        half = a ^ b
        into[i] = half ^ carry
        carry = (a & b) | (carry & half)
    while into and not into[-1]:
        into.pop()


def _bits(bitmap: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap.to_bytes((width + 7) // 8, "little"), np.uint8), bitorder="little", count=width)


def values_of(slices: list[int], width: int) -> np.ndarray:
    """The values of ordinals ``0 ... width - 1``; as floats where they don't fit 62 bits."""
    out = np.zeros(width, np.int64 if len(slices) <= 62 else np.float64)
    for i, bitmap in enumerate(slices):
        out += _bits(bitmap, width).astype(out.dtype) * (1 << i if len(slices) <= 62 else 2.0**i)
    return out


def pack(slices: list[int]) -> list[tuple[int, bytes]]:
    """Compressed form: for each slice its number of set bits with its ordinals where they are few, else with the bitmap."""
    parts = []
    for bitmap in slices:
        n, size = bitmap.bit_count(), (bitmap.bit_length() + 7) // 8
        few = 4 * n < size
        parts.append((n if few else -1, np.flatnonzero(_bits(bitmap, 8 * size)).astype(np.uint32).tobytes() if few else bitmap.to_bytes(size, "little")))
    return parts


def unpack(parts: list[tuple[int, bytes]]) -> list[int]:
    """Inverse of :func:`pack`."""
    out = []
    for n, data in parts:
        if n < 0:
            out.append(int.from_bytes(data, "little"))
            continue
        bitmap = 0
        for at in np.frombuffer(data, np.uint32).tolist():
            bitmap |= 1 << at
        out.append(bitmap)
    return out


class Sliced:
    """Counts, totals and latest times of one kind over one block."""

    def __init__(self) -> None:
        self.numbers: dict[str, list[tuple[int, bytes]]] = {}
        self.latest = np.empty(0, np.int64)

    def add(self, ordinals: np.ndarray, cells: dict[str, np.ndarray]) -> None:
        for name in ("count", "plus", "minus"):
            number = slices_of(ordinals, cells[name])
            if name != "count" and cells[f"{name}_high"].any():
                carry_add(number, [0] * _LOW_BITS + slices_of(ordinals, cells[f"{name}_high"]))
            if number:
                running = unpack(self.numbers.get(name, []))
                carry_add(running, number)
                self.numbers[name] = pack(running)
        if len(ordinals) and ordinals.max() >= len(self.latest):
            self.latest = np.append(self.latest, np.full(int(ordinals.max()) + 1, _NO_TIME))
        self.latest[ordinals] = np.maximum(self.latest[ordinals], cells["latest"])

    def values(self, name: str, width: int) -> np.ndarray:
        return values_of(unpack(self.numbers.get(name, [])), width)


# --- cells: sums of one entity and kind ---


def _add_up(cells: dict[str, np.ndarray], major: str, minor: str) -> dict[str, np.ndarray]:
    """One cell for each pair of ``major`` and ``minor``, sorted by both."""
    order = np.lexsort((cells[minor], cells[major]))
    a, b = cells[major][order], cells[minor][order]
    begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    out = {major: a[begin], minor: b[begin]}
    for name in _ARRAYS[2:]:
        reduce = np.maximum if name == "latest" else np.add
        out[name] = reduce.reduceat(cells[name][order], begin) if len(a) else cells[name]
    for name in ("plus", "minus"):  # the low part stays below its size, for any number of additions
        out[f"{name}_high"] = out[f"{name}_high"] + (out[name] >> _LOW_BITS)
        out[name] = out[name] & _LOW
    return out


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; nothing for zeros alone."""
    if not values.any():
        return b""
    kind = next((k for k in ("<u1", "<u2", "<u4") if values.min() >= 0 and values.max() <= np.iinfo(k).max), "<i8")
    return kind.encode() + values.astype(kind).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), n, 3).astype(np.int64) if data else np.zeros(n, np.int64)


def _combine(chunk: int):
    """Map side: ``block, entity, units, at_us, kinds`` to the cells of each chunk, one row a block."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        named = table.column("entity").combine_chunks().dictionary_encode(null_encoding="encode")
        entity = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        block_of = np.zeros(len(named.dictionary), np.int64)
        block_of[entity] = table.column("block").to_numpy()
        by_block = np.argsort(block_of, kind="stable")
        rank = np.empty_like(by_block)
        rank[by_block] = np.arange(len(by_block))
        lists = table.column("kinds").combine_chunks()
        row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
        kinds = lists.flatten().dictionary_encode()
        units = table.column("units").to_numpy()[row]
        plus, minus = np.maximum(units, 0), np.maximum(-units, 0)
        cells = {"ordinal": rank[entity[row]], "kind": kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), "count": np.ones(len(row), np.int64), "latest": table.column("at_us").to_numpy()[row]}
        cells |= {"plus": plus & _LOW, "plus_high": plus >> _LOW_BITS, "minus": minus & _LOW, "minus_high": minus >> _LOW_BITS}
        cells = _add_up(cells, "ordinal", "kind")
        blocks, first = np.unique(block_of[by_block], return_index=True)
        last = np.append(first[1:], len(by_block))
        edges = np.searchsorted(cells["ordinal"], np.append(first, len(by_block)))
        out: list[list] = [[] for _ in range(4)]
        for block, a, b, x, y in zip(blocks.tolist(), first, last, edges, edges[1:]):
            part = {name: values[x:y] for name, values in cells.items()}
            part["ordinal"] = part["ordinal"] - a
            used, part["kind"] = np.unique(part["kind"], return_inverse=True)
            row_ = (block, named.dictionary.take(pa.array(by_block[a:b])).to_pylist(), kinds.dictionary.take(pa.array(used)).to_pylist(), [int(y - x).to_bytes(4, "little"), *(_packed(part[name]) for name in _ARRAYS)])
            for column, value in zip(out, row_):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CHUNK_ARROW)], schema=_CHUNK_ARROW)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


class _Block:
    """Entities and kinds of one block with their numbers."""

    def __init__(self, flush: int) -> None:
        self.entities: dict[str | None, int] = {}
        self.kinds: dict[str, int] = {}
        self.sums: list[Sliced] = []
        self.held: list[dict[str, np.ndarray]] = []
        self.size, self.most = 0, flush

    def add(self, entities: list[str | None], kinds: list[str], cells: list[bytes]) -> None:
        n = int.from_bytes(cells[0], "little")
        part = {name: _unpacked(data, n) for name, data in zip(_ARRAYS, cells[1:])}
        for name, known, words in (("ordinal", self.entities, entities), ("kind", self.kinds, kinds)):
            codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
            part[name] = codes[part[name]] if n else part[name]
        self.held.append(part)
        self.size += n
        if self.size >= self.most:
            self.flush()

    def flush(self) -> None:
        self.sums += [Sliced() for _ in range(len(self.kinds) - len(self.sums))]
        if not self.size:
            return
        cells = _add_up({name: np.concatenate([p[name] for p in self.held]) for name in _ARRAYS}, "kind", "ordinal")
        first = np.flatnonzero(np.r_[True, np.diff(cells["kind"]) != 0])
        for a, b in zip(first, np.append(first[1:], len(cells["kind"]))):
            self.sums[cells["kind"][a]].add(cells["ordinal"][a:b], {name: cells[name][a:b] for name in _ARRAYS[2:]})
        self.held, self.size = [], 0

    def rows(self) -> pa.RecordBatch:
        self.flush()
        width = len(self.entities)
        ordinal, kind, count, latest, total = [], [], [], [], []
        for i, s in enumerate(self.sums):
            counts = s.values("count", width)
            at = np.flatnonzero(counts)
            ordinal.append(at)
            kind.append(np.full(len(at), i))
            count.append(counts[at])
            latest.append(s.latest[at])
            total.append((s.values("plus", width)[at] - s.values("minus", width)[at]) / UNIT)
        cat = lambda parts, kind_: np.concatenate(parts).astype(kind_) if parts else np.empty(0, kind_)
        ordinal, kind, count, latest, total = (cat(p, t) for p, t in ((ordinal, np.int64), (kind, np.int64), (count, np.int64), (latest, np.int64), (total, np.float64)))
        order = np.lexsort((kind, ordinal))
        ordinal, kind, count, latest, total = ordinal[order], kind[order], count[order], latest[order], total[order]
        offsets = pa.array(np.searchsorted(ordinal, np.arange(width + 1)).astype(np.int32))
        keys = pa.array(list(self.kinds), pa.string()).take(pa.array(kind))
        maps = [pa.MapArray.from_arrays(offsets, keys, values) for values in (pa.array(count), pa.array(latest, mask=latest == _NO_TIME), pa.array(total))]
        return pa.RecordBatch.from_arrays([pa.array(list(self.entities), pa.string()), *maps], ["entity", "counts", "latest_us", "totals"])


def _accumulate(flush: int):
    """Entity rows of each block; input is sorted by block, one block is held."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, _Block(flush)
        for batch in it:
            for at, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if at != number:
                    if block.entities:
                        yield block.rows()
                    number, block = at, _Block(flush)
                block.add(*parts)
        if block.entities:
            yield block.rows()

    return run


def feature_rows(events: DataFrame, chunk: int = CHUNK_ROWS, flush: int = FLUSH_CELLS) -> DataFrame:
    """``entity, counts, latest_us, totals`` of ``events(entity, kinds array<string>, weight double, at_us long)``.

    The three maps are keyed by kind; a kind appears where the entity has at least one such event.
    An event counts once for each kind it lists; null and repeated kinds in one event are ignored.
    A null, infinite or undefined weight adds nothing, nor does one of ``2**62 / UNIT`` or more; weights
    are rounded to one in :data:`UNIT` and added exactly. The latest time of a kind without a readable
    time is null. A null entity is an entity of its own, and one whose events list no kind has empty
    maps. Repeated rows count. Empty input gives no rows.

    The number of blocks follows from an estimate of the number of entities, for which their column is read once.
    """
    weight = F.when(F.abs("weight") < 2.0**62 / UNIT, F.round(F.col("weight") * UNIT).cast("long"))
    entity = F.col("entity").cast("string")
    estimate = events.agg(F.approx_count_distinct(entity)).first()[0]
    blocks = estimate // BLOCK + 1
    narrow = events.select(
        F.pmod(F.xxhash64(entity), F.lit(blocks)).alias("block"),
        entity.alias("entity"),
        F.array_distinct(F.array_compact(F.coalesce("kinds", F.array().cast("array<string>")))).alias("kinds"),
        F.coalesce(weight, F.lit(0)).alias("units"),
        F.coalesce("at_us", F.lit(_NO_TIME)).alias("at_us"),
    )
    cells = narrow.mapInArrow(_combine(chunk), _CHUNK)
    return cells.repartition("block").sortWithinPartitions("block").mapInArrow(_accumulate(flush), _ROWS)


def profile_event_kinds(profile_events: DataFrame) -> DataFrame:
    """Error events as input of :func:`feature_rows`: kinds ``tag:<tag>`` and ``subtype:<subtype>``, in one spelling each."""
    kinds = F.array(F.concat(F.lit("tag:"), joined_words("tag")), F.concat(F.lit("subtype:"), joined_words("subtype")))
    return profile_events.select(F.col("student_id").alias("entity"), kinds.alias("kinds"), "weight", iso_micros("ts").alias("at_us"))


def learner_features(profile_events: DataFrame) -> DataFrame:
    """One row per ``student_id`` over all kinds of error event; see :func:`feature_rows`."""
    rows = feature_rows(profile_event_kinds(profile_events))
    return rows.select(F.col("entity").alias("student_id"), F.size("counts").alias("n_kinds"), "counts", "latest_us", "totals")


def feature_cells(features: DataFrame) -> DataFrame:
    """Long form of :func:`learner_features`: one row per entity and kind."""
    kind = F.explode(F.map_keys("counts")).alias("kind")
    at = lambda c: F.col(c)[F.col("kind")]
    return features.select("student_id", kind, "counts", "latest_us", "totals").select("student_id", "kind", at("counts").alias("n_events"), at("latest_us").alias("latest_us"), at("totals").alias("total_weight"))
