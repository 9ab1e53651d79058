"""Vector code compression: exact Lloyd rounds per part position, kept cheap by heaps.

Every vector is cut into equal parts and each part position has its own codebook.  A block of vectors keeps, for each part position
and entry, a heap of the parts assigned to that entry, keyed by lower bound minus upper bound (how much nearer this entry is than
any other) plus the entry's drift when it was pushed.  When entries move, an entry's drift grows by its own move and the
largest move of another; only parts whose key is within that drift can have another nearest entry, and they
are on top of the heap.  They are popped and measured again against all entries, in exact integers; the others are not looked at.

Plan.  Vectors are packed to blocks of whole numbers once, dealt to buckets and written as a table bucketed by block in the shared folder; so are the heaps of each round.
A round pairs both tables bucket by bucket, with no exchange, gives the changed heaps and what parts that moved take from and add to
their entries, and Spark sums those changes: a few rows.  The codebooks (parts x entries x part length) are what the driver holds and sends out.
A lost executor repeats one round's tasks from the tables.

Defined results.  A row whose vector is null, empty or holds null or non-finite components is dropped, as is one whose length differs from
that of the smallest kept vec_id (the shortest vector of several) or is no multiple of the parts.  Rows that repeat a vec_id are each
coded; null vec_ids come last in order.  Fewer rows than entries give as many entries as rows; equal first vectors give equal entries, of which the
first is used.  Ties go to the lower entry.  Components beyond 2**62 after scaling are taken as 2**62, errors beyond a long as the
largest long.  No row kept gives no row.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Shelf, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors and components of one block at most, and vectors of one bucket, the unit of a task.
BLOCK, BLOCK_COMPONENTS, BUCKET = 16_384, 1 << 23, 1 << 17
_MOST = 1 << 62
_LONG = (1 << 63) - 1
#: Relative room for rounding in bounds.
_ROOM = 1e-9


def _whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as the smallest fitting integers."""
    x = np.clip(np.floor(flat.astype(np.float64) * scale), -float(_MOST), float(_MOST)).astype(np.int64)
    most = int(np.abs(x).max()) if len(x) else 0
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


class Codebooks:
    """Entries of every part position, as whole numbers, with each entry's drift."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.parts, self.size, self.width = len(entries), len(entries[0]), len(entries[0][0])
        self.drift = np.zeros((self.parts, self.size))
        self._arrays()

    def _arrays(self) -> None:
        most = max((abs(x) for p in self.entries for e in p for x in e), default=0)
        self.most = most
        self.small = np.array(self.entries, dtype=np.float64) if most < 1 << 40 else None

    def moved(self, sums: dict[tuple[int, int], list[int]]) -> None:
        """Replaces entries by the floor of their parts' mean; sums: of (part, entry) the components' sums and the count."""
        step = np.zeros((self.parts, self.size))
        for (p, e), own in sums.items():
            if own[-1]:
                new = [x // own[-1] for x in own[:-1]]
                step[p, e] = float(sum((x - y) ** 2 for x, y in zip(new, self.entries[p][e], strict=True))) ** 0.5
                self.entries[p][e] = new
        self._arrays()
        step *= 1 + _ROOM
        if self.size > 1:
            at, top = np.arange(self.parts), step.argmax(axis=1)
            other, rest = np.repeat(step.max(axis=1, keepdims=True), self.size, axis=1), step.copy()
            rest[at, top] = 0
            other[at, top] = rest.max(axis=1)
            self.drift = self.drift + step + other

    def distances(self, part: int, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of x to the entries; whole numbers, as Python integers where 53 bits do not hold them."""
        most = max(self.most, int(np.abs(x).max()) if x.size else 0)
        if self.small is not None and 4 * most * most * self.width < 1 << 52:
            c, y = self.small[part], x.astype(np.float64)
            return (y * y).sum(axis=1)[:, None] - 2 * (y @ c.T) + (c * c).sum(axis=1)[None, :]
        c, y = np.array(self.entries[part], dtype=object), x.astype(object)
        return np.stack([((y - row) ** 2).sum(axis=1) for row in c], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for p in self.entries for e in p for x in e).encode()).hexdigest()


class Heaps:
    """For each part position and entry a heap of (key, row), held as arrays in heap order."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.sizes, self.keys, self.rows = sizes, keys, rows

    @classmethod
    def load(cls, data: bytes, books: Codebooks) -> Heaps:
        import zstandard

        raw, k = zstandard.ZstdDecompressor().decompress(data), books.parts * books.size
        sizes = np.frombuffer(raw, "<i4", k)
        n = int(sizes.sum())
        return cls(sizes.reshape(books.parts, books.size), np.frombuffer(raw, "<f8", n, 4 * k), np.frombuffer(raw, "<i4", n, 4 * k + 8 * n))

    def dump(self) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(self.sizes.astype("<i4").tobytes() + self.keys.astype("<f8").tobytes() + self.rows.astype("<i4").tobytes())

    def of(self) -> Iterator[tuple[int, int, slice]]:
        ends = np.cumsum(self.sizes.reshape(-1))
        for k, end in enumerate(ends.tolist()):
            yield *divmod(k, self.sizes.shape[1]), slice(end - int(self.sizes.flat[k]), end)

    def codes(self, n: int) -> np.ndarray:
        out = np.zeros((n, self.sizes.shape[0]), np.uint8)
        for p, e, own in self.of():
            out[self.rows[own], p] = e
        return out


def _measured(books: Codebooks, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its key before drift: the second nearest's distance minus the nearest's, rounded down."""
    d = books.distances(part, x)
    if d.dtype == object:
        nearest = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
        d = d.astype(np.float64)
    else:
        nearest = d.argmin(axis=1)
    if books.size == 1:
        return nearest, np.full(len(x), np.inf)
    root = np.sqrt(d)
    upper = root[np.arange(len(x)), nearest]
    root[np.arange(len(x)), nearest] = np.inf
    lower = root.min(axis=1)
    return nearest, (lower - upper) - _ROOM * (lower + upper)


def refresh(books: Codebooks, vectors: np.ndarray, heaps: Heaps | None) -> tuple[Heaps, list[tuple[int, int, np.ndarray]], int]:
    """The heaps under moved codebooks, the parts that changed their entry as (part, from or -1, to, rows), and how many were measured."""
    n, keep, changes, measured = len(vectors), {}, [], 0
    popped = {p: ([], []) for p in range(books.parts)}
    if heaps is None:
        popped = {p: ([np.arange(n)], [np.full(n, -1)]) for p in range(books.parts)}
    else:
        for p, e, own in heaps.of():
            limit = float(books.drift[p, e])
            limit += _ROOM * limit
            if own.start == own.stop or heaps.keys[own.start] > limit:
                keep[p, e] = (heaps.keys[own], heaps.rows[own])
                continue
            heap, out = list(zip(heaps.keys[own].tolist(), heaps.rows[own].tolist(), strict=True)), []
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
            keep[p, e] = heap
            popped[p][0].append(np.array(out, np.int64))
            popped[p][1].append(np.full(len(out), e))
    for p, (rows, was) in popped.items():
        if not rows:
            continue
        rows, was = np.concatenate(rows), np.concatenate(was)
        measured += len(rows)
        width = books.width
        nearest, slack = _measured(books, p, vectors[rows, p * width : (p + 1) * width])
        key = slack + books.drift[p, nearest]
        key -= _ROOM * np.abs(key)
        for e in np.unique(nearest).tolist():
            own = np.flatnonzero(nearest == e)
            heap = keep.get((p, e), [])
            if isinstance(heap, tuple):
                heap = list(zip(heap[0].tolist(), heap[1].tolist(), strict=True))
            new = list(zip(key[own].tolist(), rows[own].tolist(), strict=True))
            if len(new) > len(heap):
                heap = heap + new
                heapq.heapify(heap)
            else:
                for item in new:
                    heapq.heappush(heap, item)
            keep[p, e] = heap
        for pair in np.unique(was[was != nearest] * books.size + nearest[was != nearest]).tolist():
            a, b = divmod(pair, books.size)
            changes.append((p, a, b, rows[(was == a) & (nearest == b)]))
    sizes, keys, rows = np.zeros((books.parts, books.size), np.int32), [], []
    for p in range(books.parts):
        for e in range(books.size):
            heap = keep.get((p, e), [])
            own = heap if isinstance(heap, tuple) else (np.array([k for k, _ in heap], np.float64), np.array([r for _, r in heap], np.int32))
            sizes[p, e] = len(own[0])
            keys.append(own[0])
            rows.append(own[1])
    return Heaps(sizes, np.concatenate(keys), np.concatenate(rows)), changes, measured


def _packed(scale: int, block: int):
    """Rows (item, vector) as blocks: the items beside the vectors' whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def block_of(table: pa.Table, number: int) -> pa.RecordBatch:
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x, own = _whole(flat, scale), table.column("item").combine_chunks()
            data = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
            columns = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([x.itemsize], pa.int32()), pa.array([data])]
            return pa.RecordBatch.from_arrays(columns, names=["block", "items", "bytes", "vectors"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= block:
                table = pa.Table.from_batches(held)
                yield block_of(table.slice(0, block), number)
                held, rows, number = table.slice(block).to_batches(), rows - block, number + 1
        if rows:
            yield block_of(pa.Table.from_batches(held), number)

    return run


def _vectors(row: pa.Table) -> np.ndarray:
    import zstandard

    size, raw = row.column("bytes")[0].as_py(), zstandard.ZstdDecompressor().decompress(row.column("vectors")[0].as_py())
    n = len(row.column("items")[0])
    flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(f"<i{size}").reshape(-1)
    return flat.reshape(n, -1)


_CHANGE = pa.list_(pa.struct([("place", pa.int64()), ("by", pa.decimal128(38, 0))]))
_ROUND = pa.schema([("block", pa.int64()), ("heaps", pa.binary()), ("changes", _CHANGE), ("measured", pa.int64())])
_ROUNDS = "block long, heaps binary, changes array<struct<place:long,by:decimal(38,0)>>, measured long"


def _state(books: Codebooks, tables: tuple) -> tuple[np.ndarray, Heaps, list, int]:
    """A block's vectors and its heaps under the codebooks; tables: the vectors and, after the first round, the heaps of the round before."""
    x = _vectors(tables[0])
    return x, *refresh(books, x, Heaps.load(tables[1].column("heaps")[0].as_py(), books) if len(tables) > 1 else None)


def _round(broadcast):
    def run(key: tuple, *tables: pa.Table) -> pa.Table:
        books = broadcast.value
        x, heaps, changes, measured = _state(books, tables)
        width, by = books.width, {}
        for p, a, b, rows in changes:
            own = x[rows, p * width : (p + 1) * width]
            sums = [*own.astype(np.int64 if own.itemsize < 8 else object).sum(axis=0).tolist(), len(rows)]
            for entry, sign in ((a, -1), (b, 1)):
                if entry >= 0:
                    for k, s in enumerate(sums):
                        if s:
                            place = (p * books.size + entry) * (width + 1) + k
                            by[place] = by.get(place, 0) + sign * s
        found = pa.array([[{"place": k, "by": Decimal(int(v))} for k, v in by.items()]], _CHANGE)
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([heaps.dump()]), found, pa.array([measured])], schema=_ROUND)

    return _of_arity(run)


def _coded(broadcast, names: list[str]):
    def run(key: tuple, *tables: pa.Table) -> pa.Table:
        books = broadcast.value
        x, heaps, _, _ = _state(books, tables)
        codes, width = heaps.codes(len(x)), books.width
        most = max(books.most, int(np.abs(x.astype(np.float64)).max()))
        kind = np.int64 if 4 * most * most * width * books.parts < _MOST else object
        error = np.zeros(len(x), dtype=kind)
        for p in range(books.parts):
            entries = np.array(books.entries[p], dtype=kind)
            error += ((x[:, p * width : (p + 1) * width].astype(kind) - entries[codes[:, p]]) ** 2).sum(axis=1)
        text, step = codes.tobytes().hex(), 2 * books.parts
        items = tables[0].column("items").combine_chunks().flatten()
        found = [pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string()), pa.array([min(v, _LONG) for v in error.tolist()], pa.int64())]
        return pa.Table.from_arrays([*(items.field(k) for k in range(items.type.num_fields)), *found], names=[*names, "code", "error"])

    return _of_arity(run)


def _of_arity(run):
    """Spark reads the number of a function's arguments."""
    return (lambda key, vectors: run(key, vectors)), (lambda key, vectors, heaps: run(key, vectors, heaps))


class _Bucketed:
    """Tables bucketed by block in the shared folder, so that pairing them by block needs no exchange."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.top = spark, buckets, shared_dir(spark)

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        name = f"codes_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", f"{self.top}/{name}").format("parquet").saveAsTable(name)
        return self.spark.table(name), name

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _kept(rows: DataFrame) -> DataFrame:
    """Rows whose vector has numbers only."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd)


def compress(rows: DataFrame, key: str, vector: str, label: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, Codebooks | None, list[int]]:
    """(one row per kept vector: key, label if named, code, error; the final codebooks; parts measured in each assignment but the last)."""
    spark = rows.sparkSession
    names = [key] if label is None else [key, label]
    kept = _kept(rows.select(F.struct(*names).alias("item"), F.col(vector).cast("array<double>").alias("vector")))
    order = [F.col(f"item.{key}").isNull(), F.col(f"item.{key}")]
    smallest = F.min(F.struct(*(c.alias(f"k{j}") for j, c in enumerate(order)), F.size("vector").alias("n")))
    lead = kept.agg(smallest.alias("m"), F.count("*").alias("total")).first()
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if lead["m"] is None or lead["m"]["n"] % parts:
        return spark.createDataFrame([], schema), None, []
    length = lead["m"]["n"]
    kept, width = kept.where(F.size("vector") == length), length // parts
    first = [_whole(np.array(r["vector"]), scale).tolist() for r in kept.orderBy(*order, "vector").select("vector").limit(entries).collect()]
    books = Codebooks([[v[p * width : (p + 1) * width] for v in first] for p in range(parts)])
    # enough buckets for all cores, of a bounded size beyond that
    buckets = min(max(1, -(-lead["total"] // BUCKET), min(2 * spark.sparkContext.defaultParallelism, lead["total"] // 1024)), 100_000)
    block = max(1, min(block, BLOCK_COMPONENTS // length, -(-lead["total"] // (2 * buckets))))
    tables, measured, sums, state, old = _Bucketed(spark, buckets), [], {}, None, None
    item = T.ArrayType(kept.schema["item"].dataType)
    packed = T.StructType([T.StructField("block", T.LongType()), T.StructField("items", item), T.StructField("bytes", T.IntegerType()), T.StructField("vectors", T.BinaryType())])
    vectors, _ = tables.put(kept.mapInArrow(_packed(scale, block), packed).repartition(buckets, "block"))
    for _ in range(rounds):
        new, name = tables.put(_assigned(vectors, state, _round(spark.sparkContext.broadcast(books)), _ROUNDS))
        if old:
            tables.drop(old)
        state, old = new, name
        measured.append(int(state.agg(F.sum("measured")).first()[0]))
        for r in state.select(F.explode("changes").alias("c")).groupBy("c.place").agg(F.sum("c.by").alias("by")).collect():
            k, c = divmod(r["place"], width + 1)
            sums.setdefault(divmod(k, books.size), [0] * (width + 1))[c] += int(r["by"])
        books.moved(sums)
    return _assigned(vectors, state, _coded(spark.sparkContext.broadcast(books), names), schema), books, measured


def _assigned(vectors: DataFrame, state: DataFrame | None, functions: tuple, schema) -> DataFrame:
    """The function of one table on the vectors, or that of two on vectors and heaps, block by block."""
    alone, both = functions
    if state is None:
        return vectors.groupBy("block").applyInArrow(alone, schema)
    return vectors.groupBy("block").cogroup(state.select("block", "heaps").groupBy("block")).applyInArrow(both, schema)


def with_label_error(coded: DataFrame, label: str) -> DataFrame:
    """Adds the error summed over rows of equal label; one sum per label meets the rows, so a common label is no bottleneck."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col(label).alias("_same")).agg(total.alias("label_error"))
    return coded.join(sums, coded[label].eqNullSafe(sums["_same"])).drop("_same")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    found = with_label_error(Shelf(spark).put(coded), "label")
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
