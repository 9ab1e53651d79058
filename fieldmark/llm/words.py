"""Vectorised words and windows of whole Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  UTF-8 keeps those
bytes for themselves, so words are found on the raw column buffer without decoding;
all documents of a slice are handled by the same numpy calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Base of the rolling polynomial hash over word hashes.
RK_BASE, RK_OTHER = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_LONG_WORD = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a slice of documents: byte ranges, per-document extents and 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_binary())
        n, at = len(texts), texts.offset
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.n_docs = n
        self.offsets = offsets - lo
        self.buf = np.zeros(hi - lo + 8, dtype=np.uint8)
        self.buf[:-8] = _LOWER[raw] if lower else raw
        solid = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[self.offsets] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        if len(raw):
            before[1:] |= ~solid[:-1]
            after[:-1] |= ~solid[1:]
            before[0] = after[-1] = True
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & after) + 1
        #: word index of each document's first word, and the total
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs, dtype=np.int32), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self._hashes()
        return self._hash

    def _hashes(self) -> np.ndarray:
        lengths = self.ends - self.starts
        h = lengths.astype(np.uint64) * _K1
        lanes = np.ndarray((len(self.buf) - 7,), dtype="<u8", buffer=self.buf, strides=(1,))
        long = np.flatnonzero(lengths > _LONG_WORD)
        pos, left, who = self.starts, lengths, None
        if len(long):
            who = np.flatnonzero(lengths <= _LONG_WORD)
            pos, left = pos[who], left[who]
        while len(pos):
            lane = lanes[pos] & _LANE_MASK[np.minimum(left, 8)]
            part = h if who is None else h[who]
            part = (part ^ lane) * _K2
            part ^= part >> np.uint64(29)
            if who is None:
                h = part
            else:
                h[who] = part
            more = np.flatnonzero(left > 8)
            who = more if who is None else who[more]
            pos, left = pos[more] + 8, left[more] - 8
        if len(long):
            import xxhash

            for k in long:
                h[k] = xxhash.xxh64_intdigest(self.buf[self.starts[k] : self.ends[k]].tobytes())
        return mix(h)

    def windows(self, width: int, base: np.uint64 = RK_BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index of the window's start, document index, Rabin-Karp hash) of every window inside a document."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        h, words = np.zeros(n, dtype=np.uint64), self.hash
        for j in range(width):
            h *= base
            h += words[j : j + n]
        own = np.maximum(self.counts - width + 1, 0)
        doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), own)
        total = int(own.sum())
        skipped = np.repeat(self.first[:-1] - (np.cumsum(own) - own), own)
        at = np.arange(total) + skipped
        return at, doc, mix(h[at])

    def sequence_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each document's whole word sequence (0, 0 when it has no word)."""
        place = np.arange(len(self.starts), dtype=np.uint64) - np.repeat(self.first[:-1], self.counts).astype(np.uint64)
        one = mix(self.hash + (place + np.uint64(1)) * _K1)
        two = mix((self.hash ^ _K3) * _K1 + (place + np.uint64(7)) * _K2)
        return self._sum(one), self._sum(two)

    def _sum(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def shingle_sets(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(document index, hash), sorted and distinct: each document's set of word shingles.

        A document with 1 to width-1 words has one shingle, its whole sequence; one without words has none.
        """
        _, doc, h = self.windows(width)
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        if len(short):
            doc = np.concatenate([doc, short.astype(np.int32)])
            h = np.concatenate([h, self.sequence_hashes()[0][short]])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        if len(h):
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[new], h[new]
        return doc, h

    def word(self, k: int) -> bytes:
        return self.buf[self.starts[k] : self.ends[k]].tobytes()

    def text(self, doc: int) -> bytes:
        return self.buf[self.offsets[doc] : self.offsets[doc + 1]].tobytes()


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Zero-copy runs of rows holding about `size` bytes of text each; a longer text stands alone."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False) if isinstance(lengths, pa.Array) else lengths.to_numpy())
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def total_bytes(docs, column: str = "text") -> int:
    """Bytes of text in the whole table: one aggregate row."""
    from pyspark.sql import functions as F

    return int(docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def planes(*columns: np.ndarray) -> bytes:
    """64-bit columns as compressed byte planes: sorted hashes shrink as differences, small numbers to their low bytes."""
    import zstandard

    parts = []
    for x in columns:
        x = np.ascontiguousarray(x).view(np.uint64)
        d = np.empty_like(x)
        d[:1] = x[:1]
        np.subtract(x[1:], x[:-1], out=d[1:])
        if not (len(x) < 2 or bool((x[1:] >= x[:-1]).all())):
            d = x
            parts.append(b"\x00")
        else:
            parts.append(b"\x01")
        parts.append(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unplanes(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    import zstandard

    raw, out = zstandard.ZstdDecompressor().decompress(data), []
    for k in range(columns):
        at = k * (8 * n + 1)
        x = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=8 * n, offset=at + 1).reshape(8, n).T).view(np.uint64).reshape(-1)
        out.append(np.cumsum(x, dtype=np.uint64) if raw[at] else x.copy())
    return out


_REMEMBERED: dict = {}


def remembered(key, make):
    """What a worker keeps between batches and tasks; a new key takes the place of all others, so memory has one owner."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """Gives up what other operators have left in this worker: workers outlive the stages that they serve."""
    _REMEMBERED.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system: an idle worker should not hold what its last task needed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def release(spark) -> None:
    """Lets Spark's cleaner drop shuffle and checkpoint files that nothing refers to any more, before the next step writes its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Only a session on one machine (local master) that names none gets a folder of its own.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share.")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


class Shelf:
    """Tables written as Parquet in the shared folder: they cut lineage, outlive executors and go when no longer needed."""

    def __init__(self, spark):
        self.spark, self.top, self.paths = spark, shared_dir(spark), {}

    def put(self, df):
        path = f"{self.top}/shelf-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables) -> None:
        """Deletes tables that `put` gave and nothing will read again."""
        for df in tables:
            _, path = self.paths.pop(id(df))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
