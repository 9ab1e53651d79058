"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is removed from a document when the same word sequence starts in a document with a
smaller doc_id; overlapping removed windows merge into maximal intervals of words.

Plan.  Documents are dealt to chunks of a few MB by a hash of doc_id and length, so a chunk is bounded
whatever the data.  A chunk sends one entry (hash, its smallest doc_id) per distinct window, in
compressed blocks by hash range, so a window that a third of all documents hold costs one entry a
chunk.  A hash range finds each window's smallest document over all chunks and answers one bit
per entry.  The chunk is read again from the same exchange, its windows are formed again and the bits
say which of them start earlier elsewhere.  Nothing is collected, and no window is skipped.

Sizes.  There are as many ranges as the text's bytes ask for, so a task's memory does not grow with
the table.  A chunk's block for one range should hold several entries; chunks and ranges therefore grow with the
square root of the table, from 3 to 64 MB (100 TB).

Windows are equal where two Rabin-Karp hashes of different bases are, 88 bits in all: among the
1.5 * 10**13 windows of 100 TB that leaves 0.4 false pairs to be expected.  Both are made from the same 64-bit hash of each word,
so that figure holds as long as no two different words share that hash.

Defined results.  A null or empty text has no words; an empty table gives no row.  A null doc_id has no order: that row keeps all its
words and takes none from others.  Rows with the same doc_id are one document for the
comparison, so neither removes words of the other.  A very long text is read whole and alone; rows without id and of equal length meet in one chunk.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import RK_OTHER, Words, planes, slices, total_bytes, unplanes

#: Least and most text of one chunk, the unit that one Python worker holds, and least text of one range.
CHUNK_BYTES, MOST_BYTES, RANGE_BYTES = 3 << 20, 64 << 20, 16 << 20
#: Bits of the second hash.
_EXTRA = 24
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,length:long>>"


def _sorted(h: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both hashes and, in that order, where a new window begins."""
    order = np.argsort(h)
    hs, es = h[order], extra[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = hs[1:] != hs[:-1]
    if len(h) and (~new[1:] & (es[1:] != es[:-1])).any():
        # the first hash alone does not tell these apart
        order = np.lexsort((extra, h))
        hs, es = h[order], extra[order]
        new[1:] = (hs[1:] != hs[:-1]) | (es[1:] != es[:-1])
    return order, new


def _entries(table: pa.Table, width: int) -> tuple:
    """Slices with their windows; the chunk's distinct windows (sorted) with each one's smallest doc_id; and, for every window, the order, doc_id and distinct entry."""
    parts, hashes, extras, ids = [], [], [], []
    for piece in slices(table):
        words = Words(piece.column("text"))
        known = ~np.asarray(piece.column("doc_id").is_null())
        doc_id = piece.column("doc_id").fill_null(0).to_numpy()
        at, doc, h = words.windows(width)
        extra = (words.windows(width, RK_OTHER)[2] >> np.uint64(64 - _EXTRA)).astype(np.uint32)
        keep = known[doc]
        at, doc, h, extra = at[keep], doc[keep], h[keep], extra[keep]
        parts.append((words, doc_id, known, at))
        hashes.append(h)
        extras.append(extra)
        ids.append(doc_id[doc])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    extra = np.concatenate(extras) if extras else np.zeros(0, np.uint32)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order, new = _sorted(h, extra)
    h, extra, ids = h[order], extra[order], ids[order]
    least = np.minimum.reduceat(ids, np.flatnonzero(new)) if len(h) else ids
    return parts, h[new], extra[new], least, order, ids, np.cumsum(new) - 1


def _bounds(h: np.ndarray, ranges: int) -> np.ndarray:
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def _pack(h: np.ndarray, extra: np.ndarray, ids: np.ndarray) -> bytes:
    """Entries of one block; doc_ids are given once and named by place."""
    import zstandard

    own, place = np.unique(ids, return_inverse=True)
    narrow = np.uint8 if len(own) <= 1 << 8 else np.uint16 if len(own) <= 1 << 16 else np.uint32
    tail = [x.astype(t).view(np.uint8).reshape(len(h), -1).T.tobytes() for x, t in ((extra, "<u4"), (place.reshape(-1), narrow))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(own).to_bytes(4, "little"), own.astype("<i8").tobytes(), tail[0][: 3 * len(h)], tail[1]])) + planes(h)


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    reader = zstandard.ZstdDecompressor().decompressobj()
    raw = reader.decompress(data)
    k = int.from_bytes(raw[:4], "little")
    own, at = np.frombuffer(raw, "<i8", k, 4), 4 + 8 * k
    extra = np.zeros((4, n), np.uint8)
    extra[:3] = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(3, n)
    at += 3 * n
    width = 1 if k <= 1 << 8 else 2 if k <= 1 << 16 else 4
    place = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(f"<u{width}").reshape(-1)
    return unplanes(reader.unused_data, n, 1)[0], np.ascontiguousarray(extra.T).view("<u4").reshape(-1), own[place]


def _send(width: int, ranges: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, h, extra, ids, *_ = _entries(table, width)
        cut, rows = _bounds(h, ranges), {"range": [], "chunk": [], "n": [], "block": []}
        for r in np.flatnonzero(np.diff(cut)):
            a, b = cut[r], cut[r + 1]
            rows["range"].append(int(r))
            rows["chunk"].append(key[0].as_py())
            rows["n"].append(int(b - a))
            rows["block"].append(_pack(h[a:b], extra[a:b], ids[a:b]))
        return pa.table(rows, schema=pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("block", pa.binary())]))

    return send


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """One bit per entry: whether its window starts in a smaller document than the chunk's smallest."""
    sizes, got = table.column("n").to_numpy(), [_unpack(b.as_py(), n.as_py()) for b, n in zip(table.column("block"), table.column("n"), strict=True)]
    h, extra, ids = (np.concatenate([x[k] for x in got]) for k in range(3))
    order, new = _sorted(h, extra)
    s_ids, starts = ids[order], np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(s_ids, starts), np.diff(np.append(starts, len(h))))
    later = np.empty(len(h), dtype=bool)
    later[order] = s_ids > least
    cuts = np.cumsum(sizes)[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(later, cuts)]
    return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "n": table.column("n"), "bits": pa.array(bits, pa.binary())})


def _cut(width: int, ranges: int):
    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        parts, distinct, _, least, order, ids, entry = _entries(table, width)
        bounds, later = _bounds(distinct, ranges), np.zeros(len(distinct), dtype=bool)
        for r, n, bits in zip(answers.column("range").to_pylist(), answers.column("n").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            a, b = bounds[r], bounds[r + 1]
            if b - a != n:
                raise ValueError("a chunk changed between its two readings")
            later[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        gone = np.empty(len(order), dtype=bool)
        gone[order] = later[entry] | (ids > least[entry])
        done = 0
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "removed": []}
        for words, doc_id, known, at in parts:
            hit = at[gone[done : done + len(at)]]
            done += len(at)
            delta = np.zeros(len(words.starts) + 1, dtype=np.int32)
            delta[hit] = 1
            delta[hit + width] -= 1
            covered = np.cumsum(delta[:-1]) > 0
            for d in range(words.n_docs):
                a, b = words.first[d], words.first[d + 1]
                mask = covered[a:b]
                kept = _kept(words, a, b, mask)
                steps = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                begin, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
                out["doc_id"].append(int(doc_id[d]) if known[d] else None)
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(mask.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["removed"].append([{"start": int(x), "length": int(y - x)} for x, y in zip(begin, end, strict=True)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", span)]))

    return cut


def _kept(words: Words, a: int, b: int, mask: np.ndarray) -> bytes:
    if a == b:
        return b""
    lo, hi = words.starts[a], words.ends[b - 1]
    if not mask.any():
        return b" ".join(words.buf[lo:hi].tobytes().split())
    raw = words.buf[lo:hi].tobytes().split()
    return b" ".join([w for w, m in zip(raw, mask.tolist(), strict=True) if not m])


def repeated_windows(docs: DataFrame, width: int = 13, chunk_bytes: int | None = None, range_bytes: int | None = None) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 and the maximal removed intervals of words."""
    size = total_bytes(docs)
    # a window is some 6 bytes of text; 8 entries to a block
    even = math.isqrt(48 * size)
    chunks = max(1, -(-size // (chunk_bytes or max(CHUNK_BYTES, min(MOST_BYTES, even)))))
    ranges = max(1, -(-size // (range_bytes or max(RANGE_BYTES, min(MOST_BYTES, even)))))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)))
    blocks = dealt.groupBy("chunk").applyInArrow(_send(width, ranges), "range int, chunk long, n int, block binary")
    answers = blocks.groupBy("range").applyInArrow(_answer, "chunk long, range int, n int, bits binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(width, ranges), _RESULT)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")

