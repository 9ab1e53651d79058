"""Packing by minimum bin slack: bitset subset-sum fills each window as close to capacity as the lengths allow.

1. Documents become token ids and are cut into pieces of at most `capacity`.  Words repeat, so a worker
   tokenizes each distinct word once and joins the ids (the tokenizer never joins across white space).
2. The plan needs only how many pieces have each length: at most `capacity` numbers.  The longest length
   left seeds a window; a bitset of reachable sums over the lengths left, each as often as it
   remains, gives the fullest window, backtracking gives its multiset of lengths, and the window is
   repeated while the counts last.  So the plan grows with the lengths, not with the documents.
3. Pieces of one length are ranked (counts per bucket, then ranks within buckets: no length meets in
   one task) and the rank points into the plan: sequence and offset.

Defined results.  A null text is empty: its document is the end id alone.  A null doc_id stays null.
Repeated rows are packed as often as they come; equal ones (same doc_id, start and ids) are ranked in one task.  An empty table gives no row.
Very long texts are tokenized whole and cut at the capacity.  Ties: pieces of one length are alike to the plan and are placed by bucket, doc_id and
start; of equal windows the first found fills.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import positions
from .words import Words, remembered, shared_dir, slices, trim

CAPACITY = 4096
END_ID = 2
#: Distinct words whose ids one worker keeps.
_WORDS = 500_000
_SIMPLE = re.compile(r"([a-zß-öø-ÿĀ-ɏ]+)([.,;:!?]*)")
#: The byte-level alphabet of public byte-level BPE vocabularies: printable bytes stand for themselves, the rest follow from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


class WordIds:
    """Token ids of words; each distinct word is tokenized once per worker while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: token ids of short runs of letters, as bytes: lists of numbers take several times their memory
        self.letters: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        # hashes of the words, ascending, and where each word stands in start, length and met
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.length, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.letters.clear()

    def forget(self) -> None:
        """Keeps the words that were met in more than one slice."""
        again = np.flatnonzero(self.met[self.rows] > 1)[: _WORDS // 2]
        keys, rows = self.hashes[again], self.rows[again]
        length, flat = self.length[rows], self.flat[self._places(self.start[rows], self.length[rows])]
        self.clear()
        self._put(keys, flat, length)

    @staticmethod
    def _places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where the ids of words with these starts and lengths lie, word after word."""
        ends = np.cumsum(length)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)

    def one(self, word: str) -> bytes:
        low = word.lower()
        m = _SIMPLE.fullmatch(low)
        if not m:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return self.piece(m[1]) + (self.piece(m[2]) if m[2] else b"")

    def piece(self, text: str) -> bytes:
        ids = self.letters.get(text)
        if ids is None:
            mapped = text if text.isascii() else "".join(map(_BYTE.__getitem__, text.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(text) <= 12 and len(self.letters) < 150_000:
                self.letters[text] = ids
        return ids

    def _put(self, keys: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        """Adds words that are not there yet, all of a slice at once; keys ascend."""
        k, n = len(self.hashes), len(keys)
        while k + n > len(self.start):
            self.start, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.met))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[k : k + n], self.length[k : k + n] = self.used + np.cumsum(length) - length, length
        self.used += len(flat)
        at = np.searchsorted(self.hashes, keys)
        self.hashes, self.rows = np.insert(self.hashes, at, keys), np.insert(self.rows, at, np.arange(k, k + n, dtype=np.int32))

    def _rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Where these words stand, -1 for those that are not there."""
        if not len(self.hashes):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return np.where(self.hashes[at] == keys, self.rows[at], -1).astype(np.int64)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents after one another, number of ids of each document)."""
        if len(self.hashes) > _WORDS:
            self.forget()
        h = words.hash
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        first, keys = order[np.flatnonzero(new)], s[new]
        at = self._rows_of(keys)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = np.arange(len(self.hashes), len(self.hashes) + len(fresh))
            found = [self.one(words.word(j).decode("utf-8", "replace")) for j in first[fresh].tolist()]
            length = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self._put(keys[fresh], np.frombuffer(b"".join(found), np.uint32), length)
        self.met[at] += 1
        entry = np.empty(len(h), np.int64)
        entry[order] = at[np.cumsum(new) - 1] if len(h) else 0
        start, length = self.start[entry], self.length[entry]
        bounds = np.concatenate([[0], np.cumsum(length)])
        return self.flat[self._places(start, length)], np.diff(bounds[words.first])


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = remembered(("ids", path), lambda: WordIds(path))
        trim()
        for batch in batches:
            for piece in slices(batch):
                words = Words(piece.column("text"))
                flat, counts = vocabulary.ids(words)
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
                at = 0
                for doc_id, n in zip(piece.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for a in range(0, n + 1, capacity):
                        part = ids[a : a + capacity]
                        out["doc_id"].append(doc_id)
                        out["start"].append(a)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                        out["doc_tokens"].append(n + 1)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))
                del words, flat, ids, part
                trim()

    return run


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, with the largest sum up to capacity."""
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> capacity:
            break
    total, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            found[length] = found.get(length, 0) + take
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, multiset of lengths) of each kind of window, until no piece is left."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        rest = {k: v for k, v in rest.items() if v > 0 and k <= capacity - seed}
        window = fullest(rest, capacity - seed) if rest else {}
        window[seed] = window.get(seed, 0) + 1
        repeats = min(left[k] // m for k, m in window.items())
        out.append((repeats, window))
        for k, m in window.items():
            left[k] -= m * repeats
            if not left[k]:
                del left[k]
    return out


def _lookup(windows: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, in order of rank: (first rank, first sequence, pieces of that length in a sequence, offset of the first)."""
    used, table, sequence = {}, {}, 0
    for repeats, window in windows:
        offset = 0
        for length in sorted(window, reverse=True):
            m = window[length]
            rank = used.get(length, 0)
            table.setdefault(length, []).append((rank, sequence, m, offset))
            used[length] = rank + m * repeats
            offset += m * length
        sequence += repeats
    return {k: np.array(v, dtype=np.int64) for k, v in table.items()}


def _placed(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own, rows = np.flatnonzero(length == k), table.value[int(k)]
                entry = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - entry[:, 0]
                sequence[own] = entry[:, 1] + nth // entry[:, 2]
                offset[own] = entry[:, 3] + nth % entry[:, 2] * k
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").checkpoint()
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = docs.sparkSession.sparkContext.broadcast(_lookup(plan(counts, capacity)))
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(256)).alias("bucket")
    ranked = positions(pieces.select("*", bucket), ["length"], ["bucket"], ["doc_id", "start", "ids_crc32"], "rank")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(table), schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
