"""N-gram Jaccard self-join: a blocked sparse matrix product of documents by shingles.

Rows of the matrix are documents, columns their distinct word shingles.  Columns have one global order,
rare before frequent.  Two rows that reach the similarity t share a column among the first
n - ceil(t*n) + 1 of each, so the product is first formed over those leading columns only: blocks of column
hashes gather (column, document) entries and drop every column that one document alone holds.  What
is left accumulates overlap counts, and pairs whose count plus the rest of the longer row cannot reach
the bound for their sizes are discarded.  The pairs left open are dealt to blocks of rows; there the product is
completed over all columns, range by range, and a pair goes as soon as its count plus what is left of
either row falls below its bound.

A group of k near copies would give k*k/2 pairs.  The first round compares each document with the smallest
document of the column it shares most (k pairs) and forms components of the links.  Rounds of tries
compare it with a few pivots of its columns that are in other components, as long as that links many.  The last round compares what is left in different components, all of it.  No pair of
different components goes untested, so components are exact; the rounds before only leave it less.

Frequent columns are found in a pass over all documents: each task keeps counts of its shingles, and
the 2**20 most frequent of those with a count of `OFTEN` or more are broadcast, 8 MB at most.  The list only orders
columns: any order gives the same result.

The entries that travel hold only the leading bits of their column's hash, as many as the size of the table needs for few
columns to fall together (`_SPARE`).  Columns that do only name pairs too many, which the completed product, over whole hashes, drops;
where two columns of one row do, its overlap is counted too small by one, and the bound allows for that.

Tables between rounds are Parquet in the shared folder, and go when the next is written.

Defined results.  Null and blank texts have no shingle, link with nothing and are their own
component; an empty table gives no row.  A row with a null doc_id links with nothing and has a null component.  Rows that
repeat a doc_id are one document of several texts: what one of them links to, all of them do.  Equal word sequences are
one class with the smallest of its doc_ids.  Very long texts are read whole, one by one.  Other columns of docs are ignored, whatever their names.  A
shingle is its 64-bit hash: for one pair of sets of a thousand the chance that two differ and have equal hashes is 1 in 10**13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .words import Shelf, Words, forget, mix, planes, release, slices, total_bytes, trim, unplanes

#: Compacted counts that one task holds while it looks for frequent shingles.
_COUNTS = 1 << 18
#: Text whose leading columns make one block of the product: what one task holds, whatever the table's size.
_BLOCK_TEXT = 8 << 20
#: Entries that a task gathers before it sends its column blocks: more where there are many blocks, up to a bound.
_ENTRIES, _MOST_ENTRIES = 1 << 18, 1 << 23
#: Bits of the filter that keeps most rows no pair names from being sent: 16 an id, up to 16 MB.  Rows are joined by id after it.
_FILTER_BITS = 1 << 27
#: Parts that the entries of a frequent column are dealt to, and pairs that a task forms at a time in the last round.
_SALTS, _HOT_PAIRS = 32, 1 << 18
#: Rows that make a column hot in the last round, and pairs beyond which it is dealt to the cells of a grid.
_HOT, _SPLIT = 1024, 1 << 22
#: Rows compared with one row at a time, rows of one block of pairs, and text decoded at a time there.
_ROWS, _BUNDLE, _DECODED = 256, 256, 1 << 20
#: Entries that stand in one row of a written column.
_HELD = 1024
#: Bits of a column's hash in the entries beyond those that number all leading columns.
_SPARE = 16
#: Bytes of a group before which freed memory is given back.
_TRIMMED = 1 << 20
#: Texts that a task knows again.
_SEEN = 50_000

#: Documents that make a shingle frequent, and how many such shingles are put last in the order.
OFTEN, ORDERED = 16, 1 << 20
#: Documents of a column that others are compared with before the last round: its smallest and some by hash.
_PIVOTS = 4
#: Pivots that a document is compared with in a round of tries, such rounds at most, and the share of tries that must link for another.
_TRIES, _ROUNDS, _WORTH = 8, 3, 0.05
#: Of a document's shingles, the share that it should have first in common with another to be compared before the last round.
#: Documents alike have a seventh there, less what differs.  The last round compares them whatever they have.
_LIKELY = 0.04


def _merged(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, c = h[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[new], np.add.reduceat(c, new)


_FACTS = "doc_id long, n long, seq binary, h long, c long"


def _facts(width: int):
    """Per document its number of shingles and the hash of its word sequence; per task the counts of shingles it met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in slices(batch):
                words = Words(piece.column("text"), lower=True)
                doc, got = words.shingle_sets(width)
                seq = np.stack(words.sequence_hashes(), axis=1)
                k = words.n_docs
                n = np.bincount(doc, minlength=k).astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in seq], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["doc_id", "n", "seq", "h", "c"])
                if len(got):
                    h, c = np.concatenate([h, got]), np.concatenate([c, np.ones(len(got), np.int64)])
                if len(h) > _COUNTS:
                    h, c = _merged(h, c)
                    if len(h) > _COUNTS // 2:
                        h, c = h[c > 1], c[c > 1]
        if len(h):
            h, c = _merged(h, c)
            h, c = h[c > 1], c[c > 1]
            k = len(h)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(h.view(np.int64)), pa.array(c)], names=["doc_id", "n", "seq", "h", "c"])
        trim()

    return run


def _frequent(facts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that most documents hold."""
    found = facts.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "h").limit(ORDERED).select("h")
    return np.sort(np.array([r[0] for r in found.collect()], dtype=np.int64).view(np.uint64))


def _prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)


def _kept_bits(size: int) -> int:
    """Leading bits of a hash that entries of `size` bytes of text hold: a leading column takes 16 bytes of it or more, but for short texts."""
    return min(64, (size >> 4).bit_length() + _SPARE)


def _leading(width: int, num: int, den: int, frequent, blocks: int, bits: int):
    """Column blocks of the leading columns; of equal word sequences that a task meets only the first is sent."""
    most, cut = min(_MOST_ENTRIES, max(_ENTRIES, 64 * blocks)), np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        often, seen = frequent.value, set()
        waiting: list[tuple] = []
        held = 0

        def flush():
            h, ids, n, pos, part = (np.concatenate([w[k] for w in waiting]) for k in range(5))
            waiting.clear()
            order = np.lexsort((h, part))
            h, ids, n, pos, part = h[order], ids[order], n[order], pos[order], part[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(part))[: len(at)]
            return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(ends - at), pa.array([planes(h[a:b], ids[a:b], n[a:b], pos[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary())], names=["part", "n", "block"])

        for batch in batches:
            for piece in slices(batch):
                words = Words(piece.column("text"), lower=True)
                doc, h = words.shingle_sets(width)
                ids = piece.column("doc_id")
                known = ~np.asarray(ids.is_null())
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                one, two = words.sequence_hashes()
                n = np.bincount(doc, minlength=words.n_docs)
                fresh = np.zeros(words.n_docs, dtype=bool)
                for d in np.flatnonzero(known & (n > 0)):
                    key = (int(one[d]), int(two[d]))
                    fresh[d] = key not in seen
                    seen.add(key)
                if len(seen) > _SEEN:
                    seen.clear()
                flag = np.zeros(len(h), dtype=bool)
                if len(often) and len(h):
                    flag = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
                    if flag.any():
                        order = np.lexsort((flag, doc))
                        doc, h, flag = doc[order], h[order], flag[order]
                first = np.cumsum(n) - n
                pos = np.arange(len(h)) - first[doc]
                lead = pos < _prefix_length(n, num, den)[doc]
                lead &= fresh[doc]
                doc, h, flag, pos = doc[lead], h[lead] >> cut << cut, flag[lead], pos[lead]
                salt = np.where(flag, (mix(ids[doc].astype(np.uint64)) % np.uint64(_SALTS)).astype(np.int64) + 1, 0)
                # leading columns stand low, so their blocks go by another hash
                block = (mix(h) >> np.uint64(32)).astype(np.int64) * blocks >> 32
                waiting.append((h, ids[doc], n[doc].astype(np.int64), pos, (block + salt * 7) % blocks * (_SALTS + 1) + salt))
                held += len(h)
                if held >= most:
                    held = 0
                    yield flush()
        if waiting:
            yield flush()
        seen.clear()
        trim()

    return run


_PIVOT_FIELDS = [f"{x}{j}" for j in range(_PIVOTS) for x in "pn"]
_COLUMN = "h long, salted boolean, k int, held array<struct<id: long, n: int, pos: int, again: boolean>>, " + ", ".join(f"p{j} long, n{j} int" for j in range(_PIVOTS))
_HELD_TYPE = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("again", pa.bool_())]))
_COLUMN_TYPES = [("h", pa.int64()), ("salted", pa.bool_()), ("k", pa.int32()), ("held", _HELD_TYPE), *((f, pa.int64() if f[0] == "p" else pa.int32()) for f in _PIVOT_FIELDS)]


def _shared_columns(key: tuple, table: pa.Table) -> pa.Table:
    """The columns that two documents or more hold, with their entries and pivots: each column's smallest document and some others of it.

    An entry of a row that has the column at an earlier place is marked `again`.  A column of many entries comes in several rows.
    """
    if table.nbytes > _TRIMMED:
        trim()
    got = [unplanes(b.as_py(), n.as_py(), 4) for b, n in zip(table.column("block"), table.column("n"), strict=True)]
    h, ids, n, pos = (np.concatenate([g[k] for g in got]) for k in range(4))
    del got
    order = np.argsort(h)
    h, ids, n, pos = h[order], ids[order].view(np.int64), n[order].astype(np.int32), pos[order].astype(np.int32)
    size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h)))
    salted = key[0].as_py() % (_SALTS + 1) > 0
    if not salted:
        keep = np.repeat(size > 1, size)
        h, ids, n, pos, size = h[keep], ids[keep], n[keep], pos[keep], size[size > 1]
    if not len(h):
        return pa.table({c: pa.array([], t) for c, t in _COLUMN_TYPES})
    at = np.cumsum(size) - size
    order = np.lexsort((pos, ids, h))
    ids, n, pos = ids[order], n[order], pos[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (ids[1:] == ids[:-1]) & (pos[1:] != pos[:-1])
    place, column = np.arange(len(h)), np.repeat(np.arange(len(size)), size)
    # what a column has once is written once: its hash and pivots weigh more than its entries
    cuts = np.flatnonzero((place - at[column]) % _HELD == 0)
    own = column[cuts]
    entries = pa.StructArray.from_arrays([pa.array(x) for x in (ids, n, pos, again)], names=["id", "n", "pos", "again"])
    out = {"h": h[cuts].view(np.int64), "salted": np.full(len(cuts), salted), "k": size[own].astype(np.int32), "held": pa.ListArray.from_arrays(pa.array(np.append(cuts, len(h)), pa.int32()), entries)}
    for j in range(_PIVOTS):
        rank = ids if j == 0 else mix(ids.view(np.uint64) ^ h ^ np.uint64(j))
        # the place of each column's smallest rank
        best = place[rank == np.repeat(np.minimum.reduceat(rank, at), size)]
        first = np.empty(len(size), np.int64)
        first[column[best[::-1]]] = best[::-1]
        # a column of two has but one pivot
        one, many = (ids[first], n[first]), (size > 2) | (j == 0)
        out[f"p{j}"], out[f"n{j}"] = (np.where(many, x, 0).astype(x.dtype)[own] for x in one)
    return pa.table(out)


def _entries(columns: DataFrame) -> DataFrame:
    """(h, salted, k, id, n, pos, again, pivots): one row for each entry."""
    return columns.select("h", "salted", "k", F.inline("held"), *_PIVOT_FIELDS)


def _can_reach(a: str, b: str, num: int, den: int):
    """Size bound: the smaller set holds at least num/den of the larger one's size."""
    return (F.least(a, b) * den) >= (F.greatest(a, b) * num)


def _first_shared(n: str, pos: str, a: str, b: str, num: int, den: int):
    """Whether a column at this place of a row can be the first that rows of sizes a and b share: what follows must hold the whole overlap."""
    return ((F.col(n) - F.col(pos)) * (num + den)) >= ((F.col(a) + F.col(b)) * num)


def _rest(c: str, a: str, b: str, num: int, den: int):
    """Overlap counted so far plus what the longer rest of either row could add reaches num*(a+b)/(num+den)."""

    def rest(n: str):
        return F.ceil(F.col(n) * F.lit(num) / F.lit(den)) - 1

    return (F.col(c) + F.greatest(rest(a), rest(b))) * (num + den) >= (F.col(a) + F.col(b)) * num


def _slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of ids in the filter, three each: one alone lets so many others through that they weigh as much as the named rows."""
    return [(mix(ids.astype(np.uint64) + np.uint64(k << 56)) % np.uint64(bits)).astype(np.int64) for k in range(3)]


def _filter(pairs: DataFrame, bits: int):
    """A bitmap over the ids in pairs; more ids than it can tell apart only make it let more rows through."""
    lanes = 1 << 10

    def set_bits(batches):
        out = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for c in ("a", "b"):
                for slot in _slots(batch.column(c).to_numpy(), bits):
                    np.bitwise_or.at(out, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        packed = out.reshape(-1, lanes)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_pydict({"lane": used, "bits": pa.array([packed[k].tobytes() for k in used], pa.binary())})

    def either(key, table):
        out = np.zeros(lanes, dtype=np.uint8)
        for b in table.column("bits"):
            out |= np.frombuffer(b.as_py(), np.uint8)
        return pa.table({"lane": [key[0].as_py()], "bits": pa.array([out.tobytes()], pa.binary())})

    found = pairs.select("a", "b").mapInArrow(set_bits, "lane long, bits binary").groupBy("lane").applyInArrow(either, "lane long, bits binary").collect()
    packed = np.zeros((bits // 8 // lanes, lanes), dtype=np.uint8)
    for r in found:
        packed[r["lane"]] = np.frombuffer(r["bits"], np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(packed.reshape(-1))


def _named_rows(docs: DataFrame, needed, bits: int) -> DataFrame:
    """(id, size, row): the compressed texts of the documents that the filter lets through."""

    def run(batches):
        import zstandard

        own, packer, seen = needed.value, zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            known = ~np.asarray(batch.column("doc_id").is_null())
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            hit = known
            for slot in _slots(ids, bits):
                hit = hit & ((own[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
            for piece in slices(batch.filter(pa.array(hit))):
                rows = {(i, (t or "").encode()): None for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True)}
                # a row that comes again in a task says nothing new
                rows = [(i, t) for i, t in rows if (i, hash(t)) not in seen]
                seen.update((i, hash(t)) for i, t in rows)
                if len(seen) > _SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows], pa.int64()), "size": pa.array([len(t) for _, t in rows], pa.int64()), "row": pa.array([packer.compress(t) for _, t in rows], pa.binary())})

    return docs.mapInArrow(run, "id long, size long, row binary")


def _counted(x: np.ndarray, doc: np.ndarray, h: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the rows (doc, h) of sizes n reach the similarity with row x: the product over all columns, by ranges of them."""
    ranges, alive, count = 4, np.ones(len(n), dtype=bool), np.zeros(len(n), np.int64)
    left_x, left = len(x), n.copy()
    if not len(x):
        return np.zeros(len(n), dtype=bool)
    which = (h >> np.uint64(62)).astype(np.int8)
    for r in range(ranges):
        here = np.flatnonzero((which == r) & alive[doc]) if ranges > 1 else np.arange(len(h))
        own = x[np.searchsorted(x, np.uint64(r << 62)) : np.searchsorted(x, np.uint64((r + 1 << 62) - 1), side="right")]
        if len(own) and len(here):
            place = np.minimum(np.searchsorted(own, h[here]), len(own) - 1)
            count += np.bincount(doc[here][own[place] == h[here]], minlength=len(n))
        left_x -= len(own)
        left = left - np.bincount(doc[here], minlength=len(n))
        alive &= (count + np.minimum(left_x, left)) * (num + den) >= (len(x) + n) * num
        if not alive.any():
            break
    return alive & (count * den >= (len(x) + n - count) * num) & (n > 0)


def _completed(width: int, num: int, den: int):
    """Of a bundle of rows, the links (a, b): each a (role 0) with the documents b (role 1) of its part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import zstandard

        table = table.sort_by([("a", "ascending"), ("part", "ascending"), ("role", "ascending")])
        a, part, role, ids, sizes = (table.column(c).to_numpy() for c in ("a", "part", "role", "id", "size"))
        row, unpack = table.column("row"), zstandard.ZstdDecompressor().decompress
        cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])).tolist() + [len(a)]
        out_a, out_b = [], []
        # (rows of a, rows of b) that are decoded together
        waiting, held = [], 0

        def compare():
            rows = [k for one, other in waiting for k in (*one, *other)]
            words = Words(pa.array([unpack(row[k].as_py()) if sizes[k] else b"" for k in rows], pa.large_binary()), lower=True)
            doc, h = words.shingle_sets(width)
            cut, at = np.searchsorted(doc, np.arange(words.n_docs + 1)), 0
            for one, other in waiting:
                lo, hi = at + len(one), at + len(one) + len(other)
                n = np.diff(cut[lo : hi + 1])
                linked = np.zeros(len(other), dtype=bool)
                for k in range(at, lo):
                    linked |= _counted(h[cut[k] : cut[k + 1]], doc[cut[lo] : cut[hi]] - lo, h[cut[lo] : cut[hi]], n, num, den)
                for k in np.flatnonzero(linked).tolist():
                    out_a.append(a[other[k]])
                    out_b.append(ids[other[k]])
                at = hi
            waiting.clear()

        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            first = lo + int(np.searchsorted(role[lo:hi], 1))
            one, other = list(range(lo, first)), []
            held += int(sizes[lo:first].sum())
            for k in range(first, hi):
                other.append(k)
                held += int(sizes[k])
                if held >= _DECODED:
                    waiting.append((one, other))
                    compare()
                    other, held = [], int(sizes[lo:first].sum())
            if one and other:
                waiting.append((one, other))
        if waiting:
            compare()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _links(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose completed overlap reaches the similarity; pairs must be a table of the shelf."""
    asked = pairs.count()
    if not asked:
        return pairs.select("a", "b")
    bits = 1 << min(_FILTER_BITS.bit_length() - 1, max(13, (32 * asked - 1).bit_length()))
    rows = _named_rows(docs, _filter(pairs, bits), bits)
    bundles = F.lit(-(-asked // _BUNDLE))
    per = pairs.groupBy("a").agg(F.count("*").alias("k"))
    parts = per.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.ceil(F.col("k") / _ROWS).cast("int") - 1)).alias("part"), F.lit(0).alias("role"))
    # only rows with many partners are dealt to parts; there is one of them for every _ROWS pairs at most
    many = per.where(F.col("k") > _ROWS).select("a", F.ceil(F.col("k") / _ROWS).cast("int").alias("parts"))
    dealt = pairs.join(many, "a", "left").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("role"))
    asks = parts.unionByName(dealt).withColumn("bundle", F.pmod(F.xxhash64("a", "part"), bundles))
    return asks.join(rows, "id").groupBy("bundle").applyInArrow(_completed(width, num, den), "a long, b long")


def _classes(shelf: Shelf, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class) of documents whose smallest equal document is another, and links (a, b) between classes of one doc_id."""
    known = rows.where("doc_id is not null and n > 0").select("doc_id", "seq", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).alias("salt"))
    # two levels, so that a class of a third of all rows meets in no task
    some = known.groupBy("seq", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"))
    least = some.groupBy("seq").agg(F.min("least").alias("class"), F.sum("k").alias("k")).where("k > 1").select("seq", "class")
    named = shelf.put(known.join(some.select("seq", "salt").join(least, "seq"), ["seq", "salt"]).select(F.col("doc_id").alias("id"), "class").distinct())
    per = named.groupBy("id").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    several = named.join(per.where("least <> most").select("id", "least"), "id").select(F.col("least").alias("a"), F.col("class").alias("b")).where("a <> b")
    out = shelf.put(per.where("id <> least").select("id", F.col("least").alias("class"))), shelf.put(several.distinct())
    shelf.drop(named)
    return out


def _by_class(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """Distinct pairs, a < b, of the classes' smallest documents."""
    a, b = same.toDF("a", "ca"), same.toDF("b", "cb")
    told = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    return told.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def _labels(shelf: Shelf, links: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class, component) of every document that is not its own component or has a link; and links that say the same, one a document."""
    found = shelf.put(components(links))
    told = same.join(found.toDF("class", "component"), "class", "left").select("id", "class", F.coalesce("component", "class").alias("component"))
    label = shelf.put(told.unionByName(found.select("id", F.col("id").alias("class"), "component")).groupBy("id").agg(F.min("class").alias("class"), F.min("component").alias("component")))
    short = shelf.put(found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))
    shelf.drop(found, links)
    return label, short


def _named(entries: DataFrame, label: DataFrame) -> DataFrame:
    """(h, id, n, pos, label): entries by class, with their components."""
    return entries.select("h", "id", "n", "pos").join(label, "id", "left").select("h", F.coalesce("class", "id").alias("id"), "n", "pos", F.coalesce("component", "id").alias("label"))


def _mixed(named: DataFrame) -> DataFrame:
    """(h, id, n, pos, label, main): entries of the columns that hold several components, with each column's largest."""
    several = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h")
    named = named.join(several, "h")
    main = named.groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    return named.join(main, "h")


def _near(j: int, num: int, den: int):
    """Whether an entry's document can be alike with its column's j-th pivot, and this column the first they share."""
    return (F.col("id") != F.col(f"p{j}")) & _can_reach("n", f"n{j}", num, den) & _first_shared("n", "pos", "n", f"n{j}", num, den)


def _first_round(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Each document with the smallest document of the column it shares most, and frequent columns' smallest documents with each other."""
    by_column = entries.where(_near(0, num, den)).groupBy(F.col("p0").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= F.col("n") * _LIKELY)
    best = by_column.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a"))
    pivots = entries.where("salted").select("h", F.col("p0").alias("b"), F.col("n0").alias("n")).distinct()
    least = pivots.groupBy("h").agg(F.min(F.struct(F.col("b").alias("a"), F.col("n").alias("an"))).alias("s")).select("h", "s.a", "s.an")
    across = pivots.join(least, "h").where((F.col("a") != F.col("b")) & _can_reach("n", "an", num, den)).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return best.select("a", "b").union(across.where(F.col("c") >= F.col("n") * _LIKELY).select("a", "b"))


def _met(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, c): pivots a and documents b of their columns that may share many; c estimates how many columns they share first.

    The smallest document is met in each of its columns; another stands for the k of its column.
    """
    share = lambda j: F.lit(1.0) if j == 0 else F.col("k") / F.lit(_PIVOTS - 1.0)
    pivots = [F.when(_near(j, num, den) & ((F.col("k") > 2) if j else F.lit(True)), F.struct(F.col(f"p{j}").alias("x"), F.lit(min(j, 1)).alias("kind"), share(j).alias("w"))) for j in range(_PIVOTS)]
    each = entries.select(F.explode(F.array_compact(F.array(*pivots))).alias("p"), F.col("id").alias("y"), "n").select("p.*", "y", "n")
    sums = [F.sum(F.when(F.col("kind") == j, F.col("w"))).alias(f"c{j}") for j in (0, 1)]
    met = each.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(*sums, F.first("n").alias("n"))
    met = met.withColumn("c", F.greatest("c0", "c1")).where(F.col("c") >= F.col("n") * _LIKELY).select("a", "b", "c")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), F.xxhash64("a", "b")))
    return met.withColumn("nth", nth).where(F.col("nth") <= 2 * _TRIES).select("a", "b", "c")


def _tries(met: DataFrame, label: DataFrame, tested: DataFrame) -> DataFrame:
    """Of the pairs met those in different components and not tested, a few of each document."""
    of = label.select("id", "component")
    a, b = of.toDF("a", "la"), of.toDF("b", "lb")
    done = tested.union(tested.select("b", "a"))
    open_ = met.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "c").join(done, ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), F.xxhash64("a", "b")))
    return open_.withColumn("nth", nth).where(F.col("nth") <= _TRIES).select("a", "b")


def _largest(h: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row the label that most rows of its column h have."""
    order = np.lexsort((label, h))
    hs, ls = h[order], label[order]
    run = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])]))
    count = np.diff(np.append(run, len(hs)))
    by = np.lexsort((ls[run], count, hs[run]))
    last = np.concatenate([hs[run][by][1:] != hs[run][by][:-1], [True]])
    return ls[run][by][last][np.searchsorted(hs[run][by][last], h)]


def _product(num: int, den: int):
    """Of one block of columns, the distinct pairs of different components that a column can be the first shared one of."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if table.nbytes > _TRIMMED:
            trim()
        h, ids, n, pos, label = (table.column(c).to_numpy() for c in ("h", "id", "n", "pos", "label"))
        # equal texts of several tasks are one row, and a row's columns that fall together the first of them
        order = np.lexsort((pos, ids, h))
        again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (ids[order][1:] == ids[order][:-1])])
        order = order[~again]
        h, ids, n, pos, label = h[order], ids[order], n[order].astype(np.int64), pos[order], label[order]
        if "main" in table.column_names:
            main, asks, meets = table.column("main").to_numpy()[order], *(table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("asks", "meets"))
        else:
            main = _largest(h, label)
            asks, meets = label != main, np.ones(len(h), dtype=bool)
        start = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.flatnonzero(start)
        column = np.cumsum(start) - 1
        size = np.diff(np.append(at, len(h)))
        x = np.flatnonzero(asks)
        todo, out = np.cumsum(size[column[x]]), []
        while len(x):
            # as many rows as meet a bounded number of others
            k = max(1, int(np.searchsorted(todo, _HOT_PAIRS)))
            now, x = x[:k], x[k:]
            todo = todo[k:] - (todo[k - 1] if k else 0)
            each = size[column[now]]
            i = np.repeat(now, each)
            ends = np.cumsum(each)
            j = np.arange(ends[-1]) - np.repeat(ends - each, each) + np.repeat(at[column[now]], each)
            keep = meets[j] & (label[i] != label[j]) & ((label[j] == main[j]) | (ids[i] < ids[j]))
            i, j = i[keep], j[keep]
            both = n[i] + n[j]
            keep = (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & ((n[i] - pos[i]) * (num + den) >= both * num) & ((n[j] - pos[j]) * (num + den) >= both * num)
            i, j = i[keep], j[keep]
            i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
            out.append(np.unique(np.stack([ids[i], ids[j], n[i], n[j]], axis=1), axis=0))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64)
        return pa.table({c: pa.array(found[:, k], pa.int64()) for k, c in enumerate(("a", "b", "na", "nb"))})

    return run


def _last_round(entries: DataFrame, label: DataFrame, tested: DataFrame, blocks: int, num: int, den: int) -> DataFrame:
    """Whatever is left between different components.

    Columns that can be the first shared one of two rows name the pairs: rows whose every shared column
    comes later, behind too many of their own, are never put together.  A column of two rows names one pair; those of
    more are multiplied in blocks.  A hot column is dealt to a grid: rows that ask to its lines, rows that are met to its rows, so
    that with c cells a row is copied some sqrt(c) times and every two rows meet in one cell.
    """
    a, b = label.toDF("x", "a", "la"), label.toDF("y", "b", "lb")
    two = entries.where((F.col("k") == 2) & ~F.col("salted") & (F.col("id") != F.col("p0")) & _can_reach("n", "n0", num, den)).select(F.col("p0").alias("x"), F.col("id").alias("y"), F.col("n0").alias("nx"), F.col("n").alias("ny"), _near(0, num, den).alias("first"))
    # labels of x come before the sums, so that one shuffle by x serves both
    two = two.join(a, "x", "left").groupBy("x", "y", "nx", "ny", "a", "la").agg(F.count("*").alias("c"), F.bool_or("first").alias("first"))
    two = two.join(b, "y", "left").where(F.coalesce("la", "x") != F.coalesce("lb", "y")).select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b"), F.col("nx").cast("long").alias("nx"), F.col("ny").cast("long").alias("ny"), "c", "first")
    turned = F.col("a") > F.col("b")
    two = two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("ny")).otherwise(F.col("nx")).alias("na"), F.when(turned, F.col("nx")).otherwise(F.col("ny")).alias("nb"), "c", "first")
    # leading columns of long rows stand in the lowest quarter, which has as many ranges as the rest; a pair is named once a range
    ranges, place = max(4, blocks // 4), F.shiftrightunsigned("h", 32)
    low = F.shiftright(place * F.lit(4 * ranges), 32)
    block = F.when(low < ranges, low).otherwise(ranges + F.shiftright((place - (1 << 30)) * F.lit(ranges), 32))
    hot = F.col("salted") | (F.col("k") > _HOT)
    made = "a long, b long, na long, nb long"
    cold = _named(entries.where((F.col("k") > 2) & ~hot), label).withColumn("block", block).groupBy("block").applyInArrow(_product(num, den), made)

    mixed = _mixed(_named(entries.where((F.col("k") > 2) & hot | F.col("salted")), label))
    sizes = mixed.groupBy("h").agg(F.count("*").alias("size"), F.sum((F.col("label") != F.col("main")).cast("long")).alias("out"))
    cells = sizes.withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("size") * F.col("out") / _SPLIT)))
    # askers are copied once a column of the grid, met rows once a line: the copies are fewest at this ratio
    lines = F.greatest(F.lit(1), F.least("cells", F.ceil(F.sqrt(F.col("cells") * F.col("out") / F.col("size")))))
    grid = cells.select("h", lines.alias("lines"), F.ceil(F.col("cells") / lines).alias("columns"))
    placed = mixed.join(grid, "h").withColumns({"asking": F.col("label") != F.col("main"), "line": F.pmod(F.xxhash64("id"), F.col("lines")), "column": F.pmod(F.xxhash64("id", F.lit(1)), F.col("columns"))})
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("lines") - 1), lambda x: F.struct((x * F.col("columns") + F.col("column")).alias("part"), (F.col("asking") & (x == F.col("line"))).alias("asks"), F.lit(True).alias("meets")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1), lambda y: F.col("asking") & (y != F.col("column")))
    ask = F.transform(others, lambda y: F.struct((F.col("line") * F.col("columns") + y).alias("part"), F.lit(True).alias("asks"), F.lit(False).alias("meets")))
    # a column in cells has groups of its own
    own = F.when((F.col("lines") > 1) | (F.col("columns") > 1), F.col("h")).otherwise(F.lit(0).cast("long"))
    dealt = placed.select("h", "id", "n", "pos", "label", "main", block.alias("block"), own.alias("own"), F.explode(F.concat(met, ask)).alias("cell")).select("h", "id", "n", "pos", "label", "main", "block", "own", "cell.*")
    more = cold.union(dealt.groupBy("block", "own", "part").applyInArrow(_product(num, den), made))
    named = two.union(more.select("*", F.lit(0).cast("long").alias("c"), F.lit(True).alias("first"))).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"), F.bool_or("first").alias("first"))
    return named.where("first").drop("first").join(tested, ["a", "b"], "left_anti")


def _open(shelf: Shelf, pairs: DataFrame, entries: DataFrame, same: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, na, nb, c) those that their overlap over all leading columns leaves open.

    c counts the columns of the two rows alone; those of more are added, and as many as may have fallen together.
    pairs must be a table of the shelf.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # a class may be sent by other documents than its smallest
    own = ids.join(same.toDF("other", "id"), "id").select(F.col("other").alias("id"), F.col("id").alias("class")).union(ids.select("id", "id"))
    held = entries.where((F.col("k") > 2) | F.col("salted")).select("id", "h").join(own, "id").groupBy(F.col("class").alias("id")).agg(F.collect_set("h").alias("columns"))
    columns = ids.join(held, "id", "left").select("id", F.coalesce("columns", F.array().cast("array<long>")).alias("columns"))
    twice = entries.where("again").select("id").join(own, "id").groupBy(F.col("class").alias("a")).agg(F.count("*").alias("twice"))
    columns = shelf.put(columns)
    # most pairs fall by the numbers of their columns, and are never joined with lists of them
    sizes = columns.select("id", F.size("columns").alias("size"))
    pairs = pairs.join(twice, "a", "left").withColumn("c", F.col("c") + F.coalesce("twice", F.lit(0))).drop("twice")
    most = pairs.join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b").withColumn("most", F.col("c") + F.least("sa", "sb"))
    left = shelf.put(most.where(_rest("most", "na", "nb", num, den)).select("a", "b", "na", "nb", "c"))
    counted = left.join(columns.toDF("a", "la"), "a").join(columns.toDF("b", "lb"), "b").withColumn("c", F.col("c") + F.size(F.array_intersect("la", "lb")))
    found = shelf.put(counted.where(_rest("c", "na", "nb", num, den)).select("a", "b"))
    shelf.drop(columns, left)
    return found


def similar_components(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links have Jaccard similarity of at least num/den."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = total_bytes(docs)
    blocks, bits = max(8, -(-size // _BLOCK_TEXT)), _kept_bits(size)
    facts = shelf.put(docs.mapInArrow(_facts(width), _FACTS))
    rows = facts.where("seq is not null").select("doc_id", "n", "seq")
    frequent = spark.sparkContext.broadcast(_frequent(facts))
    columns = shelf.put(docs.mapInArrow(_leading(width, num, den, frequent, blocks, bits), "part long, n long, block binary").groupBy("part").applyInArrow(_shared_columns, _COLUMN))
    entries = _entries(columns)
    same, links = _classes(shelf, rows)
    release(spark)

    def compared(pairs: DataFrame, links: DataFrame, tested: DataFrame, fresh: bool = False) -> tuple[DataFrame, DataFrame, int, int]:
        """Links and pairs tested, with those of pairs (fresh: by class and not tested); how many were linked and asked for."""
        asked = shelf.put(pairs if fresh else _by_class(pairs, same).join(tested, ["a", "b"], "left_anti"))
        found = shelf.put(_links(docs, asked, width, num, den))
        out, done = shelf.put(links.union(found)), shelf.put(tested.union(asked))
        told = out, done, found.count(), asked.count()
        shelf.drop(asked, found, links, tested)
        release(spark)
        return told

    links, tested, _, _ = compared(_first_round(entries, num, den), links, shelf.put(links))
    met = shelf.put(_met(entries, num, den))
    for _ in range(_ROUNDS):
        label, links = _labels(shelf, links, same)
        links, tested, new, asked = compared(_tries(met, label, tested), links, tested)
        shelf.drop(label)
        if new <= _WORTH * asked:
            break
    shelf.drop(met)
    label, links = _labels(shelf, links, same)
    pairs = shelf.put(_last_round(entries, label, tested, blocks, num, den))
    release(spark)
    found = _open(shelf, pairs, entries, same, num, den)
    links, tested, _, _ = compared(found, links, tested, True)
    shelf.drop(columns, label, pairs, tested, found)
    label, _ = _labels(shelf, links, same)
    out = rows.join(label.select("id", "component"), (F.col("doc_id") == F.col("id")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
