"""Cross-tokenizer alignment by byte-owner arrays.

Each byte of a text is owned by one token of tokenizer A and one of tokenizer B: np.repeat spreads the token numbers
over their bytes.  Consecutive distinct owner pairs are the overlaps; where both owners change at once lies a cut, and the
pair of owners before a cut is a link (two tokens that end together).  How often an id pair is linked in the whole corpus rates every link.

Whole texts by their parts.  A text is cut before each single space that stands between two visible characters.  Neither
tokenizer joins anything across such a place: a byte-level pre-token holds a space only at its beginning, and no piece of B has
its word mark behind another character (checked when the model is loaded; otherwise whole texts are encoded).  So a part has the same tokens wherever it stands, its end is
always a cut, and a Python worker encodes and aligns each distinct part once while it is remembered; new parts are encoded joined.

Plan.  One scan turns texts into bundles of some 16 MB of text: the documents' counts and digests, the bundle's distinct id
pairs with their counts, and the stream of links as numbers of those pairs, compressed.  The bundles are a table in the shared folder, so nothing is
encoded twice.  Pairs are summed over bundles, the highest count of each B id is taken, and each bundle gets back one rating
for each of its pairs.  A pair that all documents hold costs one entry a bundle; nothing is collected.

Defined results.  A text that is null, empty or not given back byte for byte by both tokenizers (U+2581, broken UTF-8) has no tokens: zeros and ''.
An empty table gives no row.  Rows that repeat a doc_id, or have none, are each counted and answered.  Ties for the highest count are all best.  Very long texts are encoded
whole; one bundle holds at least one document.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _BYTE
from .words import Shelf, Words, remembered, slices

#: Text and documents of one bundle.
BUNDLE_BYTES, BUNDLE_DOCS = 16 << 20, 50_000
#: Distinct parts that one worker remembers, and bytes of new parts that are encoded together.
_PARTS, _JOINED = 500_000, 1 << 16
_MARK = "▁"
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x80:] = True
#: First bytes of the characters among which the white space beyond ASCII lies.
_DOUBTFUL = np.zeros(256, dtype=bool)
_DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Parts(Words):
    """The parts of " " + text of every row; hashes and extents as for words."""

    def __init__(self, texts: pa.Array, whole: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary()))
        super().__init__(pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(b"", pa.large_binary()), spaced))
        raw = self.buf[:-8]
        if whole or len(raw) < 3:
            places = np.zeros(0, np.int64)
        else:
            at = np.flatnonzero(raw[1:-1] == 0x20) + 1
            after, before = raw[at + 1], raw[at - 1]
            fine = _VISIBLE[after] & ~_DOUBTFUL[after] & _VISIBLE[before]
            wide = before >= 0x80
            fine &= ~(wide & ((raw[np.maximum(at - 2, 0)] == 0xC2) | _DOUBTFUL[raw[np.maximum(at - 3, 0)]]))
            places = at[fine]
        edges = np.sort(np.concatenate([places, self.offsets]), kind="stable")
        edges = edges[np.append(True, edges[1:] != edges[:-1])]
        self.starts, self.ends = edges[:-1], edges[1:]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)


class Aligner:
    """Both tokenizers and the alignment of every part that was met."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in _BYTE.items()}
        size = self.a.get_vocab_size()
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        self.bytes_a = [bytes(map(byte.__getitem__, e)) if all(c in byte for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = ([str(k) for k in range(len(xs))] for xs in (self.bytes_a, self.bytes_b))
        #: whether a piece joins a mark to something before it, so that parts would not stand alone
        self.whole = any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.groups: list[str] = []
        self.pair_index: dict[int, int] = {}
        self.pairs = np.zeros(1 << 14, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        #: of each part: tokens of A and B, groups, links (-1: its bytes do not come back), first link
        self.table, self.start, self.met = np.zeros((1 << 14, 4), np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def forget(self) -> None:
        """Keeps the parts that were met in more than one slice; the others would fill the memory."""
        kept = [(k, v) for k, v in self.index.items() if self.met[v] > 1][: _PARTS // 2]
        of = np.array([v for _, v in kept], np.int64)
        groups, codes, table, start = self.groups, self.pairs, self.table[of], self.start[of]
        flat = [codes[self.flat[a : a + n]] for a, n in zip(start.tolist(), table[:, 2].tolist(), strict=True)]
        self.clear()
        for (key, v), row, own in zip(kept, table.tolist(), flat, strict=True):
            self.index[key] = len(self.groups)
            self._put(row[0], row[1], groups[v], own, row[3])

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A over `text`, which begins with a space, and of B over the rest; None where their bytes differ from it."""
        plain = text.decode("utf-8", "replace")
        a, b = self.a.encode(plain, add_special_tokens=False).ids, self.b.encode(plain[1:])
        if b"".join(map(self.bytes_a.__getitem__, a)) != text or b"".join(map(self.bytes_b.__getitem__, b)) != text:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def owners(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the token that owns each byte, in A and in B."""
        return np.repeat(np.arange(len(a)), self.length_a[a]), np.repeat(np.arange(len(b)), self.length_b[b])

    def encode(self, parts: list[bytes]) -> None:
        """Aligns new parts, joined: their ends are cuts."""
        text = b"".join(parts)
        got = self.tokens(text)
        if got is None:
            if len(parts) > 1:
                for part in parts:
                    self.encode([part])
            else:
                self._put(0, 0, "", np.zeros(0, np.int64), -1)
            return
        a, b = got
        own_a, own_b = self.owners(a, b)
        cuts = np.append(np.flatnonzero((own_a[1:] != own_a[:-1]) & (own_b[1:] != own_b[:-1])), len(text) - 1)
        last_a, last_b = own_a[cuts], own_b[cuts]
        ends = np.cumsum([len(p) for p in parts]) - 1
        of = np.searchsorted(cuts, ends)
        if (cuts[of] != ends).any():
            raise ValueError("a tokenizer joins text across the end of a part")
        codes = a[last_a] * len(self.bytes_b) + b[last_b]
        named_a, named_b = [self.name_a[k] for k in a.tolist()], [self.name_b[k] for k in b.tolist()]
        made, p, q = [], 0, 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            made.append((named_a[p] if x == p + 1 else ",".join(named_a[p:x])) + "|" + (named_b[q] if y == q + 1 else ",".join(named_b[q:y])))
            p, q = x, y
        g = p = q = 0
        for stop in (of + 1).tolist():
            x, y = int(last_a[stop - 1]) + 1, int(last_b[stop - 1]) + 1
            self._put(x - p, y - q, ";".join(made[g:stop]), codes[g:stop], stop - g)
            g, p, q = stop, x, y

    def _put(self, n_a: int, n_b: int, groups: str, codes: np.ndarray, links: int) -> None:
        k, n = len(self.groups), len(codes)
        if k == len(self.table):
            self.table, self.start, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.start, self.met))
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[k], self.table[k] = self.used, (n_a, n_b, n, links)
        for code in codes.tolist():
            at = self.pair_index.setdefault(code, len(self.pair_index))
            if at == len(self.pairs):
                self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
            self.pairs[at] = code
            self.flat[self.used] = at
            self.used += 1
        self.groups.append(groups)

    def entries(self, parts: Parts) -> np.ndarray:
        """The remembered part of every part of a slice."""
        h = parts.hash
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        keys, first = s[new].tolist(), order[new]
        at = [self.index.get(k, -1) for k in keys]
        fresh, room = [], 0
        for j, k in enumerate(at):
            if k < 0:
                word = parts.word(first[j])
                if fresh and room + len(word) > _JOINED:
                    self.encode(fresh)
                    fresh, room = [], 0
                at[j] = self.index[keys[j]] = len(self.groups) + len(fresh)
                fresh.append(word)
                room += len(word)
        if fresh:
            self.encode(fresh)
        self.met[at] += 1
        entry = np.empty(len(h), np.int64)
        if len(h):
            entry[order] = np.array(at, np.int64)[np.cumsum(new) - 1]
        return entry


def _aligner(path_a: str, path_b: str) -> Aligner:
    return remembered(("align", path_a, path_b), lambda: Aligner(path_a, path_b))


def _squeeze(x: np.ndarray, distinct: int) -> bytes:
    import zstandard

    x = x.astype("<u2" if distinct <= 1 << 16 else "<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unsqueeze(data: bytes, distinct: int) -> np.ndarray:
    import zstandard

    kind, raw = np.dtype("<u2" if distinct <= 1 << 16 else "<u4"), zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, len(raw) // kind.itemsize).T).view(kind).reshape(-1)


_DOC = pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string())])
_BUNDLE = pa.schema([("bundle", pa.int64()), ("docs", pa.list_(_DOC)), ("pair", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("links", pa.binary())])
_BUNDLES = "bundle long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, pair array<long>, n array<long>, links binary"


class _Bundle:
    def __init__(self):
        self.docs, self.links, self.size = [], [], 0

    def add(self, aligner: Aligner, piece: pa.RecordBatch) -> None:
        parts = Parts(piece.column("text"), aligner.whole)
        entry = aligner.entries(parts)
        rows = aligner.table[entry]
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(rows, axis=0)])
        lost = np.concatenate([[0], np.cumsum(rows[:, 3] < 0)])
        a, b = parts.first[:-1], parts.first[1:]
        known = lost[a] == lost[b]
        counts = np.where(known[:, None], total[b] - total[a], 0)
        kept = entry[np.repeat(known, parts.counts)]
        length = aligner.table[kept, 3]
        ends = np.cumsum(length)
        self.links.append(aligner.flat[np.arange(int(length.sum())) + np.repeat(aligner.start[kept] - (ends - length), length)])
        groups, each = aligner.groups, entry.tolist()
        for d, doc_id in enumerate(piece.column("doc_id").to_pylist()):
            mine = [groups[k] for k in each[a[d] : b[d]]] if known[d] else ()
            digest = hashlib.sha256(";".join(mine).encode()).hexdigest() if mine else ""
            self.docs.append((doc_id, *counts[d].tolist(), digest))
        self.size += len(parts.buf)

    def batch(self, aligner: Aligner, number: int) -> pa.RecordBatch:
        links = np.concatenate(self.links)
        counts = np.bincount(links, minlength=len(aligner.pair_index))
        held = np.flatnonzero(counts)
        held = held[np.argsort(aligner.pairs[held])]
        place = np.zeros(len(counts), np.int64)
        place[held] = np.arange(len(held))
        docs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.docs, strict=True), _DOC, strict=True)], fields=list(_DOC))
        columns = [pa.array([number]), pa.ListArray.from_arrays([0, len(docs)], docs), *(pa.ListArray.from_arrays([0, len(held)], pa.array(x)) for x in (aligner.pairs[held], counts[held]))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, pa.array([_squeeze(place[links], len(held))])], _BUNDLE, strict=True)], schema=_BUNDLE)


def _bundled(path_a: str, path_b: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number, bundle = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32, _Bundle()
        for batch in batches:
            for piece in slices(batch):
                bundle.add(aligner, piece)
                if bundle.size >= size or len(bundle.docs) >= BUNDLE_DOCS:
                    yield bundle.batch(aligner, number)
                    number, bundle = number + 1, _Bundle()
                    if len(aligner.groups) > _PARTS:
                        aligner.forget()
        if bundle.docs:
            yield bundle.batch(aligner, number)

    return run


def _rated(key: tuple, bundles: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over each document's links of what the corpus says about their pairs."""
    answers = answers.sort_by("pair")
    count, best = answers.column("count").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
    links = _unsqueeze(bundles.column("links")[0].as_py(), len(count)).astype(np.int64)
    docs = bundles.column("docs").combine_chunks().flatten()
    ends = np.concatenate([[0], np.cumsum(docs.field("n_links").to_numpy())])
    sums = [np.concatenate([[0], np.cumsum(x[links])]) if len(links) else np.zeros(1, np.int64) for x in (best, count)]
    columns = [docs.field(k) for k in range(docs.type.num_fields)]
    return pa.table([*columns, *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], names=[*(f.name for f in docs.type), "n_best", "count_sum"])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def linked(docs: DataFrame, path_a: str, path_b: str, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """One row per document: tokens, groups, links, how many links are their B id's most frequent one, and the links' summed counts."""
    shelf = Shelf(docs.sparkSession)
    bundles = shelf.put(_documents(docs).mapInArrow(_bundled(path_a, path_b, bundle_bytes), _BUNDLES))
    entries = bundles.select("bundle", F.explode(F.arrays_zip("pair", "n")).alias("e")).select("bundle", "e.pair", "e.n")
    pieces = _pieces(path_b)
    counts = shelf.put(entries.groupBy("pair").agg(F.sum("n").alias("count")))
    of_b = F.col("pair") % pieces
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("highest"))
    rated = counts.withColumn("b", of_b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = entries.select(F.col("bundle").alias("of"), "pair").join(rated, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return bundles.select("bundle", "docs", "links").groupBy("bundle").cogroup(answers.groupBy("of")).applyInArrow(_rated, schema)


def _pieces(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def _spans(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for piece in slices(batch):
                found = [_aligned(aligner, text) for text in piece.column("text").cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array([f[k] for f in found], t) for k, t in enumerate((_GROUPS, _OVERLAPS)))], names=["doc_id", "groups", "overlaps"])

    return run


def _aligned(aligner: Aligner, text: bytes | None) -> tuple[list[dict], list[dict]]:
    got = aligner.tokens(b" " + text) if text else None
    if got is None:
        return [], []
    a, b = got
    own_a, own_b = aligner.owners(a, b)
    new_a, new_b = (np.append(x[1:] != x[:-1], True) for x in (own_a, own_b))
    groups, start, p, q = [], 0, 0, 0
    for at in np.flatnonzero(new_a & new_b).tolist():
        x, y = int(own_a[at]) + 1, int(own_b[at]) + 1
        groups.append({"start": start, "end": at + 1, "a": a[p:x].tolist(), "b": b[q:y].tolist()})
        start, p, q = at + 1, x, y
    last = np.flatnonzero(new_a | new_b)
    length = np.diff(np.concatenate([[-1], last]))
    return groups, [{"a": x, "b": y, "bytes": z} for x, y, z in zip(own_a[last].tolist(), own_b[last].tolist(), length.tolist(), strict=True)]


_GROUPS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))
_OVERLAPS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())]))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document's groups (byte range in " " + text, ids of A and B) and overlaps (numbers of the tokens, shared bytes)."""
    schema = "doc_id long, groups array<struct<start:long,end:long,a:array<long>,b:array<long>>>, overlaps array<struct<a:long,b:long,bytes:long>>"
    return _documents(docs).mapInArrow(_spans(path_a, path_b), schema)


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
