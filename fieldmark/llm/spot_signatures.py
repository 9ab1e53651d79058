"""SpotSigs document fingerprints (Theobald, Siddharth, Paepcke, "SpotSigs: robust and efficient near duplicate
detection in large web collections", 2008).

A common word (an anchor) starts a spot signature: the anchor with the chain of the next content words, skipping
anchors.  A document's fingerprint is its set of signatures, so what stands in menus and short lists, without common
words, has little part in it.  Anchors are known without case and without signs around them.
Where `GAP` words in a row are no anchor, each content word after them starts a signature too, so texts
of few anchors, or in languages without them here, are compared by what stands in them.  A text of fewer than `FEW`
signatures has also those of all its runs of `CHAIN` + 1 words and one of its whole word sequence, or short texts
that share a phrase would count as equal.

A fingerprint is a string: the number of signatures, then the 32-bit hashes of all of them, sorted, in hex.
Likeness is the Jaccard similarity of two whole sets.

`near_pairs` compares all documents of a table.  Equal sets are one; the others are partitioned by set length,
in ranges so wide that a set can only be alike with sets of its own range and the next.  In a range, sets meet
where they share one of their rarest signatures (as many as two sets alike must share one of), and their comparison
stops as soon as the bound on what is left falls below the wanted similarity.  None of this loses a pair.
`with_next`, the query, compares given pairs and needs no partitions.

Defined results.  A null text is the empty text, its fingerprint has no signature, and two such are equal.
Rows come in order of doc_id, then text; a null doc_id comes first.  In a table of one row the next document is
the row itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, mix, remembered, shared_dir, slices, total_bytes

#: Content words in a chain.
CHAIN = 2
#: Words without an anchor after which every content word starts a signature.
GAP = 16
#: Signatures below which a text's runs of words and its whole word sequence count too.
FEW = 4
#: Signature hashes that a comparison reads before it looks at its bound again.
KEPT = 256
_PART_BYTES = 3 << 20
_REMEMBERED = 300_000

# Common words that start a signature (English, German, French, Spanish).
ANCHORS = frozenset(
    "a an the is are was were be been do does did have has had of in to and for on with that this it as at by from or not you he she they "
    "der die das ein eine und ist sind war in im zu mit von auf für den dem des sich nicht als auch "
    "le la les un une et est sont dans de du des que qui en pour par sur pas au aux ce il elle "
    "el los las una y es son en de del que por para con no se su al lo como".split()
)


_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


class _Anchors:
    """Whether each token is an anchor and its hash without case and outer punctuation, remembered per worker."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.kind, self.core = np.zeros(1 << 14, np.int8), np.zeros(1 << 14, np.uint64)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > _REMEMBERED:
            self.clear()
        h = words.hash
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        first, keys = order[np.flatnonzero(new)], s[new].tolist()
        at = [self.index.get(k, -1) for k in keys]
        for j, k in enumerate(at):
            if k < 0:
                at[j] = self._put(keys[j], words.word(first[j]))
        entry = np.empty(len(h), np.int64)
        entry[order] = np.array(at, np.int64)[np.cumsum(new) - 1] if len(h) else 0
        return self.kind[entry], self.core[entry]

    def _put(self, key: int, token: bytes) -> int:
        import xxhash

        k = len(self.index)
        if k == len(self.kind):
            self.kind, self.core = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.core))
        word = token.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]")
        # the&&& is an anchor as the is
        bare = _OUTER.sub("", word)
        if bare in ANCHORS:
            word = bare
        # 2: anchor, 1: content word, 0: punctuation alone
        self.kind[k] = 2 if word in ANCHORS else 1 if word else 0
        self.core[k] = xxhash.xxh64_intdigest(word)
        self.index[key] = k
        return k


def signatures(words: Words, anchors: _Anchors, chain: int) -> list[np.ndarray]:
    """Each document's set of signature hashes, sorted."""
    kind, core = anchors.of(words)
    content = np.flatnonzero(kind == 1)
    # the word before each: the last anchor, or the last of the document before
    at = np.arange(len(kind))
    last = np.maximum.accumulate(np.where(kind == 2, at, -1)) if len(kind) else at
    last = np.maximum(last, np.repeat(words.first[:-1], words.counts) - 1)
    starts = np.flatnonzero((kind == 2) | ((kind == 1) & (at - last > GAP)))
    nth = np.searchsorted(content, starts, side="right")
    doc = np.searchsorted(words.first, starts, side="right") - 1
    h = core[starts].copy()
    whole = nth + chain <= len(content)
    starts, nth, doc, h = starts[whole], nth[whole], doc[whole], h[whole]
    if len(starts):
        inside = content[nth + chain - 1] < words.first[doc + 1]
        nth, doc, h = nth[inside], doc[inside], h[inside]
    for j in range(chain):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + core[content[nth + j]]) if len(h) else h
    one, _ = words.sequence_hashes()
    cut = np.searchsorted(doc, np.arange(words.n_docs + 1))
    out = []
    for d in range(words.n_docs):
        own = np.unique((h[cut[d] : cut[d + 1]] >> np.uint64(32)).astype(np.uint32))
        if len(own) < FEW and words.counts[d]:
            run = core[words.first[d] : words.first[d + 1]]
            n = max(0, len(run) - chain)
            near = run[:n]
            for j in range(1, chain + 1):
                near = mix(near * np.uint64(0x9E3779B97F4A7C15) + run[j : j + n])
            more = np.append(near, one[d]) >> np.uint64(32)
            own = np.unique(np.concatenate([own, more.astype(np.uint32)]))
        out.append(own)
    return out


def fingerprint(found: np.ndarray) -> str:
    return f"{len(found)}:" + found.astype(">u4").tobytes().hex()


def parse(text: str) -> tuple[int, np.ndarray]:
    n, _, digits = text.partition(":")
    return int(n), np.frombuffer(bytes.fromhex(digits), dtype=">u4").astype(np.uint32)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], kept: int = KEPT, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 0 where it does not reach `least`, told by set sizes or by what is left."""
    (n, x), (m, y) = a, b
    if n == 0 and m == 0:
        return 1.0
    if n == 0 or m == 0 or min(n, m) / max(n, m) < least:
        return 0.0
    if least <= 0:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (n + m - both)
    both = i = j = 0
    while i < n and j < m:
        top = min(x[min(i + kept, n) - 1], y[min(j + kept, m) - 1])
        p, q = int(np.searchsorted(x, top, side="right")), int(np.searchsorted(y, top, side="right"))
        both += len(np.intersect1d(x[i:p], y[j:q], assume_unique=True))
        i, j = p, q
        most = both + min(n - i, m - j)
        if most / (n + m - most) < least:
            return 0.0
    return both / (n + m - both)


def ordered_parts(docs: DataFrame, part_bytes: int = _PART_BYTES) -> DataFrame:
    """docs by ranges of doc_id, each with a copy of the next range's first row (the last range: of the first row).

    Adds part and ahead (1 for such a copy).  Ranges are bounded by quantiles of doc_id, so a part
    is about part_bytes.  The driver holds, and each task gets, two ids per part: 16 bytes for part_bytes of text.
    """
    lowest = -(1 << 63)
    parts = max(1, -(-total_bytes(docs) // part_bytes))
    key = F.coalesce("doc_id", F.lit(lowest))
    found = docs.select(key.alias("k")).agg(F.percentile_approx("k", F.array(*[F.lit(j / parts) for j in range(1, parts)]), max(10_000, 4 * parts))).first()[0] if parts > 1 else []
    cuts = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(found or [], np.int64)))

    @F.pandas_udf(T.IntegerType())
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, k.to_numpy(), side="right").astype(np.int32))

    firsts = sorted((r["k"], r["part"]) for r in docs.select(key.alias("k")).select("k", part_of("k").alias("part")).groupBy("part").agg(F.min("k").alias("k")).collect())
    # each part's first id, and the part before it
    heads = docs.sparkSession.sparkContext.broadcast((np.array([k for k, _ in firsts], np.int64), np.array([firsts[j - 1][1] for j in range(len(firsts))], np.int32)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(k: pd.Series) -> pd.Series:
        """The row's own part and, for the first row of a part, the one before."""
        ids = k.to_numpy()
        own = np.searchsorted(cuts.value, ids, side="right")
        first, before = heads.value
        at = np.minimum(np.searchsorted(first, ids), max(0, len(first) - 1))
        head = first[at] == ids if len(first) else np.zeros(len(ids), bool)
        return pd.Series([[int(o), int(before[x])] if h else [int(o)] for o, x, h in zip(own, at, head, strict=True)])

    return docs.select("*", F.posexplode(places(key)).alias("ahead", "part"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(chain: int, kept: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        anchors = remembered("anchors", _Anchors)
        table = table.sort_by([("ahead", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        ahead = table.column("ahead").to_numpy()
        own = int((ahead == 0).sum())
        # nulls sort last in Arrow, first by contract
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(own), key=lambda k: (ids[k] is not None, ids[k] or 0, k))
        if own < len(ids):
            # of rows that repeat the first id of the next range, the first in order
            order.append(own)
        table = table.take(pa.array(order, pa.int64())) if order else table.slice(0, 0)
        out = {name: [] for name in _OUT.names}
        at = 0
        for piece in slices(table):
            n = min(piece.num_rows, own - at)
            if n <= 0:
                break
            rows = table.slice(at, n + 1 if at + n < table.num_rows else n)
            texts = [t or "" for t in rows.column("text").to_pylist()]
            if len(texts) == n:
                texts.append(texts[-1])
            edited = []
            for k in range(n):
                size = len(texts[k])
                half = size // 2
                edited.append(texts[k][: size - half] + texts[k + 1][:half])
            sets = [signatures(Words(pa.array(x, pa.large_string())), anchors, chain) for x in (texts, edited)]
            prints, edits = ([fingerprint(f) for f in s] for s in sets)
            parsed, others = ([(len(f), f) for f in s] for s in sets)
            out["doc_id"] += rows.column("doc_id").to_pylist()[:n]
            out["n_chars"] += [len(t) for t in texts[:n]]
            out["edited_sha256"] += [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
            out["fingerprint"] += prints[:n]
            out["edited_fingerprint"] += edits
            out["near_edited"] += [likeness(parsed[k], others[k], kept) for k in range(n)]
            out["near_next"] += [likeness(parsed[k], parsed[k + 1], kept) for k in range(n)]
            at += n
        return pa.table(out, schema=_OUT)

    return run


def with_next(docs: DataFrame, chain: int = CHAIN, kept: int = KEPT) -> DataFrame:
    """Fingerprints of each document, of its text edited with the next document's, and their likeness."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered_parts(rows).groupBy("part").applyInArrow(_compared(chain, kept), schema)


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(doc_id, fingerprint, n_signatures) of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = remembered("anchors", _Anchors)
        for batch in batches:
            for piece in slices(batch):
                found = signatures(Words(piece.column("text")), anchors, chain)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([fingerprint(f) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int64())], names=["doc_id", "fingerprint", "n_signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_signatures long")


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([likeness(parse(x), parse(y), least=z) for x, y, z in zip(a, b, least, strict=True)], dtype="float64")


def length_range(n: int, least: float) -> int:
    """The range of set length n: what is at least `least` alike is in the same range or in one next to it."""
    k, start = 0, 1
    while True:
        start = math.floor(start / least) + 1
        if n < start:
            return k
        k += 1


def near_pairs(docs: DataFrame, least: float, chain: int = CHAIN) -> DataFrame:
    """(doc_id, other_id, near) of all documents whose likeness is at least `least`, over 0 and at most 1.

    Documents of equal sets are given once each, with the first of them (near 1.0); two different sets by
    their first documents.  So a group of n copies makes n - 1 rows, and all pairs follow from them.  A null doc_id
    comes first; a row that repeats a doc_id and its set is a copy of its own.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1.")
    spark, lowest = docs.sparkSession, -(1 << 63)
    shared_dir(spark)
    rows = fingerprints(docs, chain).select(F.coalesce("doc_id", F.lit(lowest)).alias("id"), "fingerprint", "n_signatures")
    copies = rows.groupBy("id", "fingerprint", "n_signatures").agg(F.count("*").alias("times"))
    # two sets may have the same doc_id, so sets have numbers of their own
    found = copies.groupBy("fingerprint", "n_signatures").agg(F.min("id").alias("id")).withColumn("k", F.monotonically_increasing_id()).checkpoint()
    first = found.select(F.col("fingerprint").alias("of"), F.col("id").alias("first"))
    same = copies.join(first, F.col("fingerprint") == F.col("of")).select("first", F.col("id").alias("other"), (F.col("times") - F.when(F.col("id") == F.col("first"), 1).otherwise(0)).alias("n"))
    same = same.where("n > 0").select("first", "other", F.lit(1.0).alias("near"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def members(prints: pd.Series) -> pd.Series:
        return pd.Series([parse(p)[1].astype(np.int64) for p in prints])

    @F.pandas_udf(T.IntegerType())
    def range_of(lengths: pd.Series) -> pd.Series:
        return pd.Series([length_range(n, least) for n in lengths.tolist()], dtype="int32")

    # rarest first: a common signature stands last and seldom leads to a comparison
    each = found.where("n_signatures > 0").select("k", F.col("n_signatures").alias("n"), F.explode(members("fingerprint")).alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often"))
    # sets alike share ceil(least * n) of n, so one of the first n - ceil(least * n) + 1; a hair less against rounding
    heads = each.join(often, "s").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("ranked"))
    heads = heads.select("k", "n", range_of("n").alias("range"), F.explode(F.expr(f"slice(ranked, 1, greatest(1, cast(n - ceil({least!r}D * n - 1e-6D) + 1 as int)))")).alias("r")).where("r.often > 1").select("k", "n", "range", "r.s")
    a = heads.select(F.col("k").alias("a"), F.col("n").alias("an"), "s", F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("range"))
    b = heads.select(F.col("k").alias("b"), F.col("n").alias("bn"), "s", "range")
    # a shorter set meets longer ones, once in its range or in the next
    met = a.join(b, ["range", "s"]).where((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))).where(F.col("an") / F.col("bn") >= least).select("a", "b").distinct()
    one = found.select(F.col("k").alias("a"), F.col("id").alias("a_id"), F.col("fingerprint").alias("x"))
    two = found.select(F.col("k").alias("b"), F.col("id").alias("b_id"), F.col("fingerprint").alias("y"))
    near = met.join(one, "a").join(two, "b").withColumn("near", _alike("x", "y", F.lit(least))).where(F.col("near") >= least)
    near = near.select(F.least("a_id", "b_id").alias("first"), F.greatest("a_id", "b_id").alias("other"), "near")
    back = lambda c: F.when(F.col(c) != lowest, F.col(c))
    return same.unionByName(near).select(back("first").alias("doc_id"), back("other").alias("other_id"), "near")


def op2_spot_signatures(spark, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
