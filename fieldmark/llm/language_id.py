"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language; an unseen word falls back to
its character 5-grams, and where none is known to 4-, 3-, 2- and 1-grams.  A document's score sums its words.

The model is fitted on at most `SAMPLE` labelled documents of each of the `LANGUAGES` most labelled languages (a hash of
doc_id picks them) and keeps the `KEEP` most frequent words and n-grams of each order and language, so what the
driver holds and broadcasts has a fixed bound.  Counting is distributed and done once: the counts are a table in the
shared folder.  Scoring reads every whole text; each distinct word is scored once per worker while it is remembered.

Defined results.  A null text and a text without a letter are `und` with score 0, as is every text
when nothing labelled exists; an empty table gives no row.  A null lang labels nothing.  Rows with a null doc_id are scored,
not learned from.  Rows that repeat a doc_id are each learned from and scored.  Ties between languages go to the first in
alphabetical order.  Very long texts count and are scored whole; the score (not the prediction) takes 30 words for as
good as more.  Other columns are ignored by `predict` and kept by `annotate`, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Shelf, Words, remembered, slices

#: Labelled documents of one language that the model is fitted on.
SAMPLE = 5000
#: Languages learned, the most labelled ones.
LANGUAGES = 200
#: Words, and n-grams of each order, kept for one language.
KEEP = 20_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_REMEMBERED = 200_000


def letters_of(token: str) -> list[str]:
    """Lower-case runs of letters."""
    if token.isalpha():
        return [token.lower()]
    return "".join(c if c.isalpha() else " " for c in token.lower()).split()


def grams(word: str, n: int) -> list[str]:
    framed = f"^{word}$"
    return [framed[k : k + n] for k in range(len(framed) - n + 1)] if n > 1 else list(word)


def held_out(doc_id="doc_id"):
    """Whether a row is kept out of all learning."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, count) of each batch; order 0 stands for whole words."""
    for batch in batches:
        for piece in slices(batch):
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update((text or "").split())
            for lang, tokens in by_lang.items():
                found = {n: Counter() for n in (0, *ORDERS)}
                for token, k in tokens.items():
                    for word in letters_of(token):
                        found[0][word] += k
                for word, k in found[0].items():
                    for n in ORDERS:
                        for g in grams(word, n):
                            found[n][g] += k
                for n, counts in found.items():
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "n": pa.array([n] * len(counts), pa.int32()), "gram": pa.array(list(counts), pa.string()), "c": pa.array(list(counts.values()), pa.int64())})


class Model:
    """Log frequencies: tables[n] maps a word (n = 0) or an n-gram to a row of `rows`, one column per language."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, int]], rows: np.ndarray):
        self.langs, self.tables, self.rows = langs, tables, rows

    def word(self, word: str) -> np.ndarray:
        at = self.tables[0].get(word)
        if at is not None:
            return self.rows[at]
        for n in ORDERS:
            known = [self.tables[n][g] for g in grams(word, n) if g in self.tables[n]]
            if known:
                return self.rows[known].mean(axis=0)
        return np.zeros(len(self.langs))


def fit(docs: DataFrame, sample: int = SAMPLE, keep: int = KEEP) -> Model:
    """The model, from labelled rows of docs (doc_id, text, lang) that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {n: {} for n in (0, *ORDERS)}, np.zeros((0, 0)))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    chosen = labelled.where(F.col("lang").isin(langs) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)))
    shelf = Shelf(docs.sparkSession)
    counts = shelf.put(chosen.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    totals = {(r["lang"], r["n"]): r["t"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("t")).collect()}
    order = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram")
    kept = counts.where((F.col("n") > 0) | (F.col("c") > 1)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep)
    place = {lang: k for k, lang in enumerate(langs)}
    tables: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
    found = kept.select("lang", "n", "gram", "c").toArrow()
    shelf.drop(counts)
    at = [tables[n].setdefault((n, g), len(tables[n])) for n, g in zip(found.column("n").to_pylist(), found.column("gram").to_pylist(), strict=True)]
    # rows of one order stand together
    first, total_rows = {}, 0
    for n in tables:
        first[n], total_rows = total_rows, total_rows + len(tables[n])
    tables = {n: {g: first[n] + k for (_, g), k in table.items()} for n, table in tables.items()}
    rows = np.zeros((total_rows, len(langs)))
    row = np.array([first[n] for n in found.column("n").to_pylist()], np.int64) + np.array(at, np.int64)
    rows[row, [place[x] for x in found.column("lang").to_pylist()]] = found.column("c").to_numpy()
    for n, table in tables.items():
        own = np.fromiter(table.values(), np.int64, len(table))
        total = np.array([totals.get((lang, n), 0) for lang in langs], dtype=float)
        rows[own] = np.log((rows[own] + 0.1) / (total + 0.1 * max(1, len(table))))
    return Model(langs, tables, rows)


class _Scores:
    """Rows of (log frequencies..., number of words) for tokens, by token hash."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.index: dict[int, int] = {}
        self.rows = np.zeros((1 << 14, len(self.model.langs) + 1))

    def of(self, words: Words) -> np.ndarray:
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
                at[j] = self._put(keys[j], words.word(first[j]).decode("utf-8", "replace"))
        entry = np.empty(len(h), np.int64)
        entry[order] = np.array(at, np.int64)[np.cumsum(new) - 1] if len(h) else 0
        total = np.zeros((words.n_docs, self.rows.shape[1]))
        for c in range(self.rows.shape[1]):
            ends = np.concatenate([[0.0], np.cumsum(self.rows[entry, c])])
            total[:, c] = ends[words.first[1:]] - ends[words.first[:-1]]
        return total

    def _put(self, key: int, token: str) -> int:
        k = len(self.index)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for word in letters_of(token):
            self.rows[k, :-1] += self.model.word(word)
            self.rows[k, -1] += 1
        self.index[key] = k
        return k


def _predict(model, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, langs = remembered(key, lambda: _Scores(model.value)), model.value.langs
        for batch in batches:
            for piece in slices(batch):
                total = scores.of(Words(piece.column("text")))
                n = np.rint(total[:, -1])
                some = (n > 0) & bool(langs)
                logits = total[:, :-1] * (np.minimum(n, 30) / np.maximum(n, 1))[:, None]
                if langs:
                    p = np.exp(logits - logits.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    score = np.where(some, p[np.arange(len(p)), best], 0.0)
                    pred = [langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                else:
                    score, pred = np.zeros(len(n)), [UNKNOWN] * len(n)
                columns = [piece.column(c) for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score)], names=[*[c for c in piece.schema.names if c != "text"], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(handle, uuid.uuid4().hex), "doc_id long, lang_pred string, score double")


def annotate(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the predicted language and its score beside all their own columns, in one pass."""
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(model)
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col("text").cast("string").alias("text"))
    fields = [f"own_{k} {kind}" for k, (_, kind) in enumerate(docs.dtypes)]
    out = rows.mapInArrow(_predict(handle, uuid.uuid4().hex), ", ".join([*fields, "lang_pred string", "score double"]))
    return out.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("lang_pred").alias(pred), F.col("score").alias(score))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
