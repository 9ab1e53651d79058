"""Toxicity by a weighted finite-state pattern grammar over clauses.

Every token is a symbol: insult, threat, target, negation, report, or another word.  Five transducers read a
clause; each rewrites the symbols that concern it and weighs them.  The target transducer (a forward and a
backward one, so that a target may stand on either side) marks insults and threats that are aimed at somebody;
the negation and the reported-speech transducers mark those in their scope; the insult and the threat
transducers weigh what is marked.  `compose` makes one machine of them: its states are tuples of theirs, its arcs
feed the output of one to the next and multiply weights.  A clause's score is what its weighted hits
make together: a plain or aimed insult counts, a negated or reported one hardly, a threat only when aimed.  A document's
score combines its clauses as independent evidence: 1 - product(1 - clause).

Insults are learned from labelled documents: a word, or a word beginning of five letters, whose documents are
toxic far more often than the base rate, by a likelihood ratio that holds against the number of words
tried.  The rest of the grammar is fixed word lists.  At most `SAMPLE` labelled documents of
each label are read for learning (a hash of doc_id picks them), and at most `KEEP` entries are kept;
scoring reads every whole text.

Defined results.  A null or empty text scores 0; an empty table gives no row.  A null doc_id is scored, not learned from.  A doc_id
with several labels counts as toxic if one of them is; rows that repeat a doc_id are each scored, and learned from.  Without labels
only the fixed lists apply.  Ties for a place among `KEEP` entries go to the first in alphabetical order.  Very long texts are read
whole; a clause ends at a token that ends in one of .,;:!? or with the text.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out, letters_of
from .words import Shelf, Words, remembered, slices

#: Labelled documents of each label (toxic, not toxic) that insults are learned from.
SAMPLE = {1: 20_000, 0: 60_000}
#: Learned entries kept, best first.
KEEP = 20_000
THRESHOLD = 0.3
#: Share of a learned insult's documents that are toxic, at least: one that clean documents use too marks no text.
CERTAIN = 0.96
_STEM = 5
_REMEMBERED = 400_000

# Word lists of the grammar (English, German, French, Spanish).
INSULTS = "idiot moron stupid dumb imbecile loser scum trash worthless pathetic disgusting idiota imbécil estúpido dummkopf trottel abschaum crétin imbécile ordure".split()
THREATS = "kill murder hurt destroy strangle shoot stab matar töten umbringen tuer".split()
TARGETS = "you your yours he she they him her them people du dich ihr euch sie er tu toi vous il elle ils usted tú te ellos ella".split()
NEGATIONS = "not never no nobody isn't wasn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say quoted quote called told reported wrote sagte schrieb dit écrit dijo escribió".split()

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Marks that transducers put on an insult or a threat.
AIMED, NEGATED, REPORTED, WEIGHED = 8, 16, 32, 64
_KIND = 7


class Transducer:
    """A weighted deterministic finite-state transducer: step(state, symbol) is (next state, output symbol, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        """Output symbol and weight of each input symbol."""
        state, out = self.start, []
        for x in symbols:
            state, y, weight = self.step(state, x)
            out.append((y, weight))
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what `first` puts out to `second`; arcs are made when they are first taken."""
    arcs: dict = {}

    def step(state, x):
        arc = arcs.get((state, x))
        if arc is None:
            a, y, v = first.step(state[0], x)
            b, z, w = second.step(state[1], y)
            arc = arcs[(state, x)] = ((a, b), z, v * w)
        return arc

    return Transducer((first.start, second.start), step)


def _marking(opener: int, scope: int | None, mark: int) -> Transducer:
    """Marks hits within `scope` symbols behind an opener (None: all that follow)."""
    whole = -1

    def step(state, x):
        kind = x & _KIND
        if kind == opener:
            return (scope if scope is not None else whole), x, 1.0
        hit = kind in (INSULT, THREAT) and state != 0
        return (state if state == whole else max(0, state - 1)), x | mark if hit else x, 1.0

    return Transducer(0, step)


def _weighing(kind: int, weight) -> Transducer:
    def step(state, x):
        return (0, x | WEIGHED, weight(x)) if x & _KIND == kind else (0, x, 1.0)

    return Transducer(0, step)


#: What is left of a hit in the scope of a negation, and in reported speech; what an insult at nobody weighs.
_NEGATED, _REPORTED, _LOOSE = 0.1, 0.15, 0.9


def _context(x: int) -> float:
    return (_NEGATED if x & NEGATED else 1.0) * (_REPORTED if x & REPORTED else 1.0)


#: A target reaches its whole clause, in either direction; a negation three symbols on; a report the rest of its clause.
TARGETING = _marking(TARGET, None, AIMED)
NEGATING = _marking(NEGATION, 3, NEGATED)
REPORTING = _marking(REPORT, None, REPORTED)
INSULTING = _weighing(INSULT, lambda x: _context(x) * (1.0 if x & AIMED else _LOOSE))
THREATENING = _weighing(THREAT, lambda x: _context(x) if x & AIMED else 0.0)
#: What reads a clause from its beginning, after the backward target transducer.
GRAMMAR = compose(compose(compose(compose(TARGETING, NEGATING), REPORTING), INSULTING), THREATENING)


def clause_score(tokens: list[tuple[int, float]]) -> float:
    """Of one clause of (symbol, weight): what the composed machine makes of its insults and threats together."""
    backward = TARGETING.run([c for c, _ in reversed(tokens)])
    left = 1.0
    for (y, weight), (_, own) in zip(GRAMMAR.run([y for y, _ in reversed(backward)]), tokens, strict=True):
        if y & WEIGHED:
            left *= 1.0 - min(own * weight, 0.999)
    return 1.0 - left


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, other documents); features are words, and beginnings of words marked '*'."""
    for batch in batches:
        for piece in slices(batch, size=8 << 20):
            counts = (Counter(), Counter())
            for toxic, text in zip(piece.column("toxic").to_pylist(), piece.column("text").to_pylist(), strict=True):
                words = {w for t in set((text or "").split()) for w in letters_of(t)}
                counts[toxic].update(words | {w[:_STEM] + "*" for w in words if len(w) > _STEM})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "t": pa.array([counts[1][n] for n in names], pa.int64()), "c": pa.array([counts[0][n] for n in names], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, keep: int = KEEP) -> dict[str, tuple[int, float]]:
    """The lexicon: word or 'begin*' -> (class, weight)."""
    lexicon = {w: (INSULT, 0.6) for w in INSULTS} | {w: (THREAT, 0.6) for w in THREATS}
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if sizes.get(1) and sizes.get(0):
        share = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE[1] / sizes[1]))).otherwise(F.lit(min(1.0, SAMPLE[0] / sizes[0])))
        chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
        # at most about 80,000 ids by SAMPLE
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
        shelf = Shelf(docs.sparkSession)
        counts = shelf.put(rows.mapInArrow(_document_counts, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t + c >= 3"))
        n = {k: min(sizes[k], SAMPLE[k]) for k in (0, 1)}
        base = n[1] / (n[0] + n[1])
        both = F.col("t") + F.col("c")
        ratio = F.col("t") * F.log(F.col("t") / both / base) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / both / (1 - base))).otherwise(0.0)
        scored = counts.where("t > 0").withColumns({"g": ratio, "p": F.col("t") / both})
        tried = counts.count()
        found = scored.where((F.col("p") >= CERTAIN) & (F.col("g") > math.log(max(tried, 2)) + 3)).orderBy(F.desc("g"), "f").limit(keep)
        for r in found.collect():
            # the share of toxic documents, drawn to the base rate as if by one more document
            lexicon[r["f"]] = (INSULT, (r["t"] + base) / (r["t"] + r["c"] + 1))
        clean = counts.where(F.col("f").isin([*INSULTS, *THREATS])).collect()
        for r in clean:
            if r["c"] > r["t"]:
                lexicon.pop(r["f"], None)
        shelf.drop(counts)
    for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        for w in words:
            lexicon.setdefault(w, (kind, 1.0))
    return lexicon


class _Classes:
    """(class, weight) of each token by its hash, remembered per worker."""

    def __init__(self, lexicon: dict[str, tuple[int, float]]):
        self.lexicon, self.index = lexicon, {}
        self.kind, self.weight = np.zeros(1 << 14, np.int8), np.zeros(1 << 14)
        self.ends = np.zeros(1 << 14, bool)

    def _put(self, key: int, token: str) -> int:
        k = len(self.index)
        if k == len(self.kind):
            self.kind, self.weight, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.weight, self.ends))
        whole = token.lower().strip(".,;:!?\"'()[]")
        options = [self.lexicon.get(w) or self.lexicon.get(w[:_STEM] + "*" if len(w) > _STEM else "") for w in [whole, *letters_of(token)]]
        self.kind[k], self.weight[k] = max((o for o in options if o), key=lambda o: (o[0] in (INSULT, THREAT), o[1]), default=(NONE, 0.0))
        self.ends[k] = token[-1] in ".,;:!?"
        self.index[key] = k
        return k

    def of(self, words: Words) -> np.ndarray:
        if len(self.index) > _REMEMBERED:
            self.index = {}
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
        return entry


def _score(handle, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = remembered(key, lambda: _Classes(handle.value))
        for batch in batches:
            for piece in slices(batch):
                words = Words(piece.column("text"))
                entry = classes.of(words)
                kind = classes.kind[entry]
                hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
                score = np.zeros(words.n_docs)
                if len(hits):
                    doc = np.searchsorted(words.first, hits, side="right") - 1
                    ends = classes.ends[entry]
                    # the clause of a hit: from behind the last clause end to the next one, within the document
                    closing = np.flatnonzero(ends)
                    after = np.searchsorted(closing, hits)
                    before = np.where(after > 0, closing[np.maximum(after - 1, 0)] + 1, 0) if len(closing) else np.zeros(len(hits), np.int64)
                    begin = np.maximum(before, words.first[doc])
                    end = np.where(after < len(closing), closing[np.minimum(after, len(closing) - 1)] + 1, words.first[-1]) if len(closing) else np.full(len(hits), words.first[-1])
                    end = np.minimum(end, words.first[doc + 1])
                    left, last = np.ones(words.n_docs), -1
                    for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
                        if a == last:
                            continue
                        last = a
                        own = entry[a:b]
                        left[d] *= 1.0 - clause_score(list(zip(classes.kind[own].tolist(), classes.weight[own].tolist(), strict=True)))
                    score = 1.0 - left
                names = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return run


def score(docs: DataFrame, lexicon: dict[str, tuple[int, float]]) -> DataFrame:
    """(doc_id, score) of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(handle, uuid.uuid4().hex), "doc_id long, score double")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
