"""Cross-tokenizer alignment against a plain reading of the contract."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from fieldmark.llm import catalog, cross_tokenizer

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair long, n long, bundle long, docs string, links string"
ODD = [
    None, "", " ", "  ", "a b", "a  b", "x\n  y", "x  y z", "p 　q r", "¿qué tal ¿no", "<|endoftext|> foo <s> bar</s>", "▁abc d", "tab\tx y", " lead", "trail ", "  two  spaces  ", "漢字 かな x",
    "😀 ok 👍🏽", "é\u0085 x y", "\x1c a b\x1d c", "it's we'll ' s", "\n\n a\n b", "a​ b", "1 2 3 12345 67", "<0x0A> x", "a b", "a b", "z" * 30000, "the idiot! " * 20000, "‘a’ «b» c", "a ̀b c", "a  b", "x   y",
]


def tokens(text):
    """(id, end) of every token of A and of B, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "both"):
        tokens.both = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        tokens.both[0].encode_special_tokens = True
    a, b = tokens.both
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    level = {c: k for k, c in byte_alphabet().items()}
    as_a = [bytes(level[c] for c in a.id_to_token(k)) for k in ids_a]
    as_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(as_a) != (" " + text).encode() or b"".join(as_b) != (" " + text).encode():
        return None
    return ends(ids_a, as_a), ends(ids_b, as_b)


def ends(ids, each):
    out, at = [], 0
    for k, x in zip(ids, each, strict=True):
        at += len(x)
        out.append((k, at))
    return out


def byte_alphabet():
    shown = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or k >= 174]
    hidden = [k for k in range(256) if k not in shown]
    return {k: chr(k) for k in shown} | {k: chr(256 + n) for n, k in enumerate(hidden)}


def brute(rows):
    found, pairs = [], Counter()
    for doc_id, text in rows:
        got = tokens(text)
        if got is None:
            found.append((doc_id, 0, 0, [], []))
            continue
        a, b = got
        at_a, at_b = {e: k for k, e in a}, {e: k for k, e in b}
        cuts = sorted(at_a.keys() & at_b.keys())
        links = [(at_a[c], at_b[c]) for c in cuts]
        pairs.update(links)
        groups, p, q = [], 0, 0
        for c in cuts:
            left, right = [], []
            while p < len(a) and a[p][1] <= c:
                left.append(str(a[p][0]))
                p += 1
            while q < len(b) and b[q][1] <= c:
                right.append(str(b[q][0]))
                q += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        found.append((doc_id, len(a), len(b), groups, links))
    highest = {}
    for (_, b), n in pairs.items():
        highest[b] = max(highest.get(b, 0), n)
    return sorted(
        [(i, n_a, n_b, len(g), len(x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", sum(pairs[p] == highest[p[1]] for p in x), sum(pairs[p] for p in x)) for i, n_a, n_b, g, x in found], key=repr
    )


def linked(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "d", "l") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in cross_tokenizer.linked(docs, A, B, **options).collect()), key=repr)


def test_odd_texts(spark):
    rows = [(k if k != 25 else 24, t) for k, t in enumerate(ODD)] + [(None, "a b c"), (None, None)]
    assert linked(spark, rows) == brute(rows)
    assert linked(spark, rows, bundle_bytes=200) == brute(rows)
    assert linked(spark, []) == []
    assert linked(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_made_texts(spark):
    rng = random.Random(5)
    signs = ["a", "B", "é", "ß", "1", ".", "'s", "-", " ", " ", "  ", "\n", "\t", " ", "　", " ", "字", "¿", "‘", "😀", "the", "ing", "</s>", "▁"]
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for k in range(400)]
    assert linked(spark, rows, bundle_bytes=3000) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    found = catalog.queries()["op12_cross_tokenizer"](spark, SF).select(*columns)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_remembered_parts():
    import numpy as np
    import pyarrow as pa

    aligner = cross_tokenizer.Aligner(A, B)
    texts = pa.array([t for t in ODD if t and len(t) < 1000])
    parts = cross_tokenizer.Parts(texts)
    assert [b"".join(parts.word(k) for k in range(parts.first[d], parts.first[d + 1])) for d in range(parts.n_docs)] == [b" " + t.encode() for t in texts.to_pylist()]
    before = aligner.entries(parts)
    aligner.entries(parts)
    rows, groups = aligner.table[before].copy(), [aligner.groups[k] for k in before]
    aligner.encode([b" never met again"])
    aligner.forget()
    assert len(aligner.groups) == len(np.unique(before))
    after = aligner.entries(parts)
    assert (aligner.table[after] == rows).all() and [aligner.groups[k] for k in after] == groups


def test_alignments(spark):
    docs = spark.createDataFrame([(1, "naïve tokenizers"), (2, None), (3, "▁")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in cross_tokenizer.alignments(docs, A, B).collect()}
    assert found[2]["groups"] == found[3]["groups"] == [] and found[2]["overlaps"] == []
    a, b = tokens("naïve tokenizers")
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    assert [g["end"] for g in found[1]["groups"]] == cuts and [g["start"] for g in found[1]["groups"]] == [0, *cuts[:-1]]
    assert [k for g in found[1]["groups"] for k in g["a"]] == [k for k, _ in a] and [k for g in found[1]["groups"] for k in g["b"]] == [k for k, _ in b]
    spans_a, spans_b = ([(s, e) for s, e in zip([0, *(e for _, e in x)], (e for _, e in x), strict=False)] for x in (a, b))
    shared = [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(spans_a) for j, y in enumerate(spans_b)]
    assert [tuple(o) for o in found[1]["overlaps"]] == [s for s in shared if s[2] > 0]


@pytest.fixture(autouse=True)
def quiet(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
