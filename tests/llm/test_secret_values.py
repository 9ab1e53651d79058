"""Whole values behind names of credentials, and the scan against a plain reading of words."""

import random
import re

import pytest

from fieldmark.llm import secret_scan

MASK = secret_scan.MASK


@pytest.fixture(scope="module")
def forest():
    import public_tokenizers

    return secret_scan.train(words=public_tokenizers.path("word_bpe_49k.json"))


WHOLE = {
    "password=Tr0ub4dor&3horse!": f"password={MASK}", "key: p@ssw0rd!2024": f"key: {MASK}", "token=abc=DEF1234567890xyz": f"token={MASK}", "secret=dGhpc2lzYXNlY3JldA==": f"secret={MASK}", 'apikey="ab cd1234567890"': f'apikey="{MASK}"',
    "see password: 'x9#Kq!72 zz' there": f"see password: '{MASK}' there", "DB_PASSWORD = Wr0ng+H0rse%": f"DB_PASSWORD = {MASK}", "password=é1ß2ü3xyz9!": f"password={MASK}", "{\"token\":\"a8$kd92#lq\",\"n\":1}": f"{{\"token\":\"{MASK}\",\"n\":1}}", "pwd=q7&Zt4!m, next": f"pwd={MASK}, next",
}
LEFT = ["password=$DB_PASSWORD", "password: ********", "the token: remember!", "key: https://www.site.org/page", "password=<your-password>", 'password="" then', 'say password="open and never closed', "keys: a, b"]


def test_whole_values(spark, forest):
    df = spark.createDataFrame(list(enumerate([*WHOLE, *LEFT])), "doc_id long, text string")
    out = [r["text"] for r in secret_scan.redact(df, forest).orderBy("doc_id").collect()]
    assert dict(zip([*WHOLE, *LEFT], out, strict=True)) == WHOLE | {t: t for t in LEFT}


def plain_scan(text, forest):
    """(start, length) by reading every word of the text."""
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, until = [], 0
    for k, (start, _) in enumerate(words):
        tokens = [w for _, w in words[max(0, k - 3) : k + 3]]
        here = k - max(0, k - 3)
        for value, joint, place, still_open in secret_scan._places(tokens, here):
            at = start + place
            if at < until:
                continue
            if still_open:
                line = text[at : at + secret_scan.QUOTED].split("\n")[0]
                value = line[: line.index(still_open)] if still_open in line else value
            if len(value) < secret_scan.NAMED:
                continue
            until = at + len(value)
            before = tokens[:here] + ([joint.rstrip("=:\"'")] if "=" in joint or ":" in joint else [])
            if forest.predict(__import__("numpy").array([secret_scan.features(value, before[-3:], tokens[here + 1 : here + 3], "", joint, forest.known)]))[0] >= secret_scan.THRESHOLD:
                out.append((at, len(value)))
    return out


def test_scan_reads_every_word(spark, forest):
    """The gates on byte classes leave out no word in which a plain reading finds a secret."""
    rng = random.Random(8)
    lines = [line for line, _, _ in secret_scan.labelled_findings(500, seed=21)] + [*WHOLE, *LEFT]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choice(lines) for _ in range(rng.randrange(1, 5))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in secret_scan.scan(df, forest).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    expected = {k: plain_scan(t, forest) for k, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in expected.items() if v}
