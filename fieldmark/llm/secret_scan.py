"""Secret scans: candidate strings judged by a random forest that removes false positives.

Candidates are values of [A-Za-z0-9+/_.=-], standing alone, in quotes or behind '=' or ':': of at least `SHORTEST`
characters where they hold a digit, mix cases (a capital after the first character) or begin as known keys do.  Behind the name of a
credential and '=' or ':' the whole value is the candidate, whatever its characters, if it has `NAMED` of them: all up to the closing
quote (on the same line, at most `QUOTED` bytes on), or up to white space, a comma, a semicolon or a bracket.  Each has features of its length, its
character transitions (how often letters, digits and cases alternate, entropy, letter-pair frequency of prose), its dictionary
coverage (how much of its letters the longest words of a dictionary cover), its path (the value's own slashes and dots, and
whether the document's path or source is one of tests, examples or documentation) and the words around it.  The
dictionary is the vocabulary file of a public tokenizer, or a short list where none is given.  The forest is trained on labelled
findings: those given, or the synthetic ones that `labelled_findings` generates from public formats of keys and of
their look-alikes (checksums, ids, addresses, versions, placeholders, keys of test files).

Whole texts are read; most words are ruled out by their byte classes for all documents at once.

Defined results.  A null or empty text has no finding; an empty table gives none.  A null doc_id is scanned like any other.  Repeated
rows give repeated findings, and a value that comes twice in a text is found twice.  `start` counts code points.  A score equal to the
threshold is a finding.  Very long texts and words are read whole.  `scan` ignores other columns; `redact` keeps them, whatever
their names.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, forget, slices, trim

SHORTEST = 12
#: Characters of a value behind the name of a credential.
NAMED = 6
#: Bytes in which the closing quote of a value with spaces must stand.
QUOTED = 256
THRESHOLD = 0.5
MASK = "[SECRET]"

# Words near secrets, near look-alikes, in placeholders, and common words of values that are no secrets.
NEAR = "password passwd pwd secret token key apikey api_key auth bearer credential credentials access private passphrase login".split()
AWAY = "commit sha sha1 sha256 md5 checksum hash uuid guid etag version release isbn order invoice build id ref revision digest".split()
FAKE = "example sample test dummy changeme placeholder your xxxx todo redacted fake".split()
VOID = "required missing invalid string optional expired disabled enabled undefined unknown private authentication generation authorization verification management changed forgotten policy manager protected encrypted remember please should cannot because before without".split()
COMMON = "the and for with from this that user name file data test example config server client version release image index page home main value string number default local host http https www com org net html json xml http api docs".split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "glpat-", "npm_", "SG.")

_VALUE = re.compile(r"[A-Za-z0-9+/_.=\-]{%d,}" % min(NAMED, SHORTEST))
_SEPARATORS = ("=", ":", "=>", ":=")
#: The name of a credential, a separator and an opening quote, at the end of what stands before a value.
_NAME = re.compile(
    r"(?:(?:passw(?:or)?d|passphrase|passcode|pwd|secret|token|credential|(?:api|access|private|auth|account|signing|encryption)[_.\-]?key)[\w.\-]*|(?<![a-z])(?:pass|auth|login|key)s?\d*)[\"'\])]*(?:=>|:=|=|:)+[\"'(\[{]*$",
    re.IGNORECASE,
)
#: What may stand between a name and its value, and an unquoted value behind a name.
_LEAD, _JOINTS = re.compile(r"[=:>\"'(\[{]*"), re.compile(r"(?:=>|:=|=|:)+[\"'(\[{]*")
_WHOLE = re.compile(r"[^\s\"'`,;<>()\[\]{}|]+")
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://")
_KNOWN = re.compile(b"|".join(re.escape(p.encode()) for p in PREFIXES))
_MARK = re.compile(r"[=:]>?")
_CLASS = np.zeros(256, np.int8)
for _c in range(256):
    _CLASS[_c] = 1 if chr(_c).isascii() and chr(_c).islower() else 2 if chr(_c).isascii() and chr(_c).isupper() else 3 if chr(_c) in string.digits else 0
#: How often letter pairs of prose follow each other, for a rate of unusual pairs.
_USUAL = set("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ch ei ie un be qu ue la os do ad co mi ta".split())


#: Folders whose keys are made up.
_MADE_UP = re.compile(r"(?:^|[/\\_.-])(?:tests?|testing|examples?|samples?|fixtures?|mocks?|docs?|documentation)(?:$|[/\\_.-])", re.IGNORECASE)
#: Letters of a dictionary word that count as one.
_LEAST_WORD, _MOST_WORD = 4, 16


def dictionary(path: str | None = None) -> frozenset[str]:
    """Whole words of a public tokenizer's vocabulary file (JSON, words end in '</w>'); without one a short list."""
    if path is None:
        return frozenset(w for w in COMMON if len(w) >= _LEAST_WORD)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t.removesuffix("</w>") for t in vocabulary if t.endswith("</w>"))
    return frozenset(w for w in words if _LEAST_WORD <= len(w) <= _MOST_WORD and w.isascii() and w.isalpha())


def coverage(value: str, known: frozenset[str]) -> float:
    """The share of a value that dictionary words cover, longest first from the left."""
    covered = 0
    for run in re.findall(r"[a-z]+", value.lower()):
        at = 0
        while at <= len(run) - _LEAST_WORD:
            step = next((k for k in range(min(_MOST_WORD, len(run) - at), _LEAST_WORD - 1, -1) if run[at : at + k] in known), 0)
            covered += step
            at += step or 1
    return covered / max(1, len(value))


def features(value: str, before: list[str], after: list[str], path: str, joint: str, known: frozenset[str]) -> list[float]:
    """Numbers that describe one candidate; `joint` is what stands between the word before and the value."""
    n = len(value)
    kinds = [1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = value.lower()
    pairs = [low[k : k + 2] for k in range(n - 1) if low[k : k + 2].isalpha()]
    usual = sum(p in _USUAL for p in pairs) / max(1, len(pairs))
    covered = coverage(value, known)
    words = [w.strip(".,;:!?\"'()[]{}<>=").lower() for w in [*before, *after]]
    near = " ".join(words)
    return [
        float(n),
        changes,
        entropy,
        usual,
        covered,
        kinds.count(3) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(4) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value))),
        float(value.startswith(PREFIXES)),
        float(any(w in NEAR or any(k in w for k in ("passw", "secret", "token", "apikey", "api_key")) for w in words)),
        float(any(w in AWAY for w in words)),
        float(any(w in low or w in near for w in FAKE)),
        float("=" in joint),
        float('"' in joint or "'" in joint),
        float("/" in value or "." in value),
        float("@" in joint or any("@" in w for w in before[-1:] + after[:1])),
        float(bool(_MADE_UP.search(path))),
        float(_names(joint)),
    ]


class Forest:
    """A random forest of binary trees over numbers, grown on bootstrap samples with random feature subsets."""

    def __init__(self, trees: int = 40, depth: int = 9, seed: int = 5, known: frozenset[str] = frozenset()):
        self.n_trees, self.depth, self.seed, self.trees, self.known = trees, depth, seed, [], known

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.n_trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], self.depth, rng))
        return self

    def _grow(self, x, y, depth, rng):
        p = float(y.mean())
        if depth == 0 or len(y) < 4 or p in (0.0, 1.0):
            return p
        best = (np.inf, 0, 0.0)
        for f in rng.permutation(x.shape[1])[: max(1, round(math.sqrt(x.shape[1])) + 1)]:
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            for cut in rng.choice((values[1:] + values[:-1]) / 2, min(12, len(values) - 1), replace=False):
                left = x[:, f] < cut
                a, b = y[left], y[~left]
                gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if gini < best[0]:
                    best = (gini, int(f), float(cut))
        if best[0] == np.inf:
            return p
        left = x[:, best[1]] < best[2]
        return (best[1], best[2], self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            self._add(tree, x, np.arange(len(x)), out)
        return out / max(1, len(self.trees))

    def _add(self, node, x, rows, out):
        if not isinstance(node, tuple):
            out[rows] += node
        elif len(rows):
            left = x[rows, node[0]] < node[1]
            self._add(node[2], x, rows[left], out)
            self._add(node[3], x, rows[~left], out)


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, int, str]]:
    """Synthetic (line, 1 if its candidate is a secret, path); lines are made from public formats."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    prose = lambda: " ".join(pick("etaoinshrdlu", rng.randint(2, 9)) for _ in range(rng.randint(2, 6)))
    word = lambda: rng.choice([*COMMON, *(pick("etaoinshr", rng.randint(3, 8)) for _ in range(3))])
    quote = lambda v: rng.choice([v, f'"{v}"', f"'{v}'"])
    name = lambda: rng.choice(["password", "passwd", "secret", "token", "api_key", "auth_token", "access_key", "client_secret", "DB_PASSWORD", "SECRET_KEY"])
    letters = string.ascii_letters
    phrase = lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 4)))
    short = lambda: rng.choice([word() + pick(string.digits, rng.randint(1, 4)) + pick(string.ascii_lowercase + string.digits, rng.randint(0, 3)), word().capitalize() + pick(string.digits, rng.randint(2, 4)), pick(alnum, rng.randint(7, 13))])
    between = lambda: rng.choice(["=", " = ", ": ", ":"])
    signs = "!@#$%^&*+=~?"
    strong = lambda: rng.choice([pick(alnum, rng.randint(3, 9)), word().capitalize(), short()]) + pick(signs, rng.randint(1, 2)) + pick(alnum, rng.randint(3, 9)) + pick("!#$*=", rng.randint(0, 2))
    secret = [
        lambda: "AKIA" + pick(upper, 16),
        lambda: f"aws_access_key_id = {quote('AKIA' + pick(upper, 16))}",
        lambda: f"{name()}{rng.choice(['=', ' = ', ': '])}{quote(pick(hexa, rng.choice([16, 18, 24, 32, 40, 48, 64])))}",
        lambda: f"{name()}{rng.choice(['=', ' = ', ': '])}{quote(pick(alnum, rng.randint(14, 44)))}",
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: f"{name()}{between()}{quote(phrase())}",
        lambda: f"{name()}{between()}{quote(short())}",
        lambda: f"{name()}{between()}{quote(pick(letters, rng.randint(8, 40)))}",
        lambda: rng.choice(["AKIA" + pick(string.ascii_uppercase, 16), "ghp_" + pick(letters, 36), "sk_live_" + pick(letters, 24), "npm_" + pick(letters, 36)]),
        lambda: pick(letters, rng.randint(24, 44)),
        lambda: f"{name()}{between()}{quote(strong())}",
        lambda: f"{name()}={','.join(pick(rng.choice([hexa, alnum]), rng.randint(16, 32)) for _ in range(2))}",
        lambda: f"{name()}{between()}{quote(pick(alnum + '+/', rng.choice([22, 30, 43])) + rng.choice(['=', '==']))}",
        lambda: "Authorization: Bearer eyJ" + pick(alnum, 30) + "." + pick(alnum, 40) + "." + pick(alnum + "_-", 43),
    ]
    other = [
        lambda: f"{rng.choice(['commit', 'sha1', 'revision', 'digest'])} {pick(hexa, 40)}",
        lambda: f"{rng.choice(['md5', 'checksum', 'etag', 'hash'])}{rng.choice([':', ' ', '='])} {pick(hexa, 32)}",
        lambda: f"sha256:{pick(hexa, 64)}",
        lambda: f"{rng.choice(['id', 'uuid', 'ref', ''])} {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
        lambda: f"{word()}.{rng.randint(1, 99)}@{rng.choice(['mail', 'corp', 'post'])}{rng.randint(1, 9)}.example.com",
        lambda: f"{word()}{rng.randint(1, 99)}.{word()}{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.org",
        lambda: f"https://www.{word()}{rng.randint(1, 99)}.com/{word()}/{word()}/{rng.randint(1, 9999)}.html",
        lambda: f"/usr/{word()}/{word()}-{rng.randint(1, 9)}.{rng.randint(0, 9)}/{word()}",
        lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-release{rng.randint(1, 9)}",
        lambda: f"{name()}={rng.choice(['your_api_key_1234', 'changeme123456', 'example_token_000', 'xxxxxxxxxxxx1', 'dummy-value-12345'])}",
        lambda: f"{pick(string.digits, rng.randint(12, 16))}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:00",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word()}-{word()}",
        lambda: f"isbn {pick(string.digits, 3)}-{pick(string.digits, 1)}-{pick(string.digits, 5)}-{pick(string.digits, 3)}-{pick(string.digits, 1)}",
        lambda: f"order {rng.choice('ABCDE')}{pick(string.digits, 6)}-{pick(string.digits, 8)}",
        lambda: f"{word()}_{word()}_{word()}{rng.randint(1, 99)}",
        lambda: f"{word()}-{word()}-{rng.randint(1, 999)}-{word()}",
        lambda: f"{name()}{between()}{quote(rng.choice(VOID))}",
        lambda: f"{name()}{between()}{rng.choice([pick('etaoinshrdlu', rng.randint(6, 11)), word() + word()])}",
        lambda: f"{name()}{between()}{rng.choice(['self', 'config', 'os.environ', 'settings', 'args'])}.{word()}_{word()}",
        lambda: f"{name()}{between()}{quote(rng.choice(['$', '%', '&', '@']) + word().upper() + '_' + word().upper())}",
        lambda: f"{name()}{between()}{quote(rng.choice('*x#?.-') * rng.randint(6, 16))}",
        lambda: f"{name()}{between()}{word()}{rng.choice(['/', '&', '+', '?'])}{word()}",
        lambda: phrase() + rng.choice(["", "s", "ing", "er"]),
        lambda: word() + phrase(),
        lambda: rng.choice("-./_").join(word().capitalize() for _ in range(rng.randint(2, 4))),
        lambda: f"https://www.{word()}.org/{word().capitalize()}/{phrase()}",
        lambda: rng.choice("-/").join(pick(string.ascii_uppercase, rng.randint(2, 5)) for _ in range(2)) + pick("etaoinshr", rng.randint(6, 9)),
    ]
    folder = lambda *names: f"{word()}/{rng.choice(names)}/{word()}.{rng.choice(['py', 'yml', 'json', 'md'])}"
    out = []
    for k in range(n):
        positive = k % 2
        path = rng.choice(["", f"src{rng.randint(0, 99)}", folder("src", "config", "deploy", "lib")])
        if not positive and rng.random() < 0.2:
            # keys of test files and examples are made up
            line, path = rng.choice(secret)(), folder("tests", "test", "examples", "fixtures", "docs")
        else:
            line = rng.choice(secret if positive else other)()
        out.append((f"{prose()} {line} {prose()}", positive, path))
    return out


def train(findings: list[tuple] | None = None, words: str | None = None) -> Forest:
    """A forest from labelled lines (line, label) or (line, label, path); every candidate of a line has the line's label.

    `words` names the vocabulary file that serves as dictionary.
    """
    known, x, y = dictionary(words), [], []
    for line, label, *path in findings if findings is not None else labelled_findings():
        tokens = line.split()
        for k in range(len(tokens)):
            for value, joint in _values(tokens, k):
                x.append(features(value, tokens[max(0, k - 3) : k], tokens[k + 1 : k + 3], path[0] if path else "", joint, known))
                y.append(label)
    return Forest(known=known).fit(np.array(x), np.array(y, float))


def _values(tokens: list[str], k: int) -> list[tuple[str, str]]:
    """(value, joint) of the candidates in token k."""
    return [(value, joint) for value, joint, _, _ in _places(tokens, k) if len(value) >= NAMED]


def _behind_names(tokens: list[str], k: int) -> list[tuple[str, str, int, str]]:
    """(value, joint, place, open quote) of the whole values behind names of credentials in token k or before it."""
    token, out, done = tokens[k], [], 0
    lead = _LEAD.match(token).end()
    before = tokens[k - 1] if k else ""
    if before in _SEPARATORS:
        before = (tokens[k - 2] if k > 1 else "") + before
    spots = [(lead, before + token[:lead])] if before else []
    spots += [(m.end(), token[: m.end()]) for m in _JOINTS.finditer(token) if m.end() > lead or not before]
    for at, joint in spots:
        if at < done or at >= len(token) or not _names(joint):
            continue
        quote, still_open = token[at - 1] if at and token[at - 1] in "\"'" else "", ""
        if quote:
            end = token.find(quote, at)
            value, still_open = (token[at:end], "") if end >= 0 else (token[at:], quote)
        else:
            m = _WHOLE.match(token, at)
            value = m[0].rstrip(".,:?") if m else ""
            if value.rstrip("!").isalpha():
                value = value.rstrip("!")
        if _ADDRESS.match(value) or (len(value) < NAMED and not still_open):
            continue
        out.append((value, joint + ("@" if "@" in token[at + len(value) :][:1] else ""), at, still_open))
        done = at + len(value)
    return out


def _places(tokens: list[str], k: int) -> list[tuple[str, str, int, str]]:
    """(value, joint, place in the token, open quote) of the candidates in token k; the name of a credential in words before belongs to the joint.

    A value with an open quote goes on behind the token.
    """
    token = tokens[k]
    out = _behind_names(tokens, k)
    taken = [(at, at + len(value)) for value, _, at, _ in out]
    for m in _VALUE.finditer(token):
        value, at = m[0], m.start()
        if any(m.start() < b and a < m.end() for a, b in taken):
            continue
        joint, after = token[:at], token[m.end() : m.end() + 1]
        # name=value and name:value inside one token: only the value is a candidate
        if "=" in value.rstrip("="):
            head, _, value = value.rstrip("=").rpartition("=")
            joint, at = f"{joint}{head}=", at + len(head) + 1
        at += len(value) - len(value.lstrip(".-_/"))
        value = value.strip(".-_/")
        apart = tokens[k - 1] if k and not joint.lstrip("\"'([{") else ""
        if apart in _SEPARATORS and joint in ("", '"', "'") and apart != ":=":
            joint = apart + joint
        digit = any(c.isdigit() for c in value)
        if len(value) < SHORTEST:
            continue
        if not digit and value.endswith("=") and after and after in "\"'":
            continue  # a name before a quoted value
        if digit or value.startswith(PREFIXES) or (any(c.islower() for c in value) and any(c.isupper() for c in value[1:])):
            out.append((value, joint + ("@" if after == "@" else ""), at, ""))
    return sorted(out, key=lambda x: x[2])


def _candidate_words(words: Words) -> np.ndarray:
    """Words in which `_places` can find a value: long ones with a digit, mixed cases or a known beginning, and those behind names of credentials."""
    long = np.flatnonzero(words.ends - words.starts >= SHORTEST)
    digits = np.concatenate([[0], np.cumsum((words.buf >= 48) & (words.buf <= 57))])
    held = digits[words.ends[long]] > digits[words.starts[long]]
    rest = long[~held]
    lower, upper = (np.concatenate([[0], np.cumsum((words.buf >= a) & (words.buf < a + 26))]) for a in (97, 65))
    mixed = (lower[words.ends[rest]] > lower[words.starts[rest]]) & (upper[words.ends[rest]] > upper[words.starts[rest] + 1])
    known = [k for k, both in zip(rest.tolist(), mixed.tolist(), strict=True) if both or _KNOWN.search(words.word(k))]
    # '=' and ':' stand in few words; a value is in the same word or the next
    marks = np.concatenate([[0], np.cumsum((words.buf == 61) | (words.buf == 58))])
    named = np.flatnonzero(marks[words.ends] > marks[words.starts])
    behind = []
    for k in named.tolist():
        own = words.word(k).decode("utf-8", "replace")
        text = own if own.strip("=:>\"'([{") and own[0] not in "=:" else (words.word(k - 1).decode("utf-8", "replace") if k else "") + own
        if any(_names(text[max(0, m.end() - 120) : m.end()]) for m in _MARK.finditer(text)):
            behind += [k, k + 1]
    behind = [k for k in behind if k < len(words.starts)]
    return np.unique(np.concatenate([long[held], np.array(known + behind, np.int64)]))


def _names(before: str) -> bool:
    """Whether the name of a credential and a separator end what stands before a value; such names are short."""
    return bool(_NAME.search(before[-120:]))


def _findings(words: Words, doc: int, own: np.ndarray, path: str, forest: Forest, threshold: float):
    """(byte start, byte end, score) of the secrets among the candidate words of one document."""
    first, last = words.first[doc], words.first[doc + 1]
    spots, x, until = [], [], 0
    for k in own.tolist():
        a, b = max(first, k - 3), min(last, k + 3)
        tokens = [words.word(j).decode("utf-8", "replace") for j in range(a, b)]
        here = k - a
        token = words.word(k)
        for value, joint, place, still_open in _places(tokens, here):
            before = tokens[:here]
            if "=" in joint or ":" in joint:
                before = [*before, joint.rstrip("=:\"'")]
            at, size = len(tokens[here][:place].encode("utf-8", "replace")), len(value.encode("utf-8", "replace"))
            if token[at : at + size] != value.encode("utf-8", "replace"):
                at = token.find(value.encode("utf-8", "replace"))  # bytes that are no UTF-8
            at += int(words.starts[k])
            if at < words.starts[k] or at < until:
                continue
            if still_open:
                # a quoted value with spaces ends at its quote on the same line
                rest = words.buf[at : min(at + QUOTED, int(words.offsets[doc + 1]))].tobytes().split(b"\n")[0]
                close = rest.find(still_open.encode())
                if close >= 0:
                    value, size = rest[:close].decode("utf-8", "replace"), close
            if len(value) < NAMED:
                continue
            until = at + size
            spots.append((at, at + size))
            x.append(features(value, before[-3:], tokens[here + 1 : here + 3], path, joint, forest.known))
    if not spots:
        return []
    score = forest.predict(np.array(x))
    return [(a, b, float(s)) for (a, b), s in zip(spots, score, strict=True) if s >= threshold]


def _path_of(docs: DataFrame):
    """Where a document stands: its path and source, as far as there are such columns."""
    return F.concat_ws("/", *[F.col(c).cast("string") for c in ("path", "source") if c in docs.columns])


def _scan(handle, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words = Words(piece.column("text"))
                hits = _candidate_words(words)
                doc = np.searchsorted(words.first, hits, side="right") - 1
                ids, paths = piece.column("doc_id").to_pylist(), piece.column("path").to_pylist()
                out = {"doc_id": [], "start": [], "length": [], "score": []}
                for d in np.unique(doc).tolist():
                    base = int(words.offsets[d])
                    for a, b, s in _findings(words, d, hits[doc == d], paths[d] or "", handle.value, threshold):
                        out["doc_id"].append(ids[d])
                        out["start"].append(len(words.buf[base:a].tobytes().decode("utf-8", "replace")))
                        out["length"].append(b - a)
                        out["score"].append(s)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    return run


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """One row per secret: doc_id, start, length, score."""
    handle = docs.sparkSession.sparkContext.broadcast(forest)
    path = _path_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), path.alias("path"))
    return rows.mapInArrow(_scan(handle, threshold), "doc_id long, start long, length long, score double")


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with every secret replaced by the mask and n_chars, where there is one, counted anew."""
    handle = docs.sparkSession.sparkContext.broadcast(forest)
    names = docs.columns
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(names)]
    path = _path_of(docs)
    rows = docs.select(*own, F.col("text").cast("string").alias("text"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                words = Words(piece.column("text"))
                hits = _candidate_words(words)
                doc = np.searchsorted(words.first, hits, side="right") - 1
                texts, paths, changed = piece.column("text"), piece.column("path").to_pylist(), {}
                for d in np.unique(doc).tolist():
                    spots = _findings(words, d, hits[doc == d], paths[d] or "", handle.value, threshold)
                    if spots:
                        parts, at = [], int(words.offsets[d])
                        for a, b, _ in sorted(spots):
                            parts += [words.buf[at:a].tobytes(), mask.encode()]
                            at = b
                        parts.append(words.buf[at : words.offsets[d + 1]].tobytes())
                        changed[d] = b"".join(parts).decode("utf-8", "replace")
                if changed:
                    texts = pa.array([changed.get(d, t) for d, t in enumerate(texts.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in range(len(names))), texts], names=[*(f"own_{k}" for k in range(len(names))), "masked"])
        trim()

    fields = [f"own_{k} {kind}" for k, (_, kind) in enumerate(docs.dtypes)]
    out = rows.mapInArrow(run, ", ".join([*fields, "masked string"]))
    fresh = {"text": F.col("masked"), "n_chars": F.length(F.coalesce("masked", F.lit(""))).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[fresh.get(c, F.col(f"own_{k}")).alias(c) for k, c in enumerate(names)])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs, train(words=public_tokenizers.path("word_bpe_49k.json")))
