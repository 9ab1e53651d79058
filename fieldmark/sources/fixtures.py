"""Admission of offline fixtures: where they lie, what their manifest says, what they hold."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

# How a source's policy treats fixtures, and keys no synthetic fixture may hold.
BEHAVIORS = ("allowed", "sanitized_only", "prohibited")
BANNED_KEYS = ("api_key", "authorization", "cookie", "password", "token")


class FixtureError(ValueError):
    pass


def load(path: str | Path) -> list[dict]:
    """The fixtures a manifest lists."""
    try:
        listed = json.loads(Path(path).read_text())["fixtures"]
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise FixtureError(f"A fixture manifest holds a 'fixtures' list: {path}") from e
    for f in listed:
        for key, kind in (("source", str), ("path", str), ("sha256", str), ("sanitization", str), ("contains_real_contact_data", bool)):
            if not isinstance(f.get(key), kind):
                raise FixtureError(f"A fixture needs {key}.")
    return listed


def leaves(value) -> list[tuple[str, object]]:
    """(path, value) of everything in a JSON document that is no list and no mapping; a path is keys joined by '/'."""
    out, waiting = [], [("", value)]
    while waiting:
        path, now = waiting.pop()
        inner = now.items() if isinstance(now, dict) else enumerate(now) if isinstance(now, list) else None
        if inner is None:
            out.append((path, now))
        else:
            waiting += [(f"{path}/{k}", v) for k, v in inner]
    return out


def _named(path: str) -> str:
    """The last key of a path that is no place in a list."""
    return next((k for k in reversed(path.split("/")) if k and not k.isdigit()), "").lower()


def _outside(value) -> bool:
    host = re.match(r"(?i)https?://(?:[^/?#@]*@)?([^/?#:]*)", value) if isinstance(value, str) else None
    return bool(host) and not host[1].lower().endswith(".example.test")


#: What keeps a document out of the synthetic fixtures: (reason, test of a path and its value).
CONTENT_RULES = (
    ("addresses leave the reserved domain", lambda path, value: _outside(value)),
    ("keys of credentials are present", lambda path, value: _named(path) in BANNED_KEYS),
)

#: What keeps a fixture out before its content is looked at: (reason, behaviors it holds for, test of fixture, file and root).
FILE_RULES = (
    ("the source takes none", ("prohibited",), lambda f, file, top: True),
    ("the hash is not written as 64 lower-case hex digits", ("sanitized_only",), lambda f, file, top: not re.fullmatch(r"[0-9a-f]{64}", f["sha256"])),
    ("it is not declared synthetic", ("sanitized_only",), lambda f, file, top: f["sanitization"] != "synthetic"),
    ("it declares real contacts", ("sanitized_only",), lambda f, file, top: f["contains_real_contact_data"]),
    ("it lies outside the fixture folder", BEHAVIORS, lambda f, file, top: not file.is_relative_to(top) or file == top),
    ("there is no such file", BEHAVIORS, lambda f, file, top: not file.is_file()),
    ("its bytes have another hash", BEHAVIORS, lambda f, file, top: hashlib.sha256(file.read_bytes()).hexdigest() != f["sha256"]),
)


def refusals(fixture: dict, behavior: str, root: str | Path) -> list[str]:
    """Why the policy keeps a fixture out: the first file rule that it breaks, or all content rules; none when it may be used."""
    if behavior not in BEHAVIORS:
        return [f"unknown behavior {behavior}"]
    top = Path(root).resolve()
    file = (top / fixture["path"]).resolve()
    broken = next((reason for reason, held, test in FILE_RULES if behavior in held and test(fixture, file, top)), None)
    if broken or behavior != "sanitized_only":
        return [broken] if broken else []
    try:
        flat = leaves(json.loads(file.read_bytes()))
    except ValueError:
        return ["it is not JSON"]
    return [reason for reason, test in CONTENT_RULES if any(test(path, value) for path, value in flat)]


def admit(fixture: dict, behavior: str, root: str | Path) -> Path:
    """The fixture's file when the policy lets it in; the reasons as an error when not."""
    why = refusals(fixture, behavior, root)
    if why:
        raise FixtureError(f"Fixture {fixture['path']} of {fixture['source']} is refused: " + "; ".join(why))
    return (Path(root).resolve() / fixture["path"]).resolve()
