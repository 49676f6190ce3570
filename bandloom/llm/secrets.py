"""Secret scans: fixed patterns, and an assignment-aware lexer that scores literals by the names they reach."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from bandloom.llm.lexer import MARKS, PEM, PROSE, Either, Summary, assignments, logins

KINDS = ("assign", "access", "hex", "lexed")

# The patterns of the base kinds.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal either way, so a shorter one fails as a whole
ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: Words of a target's name and how sensitive they make what it holds.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.9, "credential": 0.9,
    "credentials": 0.9, "apikey": 1.0, "authkey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "auth": 0.6, "bearer": 0.8, "jwt": 0.8, "dsn": 0.6,
}
#: Words before "key" that make it one to keep.
KEY_OWNERS = {"api", "access", "private", "signing", "encryption", "client", "account", "master", "service", "auth", "shared", "ssh", "secret"}
#: Words after which a name is about a secret rather than one, and words that say so anywhere.
ABOUT = {"name", "count", "id", "hint", "length", "len", "url", "uri", "path", "file", "type", "field", "label", "size", "limit", "expiry", "ttl", "policy", "prompt", "regex", "username", "user", "host", "method", "provider", "algorithm", "issuer", "audience", "scope", "email"}
PUBLIC = {"public", "max", "min", "num", "example"}
_FILLER = r"(?:example|change.?me|placeholder|your|dummy|redacted|todo|insert)(?:api|secret|password|passwd|token|key|value)*\d*"
#: Whole values that stand for one: plain words around a filler, and whole references to variables.
PLACEHOLDERS = re.compile(
    rf"(?i)^(?:(?:[a-z]+[-_. :/]+)*{_FILLER}(?:[-_. :/]+[a-z]+\d*)*[-_. :/!]*|(?:none|null|true|false|undefined|required|optional|string|password)|(.)\1*"
    r"|\$[a-z_]+\d*|(?:\$\{[^{}]*\}[-_./:@]*)+|<.*>|\{\{.*|%\(\w+\)[a-z]|%[a-z_]\w*%|\*+|x{4,})$"
)
MIN_LENGTH = 8
#: Name sensitivity times literal strength from which a literal is reported.
THRESHOLD = 0.5
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: What every sensitive name holds; a text without any needs no lexer.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "jwt", "dsn")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, each leftmost and without overlap within its kind."""
    found = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """How sensitive a target of this name is, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT or PUBLIC & set(words):
        return 0.0
    score = max(SENSITIVE.get(w, 0.0) for w in words)
    if words[-1] in ("key", "keys") and KEY_OWNERS & set(words[:-1]):
        score = max(score, 0.9)
    return score


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1: no placeholder, and rich in different characters.

    A private key block is one. A value with white space is a passphrase if it has three words or more, or a word with a
    digit, and none of a sentence.
    """
    if PEM.search(value):
        return 1.0
    if len(value) < MIN_LENGTH or PLACEHOLDERS.match(value):
        return 0.0
    words = re.sub(r"\\[nrt]", " ", value).split()
    return _richness(len(words), {w.lower().strip(MARKS) for w in words} & PROSE, Counter(value))


def long_score(value: Summary) -> float:
    """``literal_score`` of a value of any length, from a summary of it. Of the placeholders, those in brackets remain."""
    if value.key_block:
        return 1.0
    if value.head.startswith("<") and value.tail.endswith(">") or value.head.startswith("{{"):
        return 0.0
    return _richness(*value.words(), value.counts)


def _richness(words: int, prose: set[str], counts: Counter) -> float:
    if words > 1 and (prose or words < 3 and not any(c.isdigit() for c in counts)):
        return 0.0
    size = sum(counts.values())
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    classes = sum(any(map(test, counts)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, entropy / 4 + 0.1 * (classes - 1))


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the literals that reach a sensitive name by the assignments of the text (``lexer``).

    Joined literals and constants count as what they make together, carried along by any number of steps; later
    assignments replace earlier ones. A value is scored whole, however long it is, and once.
    """
    found: set[tuple[int, int]] = set()
    low = text.lower()
    named = assignments(text) if any(hint in low for hint in HINTS) else iter(())
    for name, node in itertools.chain(named, logins(text)):
        if not (score := name_score(name)):
            continue
        ahead = [node]
        while ahead:
            value = ahead.pop()
            if value.tried >= score:  # as sensitive a name has asked for all of it before
                continue
            value.tried = score
            if isinstance(value, Either):
                ahead += value.options
            elif not value.reported:
                if value.score is None:
                    value.score = literal_score(value.text) if value.text is not None else long_score(value.summary())
                if score * value.score >= THRESHOLD:
                    found.update(value.spans())
    return sorted(found)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed``.

    Spans are ``kind:start:end`` in code points, end exclusive, over the whole text, by start and then in the order of
    KINDS. A null text is an empty one; it and a text without finds have empty spans. Base spans stay whatever the
    lexer adds. Rows that repeat are scanned each; other columns are ignored; an empty table gives an empty result. Time
    and memory are linear in a text, however long it or one line of it is.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column(1):
                text = item.as_py() or ""
                base = base_spans(text)
                lexed = [(a, 3, b) for a, b in lexed_spans(text)]
                tally = Counter(kind for _, kind, _ in base)
                rows.append((tally[0], tally[1], tally[2], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + lexed)), len(lexed)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return rows.mapInArrow(of, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")
