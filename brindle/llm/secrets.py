"""Secret scan: keyword automaton, anchored patterns at its hits, then checks embedded in the secret.

One pass of an Aho-Corasick automaton over the ASCII-lowered text finds every keyword; a pattern is tried
only where one of its keywords starts. Long hexadecimal runs have no keyword; one linear pattern finds
them. Beyond the base kinds (assign, access, hex) the method adds kinds whose values carry a check:
a CRC-32 in base 62 (github, npm), a JSON header (jwt), an armoured block that decodes (pem), and base 32
account bits of an access key (keyid). Spans that fail their check are not reported.

Spans are code point offsets, end exclusive. Defined cases: a null or empty text has no spans; equal texts
have equal spans; matches of one kind never overlap, those of two kinds may; an empty table gives no rows.
Whole texts are scanned in time linear in their length; memory is that of one batch of texts.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_rows, per_process

#: Kinds in the order of reports; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "keyid")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
# parts of any length, each a run up to what ends it, without steps back
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{10,}+")
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----([A-Za-z0-9+/=\s]{64,}+)-----END \1-----")
KEYID = re.compile(r"(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Z0-9])")

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _crc_ok(m: re.Match) -> bool:
    body = m[0].partition("_")[2]
    return base62_crc(body[:30]) == body[30:]


def _jwt_ok(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode((h := m[0].partition(".")[0]) + "=" * (-len(h) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _pem_ok(m: re.Match) -> bool:
    try:
        der = base64.b64decode(re.sub(r"\s", "", m[2]), validate=True)
    except (ValueError, binascii.Error):
        return False
    return der[:1] == b"\x30" or m[1].startswith("OPENSSH") and der.startswith(b"openssh-key-v1")


def _keyid_ok(m: re.Match) -> bool:
    """The first 41 bits after the prefix hold the account number, which has 12 digits at most."""
    bits = int.from_bytes(base64.b32decode(m[0][4:20])[:6], "big")
    return 0 < (bits & 0x7FFFFFFFFF80) >> 7 < 10**12


#: kind, keywords (lower case), pattern, what a match must pass.
RULES = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: len(m[2]) >= 6),
    ("access", ("akia",), ACCESS, lambda m: len(m[0]) >= 20),
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), GITHUB, _crc_ok),
    ("npm", ("npm_",), NPM, _crc_ok),
    ("jwt", ("eyj",), JWT, _jwt_ok),
    ("pem", ("-----begin ",), PEM, _pem_ok),
    ("keyid", ("akia", "asia"), KEYID, _keyid_ok),
)


def _automaton() -> ahocorasick.Automaton:
    rules: dict[str, list[int]] = {}
    for i, (_, words, _, _) in enumerate(RULES):
        for w in words:
            rules.setdefault(w, []).append(i)
    a = ahocorasick.Automaton()
    for w, ids in rules.items():
        a.add_word(w, (len(w), ids))
    a.make_automaton()
    return a


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is, so offsets stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then by kind as listed."""
    if not text:
        return []
    spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    hits: dict[int, list[int]] = {}
    for end, (n, ids) in per_process("secret-automaton", _automaton).iter(ascii_lower(text)):
        for i in ids:
            hits.setdefault(i, []).append(end + 1 - n)
    for i, starts in hits.items():
        kind, _, pattern, ok = RULES[i]
        done = 0
        for at in sorted(set(starts)):
            # a match takes its text whether it passes the check or not
            if at < done:
                continue
            if m := pattern.match(text, at):
                done = m.end()
                if ok(m):
                    spans.append((kind, at, done))
            elif pattern is JWT and (m := JWT_RUN.match(text, at)):
                done = m.end()  # later hits of this run would fail alike
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts, the digest of its base spans, and all spans."""

    def rows(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            spans = find_spans(t)
            base = [s for s in spans if s[0] in KINDS[:3]]
            n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            yield i, *n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)

    return map_rows(docs, [doc_id, text], rows, SCHEMA)
