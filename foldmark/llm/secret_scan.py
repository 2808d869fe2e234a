"""Secret scan: Aho-Corasick keywords, anchored patterns near hits, embedded checksums.

One automaton pass over the text finds the keywords of all kinds; a kind's pattern is tried only at its hits, and a
match must stand up to the checks of its kind (length, checksum, decodable header). Long hexadecimal runs have no
keyword, one scan finds them. Work is on UTF-8 bytes with A-Z folded for the automaton; spans are in code points.

Kinds: assign, access and hex are the base. The method adds github and npm (tokens that carry a CRC-32 in
base 62), jwt (a header that decodes to JSON with an alg) and pem (private key blocks).

Edge cases: null text is empty and has no span; matches that fail still use up their characters, as in a scan from
the left; spans of different kinds may overlap and are all listed; repeated rows are each scanned.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
# Each run of token characters and each key block is tried from its beginning only, so that a scan stays linear in the text.
JWT = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
PEM = re.compile(
    rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----"
    rb"[A-Za-z0-9+/=\s:,]*+(?:-(?!----(?:BEGIN|END) )[A-Za-z0-9+/=\s:,]*+)*+-----END \1-----"
)
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = 3
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of the body as six digits in base 62."""
    left, out = zlib.crc32(body), []
    for _ in range(6):
        left, digit = divmod(left, 62)
        out.append(BASE62[digit])
    return bytes(reversed(out))


def _checksum(m: re.Match) -> bool:
    body = m[0][4:]
    return base62_crc(body[:-6]) == body[-6:]


def _header(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


PATTERNS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "github": (GITHUB, _checksum),
    "npm": (NPM, _checksum),
    "jwt": (JWT, _header),
    "pem": (PEM, lambda m: True),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, listed in KEYWORDS.items():
        for word in listed:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of every secret, in order, in code points."""
    raw = (text or "").encode()
    spans = [(m.start(), m.end(), KINDS.index("hex")) for m in HEX.finditer(raw)]
    free = dict.fromkeys(PATTERNS, 0)
    for last, (kind, length) in keywords.iter(raw.lower().decode("latin-1")):
        start = last - length + 1
        if start < free[kind]:
            continue
        pattern, holds = PATTERNS[kind]
        m = pattern.match(raw, start)
        if m:
            free[kind] = m.end()
            if holds(m):
                spans.append((start, m.end(), KINDS.index(kind)))
    if spans and len(raw) != len(text):
        edges = sorted({x for s in spans for x in s[:2]})
        pieces = [len(raw[a:b].decode()) for a, b in zip([0, *edges], edges)]
        place = dict(zip(edges, np.cumsum(pieces).tolist()))
        spans = [(place[a], place[b], k) for a, b, k in spans]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keywords = automaton()
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            spans = scan(text, keywords)
            base = [s for s in spans if s[2] < BASE]
            counts = [sum(s[2] == k for s in base) for k in range(BASE)]
            rows.append((doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        yield out.astype({"doc_id": "Int64", "n_assign": "int64", "n_access": "int64", "n_hex": "int64"})


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_report, REPORT)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets blacked out in text; n_chars, where it was right, follows the text."""
    keywords: list = []

    @F.pandas_udf("string")
    def black_out(texts: pd.Series) -> pd.Series:
        if not keywords:
            keywords.append(automaton())
        return pd.Series([None if t is None else redact(t, scan(t, keywords[0])) for t in texts], dtype=object)

    out = docs.withColumn("_clear", black_out("text"))
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.col("_clear")}
    if "n_chars" in docs.columns:
        changed = F.col("_clear") != F.col("text")
        columns["n_chars"] = F.when(changed, F.length("_clear").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[v.alias(k) for k, v in columns.items()])
