"""Secret scan: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick automaton over all keywords reads a text once. Where a keyword ends, the regular
expression of its kind is tried at the place where that keyword begins, and nowhere else. Runs of
hexadecimal digits have no keyword; they are found as one literal in the text's class string (every
hexadecimal digit becomes ``h``), and only there the expression runs. Kinds whose tokens carry a checksum
are reported when it is right: a token of random characters passes for a real one by chance only.

Positions are code points. Null text counts as empty and has no spans. Repeated rows are scanned each for
itself; an empty table gives an empty result. Batches go through Arrow, nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import by_value, lowered, text_or_empty

by_value(__name__)

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_in_base62(token: str) -> bool:
    """The last six characters are the CRC-32 of the random part (after the prefix) in base 62."""
    body, check = token[token.rindex("_") + 1 : -6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return check == digits.rjust(6, "0")


def signed_header(token: str) -> bool:
    """The first part of a signed web token is JSON that names its algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def der_length(block: str) -> bool:
    """The body of a PEM block is base64 of one DER sequence whose length field is right."""
    body = re.sub(r"\s+", "", block.split("-----")[2])
    try:
        raw = base64.b64decode(body, validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return raw[1] + 2 == len(raw)
    width = raw[1] & 0x7F
    return 2 + width + int.from_bytes(raw[2 : 2 + width], "big") == len(raw)


@dataclass(frozen=True)
class Kind:
    """Tokens that begin with one of ``keywords``; ``least`` characters in ``group``; an optional check.

    Keywords are in lower case and found in either case; the expression decides. Where it fails at one place
    of a stretch of ``run``, it fails at all later ones of the stretch, which are not tried: without this, a
    stretch of keywords would be read again for each of them.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    least: int = 0
    group: int = 0
    valid: Callable[[str], bool] | None = None
    run: re.Pattern | None = None


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
HEX = re.compile("[0-9a-f]+")
HEX_LEAST = 24
HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))

#: In the order in which spans of equal start are listed; hex stands after the first two.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(ASSIGN, re.I | re.A), 6, 2),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), 20),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), valid=crc_in_base62),
    Kind("npm", ("npm_",), re.compile("npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), valid=crc_in_base62),
    Kind("signed", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), valid=signed_header, run=re.compile("[A-Za-z0-9_-]+")),
    Kind("pem", ("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), valid=der_length),
    Kind("google", ("aiza",), re.compile("AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    Kind("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile("xox[bpar]-[0-9]{10,}-[A-Za-z0-9-]{20,}")),
    Kind("stripe", ("sk_live_", "rk_live_"), re.compile("[sr]k_live_[A-Za-z0-9]{24,}")),
)
ORDER = ["assign", "access", "hex", *(k.name for k in KINDS[2:])]
BASE = ORDER[:3]


def automaton(kinds: tuple[Kind, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for number, kind in enumerate(kinds):
        for keyword in kind.keywords:
            found.add_word(keyword, (number, len(keyword)))
    found.make_automaton()
    return found


def hex_spans(text: str) -> list[tuple[int, int]]:
    if b"h" * HEX_LEAST not in text.encode("utf-8", "surrogatepass").translate(HEX_CLASS):
        return []
    return [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]


def spans(text: str, keywords: ahocorasick.Automaton, kinds: tuple[Kind, ...] = KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) sorted by start, then kind as listed; leftmost and non-overlapping per kind."""
    starts: dict[int, list[int]] = {}
    for last, (number, size) in keywords.iter(lowered(text)):
        starts.setdefault(number, []).append(last - size + 1)
    found = [(a, b, "hex") for a, b in hex_spans(text)]
    for number, places in starts.items():
        kind, end = kinds[number], 0
        for place in sorted(places):
            if place < end:
                continue
            m = kind.pattern.match(text, place)
            if not m:
                if kind.run and (stretch := kind.run.match(text, place)):
                    end = stretch.end()
                continue
            end = m.end()
            if len(m[kind.group]) >= kind.least and (kind.valid is None or kind.valid(m[0])):
                found.append((m.start(), m.end(), kind.name))
    return sorted(found, key=lambda s: (s[0], ORDER.index(s[2])))


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<start: long, end: long, kind: string>>"
FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton(KINDS)

    def listed(found: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)

    for batch in batches:
        rows = [spans(text.as_py(), keywords) for text in batch.column("_text")]
        base = [[s for s in row if s[2] in BASE] for row in rows]
        counts = [pa.array([sum(s[2] == kind for s in row) for row in base], pa.int64()) for kind in BASE]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *counts,
                pa.array([sha256(listed(row).encode()).hexdigest() for row in base]),
                pa.array([listed(row) for row in rows]),
                pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in row] for row in rows], FOUND_TYPE),
            ],
            names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
        )


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts, digest of the base spans, all spans as text and as structs."""
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    return rows.mapInArrow(_scan, f"_id long, {FOUND}").withColumnRenamed("_id", id_column)
