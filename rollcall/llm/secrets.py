"""Secret scans with structural confirmation.

A pattern proposes, a parser confirms.  Three base patterns are always reported.  The
method adds spans of its own kinds only after decoding them: base64 candidates, of either
alphabet and also over several lines, and hex ones must decode to a DER structure whose
nested lengths add up, PEM blocks to the same, private keys in the SSH format to
length-prefixed fields, and signed tokens must have a JSON header naming an algorithm.
What is public by its own words (certificates, public keys) is no secret, block and body.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Base kinds, in the order in which equal starts are listed; then the kinds that the method confirms.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# The runs of [0-9a-f]+ that have 32 characters are just these.
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: A block may have header lines before its body; those of older keys name the cipher of an encrypted body, which can't be parsed.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----((?:\s*^[A-Za-z][A-Za-z0-9-]*:[^\n]*$)*)([A-Za-z0-9+/=\s]{16,})-----END \1-----", re.M)
CIPHER = re.compile(r"^Proc-Type:[ \t]*4,[ \t]*ENCRYPTED[ \t\r]*$", re.M)
#: What says that it holds no secret, and the line before the body of such a block.
PUBLIC = re.compile("PUBLIC|CERTIFICATE|CRL|PARAMETERS")
PUBLIC_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:PUBLIC|CERTIFICATE|CRL|PARAMETERS)[A-Z0-9 ]*-----\s*\Z")
#: DER sequences start with byte 0x30; in base64 their first character is M. "openssh-key-v1" has a fixed start too.  Lines of a
#: wrapped key have 40 characters at least, but for the last one.
_B64 = "[A-Za-z0-9+/_-]"
BASE64 = re.compile(rf"(?<!{_B64})(?:M|b3BlbnNzaC1rZXktdjE)(?:{_B64}{{39,}}(?:\r?\n[ \t]*{_B64}{{40,}})*(?:\r?\n[ \t]*{_B64}+)?)={{0,2}}")
DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
MIN_ASSIGN, MIN_ACCESS = 8, 16


def _der_length(raw: bytes, at: int) -> tuple[int, int] | None:
    """Content start and end of the DER element at ``at``, or None where its length does not fit."""
    if at + 2 > len(raw):
        return None
    size, start = raw[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > len(raw) or raw[start] == 0:
            return None
        size, start = int.from_bytes(raw[start : start + n], "big"), start + n
        if size < 0x80:
            return None
    return (start, start + size) if start + size <= len(raw) else None


def is_der(raw: bytes) -> bool:
    """Whether ``raw`` is one DER sequence of two elements or more, an integer or a nested element among them, whose lengths all add up to the last level."""
    outer = _der_length(raw, 0)
    if not outer or raw[0] != 0x30 or outer[1] != len(raw):
        return False
    todo, seen, telling = [outer], 0, False
    while todo:
        at, end = todo.pop()
        while at < end:
            tag = raw[at]
            if tag & 0x1F == 0x1F or tag == 0:
                return False
            span = _der_length(raw, at)
            if not span or span[1] > end or (tag == 0x02 and span[0] == span[1]):
                return False
            seen += 1
            telling |= tag == 0x02 or bool(tag & 0x20)
            if tag & 0x20:
                todo.append(span)
            at = span[1]
    return telling and seen >= 2


def is_ssh(raw: bytes) -> bool:
    """Whether ``raw`` is a private key in the SSH format: its magic, then three length-prefixed fields, one key and its two parts, to the end."""
    if not raw.startswith(b"openssh-key-v1\0"):
        return False
    at, n = 15, 0
    while n < 6:
        if at + 4 > len(raw):
            return False
        size = int.from_bytes(raw[at : at + 4], "big")
        if n == 3:
            if size != 1:  # the number of keys
                return False
            size = 0
        at, n = at + 4 + size, n + 1
        if at > len(raw):
            return False
    return at == len(raw)


def _unbase64(text: str, urlsafe: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if "-" in text or "_" in text:
        if "+" in text or "/" in text:
            return None
        urlsafe = True
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Whether the first part of ``text`` is a JSON object with ``alg``, and the second a JSON object too."""
    parts = text.split(".")
    for i, part in enumerate(parts[:2]):
        raw = _unbase64(part, urlsafe=True)
        try:
            value = json.loads(raw) if raw else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (i == 0 and not isinstance(value.get("alg"), str)):
            return False
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of the three base patterns, too short ones dropped."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return out


def _base64_span(m: re.Match) -> tuple[int, int, str] | None:
    """The span of a key that a base64 candidate starts with.  A DER sequence says how long it is, so what follows it is left out."""
    places = [m.start() + i for i, c in enumerate(m[0]) if c not in "\r\n \t="]
    text = re.sub(r"[\s=]+", "", m[0])
    if text[0] != "M":
        raw = _unbase64(text)
        return (m.start(), m.end(), "ssh") if raw and is_ssh(raw) else None
    head = _unbase64(text[:8])
    if not head or head[0] != 0x30:
        return None
    size, start = head[1], 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            return None
        size, start = int.from_bytes(head[2 : 2 + n], "big"), 2 + n
    need = -(-(start + size) * 4 // 3)
    if need > len(text):
        return None
    raw = _unbase64(text[:need])
    end = m.end() if need == len(text) else places[need - 1] + 1
    return (m.start(), end, "der") if raw and is_der(raw) else None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose structure was decoded and parsed.

    What lies in a block that says it is public, or in one that is reported itself, is not reported; a body
    after the first line of a public block counts as in it, also where the block has no end.
    """
    out, settled = [], []
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            public = PUBLIC.search(m[1])
            raw = None if public else _unbase64(re.sub(r"\s+", "", m[3]))
            if raw and (is_der(raw) or is_ssh(raw) or (CIPHER.search(m[2]) and len(raw) % 8 == 0)):
                out.append((m.start(), m.end(), "pem"))
            if public or raw and out and out[-1][0] == m.start():
                settled.append((m.start(), m.end()))
    for m in BASE64.finditer(text):
        inside = any(start <= m.start() and m.end() <= end for start, end in settled)
        if not inside and not PUBLIC_HEAD.search(text, max(0, m.start() - 100), m.start()) and (span := _base64_span(m)):
            out.append(span)
    for m in DER_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "der"))
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], _RANK[s[2]], s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for text in batch.column(1):
            text = text.as_py() or ""
            base = ordered(base_spans(text))
            for kind, out in zip(KINDS[:3], rows):
                out.append(sum(s[2] == kind for s in base))
            rows[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            rows[4].append(_joined(ordered(base + confirmed_spans(text))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.int64()) for x in rows[:3]], pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text, one row per input row.

    A null text counts as empty and has no spans; a null id stays null; repeated rows are
    each scanned; other columns are not read.  Positions are code points, ends exclusive.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, SCAN_SCHEMA)


def redact(text: str) -> str:
    """``text`` with every span, overlapping ones joined, replaced by ``[kind]`` of its first span."""
    spans, out, at = ordered(base_spans(text) + confirmed_spans(text)), [], 0
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:] if spans else text


def redacted_rows(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with secrets redacted; ``length_col``, if there, gets a changed text's new length.

    Null and empty texts, rows without an id, repeated rows and other columns stay as they
    are; an empty table gives no rows.
    """
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = columns[text_at].to_pylist()
            new = [text and redact(text) for text in old]
            columns[text_at] = pa.array(new, columns[text_at].type)
            if length_at is not None:
                lengths = columns[length_at].to_pylist()
                columns[length_at] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, lengths)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
