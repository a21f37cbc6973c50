"""Operator 3: secret scan.  An Aho-Corasick automaton finds keywords; anchored patterns run only where it hit; checksums decide.

Texts are scanned as bytes (one latin-1 character each), so that offsets need no decoding; spans are told in code points.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: The base patterns of the contract, over text with A-Z in lower case for assign.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"}
#: Public token formats: kind, keyword (lower case), pattern from the keyword on.
FORMATS = (
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")),
    ("npm", ("npm_",), re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")),
    ("jwt", ("eyj",), re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}")),
    ("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9]{6,}-[0-9A-Za-z-]{10,}")),
    ("google", ("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")),
    ("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}")),
    ("private_key", ("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[0-9A-Za-z+/=\s]{16,}-----END (?:[A-Z]+ )*PRIVATE KEY-----")),
)
KINDS = ("assign", "access", "hex", *(f[0] for f in FORMATS))
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

HEX = np.zeros(256, dtype=bool)
HEX[list(b"0123456789abcdef")] = True
_PATTERNS = {kind: pattern for kind, _, pattern in FORMATS}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    for kind, words, _ in FORMATS:
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def crc_ok(body: str) -> bool:
    """The last six of 36 characters are the CRC-32 of the first 30, in base 62."""
    n, digits = zlib.crc32(body[:30].encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == body[30:]


def jwt_ok(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def hex_runs(data: np.ndarray, least: int) -> list[tuple[int, int]]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = HEX[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def scan(data: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind as listed."""
    found = [(s, e, "hex") for s, e in hex_runs(data, 16)]
    raw = data.tobytes()
    low = raw.lower().decode("latin-1")
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton().iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    if hits:
        text = raw.decode("latin-1")
        for kind, places in hits.items():
            pattern, subject = (ASSIGN, low) if kind == "assign" else (ACCESS, text) if kind == "access" else (_PATTERNS[kind], text)
            done = 0
            for at in sorted(places):
                if at < done or (m := pattern.match(subject, at)) is None:
                    continue
                done = m.end()
                if kind == "assign":
                    good = len(m[2]) >= 12
                elif kind == "access":
                    good = len(m[0]) >= 18
                elif kind in ("github", "npm"):
                    good = crc_ok(m[1])
                else:
                    good = kind != "jwt" or jwt_ok(m[0])
                if good:
                    found.append((at, done, kind))
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def code_points(data: np.ndarray, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans:
        return spans
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(before[s]), int(before[e]), k) for s, e, k in spans]


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(raw: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    """Each maximal run of spans becomes [kind] of its first span."""
    out, at = [], 0
    run_end, label = -1, ""
    run_start = 0
    for s, e, k in [*spans, (len(raw) + 1, len(raw) + 1, "")]:
        if s < run_end:
            run_end = max(run_end, e)
            continue
        if run_end >= 0:
            out += [raw[at:run_start], b"[" + label.encode() + b"]"]
            at = run_end
        run_start, run_end, label = s, e, k
    return b"".join([*out, raw[at:]])


def _scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        cols: list[list] = [[], [], [], [], [], [], []]
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), C.raw_texts(batch.column("text")), strict=True):
            found = scan(data)
            spans = code_points(data, found)
            base = [s for s in spans if s[2] in ("assign", "access", "hex")]
            kinds = [s[2] for s in base]
            row = (doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(told(base).encode()).hexdigest(), told(spans), redact(data.tobytes(), found) if found else None)
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])


def secret_scan(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans and, where spans exist, the redacted text.

    Spans are kind:start:end in code points, end exclusive, by start, then kind.  Null and empty texts have none; equal
    rows each get a row; an empty table gives an empty one; other columns are ignored.  One pass, no shuffle.
    """
    C.prepare(df.sparkSession)
    docs = df.selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(cast(text AS string), '') AS text")
    out = docs.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted binary")
    return out.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "decode(redacted, 'UTF-8') AS redacted")


def _clean(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at)
        out = []
        for data, valid in zip(C.raw_texts(texts), texts.is_valid().to_pylist(), strict=True):
            out.append((redact(data.tobytes(), scan(data)) if len(data) else b"") if valid else None)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()).cast(texts.type))


def redact_secrets(df: DataFrame) -> DataFrame:
    """The same rows and columns, each secret in text replaced by its kind in brackets; null text stays null."""
    C.prepare(df.sparkSession)
    return df.mapInArrow(_clean, df.schema)
