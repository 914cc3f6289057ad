"""Secret scan: keyword automaton, anchored expressions near hits, checksums.

One Aho-Corasick pass over a text finds every keyword; an expression is only tried at a keyword's place.
Runs of hex digits have no keyword and are looked for on their own. Kinds with an embedded checksum
count only where it holds.

Null and empty texts have no spans. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.common import map_text

#: Kinds in the order in which spans that start together are listed. The first three are the base kinds.
KINDS = ["assign", "access", "hex", "checked_token"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Tokens whose last six letters are the base-62 CRC-32 of what follows the prefix.
CHECKED_PREFIXES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
CHECKED = r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 8, "access": 16}


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(width, "0")


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


def scanner():
    """A function from a text to its spans (start, kind number, end), sorted."""
    words = ahocorasick.Automaton()
    for kind, keys in ((0, ASSIGN_WORDS), (1, ["akia"]), (3, CHECKED_PREFIXES)):
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()
    assign, access = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS)
    hexes, checked = re.compile(HEX), re.compile(CHECKED)

    def spans(text: str) -> list[tuple[int, int, int]]:
        # bytes.lower() changes ASCII letters only, so places stay the same
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits = sorted({(end - size + 1, kind) for end, (kind, size) in words.iter(low)})
        out, past = [], [0, 0, 0, 0]
        for at, kind in hits:
            if at < past[kind]:
                continue
            m = (assign, access, None, checked)[kind].match(text, at)
            if not m:
                continue
            if kind == 3:
                ok = checksum_holds(m[1], m[2]) and not (at and text[at - 1].isalnum())
            else:
                past[kind] = m.end()
                ok = len(m[2]) >= LEAST["assign"] if kind == 0 else m.end() - at >= LEAST["access"]
            if ok:
                out.append((at, kind, m.end()))
        out += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        return sorted(out)

    return spans


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``secrets``: array of (kind, start, end) by start, then kind."""

    def make():
        spans = scanner()

        def work(column: pa.Array) -> list:
            return [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t or "")] for t in column.to_pylist()]]

        return work

    return map_text(docs, text, docs.columns if keep is None else keep, "secrets array<struct<kind:string,start:int,end:int>>", make)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""

    def make():
        spans = scanner()

        def work(column: pa.Array) -> list:
            rows = [spans(t or "") for t in column.to_pylist()]
            counts = [[sum(k == kind for _, k, _ in r) for r in rows] for kind in range(3)]
            digest = [hashlib.sha256(listed([s for s in r if s[1] < 3]).encode()).hexdigest() for r in rows]
            return [*counts, digest, [listed(r) for r in rows]]

        return work

    return map_text(docs, text, [doc_id], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)
