"""Credentials and their parts in whole texts.

Three strong kinds are reported wherever they stand. Weak candidates, which alone are
mostly noise, are reported only when complementary parts stand within the same scope: an
access identifier, a secret and an endpoint make up a credential. The scope of a candidate
is its paragraph (text between blank lines) and `reach` characters on either side. Parts of
a kind do not overlap, so the interval join of candidates with parts is two binary
searches for each candidate, inside the task that holds the text; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from domicilia.llm.tables import own
from domicilia.llm.words import chunks

# The strong kinds, in the order that breaks ties, and the weak ones after them.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
ACCOUNT = re.compile(r"""(?ai:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
PARAGRAPH = re.compile(r"\n[\t ]*\n")
KINDS = ("assign", "access", "hex", "short", "opaque", "account", "endpoint")
PART = {
    "assign": "secret", "hex": "secret", "short": "secret", "opaque": "secret",
    "access": "identifier", "account": "identifier", "endpoint": "endpoint",
}
STRONG = ("assign", "access", "hex")
SECRET_KINDS = ("assign", "access", "hex", "short", "opaque")

Span = tuple[int, int, str]


def parts_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, weak candidates included."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            n = m.end(2) - m.start(2)
            if n >= 4:
                found["assign" if n >= 12 else "short"].append(m.span())
        found["account"] = [m.span() for m in ACCOUNT.finditer(text)]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    if "://" in text:
        found["endpoint"] = [m.span() for m in ENDPOINT.finditer(text)]
    if any(found.values()):
        taken = _Taken([span for kind in STRONG for span in found[kind]])
        found["opaque"] = [m.span() for m in OPAQUE.finditer(text) if _varied(m[0]) and not taken.meets(*m.span())]
    return found


def _varied(run: str) -> bool:
    """Upper and lower case and digits, as in encoded keys and hardly in words."""
    return any(c.isupper() for c in run) and any(c.islower() for c in run) and any(c.isdigit() for c in run)


class _Taken:
    """Spans of several kinds, to ask whether one of them overlaps another span."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.furthest = list(accumulate((b for _, b in spans), max, initial=-1))

    def meets(self, low: int, high: int) -> bool:
        return self.furthest[bisect_left(self.starts, high)] > low


class _Parts:
    """Spans of one part of a credential, to ask which lie within a scope."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = sorted(a for a, _ in spans)
        self.ends = sorted(b for _, b in spans)

    def within(self, low: int, high: int) -> bool:
        return bisect_right(self.ends, high) > bisect_left(self.starts, low)


def scan(text: str, reach: int) -> tuple[list[Span], list[Span]]:
    """Strong spans, and the weak candidates whose complementary parts stand in their scope.

    A weak candidate needs a strong part of another kind of part, or both other parts.
    """
    found = parts_of(text)
    strong = [(a, b, kind) for kind in STRONG for a, b in found[kind]]
    weak = [(a, b, kind) for kind in KINDS[len(STRONG) :] for a, b in found[kind]]
    if not weak or len({PART[kind] for kind in KINDS if found[kind]}) < 2:
        return strong, []
    blank = [m.span() for m in PARAGRAPH.finditer(text)]
    breaks, resumes = [0, *(b for _, b in blank)], [*(a for a, _ in blank), len(text)]
    every = {p: _Parts([s for k in KINDS if PART[k] == p for s in found[k]]) for p in set(PART.values())}
    sure = {p: _Parts([s for k in STRONG if PART[k] == p for s in found[k]]) for p in set(PART.values())}
    linked = []
    for a, b, kind in weak:
        low = max(a - reach, breaks[bisect_right(breaks, a) - 1])
        high = min(b + reach, resumes[min(bisect_left(resumes, b), len(resumes) - 1)])
        others = [p for p in every if p != PART[kind]]
        if any(sure[p].within(low, high) for p in others) or all(every[p].within(low, high) for p in others):
            linked.append((a, b, kind))
    return strong, linked


def _written(spans: list[Span]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, reach: int, mask: str = "[secret]") -> str:
    """The text with every secret and access identifier that `scan` reports masked."""
    strong, linked = scan(text, reach)
    out, at = [], 0
    for a, b in sorted((a, b) for a, b, kind in [*strong, *linked] if kind in SECRET_KINDS):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


@dataclass(frozen=True)
class SecretScan:
    """`reach`: characters of a scope on either side of a candidate."""

    reach: int = 200

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans), one row for each row.

        Spans are kind:start:end in code points, end exclusive, by start and kind. A NULL text
        counts as empty; NULL and repeated ids are passed through; an empty table gives an
        empty result.
        """
        reach = self.reach
        counts = [f"n_{kind}" for kind in STRONG]

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = []
                    for text in part.column("text"):
                        strong, linked = scan(text.as_py() or "", reach)
                        rows.append(
                            [sum(k == kind for _, _, k in strong) for kind in STRONG]
                            + [len(linked), hashlib.sha256(_written(strong).encode()).hexdigest(), _written(strong + linked)]
                        )
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
                    names = ["doc_id", *counts, "n_linked", "base_sha256", "spans"]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

        rows = own(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", n_linked long, base_sha256 string, spans string"
        return rows.mapInArrow(convert, schema)

    def redacted(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """All columns of `docs`, with what `run` reports as secret masked in the text. NULL stays NULL."""
        reach, at = self.reach, docs.columns.index(text)

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, text):
                    texts = [None if t is None else redact(t, reach) for t in part.column(at).to_pylist()]
                    yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

        return docs.mapInArrow(convert, StructType(docs.schema.fields))
