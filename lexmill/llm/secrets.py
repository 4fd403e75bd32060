"""Secret scan with multipart credential linking.

Besides the patterns that stand for themselves, a text yields parts: access
identifiers, secrets and endpoints, some of them weak (a login name, a bare
base64 word, the value of a named key, a bearer token, a private key, a host). A
connection URL with a login holds all three: the name, the password and what
follows the at-sign. Parts of one scope are interval-joined: two parts meet if
no blank line lies between them and their gap is ``REACH`` characters at most.
A weak part is reported only where complementary parts co-occur: an identifier
with a secret, a secret with an identifier, an endpoint with both. Every pair of
an identifier and a secret that meet is a credential, with each endpoint that
meets the identifier.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.spans import Span, of_kinds, ordered, over_batches, scan, written
from lexmill.sources.shared import bounded_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "secret", "endpoint", "credential")
REACH = 160

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, so 32 characters or more is the same as a filter on the run's length.
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A name may follow an underscore (``DB_USER=``), a bare secret an equals sign (``AWS_SECRET_ACCESS_KEY=``).
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
#: Values that their names give away: keys (``secret_key:``, ``CLIENT_SECRET_KEY=``), tokens of a header, blocks of a private key.
_NAMED = re.compile(r"""(?:secret|private|access|auth|signing|encryption|shared)_?(?:access_?)?key["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
_BEARER = re.compile(r"(?<![A-Za-z0-9])Bearer\x20+([A-Za-z0-9+/_.=~-]{16,})", re.I | re.A)
_PRIVATE = re.compile(r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]{0,20000}?-----END [A-Z ]{0,20}PRIVATE KEY-----)", re.A)
_ENDPOINT = re.compile(r"""(?<![A-Za-z0-9])(?:(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+)""", re.I | re.A)
_LOGIN = re.compile(r"""(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*://([^\s"'<>/:@]+):([^\s"'<>/@]+)@([^\s"'<>@]+)""", re.I | re.A)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def apart(span: tuple[int, int], sorted_spans: list[tuple[int, int]]) -> bool:
    """Whether ``span`` meets none of ``sorted_spans``, which do not overlap."""
    at = bisect_left(sorted_spans, (span[1], 0)) - 1
    return at < 0 or sorted_spans[at][1] <= span[0]


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that start first, and of those that start together the longest; what overlaps them goes."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda p: (p[0], -p[1])):
        if not kept or kept[-1][1] <= a:
            kept.append((a, b))
    return kept


class _Scope:
    """Sorted intervals and the breaks that none may reach across."""

    def __init__(self, parts: list[tuple[int, int]], breaks: list[int]):
        self.parts, self.breaks = sorted(set(parts)), breaks
        self.starts = [a for a, _ in self.parts]
        self.by_end = sorted(self.parts, key=lambda p: (p[1], p[0]))
        self.ends = [b for _, b in self.by_end]

    def near(self, start: int, end: int) -> list[tuple[int, int]]:
        """All parts that share a scope with ``[start, end)``, within reach, and do not overlap it."""
        left = self.by_end[bisect_left(self.ends, start - REACH) : bisect_right(self.ends, start)]
        right = self.parts[bisect_left(self.starts, end) : bisect_right(self.starts, end + REACH)]
        block = bisect_right(self.breaks, start)
        return [p for p in (*left, *right) if bisect_right(self.breaks, p[0]) == block]


def find_in(text: str) -> list[Span]:
    """All spans of a text, sorted; see :func:`find_secrets`."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    begins = [a for a, _ in taken]
    # Spans of two kinds may lie in each other, so an earlier one may end later.
    reached = list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        at = bisect_left(begins, b) - 1
        return at < 0 or reached[at] <= a

    logins = [m for m in _LOGIN.finditer(text) if free(m.start(1), m.end(2))]
    in_url = [m.span() for m in logins]
    weak_ids = [m.span() for m in _IDENTIFIER.finditer(text) if free(*m.span()) and apart(m.span(), in_url)] + [m.span(1) for m in logins]
    weak_secrets = [m.span() for m in _BARE.finditer(text) if free(*m.span()) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and apart(m.span(), in_url)]
    named = [m.span(1) for pattern in (_NAMED, _BEARER, _PRIVATE) for m in pattern.finditer(text)]
    weak_secrets += [m.span(2) for m in logins]
    weak_secrets = disjoint(weak_secrets + [p for p in named if free(*p) and apart(p, in_url)])
    ids = weak_ids + [(a, b) for k, a, b in base if k == "access"]
    secrets = weak_secrets + [(a, b) for k, a, b in base if k != "access"]
    if not ids or not secrets:
        return ordered(base, KINDS)
    ends = [m.span() for m in _ENDPOINT.finditer(text) if free(*m.span()) and apart(m.span(), in_url)] + [m.span(3) for m in logins if free(*m.span(3))]
    breaks = [m.end() for m in _BLANK.finditer(text)]
    by_id, by_secret, by_end = _Scope(ids, breaks), _Scope(secrets, breaks), _Scope(ends, breaks)
    found, weak = set(base), set(weak_ids)
    for a, b in by_id.parts:
        if near := by_secret.near(a, b):
            for c, d in by_end.near(a, b) or [(a, b)]:
                found.update(("credential", min(a, c, x), max(b, d, y)) for x, y in near)
            if (a, b) in weak:
                found.add(("identifier", a, b))
    for a, b in weak_secrets:
        if by_id.near(a, b):
            found.add(("secret", a, b))
    for a, b in ends:
        if by_id.near(a, b) and by_secret.near(a, b):
            found.add(("endpoint", a, b))
    return ordered(list(found), KINDS)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with every value that ``spans`` report replaced by ``[SECRET]``; names and endpoints stay."""
    cuts = []
    for kind, a, b in spans:
        if kind == "assign":
            m = _ASSIGN.match(text, a)
            cuts.append(m.span(2))
        elif kind in ("access", "hex", "secret"):
            cuts.append((a, b))
        elif kind == "identifier":
            m = _IDENTIFIER.match(text, a)
            cuts.append(m.span(1) if m and m.end() == b else (a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """Secret spans of whole texts.

    Returns ``doc_id``, ``spans`` (array of kind, start, end in code points, end
    exclusive, by start then kind as in ``KINDS``) and, if ``masked``, ``edited``:
    the text with its secrets masked. One row per input row, repeated rows
    included; null and empty texts have no spans; an empty table gives an empty
    result; other columns are ignored. A text is scanned whole, in time that grows
    with its length: a part meets others within ``REACH`` characters only.
    """
    return scan(docs, id_col, text_col, find_in, mask if masked else None)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in its text and the length column set anew; all rows and columns stay.

    Rows meet no shuffle: the other columns travel beside the text. Null stays
    null, the empty text empty, equal texts stay equal, repeated rows stay, an empty
    table stays empty. Other columns may have any names, with dots too.
    """
    import pyarrow as pa

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            edited = [None if t is None else mask(t, find_in(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(edited, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    bounded_batches(docs.sparkSession)
    out = over_batches(docs, run)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out


def op2_credential_links(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scanned where it lies; nothing is shuffled."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(of_kinds(F.col("spans"), BASE)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
