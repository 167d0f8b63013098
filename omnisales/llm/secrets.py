"""Secrets in texts: assignments, access keys, long hex strings, and strings of high entropy.

The last kind is found by sliding a window over candidate strings. The Shannon entropy of a window
comes from the counts of its characters; a step of the window changes two counts, so each step costs
the same whatever the window's length. Thresholds differ by character class (hex digits have 4 bits
at most). An allow-list suppresses strings that only look random, and what it proves to be part of an address.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import tidied
from .spans import SPANS, Span, Taken, cut_out, in_order, span_array, texts_of

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Entropy window, and bits a character by class: a window counts from there on.
WINDOW = 20
BITS = {"hex": 3.0, "base64": 3.75}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile("[0-9]")
HEX_DIGITS = re.compile(r"[0-9a-fA-F]+")
#: Strings that look random and are no secrets: UUIDs, digests named as such, digits only, words and numbers joined by
#: hyphens, underscores or slashes (paths, identifiers), runs along the alphabet or keyboard, marked examples.
ALLOWED = [re.compile(p) for p in (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?:sha(?:1|224|256|384|512)|md5)[-=].*", r"[0-9+/_=-]+",
    r"(?:[A-Za-z]++|[0-9]++)(?:[-_/+=]++(?:[A-Za-z]++|[0-9]++)?+)*+",  # possessive: linear in any text
    r".*(?:abcdefgh|ABCDEFGH|01234567|12345678|qwertyui|QWERTYUI).*", r"(?i:.*(?:example|sample|dummy|placeholder).*)",
)]
#: Addresses on the allow-list: the host of a URL (behind any name and password), and all of an http path if that is
#: one part (a short link); the host of a mail address; a host name without a scheme that starts with www or ends in a
#: common domain; a mail address's name of words with a few digits. What else stands in an address is looked at.
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
HOST = rf"(?:(?>(?:{LABEL}\.(?=[A-Za-z0-9]))+)[A-Za-z]{{1,24}}|(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})(?![A-Za-z0-9_+=-])(?![A-Za-z0-9_.+=:-]*@)"
ADDRESSES = [re.compile(p) for p in (
    rf"""(?:(?<=http://)|(?<=https://)){HOST}(?::[0-9]+)?(?:/[A-Za-z0-9+_=-]+(?=[.,;:!?)\]}}>"']*(?:\s|$)))?""",
    rf"(?<=://){HOST}", rf"(?<=@){HOST}",
    rf"(?<![A-Za-z0-9_.+=@/-])(?:www\.{HOST}|(?>(?:[a-z0-9-]{{1,63}}\.(?=[a-z0-9]))+)"
    r"(?:com|org|net|edu|gov|mil|int|info|io)(?![A-Za-z0-9_+=@-])(?!\.[A-Za-z0-9]))",
)]
MAIL_NAME = re.compile(r"[A-Z]?[a-z]+[0-9]{0,4}(?:[._+-]+(?:[A-Z]?[a-z]+[0-9]{0,4}|[0-9]{1,4}))*[._+-]*")
MAIL_HOST = re.compile(HOST)
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
#: A run of characters that addresses consist of.
RUN = re.compile(r"[A-Za-z0-9+/_=.@:-]+")


def entropies(text: str, window: int) -> Iterator[float]:
    """Bits a character of each window of ``text``, by incremental counts."""
    counts: dict[str, int] = {}
    weighted = 0.0  # sum of c * log2(c)

    def change(ch: str, by: int) -> float:
        c = counts.get(ch, 0)
        counts[ch] = c + by
        return ((c + by) * math.log2(c + by) if c + by > 1 else 0.0) - (c * math.log2(c) if c > 1 else 0.0)

    whole = math.log2(window)
    for i, ch in enumerate(text):
        weighted += change(ch, 1)
        if i >= window:
            weighted += change(text[i - window], -1)
        if i >= window - 1:
            yield whole - weighted / window


def _allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOWED)


def _in_address(text: str, start: int, end: int) -> bool:
    """Whether a candidate stands where parts of an address do."""
    return text[max(0, start - 3):start].endswith(("://", "@", ".")) or text[end:end + 1] == "@"


class Addresses:
    """What the allow-list proves to be an address, run by run; candidates are asked for in the order of the text."""

    def __init__(self, text: str):
        self.text = text
        self.runs = RUN.finditer(text)
        self.right = 0
        self.hosts: list[tuple[int, int]] = []

    def outside(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """The parts of a candidate that are not proven to be an address; behind a host they are cut at slashes."""
        while self.right < end:
            left, self.right = next(self.runs).span()
            if self.right >= end:
                stop = min(len(self.text), self.right + 80)
                self.hosts = sorted(m.span() for p in ADDRESSES for m in p.finditer(self.text, left, stop))
        if self.text[end:end + 1] == "@" and MAIL_HOST.match(self.text, end + 1):
            name = _name_start(self.text, end)
            if self.text[max(0, name - 1):name] != ":" and MAIL_NAME.fullmatch(self.text, name, end):
                return
        at = bisect.bisect_left(self.hosts, (end, 0))
        if not at:
            yield start, end
            return
        behind = max(start, max(b for a, b in self.hosts[max(0, at - 2):at]))
        while behind < end:
            to = self.text.find("/", behind, end)
            to = end if to < 0 else to
            yield behind, to
            behind = to + 1


def _name_start(text: str, end: int) -> int:
    """Where the name in front of a mail address's @ begins."""
    while end > 0 and text[end - 1] in NAME_CHARS:
        end -= 1
    return end


def entropy_spans(text: str, base: list[Span]) -> list[Span]:
    found: list[Span] = []
    taken = addresses = None
    for m in CANDIDATE.finditer(text):
        if not DIGIT.search(m[0]):
            continue  # words without digits are no candidates
        taken = taken or Taken(len(text), base)
        parts = [m.span()]
        if _in_address(text, *m.span()):
            addresses = addresses or Addresses(text)
            parts = addresses.outside(*m.span())
        whole = (p for p in parts if not _allowed(text[slice(*p)]))
        for begin, end in (free for p in whole for free in taken.free(*p)):
            s = text[begin:end]
            if end - begin < WINDOW or not DIGIT.search(s) or _allowed(s):
                continue
            least = BITS["hex" if HEX_DIGITS.fullmatch(s) else "base64"]
            high = [i for i, e in enumerate(entropies(s, WINDOW)) if e >= least]
            start = None
            for i, k in enumerate(high):
                if start is None:
                    start = k
                if i + 1 == len(high) or high[i + 1] > k + WINDOW:
                    found.append(("entropy", begin + start, begin + k + WINDOW))
                    start = None
    return found


def secret_spans(text: str) -> list[Span]:
    """Base spans (leftmost, not overlapping within a kind) and entropy spans clear of them; positions in code points."""
    found: list[Span] = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found + entropy_spans(text, found), KINDS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), span_array([secret_spans(t) for t in texts_of(batch.column(1))])], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans`` (kind, start, end in code points; by start, then kind).

    Kinds: assign, access, hex, and entropy for strings that only the entropy scan finds (never over another span).
    Null or empty text has none. Rows are independent of each other; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(_scan), f"doc_id long, spans {SPANS}")


def _redact(at: int, length_at: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, sizes = [], []
            for value in batch.column(at):
                text = value.as_py()
                spans = secret_spans(text) if text else []
                new.append(cut_out(text, spans, lambda kind: f"[{kind}]") if spans else text)
                sizes.append(len(new[-1]) - len(text) if spans else 0)
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                kind = columns[length_at].type
                columns[length_at] = pa.array([None if n is None else n + d for n, d in
                                               zip(columns[length_at].to_pylist(), sizes, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[kind]``; the length column, if any, follows. All rows stay."""
    names = docs.columns
    length_at = names.index(length_col) if length_col in names else None
    return docs.mapInArrow(tidied(_redact(names.index(text_col), length_at)), StructType(docs.schema.fields))
