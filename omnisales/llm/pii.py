"""Personal data in texts: fixed patterns, and weak labelers that find more.

Base spans come from patterns with a check (mail address, IP address, card number, phone number). Other
strings of a suggestive shape are candidates: digit groups, spelled-out mail addresses, account numbers,
hardware addresses, names after a form of address. Labelers vote on each: shape and checksum, gazetteers,
words around it. Expectation-maximisation estimates how reliable each labeler is from the counts of vote
patterns over all documents, and a linear classifier on votes and shape is trained on the posterior labels.
Candidates with a probability of ``LEAST`` or more become spans of the kind ``weak``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .spans import SPANS, Span, Taken, in_order, span_array, texts_of
from .weak_labels import fit_linear, label_model, linear_score

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "weak"]
LEAST = 0.9

# The starts of these patterns are fixed by a rare character or a look-behind, so that long runs cost linear time.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGITS = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20()./-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
SPELLED = re.compile(r"[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}){1,4}")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
HARDWARE = re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])")
# Forms of address, words that announce personal data or something else, units after a number.
ADDRESS_FORMS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora")
NAMED = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(ADDRESS_FORMS)})\.?\x20(?:[^\W\d_a-z][^\W\d_]{{1,30}})(?:\x20[^\W\d_a-z][^\W\d_]{{1,30}})?")
ANNOUNCES = re.compile(r"(?i:\b(?:phone|tel|telephone|call|fax|mobile|cell|contact|mail|email|e-mail|ssn|iban|account|passport|"
                       r"téléphone|appelez|compte|telefon|handy|konto|teléfono|llame|cuenta|móvil)\b)[^\n]{0,12}\Z")
DENIES = re.compile(r"(?i:\b(?:version|license|licence|page|chapter|isbn|order|invoice|item|figure|table|token|key|id|no)\b|[#$€£%=])[^\n]{0,8}\Z")
UNIT = re.compile(r"\A\x20?(?:%|kg|km|cm|mm|GB|MB|kB|€|\$|USD|EUR|px|ms)")
GIVEN_NAMES = frozenset(("Anna Maria Peter Paul John James Mary Robert Michael William David Thomas Hans Klaus Ursula Pierre "
                         "Jean Marie Claire José Carlos Ana Luis Carmen").split())
SHAPES = ("digits", "spelled", "account", "hardware", "named")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that do not overlap within a kind; positions in code points."""
    found: list[Span] = []
    if "@" in text:
        at = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > at and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                at = m.end()
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(only_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def _account_checks(text: str) -> bool:
    s = text.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in s[4:] + s[:4])
    rest = 0
    for c in number:
        rest = (rest * 10 + int(c)) % 97
    return rest == 1


def _votes(shape: str, s: str, before: str, after: str) -> list[int]:
    """One vote of each labeler: 1 personal, 2 not, 0 no opinion."""
    digits = only_digits(s)
    checksum = 0
    if shape == "account":
        checksum = 1 if _account_checks(s) else 2
    elif shape == "digits" and len(digits) >= 13:
        checksum = 1 if luhn(digits) and len(digits) <= 19 else 2
    regex = {"hardware": 1, "spelled": 1, "account": 1}.get(shape, 0)
    if shape == "digits":
        regex = 1 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?0[0-9]{1,4}\)?[\x20/.-][0-9\x20/.-]{6,}", s) else 0
    gazetteer = 0
    if shape == "named":
        gazetteer = 1 if set(s.split()[1:]) & GIVEN_NAMES else 0
    elif UNIT.search(after):
        gazetteer = 2
    context = 1 if ANNOUNCES.search(before) else 2 if DENIES.search(before) else 0
    length = 0
    if shape == "digits":
        length = 1 if 9 <= len(digits) <= 12 else 2 if len(digits) > 15 else 0
    groups = 0
    if shape == "digits":
        parts = [p for p in re.split(r"[\x20()./-]+", s) if p]
        groups = 1 if len(parts) >= 3 and all(2 <= len(p) <= 4 for p in parts) else 2 if len(parts) == 1 else 0
    pattern = 2 if digits and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 0
    return [regex, checksum, gazetteer, context, length, groups, pattern]


LABELERS = 7


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """Start, end and code (shape and votes, base 3) of each candidate that is clear of the base spans."""
    found: list[tuple[int, int, int]] = []
    busy = None
    tries = [(HARDWARE, 3), (ACCOUNT, 2), (DIGITS, 0)]
    lower_hint = "(at)" in text or "[at]" in text
    if lower_hint:
        tries.insert(0, (SPELLED, 1))
    if any(form in text for form in ADDRESS_FORMS):
        tries.append((NAMED, 4))
    for pattern, shape in tries:
        for m in pattern.finditer(text):
            a, b = m.span()
            busy = busy or Taken(len(text), base)
            if not busy.clear(a, b):
                continue
            code = shape
            for v in _votes(SHAPES[shape], m[0], text[max(0, a - 40):a], text[b:b + 8]):
                code = code * 3 + v
            found.append((a, b, code))
            busy.add(a, b)
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("code", pa.int64())]))
    for batch in batches:
        base, more = [], []
        for text in texts_of(batch.column(1)):
            spans = base_spans(text)
            base.append(spans)
            more.append([{"start": a, "end": b, "code": c} for a, b, c in candidates(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), span_array(base), pa.array(more, kind)], ["doc_id", "base", "more"])


def _votes_of(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)], axis=1)


def _features(codes: np.ndarray) -> np.ndarray:
    votes, shape = _votes_of(codes), codes // 3**LABELERS
    return np.concatenate([votes == 1, votes == 2, shape[:, None] == np.arange(len(SHAPES))], axis=1).astype(float)


def accepted_codes(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The codes (of those counted) that the classifier takes for personal data."""
    if not len(codes):
        return codes
    votes = _votes_of(codes)
    label = label_model(votes, n, share=0.3).posterior(votes)
    x = _features(codes)
    return codes[linear_score(x, fit_linear(x, label, n)) >= LEAST]


def _merge(codes: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                spans += [("weak", s["start"], s["end"]) for s in more if s["code"] in codes]
                out.append(in_order(spans, KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), span_array(out)], ["doc_id", "spans"])
    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans`` (kind, start, end in code points; by start, then kind).

    Kinds: email, ip, card, phone, and weak for candidates that the classifier accepts (never over another span).
    Null or empty text has none; other columns are not read. Rows are looked at one by one, also those that share an id
    (each has its own spans, and its votes count), and texts of any length whole. Votes are counted over all documents;
    their patterns are at most 5 * 3**7, whatever the input.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(rows.mapInArrow(_scan, f"doc_id long, base {SPANS}, more array<struct<start:long,end:long,code:long>>"), "pii")
    counts = found.select(F.explode("more.code").alias("code")).groupBy("code").count().orderBy("code").collect()
    codes = accepted_codes(np.array([r["code"] for r in counts], np.int64), np.array([r["count"] for r in counts], float))
    return found.mapInArrow(_merge(frozenset(codes.tolist())), f"doc_id long, spans {SPANS}")
