"""Operators on texts against brute force, on rows with nulls, ties, copies, repeated ids and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from omnisales.llm import decontaminate, pii, secrets
from omnisales.llm.decontaminate import drop_contaminated, find_contamination
from omnisales.llm.fm_index import FMIndex, suffix_array
from omnisales.llm.near_dups import drop_near_duplicates, near_duplicates, odd_limit
from omnisales.llm.substrings import COVERS, cover_for, remove_repeated_passages
from omnisales.llm.words import Words, byte_class, chunks, window_hashes

from .conftest import documents, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_and_windows():
    texts = ["", None, "a", "  a  b ", "é\tA1 漢 x", "x" * 300, "a b", "\n"]
    column = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
    for kept, rule in (("space", WORD), ("alnum", ALNUM)):
        lower = kept == "alnum"
        w = Words(column, byte_class(kept), lower=lower)
        got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
        assert got == [rule.findall(low(t) if lower else t or "") for t in texts]
    w = Words(pa.array(["a b c d", "b c d a"]), byte_class("space"))
    h = window_hashes(w.hashes(), 3)
    assert h[1] == h[4] and h[0] != h[1]
    assert [b - a for a, b in chunks(pa.array(["x" * 10] * 7), 25)] == [2, 2, 2, 1]
    assert list(chunks(pa.array([], pa.string()))) == []


def test_difference_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert cover_for(50)[0] == 31 and cover_for(1)[0] == 1


def brute_passages(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 8])
def test_passages_equal_brute_force(spark, window):
    rows = edge_rows()
    got = remove_repeated_passages(documents(spark, rows), window).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got]
    assert sorted(got, key=str) == brute_passages(rows, window)


def shingles(text, size=5):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows):
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def near_copies(rnd, n, words=80, edits=2):
    base = prose(rnd, words).split()
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(words)] = f"edit{rnd.randint(0, 10**6)}"
        yield " ".join(copy)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = edge_rows(2) + [(100 + k, t) for k, t in enumerate(near_copies(rnd, 40, edits=5))]
    rows += [(200 + k, t) for k, t in enumerate(near_copies(rnd, 25))]
    docs = documents(spark, rows)
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)
    kept = {r[0] for r in got if r[3]}
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept


def test_near_duplicates_with_repeated_ids(spark):
    """Ids at several texts, at null and empty ones, and many rows of one id, around the similarity."""
    rnd = random.Random(21)
    base = prose(rnd, 60).split()

    def variant(changed):
        words = list(base)
        for k in range(changed):
            words[7 * k + 3] = f"other{k}"
        return " ".join(words)
    rows = [(5, variant(0)), (7, variant(1)), (7, None), (7, ""), (9, variant(2)), (9, prose(rnd, 40)), (11, variant(3)),
            (12, rows_text := prose(rnd, 30)), (9, rows_text), (3, ""), (3, prose(rnd, 50)), (8, variant(1)), (8, None)]
    assert near_rows(spark, rows) == brute_components(rows)
    many = [(4, variant(k % 8) + f" tail{k % 40} more words here and there") for k in range(5000)] + [(6, variant(2)), (2, None)]
    got = near_rows(spark, many)
    assert len(got) == 5002 and {r[2] for r in got if r[0] == 4} == {4} and (2, 0, 2, True) in got


def near_rows(spark, rows):
    return sorted((tuple(r) for r in near_duplicates(documents(spark, rows)).collect()), key=str)


def test_odd_sketch_limit_lets_real_links_pass():
    rnd = np.random.default_rng(5)
    limit, wrong = odd_limit(0.75), 0
    for _ in range(2000):
        differ = 2 * rnd.binomial(128, 0.25)
        parity = np.bincount(rnd.integers(0, 512, differ), minlength=512) & 1
        wrong += parity.sum() > limit
    assert wrong == 0 and limit < odd_limit(0.5)


def test_fm_index_equals_scan():
    rnd = np.random.default_rng(1)
    for n, symbols in ((0, 3), (1, 2), (200, 2), (500, 6)):
        seq = rnd.integers(1, symbols + 1, n)
        text = np.append(seq, 0)
        assert suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        index = FMIndex(seq, every=7)
        patterns = np.full((60, 5), -1)
        for p in patterns:
            size = rnd.integers(1, 6)
            p[5 - size:] = rnd.integers(1, symbols + 3, size)
        begin, end = index.search(patterns)
        for p, a, b in zip(patterns, begin, end):
            p = p[p >= 0].tolist()
            want = [i for i in range(n - len(p) + 1) if seq[i:i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_hits(rows, items, window=10):
    phrases = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                phrases[tuple(w[i:i + window])].add(item)
    out = []
    for i, text in rows:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                of = phrases.get(tuple(w[k:k + size]))
                if of:
                    hit |= set(range(k, k + size))
                    found |= of
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [100_000, 20])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_PHRASES", block)
    rnd = random.Random(8)
    items = [(k, prose(rnd, n)) for k, n in enumerate((3, 9, 10, 11, 25, 40))]
    items += [(7, None), (8, ""), (9, "..."), (None, "the"), (3, prose(rnd, 12)), (11, items[4][1])]
    rows = edge_rows(4) + [(70 + k, f"Pre {(t or '').upper()}! {prose(rnd, 4)} {(t or '')[:40]}") for k, (_, t) in enumerate(items)]
    rows += [(90, " ".join([items[0][1]] * 3))]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(docs, bench).collect()
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got]
    want = brute_hits(rows, items)
    assert sorted(got, key=str) == want
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not w[2] for w in want)


SECRET_ROWS = [
    (1, 'x password="abc123" Token: qwerty/99== api_key=short1 APIKEY = zz secret:=no'), (2, "AKIA" + "Z" * 16 + " AKIA12"),
    (3, "hex " + "0a" * 12 + " and " + "0b" * 11 + "F"), (4, None), (5, ""), (6, "é漢 token = " + "f" * 30),
    (7, "see q7Zk2Lw9Xv4Tb8Np3Rd6Yh1J here"), (8, "plainwordsplainwordsplainwords 123456789012345678901234"),
    (9, "id 123e4567-e89b-12d3-a456-426614174000 http://a.b/q7Zk2Lw9Xv4Tb8Np3Rd6Yh1J"), (10, "word " * 5000 + "token=abcdef1"),
    (1, "repeated id"), (None, "secret=nullid1"),
]


def brute_secrets(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def test_secrets_equal_brute_force(spark):
    docs = documents(spark, SECRET_ROWS)
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(docs).collect()]
    assert sorted(((i, [s for s in spans if s[0] != "entropy"]) for i, spans in got), key=str) == \
        sorted(((i, brute_secrets(t)) for i, t in SECRET_ROWS), key=str)
    extra = {i for i, spans in got for s in spans if s[0] == "entropy"}
    assert extra == {7}
    red = {(r.doc_id, r.text): r for r in secrets.redact_secrets(docs).collect()}
    assert (2, "[access] AKIA12") in red and (4, None) in red and red[2, "[access] AKIA12"].n_chars == 15
    assert secrets.redact_secrets(docs).columns == docs.columns and len(red) == len(SECRET_ROWS)


RANDOM, OTHER = "q7Zk2Lw9Xv4Tb8Np3Rd6Yh1J", "Hs8Vw3Qe5Rt7Yu1Io9Pa2Sd4"


def entropy_texts(text):
    return [text[a:b] for kind, a, b in secrets.secret_spans(text) if kind == "entropy"]


@pytest.mark.parametrize("text, want", [
    (f"eyJhbGciOiJIUzI1NiJ9.{RANDOM}.{OTHER}", [RANDOM, OTHER]), (f"SG.{RANDOM}.{OTHER}", [RANDOM, OTHER]),
    (f"postgres://user:{RANDOM}@host.example.com/db", [RANDOM]), (f"redis://:{RANDOM}@localhost:6379", [RANDOM]),
    (f"https://hooks.example.com/services/T024BE7LD/B0ABCDEF1/{RANDOM}", [RANDOM]),
    (f"hooks.example.com/services/T024BE7LD/B0ABCDEF1/{RANDOM} x", [RANDOM]),
    (f"https://10.0.0.1/a/{RANDOM}/b", [RANDOM]), (f"https://x.example.com/eyJhbGciOiJIUzI1NiJ9.{RANDOM}", [RANDOM]),
    (f"http://a.b/{RANDOM}.", []), ("www.some-long-label-with-2digits-x.com", []), ("christophermontgomery1985@example.com", []),
    ("see x@my-long-mail-host-4you-and-me.example.com", []), ("github.com/user1/repo-name2/blob/main/src/file3_test.py", []),
    ("https://example.com/2021/03/some-long-article-title-about-10-things.html", []),
])
def test_secrets_in_and_beside_addresses(text, want):
    assert entropy_texts(text) == want


@pytest.mark.parametrize("text, want", [
    (f"AKIA{'Z7' * 8}/{RANDOM}{OTHER[:16]}", [("access", 0, 20), ("entropy", 20, 61)]),
    (f"{RANDOM}{'0a' * 12}G{OTHER}", [("entropy", 0, 24), ("hex", 24, 48), ("entropy", 48, 73)]),
    (f"/plain/words/{'0a' * 12}/more/words", [("hex", 13, 37)]),
])
def test_entropy_runs_beside_base_spans(text, want):
    assert secrets.secret_spans(text) == want


@pytest.mark.parametrize("text", [
    "Form" + "_" * 40 + "Q1", "Part" + "-" * 10_000 + "v2x9", "a1" + "=" * 10_000, "/" * 10_000 + "x1", "a-" * 5_000 + "1!",
    "token" + " " * 10_000 + "x", "www." + "a-" * 5_000 + "1.com", "x" + "1." * 5_000 + "@", "a@" * 5_000 + "1", "AKIA" * 5_000,
    "http://" + "a1" * 5_000 + "/" * 5_000, "(" * 10_000 + "+1 " + "2-" * 5_000, "a." * 5_000 + "@b." + "c." * 5_000 + "1",
    "1 " * 5_000 + "x", "9" * 10_000, "password=" * 2_000 + "'" * 5_000, "example1" * 2_000, "a_" * 5_000 + "7" + "+" * 5_000,
])
def test_patterns_take_linear_time(text):
    import time
    began = time.perf_counter()
    secrets.secret_spans(text)
    pii.base_spans(text)
    assert time.perf_counter() - began < 2


def test_entropy_by_counts_equals_definition():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcde0123") for _ in range(60))
    want = []
    for i in range(len(text) - 19):
        n = collections.Counter(text[i:i + 20])
        want.append(-sum(c / 20 * math.log2(c / 20) for c in n.values()))
    assert np.allclose(list(secrets.entropies(text, 20)), want)


PII_ROWS = [
    (1, "mail a.b+c@x-y.example.com, @no.pe and a@b c@d.e@f.gh"), (2, "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 0001.02.3.255 1.2.3"),
    (3, "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111"), (4, "call +1 (555) 010-9999 +12 3"),
    (5, None), (6, ""), (7, "é 漢 x@y.zz 🙂 9.9.9.9"), (8, "1 " * 4000), (9, "9" * 5000), (10, "a" * 5000 + "@"),
    (1, "repeated"), (None, "n@u.ll"),
]


def brute_pii(text):
    text = text or ""

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_personal_data_equals_brute_force(spark):
    got = [(r.doc_id, [tuple(s) for s in r.spans if s.kind != "weak"]) for r in pii.find_personal_data(documents(spark, PII_ROWS)).collect()]
    assert sorted(got, key=str) == sorted(((i, brute_pii(t)) for i, t in PII_ROWS), key=str)


def test_weak_labelers_find_more(spark):
    rnd = random.Random(6)

    def digits(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))
    rows = [(i, f"please call phone 0{digits(2)} {digits(3)} {digits(4)} now") for i in range(40)]
    rows += [(100 + i, f"order token {digits(17)} kept") for i in range(60)]
    rows += [(200 + i, f"write to jo{i} (at) mail (dot) org") for i in range(20)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert all(got[i] == ["weak"] for i in range(40)) and not any("weak" in got[i] for i in range(100, 160))


@pytest.mark.parametrize("run", [
    lambda d, b: remove_repeated_passages(d), lambda d, b: near_duplicates(d), lambda d, b: find_contamination(d, b),
    lambda d, b: secrets.find_secrets(d), lambda d, b: pii.find_personal_data(d),
])
def test_empty_tables(spark, run):
    docs = documents(spark, [])
    assert run(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    some = documents(spark, [(1, "a b c")])
    assert run(some, spark.createDataFrame([], "item_id long, text string")).count() == 1
