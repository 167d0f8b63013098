"""Packing, collocations and spelling variants against brute force, on edge rows; the queries against their SQL."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from omnisales.llm import collocations as phrases
from omnisales.llm import packing, spelling
from omnisales.llm.queries import llm_queries
from omnisales.llm.words import Words

from .conftest import documents, edge_rows, prose

SF = "/root/testdata/sf0.001"


# --- packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t


def brute_pieces(tokenizer, rows, capacity):
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        out += [(i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=str)


def check_places(rows, capacity):
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for inside in by_sequence.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity, sizes, parts", [(1024, (512, 1000), 1), (64, (4, 10), 3), (16, (1, 1), 20)])
def test_packing_equals_plain_encoding(spark, tokenizer, capacity, sizes, parts):
    rows = edge_rows() + [(80, "<|endoftext|> x"), (81, "it's 'tis a　 b \n\n c\t\td  ")]
    docs = documents(spark, rows).repartition(parts)
    got = packing.pack_documents(docs, capacity=capacity, open_sequences=sizes[0], look_ahead=sizes[1]).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got), key=str) == brute_pieces(tokenizer, rows, capacity)
    n = check_places(got, capacity)
    assert n >= -(-sum(r.length for r in got) // capacity)


def test_sequences_hold_their_pieces(spark):
    packed = packing.pack_documents(documents(spark, edge_rows(3)))
    rows = packed.collect()
    by_id = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert len(by_id) == check_places(rows, packing.CAPACITY)
    for r in rows:
        s = by_id[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids) and r.doc_id in s.doc_ids
    assert all(len(s.ids) == 4 * s.length for s in by_id.values())


def test_few_sequences(spark):
    """Over many small tasks, close to the least number that the tokens could fill."""
    rnd = random.Random(5)
    docs = documents(spark, [(i, prose(rnd, rnd.randint(5, 300))) for i in range(1500)], extra=False).repartition(20)
    got = packing.pack_documents(docs).collect()
    least = -(-sum(r.length for r in got) // packing.CAPACITY)
    assert least <= check_places(got, packing.CAPACITY) <= 1.02 * least + 1


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_units_are_independent(tokenizer):
    encoder = packing.Encoder(open(packing.tokenizer_path(), encoding="utf-8").read())
    rnd = random.Random(3)
    parts = ["a", "B", "é", "漢", "1", "٣", " ", "  ", "\n", "\t", "\r", " ", "　", " ", "'", "'s", "'ll", "-", "!", "_",
             "🙂", "\x85", "\x1c", "\x0b", "\x00", "<|endoftext|>", "́", "²", "Ⅷ", " a", " '"]
    for _ in range(10):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(200)] + [None, ""]
        ids, at = encoder.encode(pa.array(texts), 2)
        assert encoder.by_unit
        for k, text in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], text


def test_fullest_sequence_closes_first():
    packer = packing.Packer(7, capacity=10, limit=2, look_ahead=1)
    for k, length in enumerate((6, 7, 3, 8, 2, 10)):
        packer.add((k, 0, 0, length, b""))
    packer.finish(close=True)
    places = {r[0]: r[5:] for r in packer.out}
    # 3 fills the sequence of 7 at once; 8 is the second open one; 2 goes to it; 10 stands alone.
    assert places[1] == (7, 0) and places[2] == (7, 7) and places[4] == (places[3][0], 8) and places[0][1] == 0
    assert len({p[0] for p in places.values()}) == 4
    packer = packing.Packer(0, capacity=10, limit=2, look_ahead=1)
    for k, length in enumerate((6, 7, 8)):
        packer.add((k, 0, 0, length, b""))
    assert [r[0] for r in packer.out] == [1]  # of 6 and 7 the fuller had to close


# --- collocations

def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_collocations(rows, least, top, share=50):
    f = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f.update((lang or "und" if lang is None else lang, tuple(w[i:i + size])) for i in range(len(w) - size + 1))
    total = collections.Counter()
    for (lang, p), n in f.items():
        total[lang] += n if len(p) == 1 else 0
    rows = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(n >= least and 100 * n >= share * a and p in (q[:2], q[1:]) for (o, q), n in f.items() if o == lang and len(q) == 3):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, found in rows.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def phrase_rows(seed=4):
    rnd = random.Random(seed)
    words = ["La", "la", "ße", "漢字", "new", "York", "city", "x y", "a'b", "🙂", "of", "the", "(the)", "3"]
    rows = []
    for i in range(150):
        text = " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ", ", "\n", "\t", " ; "]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "fr", None, ""]), text))
    rows += [("en", "hot " * 3000), ("fr", None), ("fr", ""), ("en", "...!?"), (None, "one"), ("de", "new york city " * 20)] * 2
    return rows


@pytest.mark.parametrize("budget, store, top", [(1 << 19, 1 << 20, 2000), (300, 1500, 25)])
def test_collocations_equal_brute_force(spark, monkeypatch, budget, store, top):
    """Small budgets divide hot words by their second and third words, and stores are sent several times a task."""
    monkeypatch.setattr(phrases, "STORE", store)
    monkeypatch.setattr(phrases, "LEAST_BITS", 4 if budget < 1000 else 12)
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang, "a", "b") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, word string, n string").repartition(3)
    got = phrases.collocations(docs, least=3, top=top, budget=budget)
    assert got.dtypes == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in
                          ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 3, top)


def test_prefixes_over_the_budget_are_divided():
    parts = phrases.Partitioning(4)
    counts = np.array([5, 100, 5, 5] + [1] * 12)
    assert parts.add(counts, 10) and parts.groups[0][1] == -1
    sizes = collections.Counter()
    for bucket, group in enumerate(parts.groups[0].tolist()):
        sizes[group] += int(counts[bucket]) if group >= 0 else 0
    assert max(sizes.values()) < 20 and parts.n_groups == 3
    assert not parts.add(np.full(16, 6), 10) and parts.n_groups > 3
    first = np.arange(1, 200, dtype=np.uint64) << np.uint64(56)
    group, level = parts.of(first, first, first)
    assert set(level.tolist()) == {1, 2} and (group >= 0).all()


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, left, right = 3_000_000_019, 4_000_000_007, 9_999_999_967
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        phrases._exact_score("a", F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", " .\n ")], [(None, "a b")]])
def test_collocations_of_nothing(spark, rows):
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert phrases.collocations(docs).count() == 0


# --- spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, least_letters=5, least_times=3, damaged=97):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damaged and h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += len(run) >= least_letters
    return {w: k for w, k in n.items() if k >= least_times}


def brute_variants(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words.get(form[w], 0)) for w in words)


def variant_rows(seed=9):
    rnd = random.Random(seed)
    base = ["colour", "Straße", "éclair", "banana", "aaaaaa", "häuser", "committee", "internationalisation", "naïve", "ÿÿÿÿÿ"]
    rows = []
    for i in range(260):
        words = []
        for _ in range(rnd.randint(0, 40)):
            w = list(rnd.choice(base[:rnd.randint(1, len(base))]))
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                kind = rnd.randrange(3)
                if kind == 0:
                    w[at] = rnd.choice("abé")
                elif kind == 1:
                    w.insert(at, rnd.choice("abé"))
                else:
                    del w[at]
            words.append("".join(w))
        rows.append((i - 5, " ".join(words) + rnd.choice(["", "漢字abcde", " ČžabcdeŽ", " x1abcde2", "×÷abcde"])))
    rows += [(500, None), (501, ""), (None, "colour colours colour"), (3, "colour"), (3, "colour"), (900, "long" * 4000 + " " + "long" * 4000 + "e")]
    return rows + [(901, "long" * 4000 + "e"), (902, "long" * 4000), (903, "long" * 4000 + " " + "long" * 4000 + "e")]


@pytest.mark.parametrize("budget", [20_000, 12])
def test_variants_equal_brute_force(spark, budget):
    rows = variant_rows()
    got = spelling.spelling_variants(documents(spark, rows).repartition(3), budget=budget).collect()
    want = brute_variants(brute_words(rows))
    assert len(want) > 150 and any(w[1] and w[2] != w[1] for w in want)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == want


def test_words_without_damage(spark):
    rows = variant_rows(2)
    got = spelling.vocabulary(documents(spark, rows), damaged=None, least_letters=3, least_times=2)
    assert {r.word: r.n for r in got.collect()} == brute_words(rows, 3, 2, None)


def test_composed_machine_accepts_the_pairs():
    rnd = random.Random(1)
    for places in (1, 2, 6):
        short = sorted({"".join(rnd.choice("abc") for _ in range(5)) for _ in range(60)})
        long = sorted({"".join(rnd.choice("abc") for _ in range(6)) for _ in range(90)})

        def first(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = {(a, b) for a in short for b in short if a < b and one_edit(a, b) and first(a, b) < places}
        want |= {(a, b) for a in short for b in long if one_edit(a, b) and first(a, b) < places}
        found = list(spelling.one_edit_pairs(short, long, places))
        assert len(found) == len(set(found)) and set(found) == want


def test_acceptor_is_minimal():
    machine = spelling.Automaton()
    start = machine.accept(["abx", "aby", "cbx", "cby"])
    assert len(machine.arcs) == 4 and sorted(machine.common(start, start)) == ["abx", "aby", "cbx", "cby"]
    assert machine.accept([]) != start and machine.accept(["abx", "aby", "cbx", "cby"]) == start


def test_checksums_of_runs():
    texts = ["abcde " + "y" * 200, "é" * 30 + " zz", ""]
    words = Words(pa.array(texts), spelling._in_run, lower=True)
    which = np.arange(len(words.start))
    prefixes = [b"1:", b":", b"77:"]
    got = spelling.run_checksums(words, which, prefixes)
    want = [zlib.crc32(prefixes[o] + words.data[a:b].tobytes()) for a, b, o in zip(words.start, words.end, words.owner())]
    assert got.tolist() == want


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(documents(spark, [])).count() == 0
    assert spelling.spelling_variants(documents(spark, [(1, "a b c"), (2, None)])).count() == 0


@pytest.mark.parametrize("name", ["op12_collocations", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from omnisales.llm.oracle import llm_oracle_sql
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = llm_queries()[name](spark, SF)
    rel = con.sql(llm_oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_packing_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = llm_queries()["op11_best_fit_packing"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"),
                          ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    want = [(i, k, a, n, zlib.crc32(raw)) for i, k, a, n, raw in brute_pieces(tokenizer, [(d.doc_id, d.text) for d in docs], 1024)]
    rows = got.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_places(rows, 1024) <= 1.01 * sum(r.length for r in rows) / 1024 + 1
