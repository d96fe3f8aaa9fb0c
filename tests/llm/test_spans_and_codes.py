"""Decontamination, periodic runs and vector codes against plain versions of their definitions."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from logloom.llm import decontaminate, periodic, vector_codes

SPACES = re.compile(rb"[^\x20\x09-\x0D]+")
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


# --- 11 decontamination ---
def item_words(text):
    return WORDS.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def windows_hit(doc, items, window):
    """Positions hit and items found, window by window."""
    hit, found = set(), set()
    for name, words in items:
        n = min(len(words), window)
        own = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
        for k in range(len(doc) - n + 1) if n else ():
            if tuple(doc[k : k + n]) in own:
                hit.update(range(k, k + n))
                found.add(name)
    return hit, found


letters = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@given(st.lists(letters, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40), st.integers(1, 5))
@settings(max_examples=600, deadline=None)
def test_automaton_finds_every_window_and_short_item(items, doc, window):
    made = decontaminate.Automaton(window)
    for k, words in enumerate(items):
        made.add(words, str(k))
    scanner = decontaminate.Scanner(made.packed())
    spans, found = scanner.match(scanner.numbered(b" ".join(doc)))
    hit, want = windows_hit(doc, [(str(k), w) for k, w in enumerate(items)], window)
    assert {i for a, b in spans for i in range(a, b)} == hit and found == want
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_a_match_is_kept_over_slices():
    doc = (b"x " * 300_000 + b"one two three four  " + b"y" * 2_000_000 + b" ") * 2
    made = decontaminate.Automaton(3)
    made.add([b"x", b"one", b"two", b"three", b"four"], "i")
    scanner = decontaminate.Scanner(made.packed())
    assert scanner.match(scanner.numbered(doc))[0] == [(299_999, 300_004), (600_004, 600_009)]


@pytest.fixture(scope="module")
def items(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [
        (1, " ".join(words[50:62])), (1, "THE cat"), (2, None), (3, ""), (4, "..."), (5, "sat on the mat and the dog ran today again"),
        (6, " ".join(words[190:215])), (7, "b"), (7, "b"), (8, "b c"), (None, "w60 w61, w62"), (None, "der hund"), (9, " ".join(words)), (10, "漢字"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_words", [200_000, 100, 30])
def test_hits_equal_plain_windows_in_any_number_of_blocks(spark, docs, items, block_words):
    found = decontaminate.scan(docs, items, ["doc_id", "text"], block_words=block_words).collect()
    asked = [(r.item_id, item_words(r.text)) for r in items.collect()]
    assert len(found) == docs.count()
    for r in found:
        words = item_words(r.text)
        hit, names = windows_hit(words, asked, 10)
        assert (r.n_words, r.n_hit, {i for s in r.spans for i in range(s.start, s.stop)}) == (len(words), len(hit), hit)
        assert sorted(r["items"], key=str) == sorted({None if x is None else str(x) for x in names}, key=str) and r.cleaned is None


def test_no_items_and_no_documents(spark, docs, empty, items):
    none = items.limit(0)
    assert {(r.n_hit, len(r["items"])) for r in decontaminate.scan(docs, none, ["doc_id"]).collect()} == {(0, 0)}
    assert decontaminate.scan(empty, items, ["doc_id"]).collect() == []
    assert decontaminate.decontaminate(empty, items).collect() == []


def test_long_spans_are_cut_and_covered_documents_go(spark, items):
    words = [f"w{k}" for k in range(400)]
    whole, part = " ".join(words[:100]), "before,\n " + "; ".join(words[50:62]) + " !\tafter  " + " ".join(f"v{k}" for k in range(30))
    docs = spark.createDataFrame([(1, whole, 0, "k"), (2, part, 1, None), (3, None, 2, "k"), (4, "a B\n C", 3, "k"), (5, "w1 W2  w3 clean", 4, "k")], "doc_id long, text string, n_hit int, `co.l` string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, longest=1).collect()}
    assert sorted(got) == [2, 3, 5]
    assert got[2].text == part.replace("; ".join(words[50:62]), "") and got[2]["co.l"] is None and got[2].n_hit == 1
    assert got[3].text is None and got[5].text == "w1 W2  w3 clean"
    every = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, longest=11, most_coverage=1.0).collect()}
    assert every == {1: "", 2: part.replace("; ".join(words[50:62]), ""), 3: None, 4: "a B\n C", 5: "w1 W2  w3 clean"}


def test_query_equals_plain_windows(spark, sf):
    asked = [(r.item_id, item_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = decontaminate.op11_decontaminate(spark, sf).collect()
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got:
        words = item_words(texts[r.doc_id])
        hit, names = windows_hit(words, asked, 10)
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(names), digest, bool(hit))


# --- 12 periodic runs ---
def smallest_period(w):
    borders = [0] * len(w)
    for i in range(1, len(w)):
        k = borders[i - 1]
        while k and w[i] != w[k]:
            k = borders[k - 1]
        borders[i] = k + (w[i] == w[k])
    return len(w) - borders[-1]


def plain_runs(w, least, exponent):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, exponent * q) and smallest_period(w[s : s + length]) == q:
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def periodic_words(draw):
    w = draw(st.lists(st.integers(0, draw(st.integers(0, 3))), max_size=70))
    for _ in range(draw(st.integers(0, 2))):
        if w:
            a, p = draw(st.integers(0, len(w) - 1)), draw(st.integers(1, 12))
            b = draw(st.integers(a, len(w)))
            w = [w[a + (i - a) % p] if a <= i < b and a + (i - a) % p < len(w) else w[i] for i in range(len(w))]
    return w


@given(periodic_words())
@settings(max_examples=1500, deadline=None)
def test_runs_equal_all_periods_tried(w):
    for least, exponent in ((2, 2), (6, 3), (24, 3), (9, 4)):
        assert periodic.runs(w, least, exponent) == plain_runs(w, least, exponent)
    for least, exponent in ((6, 3), (24, 3), (1, 3)):
        assert periodic._text_runs(np.array(w, np.int32), least, exponent) == plain_runs(w, least, exponent)


@given(st.binary(max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_slices_cut_no_word(octets, at_once):
    pieces = list(periodic.slices(octets, at_once))
    assert b"".join(pieces) == octets and [w for x in pieces for w in x.split()] == octets.split() == SPACES.findall(octets)


def plain_answer(doc_id, text):
    words = SPACES.findall((text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24, 3)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_all_periods_tried(spark, docs, sf, tmp_path):
    """The given table and rows of the fixture, with ids that plant a tail among them."""
    ids = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    texts = ["a b c", "a", "a b " * 40, "x y z " * 9 + "x y q", " ".join(map(str, range(200))), "   a\x1cb " * 30, "A a " * 13, None, "", "\n \t"]
    rows = [(k, texts[i % len(texts)]) for i, k in enumerate(ids)] + [(k + 5000, t) for k, t in enumerate(texts)]
    given_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 20000")
    path = f"file://{tmp_path}/t"
    spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(given_).write.parquet(f"{path}/documents.parquet")
    want = sorted(map(str, ((r.doc_id, *plain_answer(r.doc_id, r.text)) for r in spark.read.parquet(f"{path}/documents.parquet").collect())))
    got = periodic.op12_periodic_runs(spark, path)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_runs_carry_columns_and_take_empty_tables(spark, docs, empty):
    got = periodic.find(docs, carry=["doc_id", "slot"]).collect()
    assert len(got) == docs.count() and all(r.runs == [] for r in got if r.doc_id != 9)
    assert periodic.find(empty, carry=["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="three"):
        periodic.find(docs, exponent=2)


def test_hostile_repeats_end_soon(spark):
    fib = [0]
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    fib = b[:20_000]
    assert periodic.runs([0] * 20_000) == [(0, 20_000, 1)] and periodic.runs([k % 2 for k in range(20_001)]) == [(0, 20_001, 2)]
    assert len(periodic.runs(fib)) > 1000


# --- 13 vector codes ---
def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error), codebooks: part by part, entry by entry, in Python integers."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    ints = [[math.floor(256 * Fraction(x)) for x in r[2]] for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))
    wide = len(ints[0]) // parts if ints else 0
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for v in ints]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((away(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else book for k, book in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors, by_label = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[1]] += e
    flat = ",".join(str(x) for b in books for c in b for x in c)
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[1]]) for r, f, e in zip(kept, found, errors, strict=True)], hashlib.sha256(flat.encode()).hexdigest()


def vectors(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, code string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return spark.read.parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("n,width", [(150, 32), (40, 16), (1, 16), (0, 16)])
def test_codes_equal_plain_integers(spark, tmp_path, n, width):
    rng = np.random.default_rng(n)
    rows = [(k if k % 7 else None, (k % 3) or None, rng.normal(0, 1 + k % 4, width).astype("f4").tolist(), "x") for k in range(n)]
    if n > 2:
        rows += [rows[5], (5, 1, None, None), (6, 1, [1.0] * (width - 1) + [None], "x"), (7, 2, [math.nan] * width, "x"), (8, 2, [math.inf] + [0.0] * (width - 1), "x"), (-3, 2, [-math.inf] * width, "x")]
        rows += [(3, None, [0.25] * width, "x"), (3, None, [0.125] * width, "x"), (10**12, 4, [-900.5] * width, "x")]
    path = f"file://{tmp_path}/t"
    held = [(r.vec_id, r.label, r.embedding) for r in vectors(spark, rows, path).collect()]
    want, digest = plain_codes(held)
    got = vector_codes.op13_vector_codes(spark, path)
    assert sorted(map(str, (tuple(r)[:4] for r in got.collect()))) == sorted(map(str, want))
    assert {r.codebooks_sha256 for r in got.collect()} == ({digest} if want else set())
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}


def test_codes_over_the_given_table(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = plain_codes(rows)
    got = vector_codes.op13_vector_codes(spark, sf).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want) and {r.codebooks_sha256 for r in got} == {digest}


def test_decoded_vectors_have_the_error_of_their_code(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = vector_codes.train(rows, parts=8, entries=20, rounds=3)
    coded = vector_codes.encode(rows, books, ["vec_id", "embedding"])
    for r in vector_codes.decode(coded, books).collect():
        assert len(r.code) == 16 and r.error == sum((math.floor(256 * x) - y) ** 2 for x, y in zip(r.embedding, r.approx, strict=True))


def test_first_of_equal_entries_wins_and_unused_ones_stay():
    books = np.array([[1, 1], [1, 1], [3, 3]])
    assert vector_codes._nearest(np.array([[1, 1], [2, 2], [9, 9]]), books)[0].tolist() == [0, 0, 2]


@pytest.mark.parametrize("rows,says", [([(1, [0.0] * 16), (2, [0.0] * 32)], "one length"), ([(1, [0.0] * 15)], "divides"), ([(1, [3e38] * 16)], "too large")])
def test_vectors_without_an_exact_answer_are_errors(spark, tmp_path, rows, says):
    path = f"file://{tmp_path}/t"
    vectors(spark, [(k, 1, v, "x") for k, v in rows], path)
    with pytest.raises((PythonException, ValueError), match=says):
        vector_codes.op13_vector_codes(spark, path).collect()


def test_empty_vectors_have_the_first_entry(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    vectors(spark, [(1, 1, [], "x"), (2, None, [], "x"), (3, None, None, "x")], path)
    assert sorted(tuple(r)[:4] for r in vector_codes.op13_vector_codes(spark, path).collect()) == [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]


def test_many_labels_are_joined(spark, sf, monkeypatch):
    coded = vector_codes.with_label_error(spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("int").alias("label"), F.col("id").alias("error")))
    want = sorted(map(tuple, coded.collect()), key=str)
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)
    again = vector_codes.with_label_error(spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("int").alias("label"), F.col("id").alias("error")))
    assert sorted(map(tuple, again.collect()), key=str) == want and len(want) == 300
