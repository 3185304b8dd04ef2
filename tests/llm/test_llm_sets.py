"""Fill-in-the-middle, periodic runs and the set similarity join against brute force, with nulls, empty and long texts, repeats,
clashing names, no rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from exposure.llm import infill, jaccard, periods, queries

DOCS = StructType(
    [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n", LongType()),
        StructField("rep", StringType()), StructField("pieces", StringType()), StructField("_set", LongType()),
        StructField("_found", LongType()), StructField("text_hash", LongType()),
    ]
)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "r", "p", 2, 3, 4) for i, t in pairs], DOCS).repartition(4)


def words(rng, n, of=5000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


# ---- fill in the middle ----

ODD = [None, "", " ", "a", "ab cd", "été à la mer", "日本語 text", "x<P>y", "<S", "a<M>", "line\nbreak\r\n\tz", "ab" * 3000 + "é" * 3000, "😀 smile 😀"]


def told(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    parts = ["".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:])]
    if h4 % 100 < 20:
        return n, "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return n, "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def test_infill_matches_brute_force_and_restores(spark, monkeypatch):
    monkeypatch.setattr(infill, "_CHUNK", 7)
    rng = random.Random(3)
    pairs = list(enumerate(ODD)) + [(100 + i, "".join(rng.choice("ab C.é<\n") for _ in range(rng.randrange(60)))) for i in range(150)]
    pairs += [(5, "again"), (5, "again"), (None, None), (None, "no id at all")]
    out = infill.restore(infill.transform(frame(spark, pairs)))
    got = sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored").collect()), key=str)
    want = []
    for i, t in pairs:
        n, form, p, m, output = told(i, t)
        want.append((i, n, form, p, m, output, hashlib.sha256(output.encode()).hexdigest(), t or ""))
    assert got == sorted(want, key=str)
    assert {"plain", "psm", "spm"} == {g[2] for g in got}


def test_infill_pieces_are_the_arranged_text(spark):
    rows = infill.piece_tables(frame(spark, list(enumerate(ODD)))).select("text", "form", "pieces").collect()
    for r in rows:
        buffers = (r.text.encode(), infill.MARKS)
        joined = b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode()
        assert joined.replace("<P>", "").replace("<S>", "").replace("<M>", "") == joined or r.form != "plain" or "<" in r.text
        assert sum(p.length for p in r.pieces if p.buffer == infill.TEXT) == len(buffers[0])


def test_infill_no_rows(spark):
    assert infill.restore(infill.transform(frame(spark, []))).collect() == []


# ---- periodic runs ----


def slow_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def slow_runs(s, least_length=2, least_power=2):
    found = set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                found.add((i, j + q - i, q))
            i = max(j, i + 1)
    least = [r for r in found if not any(a <= r[0] and a + n >= r[0] + r[1] and q < r[2] and r[2] % q == 0 for a, n, q in found)]
    return sorted(r for r in least if r[1] >= max(least_length, least_power * r[2]))


def sequences(count):
    rng = random.Random(5)
    for _ in range(count):
        s = [rng.randrange(rng.choice([1, 2, 2, 3, 6])) for _ in range(rng.randrange(45))]
        if s and rng.random() < 0.4:
            s = (s[: rng.randrange(1, len(s) + 1)] * 9)[: len(s)]
        yield s


def test_lyndon_arrays_and_runs_match_brute_force():
    for s in sequences(1200):
        ids = np.unique(s, return_inverse=True)[1].astype(np.int64) if s else np.zeros(0, np.int64)
        assert periods.lyndon(ids.tolist()) == slow_lyndon(ids.tolist())
        assert [tuple(r) for r in periods.runs_of(ids).tolist()] == slow_runs(s)


def test_narrowing_changes_nothing():
    for s in sequences(1200):
        ids = np.array(s, np.int64)
        want = slow_runs(s, 6, 4)
        for narrow in (True, False):
            assert [tuple(r) for r in periods.find(ids, narrow=narrow).tolist()] == want


def test_long_sequences_stay_linear():
    assert periods.find(np.arange(200_000) % 777).tolist() == [[0, 200_000, 777]]
    assert periods.find(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]


def run_query(spark, docs, monkeypatch, query):
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    return query(spark, "")


def test_runs_query_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(i, " ".join(words(rng, rng.randrange(1, 50), 6))) for i in range(120)]
    pairs += [(500, None), (501, ""), (502, " \n\t"), (503, "a  b\na\tb a b a b c"), (503, "a  b\na\tb a b a b c"), (None, "x " * 40), (504, "é " * 9)]
    got = run_query(spark, frame(spark, pairs), monkeypatch, queries.op12_baier_runs).collect()
    want = []
    for i, t in pairs:
        w = (t or "").encode().split()
        h = zlib.crc32(str("" if i is None else i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = slow_runs(w, 6, 4)
        drop = {k for s, length, q in runs for k in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(x for k, x in enumerate(w) if k not in drop)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 8


def test_runs_no_rows(spark):
    assert periods.periodic_runs(frame(spark, [])).collect() == []


# ---- set similarity join ----


def near_pairs(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "one two", "One  two", "a b c d e", "a b c d e f"]
    texts += [" ".join(words(rng, rng.randrange(1, 40), 8)) for _ in range(60)]
    for size in (8, 9, 10, 13, 20, 40, 80, 150, 300):
        base = words(rng, size)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 25 + 2)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1, 2])] = words(rng, 1)
            texts.append(" ".join(copy))
    shared = words(rng, 60)
    texts += [" ".join(shared + words(rng, rng.randrange(5, 30))) for _ in range(40)]
    pairs = list(enumerate(texts))
    return [*pairs, pairs[9], pairs[80], (None, texts[90]), (None, "nobody else has this text here"), (1000, texts[100].upper()), (77, texts[95])]


def slow_groups(pairs):
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(pairs):
        if not sets[i]:
            out.append((doc_id, 0, doc_id))
            continue
        ids = [pairs[j][0] for j in range(len(pairs)) if sets[j] and find(j) == find(i) and pairs[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


PATHS = {
    "as set": {},
    "every shared set by single tokens, lists by shuffle": {"CHEAP": 0, "LISTED": 0},
    "no first guess": {"_guesses": lambda shared, classes: classes.where("false").select(F.col("rep").alias("a"), F.col("rep").alias("b"))},
    "no first guess, single tokens": {"CHEAP": 0, "_guesses": lambda shared, classes: classes.where("false").select(F.col("rep").alias("a"), F.col("rep").alias("b"))},
}


@pytest.mark.parametrize("path", PATHS)
def test_set_join_matches_brute_force(spark, monkeypatch, path):
    for name, value in PATHS[path].items():
        monkeypatch.setattr(jaccard, name, value)
    pairs = near_pairs()
    got = jaccard.near_duplicates(frame(spark, pairs))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = slow_groups(pairs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(w[0] != w[2] for w in want) > 40


def test_sets_short_of_units_find_their_partners(spark, monkeypatch):
    """All tokens in one segment, as may happen to small sets: what units miss, single tokens find."""
    monkeypatch.setattr(jaccard, "_guesses", PATHS["no first guess"]["_guesses"])
    classes = "rep long, text_hash long, n long, units int, across int"
    texts = ["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n o", "z y x w v u t s r q p"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [jaccard.tokens(t.encode()) for t in texts]
    hashes = [r.h for r in docs.select(F.xxhash64("text").alias("h")).collect()]
    rows = [(jaccard.name(f), h, len(f), 0, 0) for f, h in zip(found, hashes, strict=True)]
    pairs = {tuple(r) for r in jaccard._short_of_units(spark.createDataFrame(rows, classes), docs).collect()}
    assert pairs == {(rows[1][0], rows[0][0])}


def test_units_are_enough_for_every_size():
    """Each size has units enough unless many segments stay empty, and close sets always meet in one of them."""
    rng = np.random.default_rng(2)
    for n in [*range(5, 70), 100, 127, 128, 255, 256, 1000]:
        found = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keys, units = jaccard.signatures(found, jaccard.band(n), True)
        assert units >= 2 * n // 9 + 1
        most = max(0, (n - 5) // 9)
        other = np.unique(np.r_[found[most:], rng.integers(0, 2**63, min(most, n // 9), dtype=np.uint64)])
        if jaccard.band(len(other)) == jaccard.band(n):
            theirs = jaccard.signatures(other, jaccard.band(n), True)[0]
            assert len(np.intersect1d(keys >> np.uint64(6), theirs >> np.uint64(6)))


def test_set_join_no_rows(spark):
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, [(1, None), (2, ""), (2, "")])).collect())) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
