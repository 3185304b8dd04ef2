"""Operators over conversations, vectors and pages, the registered queries, and the pipeline."""

import glob
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_queries import rows_of
from exposure.llm import chat, forest, queries, toxicity, urls

SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


# ---- reply trees ----

MESSAGES = "message_id string, parent_id string, score double, role string, text string, path string, hops long"


def best_paths(rows, keep):
    """Root-to-leaf paths, best first, by walking up from every leaf."""
    by = {}
    for m, p, s, *_ in rows:
        if m is not None and (m not in by or (p or "", s or 0) < by[m]):
            by[m] = (p or "", s or 0)
    up = {m: p if p in by else None for m, (p, _) in by.items()}
    found = {}
    for leaf in set(by) - set(up.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            found.setdefault(path[-1], []).append((-sum(by[m][1] for m in path), leaf, path[::-1]))
    return {root: [(leaf, p) for _, leaf, p in sorted(v)[:keep]] for root, v in found.items()}


@pytest.mark.parametrize("keep", [1, 3])
def test_paths_of_reply_trees(spark, keep):
    say = random.Random(keep)
    rows = [(f"m{i}", f"m{say.randrange(max(1, i - 9), i)}" if i % 40 and i > 1 else None, float(say.randrange(5)), "user", "t", "x", 1) for i in range(1, 200)]
    rows += [(f"c{i}", f"c{i - 1}", 1.0, "user", "t", "x", 1) for i in range(1, 70)]  # its first parent does not exist
    rows += [("r1", "r2", 1.0, "", "", "", 0), ("r2", "r1", 1.0, "", "", "", 0), ("r3", "r2", 1.0, "", "", "", 0)]  # a cycle
    rows += [(None, "m1", 9.0, "user", "t", "x", 1), ("alone", None, None, None, None, None, None), rows[5], rows[5]]
    got = chat.reply_paths(spark.createDataFrame(rows, MESSAGES), keep).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.root_id, {}).setdefault((r["rank"], r.leaf_id), {})[r.place] = r.message_id
    paths = {root: [(leaf, [p[i] for i in range(len(p))]) for (_, leaf), p in sorted(v.items())] for root, v in mine.items()}
    assert paths == best_paths(rows, keep)


def test_formatted_turns_come_back(spark, rows):
    texts = ["\\### Assistant: </turn> ok", "", None, "\\s\\l\\h\\n", "a\nb</turn>\n### user:\n", "é\U0001d400 <b>#1</b>", "x" * 40_000]
    told = [(c, t, ["user", "assistant", None, "sys\n</turn>"][(c + t) % 4], texts[(c + t) % 7], 1) for c in range(4) for t in range(9)]
    told += [(None, 0, "assistant", "n", 1), (0, 3, "assistant", "tie", 1), (None, None, "user", "m", 1)]
    table = spark.createDataFrame(told, "conv_id long, turn long, role string, text string, formatted int")
    done = chat.chats(chat.conversations_as_replies(table))
    got = done.select(
        F.substring_index("root_id", "/", 1).try_cast("long").alias("conv"),
        "formatted", "turn_starts", "loss_spans",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")).alias("loss"),
    ).collect()
    assert len(got) == 5
    for r in got:
        own = sorted((t for t in told if t[0] == r.conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
        assert [tuple(t) for t in r.turns] == [(t[2] or "", t[3] or "") for t in own]
        assert r.loss == [t[3] or "" for t in own if t[2] == "assistant"]
        assert r.formatted.count("</turn>") == len(own)
        for s, start in zip(r.loss_spans, r.turn_starts, strict=True):
            assert r.formatted[start:].startswith("### ")
            assert s is None or r.formatted[s.end :].startswith("</turn>\n")
    assert chat.chats(chat.conversations_as_replies(table.where("false"))).count() == 0


# ---- neighbours ----


def test_neighbours_of_few_vectors_are_exact(spark):
    draw = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in draw.normal(size=6)], "n") for i in range(150)]
    same = vecs[3][1]
    vecs += [(200 + i, same, "n") for i in range(40)] + [(300, None, "n"), (301, [0.0] * 6, "n"), (302, [float("nan")] * 6, "n"), (None, same, "n")]
    vecs += [(303, [1.0, None, 1.0, 1.0, 1.0, 1.0], "n"), (304, [float("inf")] * 6, "n"), (400, [1.0, 2.0], "n"), (401, [2.0, 2.0], "n"), vecs[0], vecs[0]]
    table = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, rank string").repartition(4)
    for options in ({}, {"shard_rows": 40, "query_rows": 16, "least": 60}):
        got = {}
        for r in forest.neighbours(table, table.where("vec_id % 4 = 0"), k=10, **options).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        ok = {v[0]: np.array(v[1], np.float32).astype(float) for v in vecs if v[0] is not None and v[0] not in (300, 301, 302, 303, 304)}
        assert set(got) == {i for i in ok if i % 4 == 0}
        for q, found in got.items():
            near = sorted((float(np.sqrt(((x - ok[q]) ** 2).sum())), i) for i, x in ok.items() if i != q and len(x) == len(ok[q]))[:10]
            assert [f[0] for f in sorted(found)] == list(range(1, len(near) + 1))
            if not options or len(ok[q]) == 2:
                assert [f[1] for f in sorted(found)] == [i for _, i in near]
                assert [f[2] for f in sorted(found)] == pytest.approx([d for d, _ in near])
    assert forest.neighbours(table.where("false"), table).count() == 0


def test_recall_of_the_forest(spark):
    draw = np.random.default_rng(7)
    data = draw.normal(size=(6000, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = forest.neighbours(table, table.where("vec_id % 100 = 0"), shard_rows=3000).collect()
    hits = 0
    for q in range(0, 6000, 100):
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 600 and hits / 600 >= 0.9


# ---- url lists ----


def test_lists_as_of_the_fetch_day(spark):
    import datetime as dt

    def day(n):
        return dt.date(2020, 1, 1) + dt.timedelta(days=n)

    say = random.Random(5)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "other.org", "x.other.org"]
    entries = [(say.choice("pq"), say.choice([*hosts, "COM.", None]), say.choice(["add", "remove", "add", "x", None]), day(say.randrange(900))) for _ in range(160)]
    entries += [("p", "other.org", "add", None), (None, "other.org", "add", day(1)), entries[0], entries[0]]
    pages = [(i, f"https://u:p@{say.choice(hosts).upper()}:80/p?q#f", day(say.randrange(1200)), 1) for i in range(300)]
    pages += [(900, None, day(5), 1), (901, "no url", day(5), 1), (902, "http://other.org/", None, 1), (None, "http://other.org./x", day(400), 1), pages[0]]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched date, host int")
    lists = spark.createDataFrame(entries, "list string, domain string, action string, day date")
    got = sorted(((r.page_id, r.fetched, r.lists, r.n_entries, r.blocked) for r in urls.judge(captures, lists).collect()), key=str)

    def state(name, domain, at):
        """Whether the list held the domain, by replaying its days."""
        on = False
        days = {}
        for n, d, action, when in entries:
            if n == name and d and d.lower().rstrip(".") == domain and when and action in ("add", "remove"):
                days.setdefault(when, set()).add(action)
        for when in sorted(days):
            if when <= at:
                on = "remove" not in days[when]
        return on

    want = []
    for i, url, at, _ in pages:
        host = (url or "").partition("@")[2].partition(":")[0].lower() or ("other.org" if "other" in (url or "") else "")
        held = []
        if host and at:
            parts = host.split(".")
            held = [n for n in "pq" for k in range(len(parts)) if state(n, ".".join(parts[k:]), at)]
        want.append((i, at, ",".join(sorted(set(held))), len(held), bool(held)))
    assert got == sorted(want, key=str)
    assert urls.judge(captures.where("false"), lists).count() == 0
    assert urls.judge(captures, lists.where("false")).where("blocked").count() == 0


# ---- registered queries and the pipeline ----


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@has_tables
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    table = {"op1": "conversations", "op3": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
    (n,) = con.execute(f"SELECT count(*) FROM {table}").fetchone()
    assert got.total() >= {"op1": 2, "op3": 10}.get(name.split("_")[0], n)
    if name in queries.oracle_sql():
        rel = con.execute(queries.oracle_sql()[name])
        assert got == rows_of([d[0] for d in rel.description], rel.fetchall())


@has_tables
def test_pipeline_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.schema == docs.schema
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    one = corpus_pipeline.drop_near_duplicates(spark, clean, SF)
    found = {r.doc_id: r for r in one.collect()}
    assert one.columns == docs.columns and all(found[i] == before[i] for i in found)
    from exposure.llm import simhash

    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert set(found) == set(groups.values())
    safe = corpus_pipeline.redact_personal_data(spark, one, SF)
    assert safe.columns == docs.columns and safe.count() == len(found)
    mixed = corpus_pipeline.mix_sources(spark, safe, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(found)
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    assert sum(r.start == 0 for r in packed) == mixed.count()
    whole = corpus_pipeline.run(spark, SF)
    key = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
    assert key == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect())


def test_digest_of_the_sample_conversation(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    row = queries.op1_reply_trees(spark, SF).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
