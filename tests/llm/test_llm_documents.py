"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeats, clashing names, no rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from exposure.llm import boosting, components, media, mixing, packing, pii, sharding, simhash, toxicity

DOCS = StructType(
    [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()),
        StructField("n_chars", LongType()), StructField("size", StringType()), StructField("row", StringType()),
        StructField("fp", LongType()), StructField("_part", LongType()),
    ]
)
SAY = random.Random(4)


def words(n, of=900):
    return " ".join(f"w{SAY.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(60)
    texts = [None, "", " \n\t ", "One", "one", "Two words", "été À la mer", "z" * 50_000, words(30_000), base, base, base.upper()]
    texts += [base.replace("w1", "x1", 1), *[words(SAY.randrange(1, 90)) for _ in range(40)]]
    found = [(i, t, ["a", "b", None, "", "c"][i % 5], len(t or ""), "x", None, i, 0) for i, t in enumerate(texts)]
    return [*found, found[9], found[9], (None, None, None, None, None, None, None, None), (None, base, "a", 1, "y", "r", 1, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# ---- sharding ----


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_moves_rows_only_into_new_shards():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    assert sharding.jump_hash(keys, 16).tolist() == [jump(int(k), 16) for k in keys]
    before, after = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 20)
    moved = before != after
    assert set(after[moved]) <= {16, 17, 18, 19} and 0.15 < moved.mean() < 0.25


def test_shards(docs, rows, none):
    got = sharding.assign(docs, shards=4, more=1).collect()
    assert len(got) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    for r in got:
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 4), jump(key, 5), "key")
    assert sharding.assign(none).count() == 0


def test_shard_files_hold_all_rows(spark, docs, rows, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/s", shards=3, files=2)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == len(rows)
    assert back.where(F.col("_shard") != sharding.shard_of(F.col("doc_id"), 3)).count() == 0


# ---- mixing ----


def level(sizes, weights, most):
    total, full = sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        share = (total - sum(most * sizes[i] for i in full)) / max(1, sum(weights[i] for i in rest))
        new = {i for i in rest if most * sizes[i] <= share * weights[i]}
        if not new:
            return [most * sizes[i] if i in full else share * weights[i] for i in range(len(sizes))]
        full |= new


def test_mix_hits_each_target(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sources = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in got if r.source == s) for s in sources}
    assert sum(size.values()) == sum(len((r[1] or "").encode().split()) for r in rows)
    goals = level([size[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)
    for s, goal in zip(sources, goals, strict=True):
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, goal) and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - goal) <= 0.5
        # all but one document stand at whole copies, the same or one more
        assert sum(r.taken % r["size"] > 0 for r in own if r["size"]) <= 1
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(none).count() == 0


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1000), ("d", 0), (None, 7)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    want = level([1, 1, 1000, 0, 7], [5, 2, 1, 5, 2], 3)
    assert [got[s] for s in ("a", "b", "c", "d", None)] == pytest.approx(want)


def test_repeated_rows_hold_the_words_taken(docs):
    mixed = mixing.mix(docs, keep=docs.columns)
    out = mixing.repeated(mixed, F.col("row.text"), F.col("size"), F.col("taken"))
    assert out.select(F.sum(mixing.words(F.col("_text")))).first()[0] == mixed.select(F.sum("taken")).first()[0]


# ---- simhash ----


def simple_print(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    """Classes of the indices by chains of close prints."""
    of, left = {}, set(range(len(prints)))
    while left:
        todo = [min(left)]
        left -= set(todo)
        root = todo[0]
        while todo:
            at = todo.pop()
            of[at] = root
            near = {i for i in left if (prints[i] ^ prints[at]).bit_count() <= radius}
            left -= near
            todo += near
    return of


def test_fingerprints_and_components(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [simple_print(r[1]) for r in rows]
    of = groups(prints)
    least = {}
    for i, root in of.items():
        least[root] = min((x for x in (least.get(root), rows[i][0]) if x is not None), default=None)
    want = [(rows[i][0], f"{p:016x}", least[of[i]]) for i, p in enumerate(prints)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(of.values()))
    assert sorted((r.doc_id for r in kept), key=str) == sorted((least[r] for r in set(of.values())), key=str)


@pytest.mark.parametrize("bucket", [2, 8, 16384])
def test_links_connect_what_is_close(spark, bucket):
    say = random.Random(bucket)
    prints = [say.getrandbits(64) for _ in range(60)]
    for centre in prints[:4]:
        for _ in range(12):
            x = centre
            for b in say.sample(range(64), say.randrange(1, 7)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [tuple(int(x) % 2**64 for x in r) for r in simhash.links(table, bucket=bucket, steps=(2,)).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    table = spark.createDataFrame([(a - (1 << 63), b - (1 << 63)) for a, b in links], "a long, b long")
    root = {r.node + (1 << 63): r.root + (1 << 63) for r in components.components(table).collect()}
    want, mine = groups(prints), {}
    for i, p in enumerate(prints):
        mine.setdefault(root.get(p, p), set()).add(i)
    classes = {}
    for i, r in want.items():
        classes.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, classes.values()))


def test_blocks_share_a_mask_for_every_close_pair():
    for blocks in (6, 8, 12):
        kept = [m % 2**64 for m in simhash.masks(blocks)]
        for flips in ((0, 1, 2, 3), (0, 20, 40, 63), (12, 13, 25, 26)):
            diff = sum(1 << b for b in flips)
            assert any(not diff & m for m in kept)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (300, 300), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200}


# ---- media ----


def test_payloads_come_back_as_stored(docs, rows, none):
    stored = media.store_payloads(docs)
    pages = stored.select("doc_id", media.payload_page(F.col("doc_id"), F.col("digest")).alias("html"))
    found = media.interleave(pages, media.payload_features(stored), key="doc_id")
    got = found.select("doc_id", F.explode("sequence").alias("i")).where("i.media IS NOT NULL").select("doc_id", "i.media.*", "i.position", "i.caption").collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(map(str, want)) == sorted(str((g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32)) for g in got)
    assert all(g.position == 1 and g.caption.startswith("document ") and g.media_sha256 == g.digest for g in got)
    assert media.store_payloads(none).count() == 0


def test_sequences_keep_order_captions_and_unknown_media(spark):
    html = (
        "<body>Hi &amp; bye<script>no</script><figure><img src='media:%s' alt='alt'><figcaption>A <b>cap</b></figcaption></figure>"
        "tail<img src='http://x/y.png'><figure><figcaption>first</figcaption><video src='media:%s'></figure><img>" % ("a" * 64, "b" * 64)
    )
    pages = spark.createDataFrame([(1, html), (1, html), (None, None), (2, "")], "page_id long, html string")
    table = spark.createDataFrame([("a" * 64, b"x", 1), ("a" * 64, b"x", 1), (None, b"y", 2)], "digest string, payload binary, position int")
    got = sorted(media.interleave(pages, table).collect(), key=lambda r: str(r.page_id))
    assert [len(r.sequence) for r in got] == [5, 5, 0, 0]
    items = got[0].sequence
    assert [(i.position, i.kind, i.text or i.ref[:7], i.caption, i.media is not None) for i in items] == [
        (0, "text", "Hi & bye", None, False), (1, "img", "media:a", "A cap", True), (2, "text", "tail", None, False),
        (3, "img", "http://", None, False), (4, "video", "media:b", "first", False),
    ]
    assert media.interleave(pages.where("false"), table).count() == 0


# ---- packing ----


def test_pieces_and_sequences(docs, rows, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own = Tokenizer.from_file(path)
    cut = packing.pieces(docs, with_ids=True)
    packed = packing.pack(cut)
    got = packed.collect()
    whole = {}
    for r in rows:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            key = (r[0], s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))
            whole[key] = whole.get(key, 0) + 1
    mine = {}
    for r in got:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        mine[key] = mine.get(key, 0) + 1
    assert mine == whole
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(packing.pieces(none)).count() == 0
    made = packing.sequences(packed).collect()
    assert all(len(r.ids) == (r.tokens if r.tokens.bit_count() == 1 else 2048) for r in made)
    assert sum(r.tokens for r in made) == sum(r.length for r in got)


def test_few_words_are_encoded_at_a_time(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    monkeypatch.setattr(packing, "ENCODED", 50, raising=False)
    words = packing._Words(path)
    encode, sizes = words.encode, []
    words.encode = lambda some, **options: sizes.append(len(some)) or encode(some, **options)
    texts = [" ".join(f"{i * j}-{j}é" for j in range(90)) for i in range(9)] + ["", "plain words, all of them."]
    ids, ends = words.ids(pa.array(texts))
    own = Tokenizer.from_file(path)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(sizes) <= 50


def encoded(words):
    """How often each word is given to the tokenizer, counted from here on."""
    encode, seen = words.encode, Counter()
    words.encode = lambda some, **options: seen.update(" ".join(some).split()) or encode(some, **options)
    return seen


def test_a_word_is_encoded_once_whatever_stands_around_it(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own, words = Tokenizer.from_file(path), packing._Words(path)
    seen = encoded(words)
    say = random.Random(2)
    letters = ["".join(say.choices("abcdefgh", k=9)) for _ in range(200)]
    texts = [" ".join(form.format(w, w.title(), w.upper()) for w in letters) for form in ('("{}")', "{1}-{0};", "{2}12/{0}:", "<{0}>.")]
    texts += ["don't 'Tis IT'S", "<|endoftext|>a <|ENDOFTEXT|>", "H\u0331 \u0130. \u0958, caf\u00e9. \u4e2d\u6587,", "a\x1cb\x85c\xa0d", "", " \n"]
    for size in (packing.AT_ONCE, 20):
        monkeypatch.setattr(packing, "AT_ONCE", size)
        ids, ends = words.ids(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    # the letters in pointed brackets may begin a special token and stay whole
    assert sum(seen[w] for w in letters) == 200
    assert sum(seen.values()) < 200 + 200 + 50


def test_words_met_lately_are_kept_when_others_go(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED", 200)
    words = packing._Words(packing.tokenizer_path())
    seen = encoded(words)
    rare = iter("".join(w) for w in itertools.product("bcdf", "aeiou", "ghjk", "aeiou"))
    for _ in range(8):
        words.ids(pa.array(["of the sea " + " ".join(itertools.islice(rare, 45))]))
    assert [seen[w] for w in ("of", "the", "sea")] == [1, 1, 1]
    assert len(words.known) + len(words.older) <= 200 + 2 * 50


def test_fullest_is_the_closest_sum():
    say = random.Random(1)
    for _ in range(60):
        counts = {say.randrange(1, 30): say.randrange(1, 4) for _ in range(4)}
        room = say.randrange(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        chosen = packing.fullest(counts, room)
        assert all(chosen[k] <= counts[k] for k in chosen)
        assert sum(k * n for k, n in chosen.items()) == max(sums)


# ---- personal data ----


def by_regex(text):
    import re

    found = []
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, p in pats.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


def test_base_spans_are_those_of_the_patterns():
    say = random.Random(9)
    parts = ["a@b.co", "x_y%+@", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (679) 555-1339",
             "+12", "a@b-c.d_x@e.f", "0.0.0.0", ".", " ", "-", "é", "token=", "+", "99", "378282246310005", "(", "\n", "@a.b"]
    for _ in range(1500):
        text = "".join(say.choice(parts) for _ in range(say.randrange(1, 12)))
        assert pii.base_spans(text) == by_regex(text), text
    long = "a" * 200_000 + "1" * 200_000 + "@" + " +1" * 20_000
    assert pii.base_spans(long) == []


def test_detected_and_redacted(spark, docs, rows, none):
    told = [(1000 + i, f"call +1 (679) 555-{i:04d} or mail a.{i}@mail{i % 9}.example.com now", "s", 9, "", "", 0, 0) for i in range(300)]
    told += [(2000 + i, f"order {i}1234 on 2021-{i % 12 + 1:02d}-11 token = \"{hashlib.md5(str(i).encode()).hexdigest()}\" see 10.{i}.3.7 or 999.{i}.1.1", "s", 9, "", "", 0, 0) for i in range(300)]
    all_docs = docs.unionByName(spark.createDataFrame(told, DOCS))
    judge = pii.learn(all_docs)
    assert judge.trees is not None
    assert pii.detect(all_docs, judge).count() == len(rows) + len(told)
    texts = {r[0]: r[1] for r in [*rows, *told]}
    got = pii.detect(all_docs.where("doc_id IS NOT NULL"), judge).collect()
    for r in got:
        text = texts[r.doc_id]
        base = by_regex(text or "")
        assert r.base == pii.in_order(base) and set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)
        assert (r.redacted == text) == (r.spans == "") and not (r.redacted and "@mail" in r.redacted)
    out = pii.redacted(all_docs, judge)
    assert out.columns == all_docs.columns and out.where("n_chars <> char_length(text) AND text LIKE '%[PHONE]%'").count() == 0
    assert out.where("text LIKE '%[PHONE]%' AND text LIKE '%[EMAIL]%'").count() == 300
    assert pii.learn(none).trees is None and pii.detect(none, pii.learn(none)).count() == 0
    assert pii.redact("abcdef", [("ip", 1, 3), ("card", 2, 4), ("phone", 5, 6)]) == "a[IP]e[PHONE]"


# ---- toxicity ----


def all_paths(unary, trans, first):
    import itertools

    n, total, hit = len(unary), 0.0, np.zeros(len(unary))
    for tags in itertools.product((0, 1), repeat=n):
        w = 1.0
        for t, tag in enumerate(tags):
            w *= unary[t] if tag else 1.0
            w *= trans[tags[t - 1], tag] if t else (first if tag else 1.0)
        total += w
        hit += w * np.array(tags)
    return hit / total


def test_marginals_are_those_of_all_tag_paths():
    draw = np.random.default_rng(2)
    lengths = np.array([3, 0, 7, 1, 5])
    unary, trans = np.exp(draw.normal(size=16)), np.exp(draw.normal(size=(2, 2)))
    starts = np.cumsum(lengths) - lengths
    odds = toxicity.chain_odds(unary, starts, lengths, trans, 1.0)
    for s, n in zip(starts, lengths, strict=True):
        if n:
            assert odds[s : s + n] / (1 + odds[s : s + n]) == pytest.approx(all_paths(unary[s : s + n], trans, 1.0))


@pytest.fixture(scope="module")
def labelled(spark):
    say = random.Random(3)
    told = []
    for i in range(900):
        said = [f"{say.choice('abcdefgh')}{say.randrange(400)}" for _ in range(40)]
        if i % 3 == 0:
            for _ in range(3):
                said[say.randrange(40)] = say.choice(["grumble", "nasty" + say.choice("xyz"), "Vile"])
        told.append((i, " ".join(said), "s", 1, "", "", 0, 0))
    labels = [(i, int(i % 3 == 0)) for i in range(900)] + [(1, None), (None, 1), (5000, 1)]
    return spark.createDataFrame(told, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(labelled, docs, none):
    told, labels = labelled
    model = toxicity.train(told, labels)
    got = toxicity.score(told, model).collect()
    held = [r for r in got if r.held_out]
    assert sorted(r.doc_id for r in held) == [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    texts = dict(told.select("doc_id", "text").collect())
    tagged = []
    for r in held:
        spans = [texts[r.doc_id][int(a) : int(b)] for a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert sum(len(s.split()) for s in spans) == r.n_toxic
        tagged += [w.lower().startswith(("grumble", "nasty", "vile")) for s in spans for w in s.split()]
    assert np.mean(tagged) > 0.95
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_tags_depend_on_neighbours():
    say = random.Random(5)
    documents, labels = [], []
    for k in range(300):
        words = [f"w{say.randrange(40)}" for _ in range(20)]
        at = say.randrange(1, 19)
        words[at - 1 : at + 1] = ["you", "rot"] if k % 2 else ["wood", "rot"]
        documents.append(words)
        labels.append(np.array([k % 2 == 1 and i == at for i in range(20)], np.int8))
    model = toxicity.train_tags(documents, labels, {"w=rot"})
    p, _ = toxicity.marginals(model, [["w1", "you", "rot", "w2"], ["w1", "wood", "rot", "w2"]], toxicity.Emissions(model))
    assert [x >= 0.5 for x in p] == [False, False, True, *[False] * 5]


def test_words_scored_in_short_are_scored_right():
    weights = {"w=at": 1.0, "4=abcd": 2.0, "<s=A": 0.5, ">w=xyz": -1.0, "s=a": 0.25, "<4=ßaab": 3.0}
    memory = toxicity.Emissions(toxicity.Crf(weights))
    for word in ("at", "AT", "abcde", "XYZ", "xyz", "other", "12", "SSaab", "ßaabx", "İat", "_"):
        n = memory[word]
        assert tuple(memory.table[3 * n : 3 * n + 3]) == pytest.approx(memory.model.scores(word))


def test_words_with_the_same_features_are_scored_once():
    weights = {"w=gra": 1.0, "3=gra": 0.5, "5=grape": 2.0, "<4=grap": -0.5, ">w=grapes": 0.75, "<s=0": 0.1, "s=Aa": 0.2}
    model = toxicity.Crf(weights)
    memory, asked = toxicity.Emissions(model), []
    model.scores = lambda word: asked.append(word) or toxicity.Crf.scores(model, word)
    words = [f"{start}{i}" for start in ("gra", "grap", "grape", "grapes", "other") for i in range(1000)]
    words += ["gra", "Gra", "GRA", "grab", "grap", "grape", "grapes", "Grapes", "gr", "g", "7", "77"]
    for word in words:
        n = memory[word]
        assert tuple(memory.table[3 * n : 3 * n + 3]) == toxicity.Crf.scores(model, word)
    assert len(asked) < 30 and len(memory.table) == 3 * len(asked)


def test_chosen_features_are_those_of_every_place():
    say = random.Random(8)
    windows = []
    for _ in range(200):
        words = [say.choice(["Stone", "stones", "STONE", "rot", "you", "12", f"x{say.randrange(90)}"]) for _ in range(12)]
        windows.append((words, np.array([w == "rot" and b == "you" for b, w in zip(["", *words], words)], np.int8)))
    counts = (Counter(), Counter())
    for words, tag in windows:
        for i, t in enumerate(tag.tolist()):
            counts[t].update(toxicity.features(words[i]))
            counts[t].update(toxicity.beside(words[i - 1])[0] if i else ())
            counts[t].update(toxicity.beside(words[i + 1])[1] if i + 1 < len(words) else ())
    size = np.array([sum(len(t) - int(t.sum()) for _, t in windows), sum(int(t.sum()) for _, t in windows)], float)
    telling = set()
    for f in counts[0].keys() | counts[1].keys():
        seen = np.array([counts[0][f], counts[1][f]], float)
        ratio = sum(
            2 * x * np.log(x / (part.sum() * n / size.sum()))
            for part in (seen, size - seen) for x, n in zip(part, size, strict=True) if x
        )
        if seen.sum() >= toxicity.SEEN and ratio >= toxicity.RATIO:
            telling.add(f)
    assert set(toxicity._choose(windows)) == telling and {"w=rot", "<w=you"} <= telling


def test_texts_are_tagged_alike_in_any_blocks(labelled, monkeypatch):
    told, labels = labelled
    twice = told.unionByName(told.limit(50))  # repeated rows teach once
    model = toxicity.train(twice, labels.unionByName(labels))
    assert model.weights == toxicity.train(told, labels).weights
    texts = [r.text for r in told.collect()] + ["", "x" * 300]
    at_once = toxicity._tag(model, texts, toxicity.Emissions(model))
    monkeypatch.setattr(toxicity, "REMEMBERED", 10)
    memory = toxicity.Emissions(model)
    apart = [toxicity._tag(model, [t], memory) for t in texts]
    assert np.allclose(at_once.score, [a.score[0] for a in apart]) and at_once.spans.tolist() == [a.spans[0] for a in apart]


def test_parts_of_thousands_of_zeros_are_read():
    """Python refuses int() of more than 4300 digits, even if all are zeros."""
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}7.1.1.1 {zeros}256.1.1.1") == [("ip", 0, 5007)]
    assert pii.base_spans(zeros + ".1.1.1") == [("ip", 0, 5006)]


@pytest.mark.parametrize(("kind", "one", "other"), [
    ("email", "ann.lee@city.example", "ann.lee [at] city.example"), ("ip", "10.1.20.30", "10-1-20:30"),
    ("card", "4111 1111 1111 1111", "4111.1111/1111.1111"), ("phone", "82 2 555 0123", "82-2-555-0123"),
])
def test_spellings_of_a_span_look_alike(kind, one, other):
    """The features tell nothing about the separators, the at sign or a plus before the span."""
    seen = [pii.describe(f"call {sign}{span} now", kind, 5 + len(sign), 5 + len(sign) + len(span)) for span in (one, other) for sign in ("", "+")]
    assert all(x == seen[0] for x in seen)


def luhn_number(say: random.Random) -> str:
    head = "4" + "".join(say.choice("0123456789") for _ in range(14))
    return next(head + d for d in "0123456789" if pii.luhn(head + d))


def test_trees_add_other_spellings_and_nothing_else(spark):
    """Learned from texts that hold base spans only; no text below holds one."""
    say = random.Random(4)
    told = []
    for i in range(400):
        spans = [f"{say.choice(('ann', 'bo.li', 'kim'))}.{say.randrange(99)}@mail{i % 9}.example.com", luhn_number(say),
                 f"+1 ({say.randrange(200, 999)}) 555-{say.randrange(10000):04d}", ".".join(str(say.randrange(1, 255)) for _ in range(4))]
        told.append((i, " und ".join(f"{say.choice(('the', 'onhe', 'erich'))} {s}" for s in say.sample(spans, 3)) + " ok"))
    judge = pii.learn(spark.createDataFrame(told, "doc_id bigint, text string"))
    wanted = [
        ("email", "john.smith [at] example.com"), ("email", "jo(at)mail.example.org"), ("ip", "192-168-10-17"), ("ip", "192[.]168[.]10[.]17"),
        ("phone", "1 544 555 8128"), ("phone", "(544) 555-8128"), ("phone", "1-544-555-8128"),
        ("card", "4111/1111/1111/1111"), ("card", "4111.1111.1111.1111"),
    ]
    clean = [
        "2024-05-17 10:30", "17.05.2024", "4000123456", "10.2.1045.300", "192-168-10-300", "4111.1111.1111.1112", "4111/1111/1111/1112", "1-2-3-4",
        "3 [at] 5pm", "me @ home", "x@y", "9859476043669043", "0004-2021-00017", "a1b2@c3d4e5f6",
    ]
    texts = [f"the {s} ok" for _, s in wanted] + [f"the {s} ok" for s in clean]
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), judge).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert [spans[i] for i in range(len(wanted))] == [f"{k}:4:{4 + len(s)}" for k, s in wanted]
    assert {texts[i]: spans[i] for i in range(len(wanted), len(texts)) if spans[i]} == {}
    assert all(r.base == "" and r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in got)
    assert {r.redacted for r in got[: len(wanted)]} == {f"the [{k.upper()}] ok" for k in pii.KINDS}


def test_lessons_hold_both_labels_and_rewritten_spans_are_no_base_spans():
    say = random.Random(5)
    for _ in range(200):
        spans = {"email": f"a{say.randrange(99)}.b@c{say.randrange(9)}.d4.e5", "card": luhn_number(say), "phone": "+1 (544) 555-0123", "ip": "10.20.30.4"}
        for kind, span in spans.items():
            for turn in range(24):
                right, wrong = pii.respelled(kind, span, turn), pii.decoy(kind, span, turn)
                assert kind not in {k for k, _, _ in pii.base_spans(f"x {right} y")} | {k for k, _, _ in pii.base_spans(f"x {wrong} y")}, (right, wrong)
        rows = pii.lessons(" , ".join(spans.values()))
        assert {r for _, r, _ in rows} == {0, 1} and len({len(x) for _, _, x in rows}) == 1
    assert pii.lessons("") == [] and pii.lessons("9" * 100_000 + "@") == pii.lessons("9" * 100_000 + "@")


def test_trees_learn_from_every_candidate(spark, monkeypatch):
    """More candidates than any earlier sample: all of them grow the trees or calibrate, none is left out."""
    say = random.Random(8)
    texts = [f"{say.random()} mail a{i}@b{say.randrange(99)}.example.com or 10.{i % 250}.{say.randrange(250)}.7 call +1 (544) 555-{i % 10000:04d} at {say.random()}" for i in range(3000)]
    wanted = {h for t in texts for h, _, _ in pii.lessons(t)}
    assert len(wanted) > 25_000
    seen = []
    train, calibrated = pii.train, pii.calibrated
    monkeypatch.setattr(pii, "train", lambda rows, cuts, mean: seen.append(rows.agg(F.sum("n")).first()[0]) or train(rows, cuts, mean, trees=2))
    monkeypatch.setattr(pii, "calibrated", lambda trees, kind, margin, n, right: seen.append(int(n.sum())) or calibrated(trees, kind, margin, n, right))
    assert pii.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).trees is not None
    assert len(seen) == 2 and sum(seen) == len(wanted)


def test_trees_from_summed_histograms(spark):
    """Trees over rows in several tasks, alike ones counted together, are those of one plain pass over all rows."""
    say = np.random.default_rng(3)
    x = np.stack([say.integers(0, 90, 900), say.integers(0, 4, 900), say.integers(0, 2, 900)], axis=1).astype(float)
    y = ((x[:, 0] > 40) ^ (x[:, 1] == 2) ^ (say.random(900) < 0.1)).astype(int)
    cuts = [boosting.edges(*map(np.asarray, np.unique(x[:, i], return_counts=True))) for i in range(3)]
    assert np.array_equal(cuts[0], np.unique(np.quantile(x[:, 0], np.linspace(0, 1, 33)[1:-1]))) and cuts[1].tolist() == [0.5, 1.5, 2.5]
    told = boosting.bins(cuts, x)
    rows = spark.createDataFrame([(bytes(b), int(r)) for b, r in zip(told, y, strict=True)], "bins binary, right int").repartition(5)
    model = boosting.train(rows.groupBy("bins").agg(F.count("*").alias("n"), F.sum("right").alias("right")), cuts, float(y.mean()), trees=12)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))

    def grow(own, depth, p):
        g, h = (p - y)[own].sum(), (p * (1 - p))[own].sum()
        best, sides = 1e-6, None
        for f, k in ((f, k) for f in range(3) for k in range(31) if depth):
            low, high = own & (told[:, f] <= k), own & (told[:, f] > k)
            gains = [(p - y)[s].sum() ** 2 / ((p * (1 - p))[s].sum() + 1) for s in (low, high)]
            if sum(gains) - g**2 / (h + 1) > best + 1e-7:
                best, sides = sum(gains) - g**2 / (h + 1), (low, high)
        if sides is None:
            margin[own] += -0.2 * g / (h + 1)
        else:
            for side in sides:
                grow(side, depth - 1, p)

    for _ in range(12):
        grow(np.ones(len(y), bool), 3, 1 / (1 + np.exp(-margin)))
    assert len(model.trees) == 12 and np.abs(model.margin(x) - margin).max() < 1e-3
