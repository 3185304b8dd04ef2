"""Set similarity join of word shingles: the universe is partitioned into segments, close sets agree on a segment or nearly so.

A token (the hash of a shingle) falls into one of the m segments of a size band. Two sets with a Jaccard similarity of 0.8 differ in at
most (|r| + |s|) / 9 tokens, so of more segments than that one is equal in both. A set's *unit* is a segment that must be equal; a segment
that may differ by one token, found by its subset and by its one-deletion neighbours, counts for two units. Each set r probes
2 |r| / 9 + 1 units, and those it can have for the least number of candidates. Segments that nobody else shares cost nothing, so
most sets need no candidate at all, and common passages are left out as long as enough other segments are there. Sets whose cheapest
units still bring many candidates, as those of large groups of near copies, go on to the finest partition, where each token is a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from exposure.llm.components import components
from exposure.operators.skew import first_per
from exposure.session import store

WORDS = 5
# Least similarity in percent; the sizes below follow from it.
PERCENT = 80
# Sets of fewer tokens than this are linked with equal sets only.
LEAST = 4
# Sets below this size index the one-deletion neighbours of up to 14 segments, larger ones those of two.
SMALL = 64
_NONE = 15
# Names of sets (16 bytes each) that are sent to the texts; a longer list is joined by a shuffle.
LISTED = 500_000
# Candidates that a set may bring by its segments; beyond that its tokens are looked at.
CHEAP = 32
_SIZED = "struct<n:long,rep:long,units:int,across:int,keys:array<long>>"
_TRUE = np.array([True])
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of five words (fewer words: of the whole sequence).

    ``bytes.lower`` and ``bytes.split`` touch just A-Z and just the bytes 20 and 09-0D.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(hashed, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        found += _PLACES[j] * each[j : len(words) - size + 1 + j]
    found = np.sort(_mix(found))
    return found[np.concatenate([_TRUE, found[1:] != found[:-1]])]


def band(n: int) -> int:
    """Bands hold sizes 4-7, 8-15, 16-31 and so on."""
    return (n // LEAST).bit_length() - 1


def layout(b: int) -> tuple[int, int]:
    """Segments of a band and how many of them index one-deletion neighbours.

    There are some segments more than the largest sets of the band need, so that a set can do without a few that are empty or dear.
    """
    high = (2 * LEAST << b) - 1
    need = 2 * high // 9 + 1
    if high < SMALL:
        return max(2, need + (b > 0)), min(need + 1, _NONE - 1)
    return need + need // 10 + 4, 2


def signatures(found: np.ndarray, b: int, own: bool) -> tuple[np.ndarray, int]:
    """Keys of a set in a band, and how many units they allow, upgrades included.

    The upper 58 bits of a key tell the band, the segment and the tokens in it, or these without one (a *deletion*). The lower bits
    hold the segment if it may be upgraded (15: it may not), whether it is a deletion, and whether the band is the set's own.
    """
    m, deletions = layout(b)
    spread = _mix(found + np.uint64(2 * b + 1))
    # the upper half of the hash, scaled to the number of segments
    segment = ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.uint16 if m <= 1 << 16 else np.int64)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], _mix(spread[order] ^ np.uint64(0x5851F42D4C957F2D))
    starts = np.flatnonzero(np.concatenate([_TRUE, segment[1:] != segment[:-1]]))
    counts = np.diff(starts, append=len(segment))
    sums, at = np.add.reduceat(value, starts), segment[starts].astype(np.int64)
    salt = _PLACES[0] * at.astype(np.uint64) + _PLACES[2:3] * np.uint64(b + 1)
    may = (at < deletions) & (counts > 1)

    def keyed(total: np.ndarray, count: np.ndarray, salt: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return (_mix(total + salt + _PLACES[1] * count.astype(np.uint64)) & ~np.uint64(63)) | flags.astype(np.uint64)

    keys = [keyed(sums, counts, salt, np.where(may, at, _NONE) << 2 | int(own))]
    low = int(np.searchsorted(at, deletions))  # segments that may be upgraded come first
    if may[:low].any():
        of = np.repeat(np.arange(low), counts[:low])
        chosen = may[of]
        of = of[chosen]
        keys.append(keyed(sums[of] - value[: len(chosen)][chosen], counts[of] - 1, salt[of], at[of] << 2 | 2 | int(own)))
    return np.concatenate(keys), len(starts) + int(may.sum())


def postings(found: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Keys of a set in its own band and, if it is close to the next one's sizes, there; the units it has in its own and there."""
    n = len(found)
    if n < LEAST:
        return np.zeros(0, np.uint64), 0, 0
    b = band(n)
    keys, units = signatures(found, b, True)
    if 100 * n < PERCENT * (2 * LEAST << b):
        return keys, units, 0
    more, across = signatures(found, b + 1, False)
    return np.concatenate([keys, more]), units, across


def name(found: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), len(found))).view(np.int64))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's set: doc_id, text_hash, n (its size), rep (its name; null if empty), units it has in its own band, units
    across, in the next one, and its keys in both."""

    @F.arrow_udf(_SIZED)
    def measure(texts: pa.Array) -> pa.Array:
        sizes, names, keys = [], [], []
        for t in texts.cast(pa.binary()):
            found = tokens(t.as_py() or b"")
            n = len(found)
            posted, units, across = postings(found)
            sizes.append((n, units, across))
            names.append(name(found) if n else None)
            keys.append(posted)
        n, units, across = np.array(sizes, np.int64).reshape(-1, 3).T
        ends = np.cumsum([0, *map(len, keys)])
        flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        columns = [pa.array(n), pa.array(names, pa.int64()), pa.array(units, pa.int32()), pa.array(across, pa.int32()), lists]
        return pa.StructArray.from_arrays(columns, ["n", "rep", "units", "across", "keys"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    told = rows.withColumn("_set", measure("text")).withColumn("text_hash", F.xxhash64("text"))
    return told.select("doc_id", "text_hash", "_set.*")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of groups with more than one set, from rows sorted by key and rep, and the set before each in its group.

    A group may lie over several tasks, so the first and last row of a task are handed on whatever their groups hold.
    """

    def told(rows: np.ndarray, keep: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
        key, rep = rows[:, keep]
        before = np.r_[np.int64(0), rows[1][:-1]][keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(key >> 6), pa.array((key & 63).astype(np.int32)), pa.array(rep), pa.array(before, mask=~same[keep])],
            ["group", "flags", "rep", "prev"],
        )

    last, linked, first = np.zeros((2, 0), np.int64), False, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep")])
        rows = np.concatenate([last, rows], axis=1)
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]]
        group = rows[0] >> 6
        same = np.r_[linked, group[1:] == group[:-1]]
        keep = (same[:-1] | same[1:]) if len(group) > 1 else np.zeros(0, bool)
        if len(keep):
            keep[0] |= first
            # what stood before the row that was held back is no longer known, so that row has no predecessor to offer
            known = same.copy()
            known[0] = False
            yield told(rows[:, :-1], keep, known[:-1])
            linked, first = bool(same[-1]), False
        last = rows[:, -1:]
    if last.shape[1]:
        yield told(last, np.array([True]), np.array([False]))


@F.arrow_udf(BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the sets of two texts have a Jaccard similarity of at least 0.8, counted exactly."""
    out = []
    for x, y in zip(a.cast(pa.binary()), b.cast(pa.binary()), strict=True):
        left, right = tokens(x.as_py()), tokens(y.as_py())
        both = len(np.intersect1d(left, right, assume_unique=True))
        out.append(both > 0 and 100 * both >= PERCENT * (len(left) + len(right) - both))
    return pa.array(out, pa.bool_())


def _texts(reps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """One text of each set (rep). Texts are the widest thing that moves, and do so only where the list of sets is too long to be sent
    to them."""
    wanted = store(reps.join(classes.select("rep", "text_hash"), "rep"), "wanted")
    listed = F.broadcast(wanted) if wanted.count() <= LISTED else wanted
    rows = docs.select("text").withColumn("text_hash", F.xxhash64("text")).join(listed, "text_hash")
    return store(first_per(rows, ["rep"], F.lit(0)).select("rep", "text"), "texts")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are close."""
    pairs = store(pairs, "candidates")
    reps = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = _texts(reps, classes, docs)
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("_left"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("_right"))
    return store(pairs.join(left, "a").join(right, "b").where(similar("_left", "_right")).select("a", "b"), "links")


def need(n: Column) -> Column:
    """Units that a set of n tokens must probe to find every close set that is not larger."""
    return F.floor(2 * n / 9) + 1


def _guesses(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that are likely links: a set and the one that stands most often before it in its groups, and a set and the one that is most
    often the most central of its groups, if often enough. Central is who shares its segments with most others, as an original does with its copies."""
    whole = shared.where(F.col("flags").bitwiseAND(3) == 1).select("group", "rep", "prev")
    counts = whole.groupBy("group").agg(F.count("*").alias("c")).where("c > 1")
    sized = store(whole.join(counts, "group"), "segments")
    central = sized.groupBy("rep").agg(F.sum("c").alias("weight"))
    heads = sized.join(central, "rep").groupBy("group").agg(F.max_by("rep", F.struct("weight", "rep")).alias("head"))
    headed = sized.join(heads, "group").where("head <> rep").select("rep", F.col("head").alias("b"))
    before = sized.where("prev IS NOT NULL AND prev <> rep").select("rep", F.col("prev").alias("b"))
    found = []
    for pairs in (headed, before):
        counted = pairs.groupBy("rep", "b").agg(F.count("*").alias("c"))
        best = counted.groupBy("rep").agg(F.max_by("b", F.struct("c", "b")).alias("b"), F.max("c").alias("c"))
        found.append(best.join(classes.select("rep", "units"), "rep").where("5 * c >= units").select(F.col("rep").alias("a"), "b"))
    return found[0].unionByName(found[1]).distinct()


def _priced(labelled: DataFrame) -> DataFrame:
    """Rows of groups that more than one component shares, with the number of sets of other components there: whole (e), deletions (d).

    ``labelled``: group, flags, rep, n, units, across, root. What members of one component share is known already.
    """
    flags = F.col("flags")
    rows = labelled.withColumn("kind", F.shiftright(flags, 1).bitwiseAND(1)).withColumn("at", F.shiftright(flags, 2))
    rows = rows.withColumn("own", flags.bitwiseAND(1) == 1).drop("flags")
    sums = [F.count_if(F.col("kind") == k).alias(c) for k, c in ((0, "e"), (1, "d"))]
    by_root = rows.groupBy("group", "root").agg(*sums)
    whole = by_root.groupBy("group").agg(F.sum("e").alias("all_e"), F.sum("d").alias("all_d"), F.count("*").alias("roots"))
    others = by_root.join(whole.where("roots > 1 AND all_e > 0"), "group")
    others = others.select("group", "root", (F.col("all_e") - F.col("e")).alias("e"), (F.col("all_d") - F.col("d")).alias("d"))
    return store(rows.join(others, ["group", "root"]), "priced")


def _units(priced: DataFrame) -> DataFrame:
    """Units of each set that somebody of another component shares, with their price: the number of candidates they bring.

    A segment's own unit has no ``at``; its upgrade has one and is priced no lower, so that it never comes before it.
    """
    same = ["rep", "root", "n", "units", "across", "own"]
    base = priced.where("kind = 0 AND e > 0").select(*same, "group", F.lit(None).cast("int").alias("at"), F.col("e").alias("price"))
    price = F.sum(F.when(F.col("kind") == 0, F.col("d")).otherwise(F.col("e")))
    at_least = F.max(F.when(F.col("kind") == 0, F.col("e")).otherwise(0))
    up = priced.where(F.col("at") < _NONE).groupBy(*same, "at").agg(F.greatest(price, at_least).alias("price"))
    return base.unionByName(up.where("price > 0").withColumn("group", F.lit(None).cast("long")))


def _candidates(labelled: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components, one of which is in every chain of close sets between them that is not known yet.

    Units that nobody shares come first and cost nothing. Who needs more takes the cheapest ones. Where even these bring more than
    ``CHEAP`` candidates, the set is looked at in the finest partition, see :func:`_by_token`.
    """
    priced = _priced(labelled)
    per = Window.partitionBy("rep")
    units = _units(priced)
    mine = units.where(F.col("own") & (F.col("n") > LEAST)).withColumn("_need", need(F.col("n")) - F.col("units") + F.count("*").over(per))
    rank = F.row_number().over(per.orderBy("price", F.col("at").asc_nulls_first(), "group"))
    taken = mine.where("_need > 0").withColumn("_rank", rank).where("_rank <= _need").withColumn("_cost", F.sum("price").over(per))
    chosen = store(taken.select("rep", "root", "n", "group", "at", "_cost"), "units")
    cheap, dear = chosen.where(F.col("_cost") <= CHEAP), chosen.where(F.col("_cost") > CHEAP).select("rep").distinct()
    plain = cheap.where("at IS NULL").select("rep", "root", "n", "group", F.lit(0).alias("kind"))
    rows = priced.where(F.col("own") & (F.col("at") < _NONE)).select("rep", "root", "n", "group", "at", "kind")
    wide = cheap.where("at IS NOT NULL").select("rep", "at").join(rows, ["rep", "at"])
    probes = plain.unionByName(wide.select("rep", "root", "n", "group", (1 - F.col("kind")).alias("kind")))
    other = priced.select("group", "kind", F.col("rep").alias("b"), F.col("root").alias("_root"), F.col("n").alias("_n"))
    met = probes.select(F.col("rep").alias("a"), "root", "n", "group", "kind").join(other, ["group", "kind"])
    near = met.where(f"root <> _root AND _n <= n AND 100 * _n >= {PERCENT} * n").select("a", "b").distinct()
    # a smaller set can be a partner only if it has too few free units for the larger one too, in its own band or in the next
    shares = units.groupBy("rep", "n", "units", "across", "own").agg(F.count("*").alias("_shared"))
    n, beyond = F.col("n"), F.expr(f"shiftleft({2 * LEAST}, int(log2(n / {LEAST}D)))")
    most = F.floor((n + F.least(F.floor(n * 100 / PERCENT), beyond - 1)) / 9) + 1
    most_across = F.floor((n + F.floor(n * 100 / PERCENT)) / 9) + 1
    tied = F.when(F.col("own"), F.col("units") - F.col("_shared") < most).otherwise(F.col("across") - F.col("_shared") < most_across)
    few = (n >= LEAST) & ((F.col("units") < most) | ((100 * n >= PERCENT * beyond) & (F.col("across") < most_across)))
    partners = store(shares.where(tied).select("rep").unionByName(classes.where(few).select("rep")).distinct(), "partners")
    return near.unionByName(_by_token(dear, partners, labelled.select("rep", "root", "n").distinct(), classes, docs)).distinct()


def _by_token(dear: DataFrame, partners: DataFrame, named: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates in the finest partition: every token is a segment, and a set takes its rarest ones.

    A set r misses at most |r| - o of its tokens in s, if both must share o; of one token more, one is in s. Tokens that only one component
    has come first, then the rarer ones; the same order holds for all, so r's first token in s is also the first of s in r. Its place
    bounds what both can share, by their sizes: both are put into the bands of sizes (2 %) that the places leave.
    """
    dear = store(dear.join(named, "rep"), "dear")
    if dear.isEmpty():
        return dear.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    members = store(dear.select("rep").unionByName(partners).distinct().join(named, "rep"), "members")
    texts = _texts(members.select("rep"), classes, docs)
    told = store(texts.select("rep", F.explode(token_lists("text")).alias("token")).join(members, "rep"), "tokens")
    by_root = told.groupBy("token", "root").agg(F.count("*").alias("c"))
    counts = by_root.groupBy("token").agg(F.sum("c").alias("c"), F.count("*").alias("roots"))
    counts = counts.where("roots > 1").select("token", "c")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("c", F.lit(0)), "token")) - 1
    placed = told.join(counts, "token", "left").withColumn("i", place).where("c IS NOT NULL AND 5 * i <= n")
    placed = store(placed.select("token", "rep", "root", "n", "i"), "placed")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.02)))
    low = F.floor(F.log(F.col("n") * PERCENT / 100) / F.log(F.lit(1.02))) - 1
    high = F.floor(F.log(F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * 1.25 - F.col("i") * 2.25))) / F.log(F.lit(1.02))) + 1
    larger = placed.join(dear.select("rep"), "rep", "left_semi").where(low <= high)
    larger = larger.select("token", F.col("rep").alias("a"), "root", "n", "i", F.explode(F.sequence(low, high)).alias("size"))
    smaller = placed.where("9 * i <= n").select(
        "token", F.col("rep").alias("b"), F.col("root").alias("_root"), F.col("n").alias("_n"), F.col("i").alias("_i"), size.alias("size")
    )
    met = larger.join(smaller, ["token", "size"])
    fits = met.where("root <> _root AND _n <= n AND 9 * least(n - i, _n - _i) >= 4 * (n + _n)")
    return fits.select("a", "b").distinct()


def _short_of_units(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Candidates of sets whose tokens fell into too few segments (one in some 10^5 small sets): whoever shares a token with them."""
    short = store(classes.where(F.col("n") > LEAST).where(F.col("units") < need(F.col("n"))), "short")
    low, high = short.agg(F.min("n"), F.max("n")).first()
    if low is None:
        return None
    sizes = classes.where(F.col("n").between(low * PERCENT // 100, high)).select("rep", "n", "text_hash")
    texts = docs.select("text").withColumn("text_hash", F.xxhash64("text")).join(sizes, "text_hash")
    rows = first_per(texts, ["rep"], F.lit(0)).select("rep", "n", F.explode(token_lists("text")).alias("token"))
    rows = store(rows, "tokens")
    mine = rows.join(short.select("rep"), "rep", "left_semi").select("token", F.col("rep").alias("a"), F.col("n").alias("_n"))
    near = mine.join(rows, "token").where(f"a <> rep AND n <= _n AND 100 * n >= {PERCENT} * _n")
    return near.select("a", F.col("rep").alias("b")).distinct()


def links(docs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between sets that connect just those sets which a chain of close sets connects; equal sets are one.

    ``docs``: text; ``sets``: rep and keys of each; ``classes``: rep, text_hash, n, units, across. Postings are range-sorted by key and set,
    so that a group of any size lies over many tasks, and only those of shared groups are kept. A first guess joins likely pairs; members of
    large groups of near copies come together that way, and only candidates from other components are looked for after that. Every
    candidate is compared token by token.
    """
    posted = sets.select(F.explode("keys").alias("key"), "rep")
    dealt = posted.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    shared = store(dealt.mapInArrow(_shared, "group long, flags int, rep long, prev long"), "shared")
    found = _verified(_guesses(shared, classes), classes, docs)
    roots = components(found).select(F.col("node").alias("rep"), "root")
    named = classes.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")).drop("text_hash")
    wanted = _candidates(store(shared.select("group", "flags", "rep").join(named, "rep"), "labelled"), classes, docs)
    extra = _short_of_units(classes, docs)
    if extra is not None:
        wanted = wanted.unionByName(extra).distinct()
    return found.unionByName(_verified(wanted, classes, docs))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with n_shingles and component_id: the smallest doc_id that links of similarity 0.8 or more reach, itself included.

    A set holds the distinct shingles of five words, A-Z in lower case; fewer words make one shingle, none (or a null text) an empty set that
    is linked with nothing, not with other empty ones. Sets, shingles and texts are told apart by 64-bit hashes. Repeated rows stay, each with the
    class of its text. A null doc_id is never the smallest; a component of such rows only has a null id. Other columns are left out. No rows: no rows.
    """
    rows = store(sized(docs, key, text), "sets")
    sets = rows.where("n > 0")
    numbers = [F.max(c).alias(c) for c in ("n", "units", "across", "text_hash")]
    classes = store(sets.groupBy("rep").agg(F.min("doc_id").alias("least"), *numbers), "classes")
    joined = components(links(docs.select(F.col(text).alias("text")), sets, classes.drop("least"))).select(F.col("node").alias("rep"), "root")
    rooted = classes.select("rep", "least").join(joined, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(least, "root").select("rep", "component_id")
    told = rows.join(ids, "rep", "left")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@F.arrow_udf(ArrayType(LongType()))
def token_lists(texts: pa.Array) -> pa.Array:
    """The tokens of each text's set."""
    return pa.array([tokens(t.as_py() or b"").view(np.int64) for t in texts.cast(pa.binary())], pa.list_(pa.int64()))
