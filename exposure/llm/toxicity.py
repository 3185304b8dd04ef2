"""Toxic spans by a linear-chain conditional random field; document scores from its marginals."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bound of the training sample: labelled documents of each class, taken by a hash of their id, and characters of each that
# are learnt from. Scores are of whole texts.
SAMPLE, LEARNT = 2000, 20_000
# Folds of the sample: this many tenths teach words and tags, the rest calibrate the document score.
TAG_TENTHS = 7
# A feature speaks for toxicity if it has this many occurrences in toxic documents and this share of all is toxic.
SEEN, PURE = 6, 0.95
# Windows that tags are learnt from: those with a telling word, and one in so many of the others.
WINDOW, OTHERS = 24, 8
# Features of the field: likelihood ratio against the tags at least this (one in a thousand by chance), the best so many.
RATIO, MOST = 10.83, 5000
# Times that toxic documents are tagged anew by the field and learnt again.
ANEW = 1
FAINT = 0.1
# Words whose emission a task remembers; the memory is emptied when it is full.
REMEMBERED = 100_000

# Characters of the texts that a task tags at once; a longer text is tagged by itself.
AT_ONCE = 2_000_000

TOKEN = re.compile(r"\w+")
# Lengths of the beginnings that are features of a word, and the kinds of feature that it has for its neighbours.
STEMS = range(3, 9)
BESIDE = ("w=", "4=", "s=")


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings, which stand for rarer forms of the same stem, and its shape."""
    small = word.lower()
    return (f"w={small}", *[f"{n}={small[:n]}" for n in STEMS if len(small) >= n], f"s={shape(word)}")


def shape(word: str) -> str:
    return "0" if word.isdigit() else "A" if len(word) > 1 and word.isupper() else "Aa" if word[0].isupper() else "a"


def beside(word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What a word says of its next and of its previous neighbour: itself, its stem and its shape."""
    told = [f for f in features(word) if f[:2] in BESIDE]
    return tuple(f"<{f}" for f in told), tuple(f">{f}" for f in told)


def _by_kind(words: Iterable[str]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """The kinds of feature one after the other (``w=``, ``3=``, ..), each with all (word, its feature of that kind): there
    are far more features than words, and nearly all are too rare to be kept."""
    small = [(w, w.lower()) for w in words]
    yield "w=", [(w, x) for w, x in small]
    for n in STEMS:
        yield f"{n}=", [(w, x[:n]) for w, x in small if len(x) >= n]
    yield "s=", [(w, shape(w)) for w, _ in small]


def chain_odds(unary: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: float) -> np.ndarray:
    """Marginal odds of state 1 at every place of many chains, by forward and backward recursion over the ratio of states.

    ``unary`` is exp(score) of state 1 against 0 at each place, ``trans`` the 2 x 2 potentials, ``first`` the odds before the
    first place. All chains advance together, the longest first, so a step is one array operation over the chains still
    running, and memory is that of the places.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(longest), "left")  # chains longer than t
    forward, odds = np.empty(len(unary)), np.empty(len(unary))
    ratio = np.full(len(lengths), first)
    for t in range(longest):
        at = starts[: running[t]] + t
        before = ratio[: running[t]]
        if t:
            before = (trans[0, 1] + trans[1, 1] * before) / (trans[0, 0] + trans[1, 0] * before)
        ratio[: running[t]] = forward[at] = unary[at] * before
    back = np.ones(len(lengths))
    for t in range(longest - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        odds[at] = forward[at] * back[:k]
        ahead = unary[at] * back[:k]
        back[:k] = (trans[1, 0] + trans[1, 1] * ahead) / (trans[0, 0] + trans[0, 1] * ahead)
    return odds


@dataclass
class Crf:
    """Two tags, clean 0 and toxic 1. A token's score is a bias plus the weights of its features; ``trans`` scores tag pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    # document score: logistic in the summary of the marginals
    doc: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0]))

    def scores(self, word: str) -> tuple[float, float, float]:
        """What a word adds to the score of its own place, of the next one and of the previous one."""
        ahead, back = beside(word)
        return tuple(sum(self.weights.get(f, 0.0) for f in told) for told in (features(word), ahead, back))


class Emissions(dict):
    """Numbers of the words met so far in a table of scores, one row for all words with the same features in the model: those
    of one shape that are the same known word, or go on alike for as long as any feature does."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.table = model, array("d")
        self.rows: dict[tuple[bool, str, str], int] = {}
        self.whole, self.begins = set(), set()
        for f in model.weights:
            kind, told = f.lstrip("<>").split("=", 1)
            if kind == "w":
                self.whole.add(told)
            elif kind != "s":
                self.begins.update(told[:n] for n in range(STEMS[0], len(told) + 1))

    def __missing__(self, word: str) -> int:
        small = word.lower()
        whole, known = small in self.whole, small
        if not whole:
            n = next((n for n in STEMS if small[:n] not in self.begins), STEMS[-1] + 1)
            known = small[: n - 1] if n > STEMS[0] else ""
        key = whole, known, shape(word)
        number = self.rows.get(key)
        if number is None:
            self.rows[key] = number = len(self.rows)
            self.table.extend(self.model.scores(word))
        self[word] = number
        return number

    def shrink(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def marginals(model: Crf, texts: Iterable[list[str]], memory: Emissions) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a toxic tag for every token of all texts (lists of words), one after the other, and the number of tokens
    of each text."""
    memory.shrink()
    parts, lengths = [], []
    for words in texts:
        lengths.append(len(words))
        parts.append(np.fromiter(map(memory.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    own, ahead, back = np.array(memory.table).reshape(-1, 3)[ids].T
    lengths = np.array(lengths, np.int64)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(ids), bool)
    inner[starts[lengths > 0]] = False
    after = np.flatnonzero(inner)
    total = own + model.bias
    total[after] += ahead[after - 1]
    total[after - 1] += back[after]
    odds = chain_odds(np.exp(np.clip(total, -30, 30)), starts, lengths, np.exp(model.trans), 1.0)
    return odds / (1 + odds), lengths


def summaries(tags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: constant, largest marginal, log of the expected number of toxic tokens, their share of the tokens.

    Marginals below ``FAINT`` do not add up, or a long clean document would seem toxic by its length.
    """
    ends = np.cumsum(lengths)
    sums = np.r_[0.0, np.cumsum(np.where(tags >= FAINT, tags, 0.0))]
    total = sums[ends] - sums[ends - lengths]
    top = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        top[some] = np.maximum.reduceat(tags, (ends - lengths)[some])
    return np.stack([np.ones(len(lengths)), top, np.log1p(total), total / np.maximum(lengths, 1)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _log_chance(hits: int, misses: int, share: float) -> float:
    """Log of the chance that a draw with this share of hits misses no oftener."""
    n = hits + misses
    terms = [
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (n - k) * math.log(share) + k * math.log1p(-share)
        for k in range(misses + 1)
    ] if 0 < share < 1 else [0.0]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def label_tokens(documents: list[list[str]], toxic: np.ndarray) -> tuple[list[np.ndarray], set[str]]:
    """First tags from document labels: a token of a toxic document is toxic if one of its features stands almost only in
    toxic documents, counted by the different words of a document that have it and weighed by class size.

    Copies of a toxic document repeat its harmless words too. So a feature must also have stood after ``SEEN`` different
    words in toxic documents, and oftener than chance explains, which a word of a copied passage has not.
    """
    held_by = (Counter(), Counter())
    for words, bad in zip(documents, toxic, strict=True):
        held_by[int(bad)].update({w.lower() for w in words})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = PURE / (1 - PURE) * n1 / n0
    looked, clean = 0, {}  # features seen often enough in toxic documents; of those that tell, their number in clean ones
    for kind, told in _by_kind(held_by[0].keys() | held_by[1].keys()):
        c0, c1 = Counter(), Counter()
        for word, f in told:
            c0[f] += held_by[0].get(word, 0)
            c1[f] += held_by[1].get(word, 0)
        often = {f: c for f, c in c1.items() if c >= SEEN}
        looked += len(often)
        clean.update({kind + f: c0[f] for f, c in often.items() if c >= odds * c0[f]})
    telling = _Memory(lambda word: [f for f in features(word) if f in clean])
    after: dict[str, set[str]] = {f: set() for f in clean}
    for words, bad in zip(documents, toxic, strict=True):
        if bad:
            for before, word in zip(["", *words], words, strict=False):
                for f in telling[word]:
                    after[f].add(before.lower())
    # so many features were looked at; with this level less than one harmless one passes by chance
    level = math.log(0.5 / max(1, looked))
    share = n1 / (n1 + n0)
    found = {f for f, words in after.items() if len(words) >= SEEN and _log_chance(len(words), clean[f], share) < level}
    tells = _Memory(lambda word: not found.isdisjoint(features(word)))
    tags = [
        np.fromiter((bool(bad) and tells[w] for w in words), np.int8, len(words))
        for words, bad in zip(documents, toxic, strict=True)
    ]
    return tags, found


class _Memory(dict):
    """What a function says of each word met."""

    def __init__(self, say: Callable):
        super().__init__()
        self.say = say

    def __missing__(self, word: str):
        self[word] = said = self.say(word)
        return said


def _windows(documents: list[list[str]], tags: list[np.ndarray], found: set[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Stretches around telling or toxic tokens, and the first and one in ``OTHERS`` of the other stretches of each document."""
    tells = _Memory(lambda word: not found.isdisjoint(features(word)))
    for words, tag in zip(documents, tags, strict=True):
        told = {i // WINDOW for i, w in enumerate(words) if tag[i] or tells[w]}
        for k in range((len(words) + WINDOW - 1) // WINDOW):
            if k in told or k % OTHERS == 0:
                yield words[k * WINDOW : (k + 1) * WINDOW], tag[k * WINDOW : (k + 1) * WINDOW]


def _places_of(words: list[str], told: tuple[dict, dict, dict]) -> list[list]:
    """What is told of each place by its word, the word before and the one after it within the window, in this order."""
    own, ahead, back = told
    last = len(words) - 1
    return [
        [*own[w], *(ahead[words[i - 1]] if i else ()), *(back[words[i + 1]] if i < last else ())] for i, w in enumerate(words)
    ]


def _choose(windows: list[tuple[list[str], np.ndarray]]) -> list[str]:
    """Features, of either sign, whose presence tells of the tag by the likelihood-ratio test over all tokens of the windows."""
    # how often each word stands at, before and after a place of either tag
    stands = {side: defaultdict(lambda: [0, 0]) for side in ("", "<", ">")}
    for words, tag in windows:
        tags = tag.tolist()
        for side, some, at in (("", words, tags), ("<", words, tags[1:]), (">", words[1:], tags)):
            for w, t in zip(some, at, strict=False):
                stands[side][w][t] += 1
    counts = (Counter(), Counter())
    for side, seen in stands.items():
        for kind, told in _by_kind(seen):
            if side and kind not in BESIDE:
                continue
            here: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for word, f in told:
                both = here[f]
                both[0] += seen[word][0]
                both[1] += seen[word][1]
            for f, both in here.items():
                if sum(both) >= SEEN:
                    for t in (0, 1):
                        counts[t][f"{side}{kind}{f}"] = both[t]
    size = np.array([sum(len(t) - int(t.sum()) for _, t in windows), sum(int(t.sum()) for _, t in windows)], float)
    names = sorted(counts[0])
    if not names or not size.all():
        return []
    seen = np.array([[counts[0][f], counts[1][f]] for f in names], float)
    both = np.concatenate([seen, size - seen], axis=1)
    expect = np.concatenate([part.sum(axis=1, keepdims=True) * size / size.sum() for part in (seen, size - seen)], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * np.where(both > 0, both * np.log(both / expect), 0.0).sum(axis=1)
    best = np.argsort(-ratio, kind="stable")[:MOST]
    return [names[i] for i in best if ratio[i] >= RATIO]


def train_tags(documents: list[list[str]], labels: list[np.ndarray], found: set[str], rounds: int = 60, rate: float = 0.5) -> Crf:
    """Weights by gradient ascent on the conditional log-likelihood of the tags over the windows. The features are fixed
    beforehand, those of clean words among them, so a round is a few array operations."""
    windows = list(_windows(documents, labels, found))
    vocabulary = {f: i for i, f in enumerate(_choose(windows))}
    if not vocabulary:
        return Crf()
    told = [
        _Memory(lambda w, tell=tell: [vocabulary[f] for f in tell(w) if f in vocabulary])
        for tell in (features, lambda w: beside(w)[0], lambda w: beside(w)[1])
    ]
    ids = [at for words, _ in windows for at in _places_of(words, told)]
    y = np.concatenate([t for _, t in windows]).astype(np.float64)
    lengths = np.array([len(t) for _, t in windows], np.int64)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    col = np.array([c for x in ids for c in x], np.int64)
    inner = np.ones(len(y), bool)
    inner[starts[lengths > 0]] = False
    after = np.flatnonzero(inner)
    w, bias, trans = np.zeros(len(vocabulary)), -3.0, np.zeros((2, 2))
    y0, y1 = y[after - 1], y[after]
    seen = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
    grown = np.zeros(len(vocabulary)), np.zeros(1), np.zeros((2, 2))
    for _ in range(rounds):
        score = bias + np.bincount(row, w[col], len(y))
        unary, pot = np.exp(np.clip(score, -30, 30)), np.exp(trans)
        odds = chain_odds(unary, starts, lengths, pot, 1.0)
        p = odds / (1 + odds)
        expect = _pairs(unary, starts, lengths, pot, after, p)
        miss = y - p
        steps = (np.bincount(col, miss[row], len(vocabulary)) - 0.1 * w, np.array([miss.sum()]), seen - expect - 0.1 * trans)
        for g, s in zip(grown, steps, strict=True):
            g += s * s
        w = w + rate * steps[0] / np.sqrt(grown[0] + 1e-9)
        bias = bias + rate * float(steps[1][0] / np.sqrt(grown[1][0] + 1e-9))
        trans = trans + rate * steps[2] / np.sqrt(grown[2] + 1e-9)
    return Crf({f: float(w[i]) for f, i in vocabulary.items()}, float(bias), trans)


def _pairs(unary, starts, lengths, pot, after, p) -> np.ndarray:
    """Expected tag pairs of neighbouring places from the marginals: the forward ratio at a place and the backward one at the
    next are what is left of the marginal odds when the place itself is divided out."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    running = np.searchsorted(-n, -np.arange(int(n[0])), "left")
    forward, ratio = np.empty(len(unary)), np.ones(len(n))
    for t in range(int(n[0])):
        at = s[: running[t]] + t
        before = ratio[: running[t]]
        if t:
            before = (pot[0, 1] + pot[1, 1] * before) / (pot[0, 0] + pot[1, 0] * before)
        ratio[: running[t]] = forward[at] = unary[at] * before
    back = p / np.maximum(1 - p, 1e-300) / np.maximum(forward, 1e-300)
    f, x = forward[after - 1], unary[after] * back[after]
    cells = np.stack([pot[0, 0] * np.ones_like(f), pot[0, 1] * x, pot[1, 0] * f, pot[1, 1] * f * x])
    cells /= cells.sum(axis=0)
    return cells.sum(axis=1).reshape(2, 2)


def fit(texts: list[str], toxic: np.ndarray, folds: np.ndarray) -> Crf:
    """Tags are learnt on folds below ``TAG_TENTHS``, the document score on the others (on all if one side is empty).

    The first tags are those of telling features; the field then tags the toxic documents itself, by all its features, and
    learns again from its own tags. Clean documents hold no toxic tag throughout.
    """
    toxic = np.asarray(toxic, np.int64)
    if not len(texts) or not toxic.any():
        return Crf()
    tag = folds < TAG_TENTHS
    if not toxic[tag].any() or not (1 - toxic[tag]).any():
        tag = np.ones(len(texts), bool)
    words: dict[str, str] = {}
    documents = [[words.setdefault(w, w) for w in TOKEN.findall(t)] for t in texts]  # equal words are one object
    taught = [d for d, k in zip(documents, tag, strict=True) if k]
    labels, found = label_tokens(taught, toxic[tag])
    model = train_tags(taught, labels, found)
    for _ in range(ANEW):
        p, lengths = marginals(model, taught, Emissions(model))
        cuts = np.cumsum(lengths)[:-1]
        labels = [(part >= 0.5).astype(np.int8) * np.int8(t) for part, t in zip(np.split(p, cuts), toxic[tag], strict=True)]
        model = train_tags(taught, labels, found)
    rest = ~tag if len(set(toxic[~tag])) == 2 else np.ones(len(texts), bool)
    if len(set(toxic[rest])) == 2:
        p, lengths = marginals(model, [d for d, k in zip(documents, rest, strict=True) if k], Emissions(model))
        model.doc = _logistic(summaries(p, lengths), toxic[rest].astype(float))
    return model


def held_out(doc_id: Column) -> Column:
    """The documents no label may be learnt from: crc32 of the id's text leaves 0 modulo 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """A model of ``labels.toxic`` from at most ``sample`` documents of each class, by a hash of their id, never held-out ones.

    The sample, at most ``LEARNT`` characters of each document, is all that comes to the driver. Null labels and labels
    without a document are left out; of differing labels of one document or one text the larger counts, of differing texts
    of one document the smallest.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    free = known.where(~held_out(F.col("doc_id"))).withColumn("_hash", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["count"] for r in free.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    chosen = []
    for c in (0, 1):
        # twice the sample lies below this bound of the hash, so that tasks hand on few rows
        among = min(1.0, (2 * sample + 100) / max(1, sizes.get(c, 0)))
        near = free.where((F.col("toxic") == c) & (F.pmod("_hash", F.lit(1 << 30)) <= int(among * (1 << 30))))
        chosen.append(near.orderBy(F.pmod("_hash", F.lit(1 << 30)), "doc_id").limit(sample))
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice ``sample`` rows of three numbers
    start = F.substring(F.coalesce("text", F.lit("")), 1, LEARNT)
    texts = docs.select("doc_id", start.alias("text")).join(picked, "doc_id")
    single = texts.groupBy("doc_id", "toxic", F.pmod("_hash", F.lit(10)).alias("fold")).agg(F.min("text").alias("text"))
    once = single.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold"))
    rows = once.toPandas().sort_values("text")
    return fit(rows.text.tolist(), rows.toxic.to_numpy(), rows.fold.to_numpy())


VERDICT = "score double, predicted int, spans string, n_toxic int"


def judge(model: Crf, text: Column) -> Column:
    """Struct of score (0 to 1), predicted (1 from 0.5 on), offending spans as start:end code points, comma-joined, and their
    number of tokens. Null text counts as empty; an empty text gets the score of no toxic token."""

    @F.pandas_udf(VERDICT)
    def tag(texts: pd.Series) -> pd.DataFrame:
        memory = Emissions(model)
        whole = texts.fillna("").tolist()
        ends = np.cumsum([len(t) for t in whole]) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(whole)]
        return pd.concat([_tag(model, whole[i:j], memory) for i, j in zip(cuts, cuts[1:], strict=False)], ignore_index=True)

    return tag(text)


def _tag(model: Crf, texts: list[str], memory: Emissions) -> pd.DataFrame:
    p, lengths = marginals(model, map(TOKEN.findall, texts), memory)
    score = 1 / (1 + np.exp(-np.clip(summaries(p, lengths) @ model.doc, -30, 30)))
    spans, hits, at = [], [], 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        toxic = np.flatnonzero(p[at : at + n] >= 0.5)
        at += n
        hits.append(len(toxic))
        spans.append(_spans(text, toxic) if len(toxic) else "")
    return pd.DataFrame(
        {"score": score, "predicted": (score >= 0.5).astype("int32"), "spans": spans, "n_toxic": np.array(hits, "int32")}
    )


def _spans(text: str, toxic: np.ndarray) -> str:
    """Neighbouring toxic tokens are one span."""
    places = [m.span() for m in TOKEN.finditer(text)]
    runs = np.split(toxic, np.flatnonzero(np.diff(toxic) > 1) + 1)
    return ",".join(f"{places[r[0]][0]}:{places[r[-1]][1]}" for r in runs)


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """Every document (doc_id, text) with held_out, score, predicted, spans, n_toxic.

    Texts are read whole and in place; nothing is shuffled. Other columns are left out, so their names cannot clash. Repeated
    rows stay. No rows: no rows.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judge(model, F.col("text")).alias("_v"))
    return rows.select("doc_id", "held_out", "_v.*")


def keep_clean(docs: DataFrame, model: Crf) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), judge(model, F.col("text")).alias("_v"))
    return rows.where("_v.predicted = 0").select("row.*")
