"""Personal data: high-recall generators propose spans, boosted trees judge them, calibrated thresholds select."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.boosting import Boosted, bins, edges, train, with_margins
from exposure.session import store

KINDS = ("email", "ip", "card", "phone")
# Margins that calibrate are counted in steps of this, so that their counts stay small whatever the number of candidates.
STEP = 1 / 256
# A candidate outside the base patterns is added if its calibrated probability reaches the lowest value at which this share
# of the calibration candidates above it is right, and never below LEAST.
PRECISION, LEAST = 0.98, 0.9
# Texts without these characters hold neither a base span nor a candidate.
MAY_HOLD = r"[0-9@]|[\[(]\s?at\s?[\])]"

# ---- base patterns, as the contract of this operator fixes them; written so that no text takes more than linear time ----

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: the local part is the whole run of its characters before an @."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(done, at + 1))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ip_ok(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in span.split("."))


def _card_ok(span: str) -> bool:
    digits = span.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(span: str) -> bool:
    return 9 <= len(_DIGIT.findall(span)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start; offsets in code points, end exclusive."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern, holds in (("ip", _IP, _ip_ok), ("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok)):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if holds(m.group())]
    return found


# ---- candidates: wide patterns that may overlap one another and the base spans ----

_WIDE = (
    ("email", re.compile(r"[^\s@<>\"',;:()\[\]]{1,64}\s?(?:@|[\[(]\s?at\s?[\])])\s?[^\s@<>\"',;:()\[\]]{2,255}")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:[.:-]|\[\.\])[0-9]{1,4}){3,7}+")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,23}+")),
    ("phone", re.compile(r"(?<![0-9(])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,15}+")),
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern in _WIDE for m in pattern.finditer(text)]


def _beside(text: str, at: int) -> int:
    """Class of a neighbouring character: 0 none or space, 1 letter, 2 digit, 3 quote or sign of a value, 4 other."""
    if not 0 <= at < len(text) or text[at].isspace():
        return 0
    c = text[at]
    return 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\"'=:/_" else 4


_AT = re.compile(r"\s?(?:@|[\[(]\s?at\s?[\])])\s?")
_BREAK = re.compile(r"[ ().:/\[\]-]+")


def _plain(span: str, kind: str) -> str:
    """The span in one spelling: any at sign as @, any separators between digits as one full stop."""
    return _AT.sub("@", span) if kind == "email" else _BREAK.sub(".", span).strip(".")


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate: the lengths of its parts, whether its numbers can be of the kind, and what stands beside it.
    The spelling - plus sign, separators, at sign - is left out, so a span looks alike in every spelling."""
    span = _plain(text[start:end], kind)
    numbers = re.findall(r"[0-9]+", span)
    groups = [len(g) for g in numbers]
    letters = sum(c.isalpha() for c in span)
    left = start
    while left > 0 and start - left < 24 and text[left - 1] == "+":
        left -= 1
    before = text[max(0, left - 24) : left].split()
    word = before[-1] if before else ""
    digits = "".join(numbers)
    name, _, domain = span.partition("@")
    return [
        *[float(kind == k) for k in KINDS],
        float(len(span)), float(sum(groups)), float(letters), float(len(groups)),
        float(max(groups, default=0)), float(min(groups, default=0)),
        float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        float(groups[1] if len(groups) > 1 else 0), float(groups[2] if len(groups) > 2 else 0),
        float(span.count(".")), float(span.count("-")), float(len(set(span))), float(sum(c.isupper() for c in span)),
        float(_beside(text, left - 1)), float(_beside(text, end)), float(_beside(text, end + 1)),
        float(len(word)), float(word[-1:] in ("=", ":", "#", "(")), float(any(c.isdigit() for c in word)),
        float(groups[3] if len(groups) > 3 else 0), float(13 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and _ip_ok(".".join(numbers))), float(len(name)), float(name.isdigit()), float(_DOMAIN.fullmatch(domain) is not None),
    ]


def is_right(kind: str, start: int, end: int, base: dict[str, list[tuple[int, int]]]) -> bool:
    """Whether the candidate is a base span of its kind, apart from a few characters. Spans of a kind are sorted."""
    own = base.get(kind, [])
    i = max(0, bisect_right(own, (start, start)) - 1)
    while i < len(own) and own[i][0] < end:
        s, e = own[i]
        if min(end, e) - max(start, s) >= 0.8 * max(end - start, e - s):
            return True
        i += 1
    return False


def label(text: str, kind: str, start: int, end: int, base: dict[str, list[tuple[int, int]]]) -> int | None:
    """1: a base span of its kind, or one in another spelling; 0: neither; None: not told, so not learned from.

    Numbers in groups without a plus may be phones, four parts between dashes or colons may be an address, and a spaced at sign
    may stand in a mail address; such candidates are left to what the rewritten spans teach.
    """
    if is_right(kind, start, end, base):
        return 1
    raw = text[start:end]
    span = _plain(raw, kind)
    if any(is_right(other, start, end, base) for other in KINDS if other != kind):
        return 0
    if kind == "email":
        name, _, domain = span.partition("@")
        whole = bool(name) and set(name) <= _LOCAL and _DOMAIN.fullmatch(domain) is not None
        return int(whole) if not whole or "[" in raw or "(" in raw else None
    groups = span.split(".")
    if kind == "ip":
        holds = len(groups) == 4 and _ip_ok(span)
        return int(holds) if not holds or "[" in raw else None
    if kind == "card":
        return int(_card_ok("".join(groups)))
    return None if len(groups) > 2 and 9 <= len("".join(groups)) <= 15 and len(groups[0]) < 4 else 0


def respelled(kind: str, span: str, turn: int) -> str:
    """A base span in a spelling that the base patterns do not know."""
    if kind == "email":
        name, _, domain = span.partition("@")
        if turn & 4:  # people differ in digits and in the length of their domain, whatever the corpus prefers
            name = re.sub("[0-9]+", "", name).strip(".") or name
        if turn & 8 and domain.count(".") > 1:
            domain = domain.partition(".")[2]
        return name + (" [at] ", "(at)", " (at) ", "[at]")[turn % 4] + domain
    groups = re.findall(r"[0-9]+", span)
    if kind == "ip":
        return ("-", "[.]")[turn % 2].join(groups)
    if kind == "card":
        digits = "".join(groups)
        return ("/", ".")[turn % 2].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if turn & 4 and len("".join(groups[1:])) >= 9:  # without the country
        groups, span = groups[1:], f" ({groups[1]}) " + "-".join(groups[2:])
    return (span[1:], "-".join(groups), ".".join(groups), " ".join(groups))[turn % 4]


def decoy(kind: str, span: str, turn: int) -> str:
    """Something that looks like the kind and is none: a handle or an hour, a version or a chapter, a number whose check digit
    is wrong, a date or the number of an order. The digits are those of the span."""
    digits = "".join(_DIGIT.findall(span)) or "0"
    n = int(digits[-9:]) + turn
    if kind == "email":
        name, _, domain = span.partition("@")
        return (f"{name}@{domain.replace('.', '')}", f"{1 + n % 12} [at] {n % 60:02d}h", f"{name} (at) {domain.replace('.', ' ')}")[turn % 3]
    if kind == "ip":
        parts = span.split(".")
        if turn % 4 == 3:  # numbered chapters
            return "-".join(str(1 + int(d)) for d in (digits * 4)[:4])
        parts[turn % 4] = str(256 + n % 9000)
        return (".", "-", "[.]")[turn // 4 % 3].join(parts)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + turn % 9) % 10)
        return ("/", ".", "-", "")[turn % 4].join(wrong[i : i + 4] for i in range(0, len(wrong), 4))
    year, month, day = 1990 + n % 45, 1 + n // 7 % 12, 1 + n // 91 % 28
    return (
        f"{year}-{month:02d}-{day:02d} {n % 24:02d}", f"{year}/{month:02d}/{day:02d}-{n % 10000:04d}", f"{day:02d}.{month:02d}.{year}",
        digits[-11:], f"{n % 10000:04d}-{year}-{n // 7 % 100000:05d}", f"{month}.{day}.{n % 100000}.{turn % 10}",
    )[turn % 6]


# Characters kept on both sides of a rewritten span; no feature looks further.
AROUND = 40


def lessons(text: str) -> list[tuple[int, int, list[float]]]:
    """Labelled candidates (hash, 0 or 1, features) of a text.

    They are its own candidates, and those of its base spans written in another spelling (right) and replaced by a decoy (wrong),
    one of each in its place. Candidates of another kind that meet a rewritten span are wrong. Equal surroundings, equal hash.
    """
    base = base_spans(text)
    known = by_kind(base)
    out = []

    def add(window: str, kind: str, s: int, e: int, right: int) -> None:
        seen = window[max(0, s - 8) : e + 8] + kind
        mark = int.from_bytes(hashlib.md5(seen.encode("utf-8", "replace")).digest()[:7], "little")
        out.append((mark, right, describe(window, kind, s, e)))

    for kind, s, e in candidates(text):
        right = label(text, kind, s, e, known)
        if right is not None:
            add(text, kind, s, e, right)
    for kind, s, e in base:
        if e - s > 64:
            continue
        turn = hashlib.md5(text[max(0, s - 8) : e].encode("utf-8", "replace")).digest()[0]
        left, right = text[max(0, s - AROUND) : s], text[e : e + AROUND]
        for written, holds in ((respelled(kind, text[s:e], turn), True), (decoy(kind, text[s:e], turn), False)):
            window, end = left + written + right, len(left) + len(written)
            place = {kind: [(len(left), end)]}
            for other, a, b in candidates(window):
                if a < end and b > len(left):
                    add(window, other, a, b, int(holds and is_right(other, a, b, place)))
    return out


def by_kind(spans: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {}
    for kind, s, e in spans:
        found.setdefault(kind, []).append((s, e))
    return found


@dataclass
class Judge:
    trees: Boosted | None = None
    # calibration: logistic in the margin of the trees, and the threshold of each kind (above 1: nothing is added)
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (2.0, 2.0, 2.0, 2.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -30, 30)))


def calibrated(trees: Boosted, kind: np.ndarray, margin: np.ndarray, n: np.ndarray, right: np.ndarray) -> Judge:
    """Calibration and thresholds from counts: of a kind and a margin, how many candidates there are and how many are right.
    A margin stands for those within half a step."""
    judge = Judge(trees)
    a, b = 1.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, miss = n * p * (1 - p) + 1e-9, right - n * p
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(margin * miss).sum() - 1e-3 * (a - 1), miss.sum() - 1e-3 * b])
        a, b = a + step[0], b + step[1]
    judge.slope, judge.shift = float(max(a, 0.05)), float(b)
    found = []
    for i in range(len(KINDS)):
        own = np.flatnonzero(kind == i)
        own = own[np.argsort(-margin[own], kind="stable")]
        precise = np.flatnonzero(np.cumsum(right[own]) / np.cumsum(n[own]) >= PRECISION)
        lowest = judge.slope * (margin[own[precise[-1]]] - STEP / 2) + judge.shift if len(precise) else 0.0
        found.append(max(LEAST, float(1 / (1 + np.exp(-np.clip(lowest, -30, 30))))) if len(precise) else 2.0)
    judge.thresholds = tuple(found)
    return judge


def find(text: str, judge: Judge) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the candidates the method adds: likely enough, and clear of base spans and of likelier candidates."""
    base = base_spans(text)
    if judge.trees is None:
        return base, []
    taken = bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    proposed = [c for c in candidates(text) if taken.find(1, c[1], c[2]) < 0]
    if not proposed:
        return base, []
    p = judge.probability(np.array([describe(text, *c) for c in proposed]))
    added: list[tuple[str, int, int]] = []
    for i in np.argsort(-p, kind="stable"):
        kind, s, e = proposed[i]
        if p[i] >= judge.thresholds[KINDS.index(kind)] and taken.find(1, s, e) < 0:
            taken[s:e] = b"\1" * (e - s)
            added.append(proposed[i])
    return base, added


def in_order(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes the kind of its first one in brackets."""
    out, done, open_kind, open_end = [], 0, None, 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if open_kind and s < open_end:
            open_end = max(open_end, e)
            continue
        if open_kind:
            out.append(f"[{open_kind.upper()}]")
            done = open_end
        out.append(text[done:s])
        open_kind, open_end = kind, e
    if open_kind:
        out.append(f"[{open_kind.upper()}]")
        done = open_end
    return "".join([*out, text[done:]])


def _asked(text: Column) -> Column:
    """The text if it may hold anything; others need not leave the JVM."""
    return F.when(text.rlike(MAY_HOLD), text)


def learn(docs: DataFrame) -> Judge:
    """A judge from all labelled candidates (:func:`lessons`) of all documents: trees from folds 0 to 6 of their texts, calibration
    and thresholds from 7 to 9. Without both labels on both sides nothing is added.

    Candidates of equal surroundings count once; equal texts are on one side. Candidates stay with the tasks: the driver gets
    how often each value of a feature occurs (values are lengths and counts within a candidate, a few hundred at most), the
    histograms of the trees, and counts of right ones by step of the margin.
    """

    @F.pandas_udf("array<struct<hash:long,right:int,x:array<double>>>")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"hash": h, "right": r, "x": x} for h, r, x in lessons(t)] if t else [] for t in texts])

    asked = docs.select(_asked(F.col("text")).alias("text")).where("text IS NOT NULL")
    fold = F.pmod(F.xxhash64("text"), F.lit(10)).alias("fold")
    rows = asked.select(fold, F.explode(told("text")).alias("c")).select("fold", "c.*")
    once = rows.groupBy("hash").agg(F.min(F.struct("right", "fold", "x")).alias("c"))
    kept = store(once.select((F.col("c.fold") < 7).alias("grow"), "c.right", "c.x"), "lessons")
    sizes = {(r["grow"], r["right"]): r["count"] for r in kept.groupBy("grow", "right").count().collect()}
    if len(sizes) < 4:
        return Judge()
    seen: dict[int, list[tuple[float, int]]] = {}
    values = kept.where("grow").select(F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").count()
    for r in values.collect():
        seen.setdefault(r["feature"], []).append((r["value"], r["count"]))
    cuts = [edges(*np.array(sorted(seen[i])).T) for i in range(len(seen))]
    alike = store(_alike(kept, cuts), "alike")
    trees = train(alike.where("grow"), cuts, sizes[True, 1] / (sizes[True, 0] + sizes[True, 1]))
    judged = with_margins(alike.where("NOT grow").withColumn("margin", F.lit(trees.base)), trees.trees)
    step = F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "margin")) / STEP).cast("long").alias("step")
    counts = judged.groupBy("kind", step).agg(F.sum("n").alias("n"), F.sum("right").alias("right")).orderBy("kind", "step").collect()
    kind, at, n, right = np.array([tuple(r) for r in counts], float).T
    return calibrated(trees, kind, at * STEP, n, right)


def _alike(kept: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Candidates whose bins are all the same, as one row: side, kind, bins, how many they are and how many are right."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
                kind = pa.array(x[:, : len(KINDS)].argmax(axis=1).astype(np.int32))
                told = pa.array([row.tobytes() for row in bins(cuts, x)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("grow"), kind, told, batch.column("right")], ["grow", "kind", "bins", "right"])

    rows = kept.mapInArrow(binned, "grow boolean, kind int, bins binary, right int")
    return rows.groupBy("grow", "kind", "bins").agg(F.count("*").alias("n"), F.sum("right").alias("right"))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string"


def spans_of(judge: Judge, text: Column) -> Column:
    """Struct of base counts by kind, base spans, all spans, and the redacted text (null where nothing is redacted)."""

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, added = find(text, judge) if text else ([], [])
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            whole = base + added
            rows.append((*counts, in_order(base), in_order(whole), redact(text, whole) if whole else None))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted"])

    return scan(_asked(text))


def detect(docs: DataFrame, judge: Judge) -> DataFrame:
    """Every document (doc_id, text) with n_email, n_ip, n_card, n_phone, base, spans, redacted (text without personal data).

    Offsets are code points, end exclusive; lists are kind:start:end by kind, then start, comma-joined. Null text counts as
    empty and stays null when redacted. Texts are read whole, in place. Repeated rows stay; other columns are left out.
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), spans_of(judge, F.col("text")).alias("_s"))
    return rows.select("doc_id", *[f"_s.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")], F.coalesce("_s.redacted", "text").alias("redacted"))


def redacted(docs: DataFrame, judge: Judge) -> DataFrame:
    """The documents with personal data replaced in ``text``, and ``n_chars`` as it then is; other columns stay as they are."""
    found = docs.select(F.struct("*").alias("row"), spans_of(judge, F.col("text")).alias("_s"))
    new = F.coalesce("_s.redacted", "row.text")
    changed = {"text": new, "n_chars": F.when(F.col("_s.redacted").isNull(), F.col("row.n_chars")).otherwise(F.char_length(new).cast("long"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])
