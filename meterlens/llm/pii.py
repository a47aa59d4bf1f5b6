"""Personal data: strict patterns, and candidates that boosted trees decide on.

The base patterns find e-mail addresses, IP addresses, card and phone numbers of strict
form; what they find stays. Looser generators propose overlapping spans besides
(addresses spelled with "at" and "dot", numbers with other separators or no country
code). Boosted trees score a span by its format and its surroundings; a kind's
threshold is the least at which the training spans held back from the trees are at
least TARGET precise.

The trees learn from SAMPLE documents at most (those with the smallest hash of their
text that hold a digit, @ or +), of LEARN_CHARS characters at most; both are parameters.
Candidates that a base pattern confirms are positive, also rewritten in looser forms
where they stand (REWRITES of each kind in a text), the others negative. All texts are
searched, whatever their length; the time is in proportion to it.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bounded_batches, values

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_AT, _DOT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)", r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_LOCAL, _HOST = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED, _PART = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")
#: Repeats are bounded and an address starts where a word does, so that long runs of letters cost no more than others.
LOOSE = {
    "email": re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9_%+-]{{0,63}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,63}}){{0,6}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,6}}", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:\s?(?:\.|\[\.\])\s?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"),
    "card": re.compile(r"[0-9](?:[ ./\-]{0,2}[0-9]){11,20}"),
    "phone": re.compile(r"(?:\+|00|\()?[0-9](?:[ ()./\-]{0,2}[0-9]){6,15}"),
}
#: Common ends of host names.
TOP = set("com org net edu gov io de fr es uk us eu ch at it nl co info biz".split())
SAMPLE, LEARN_CHARS, REWRITES = 3000, 20_000, 2
TARGET, LEAST = 0.98, 0.9
DIGIT = re.compile(r"[0-9]")
WORDS = re.compile("[a-z]{2,9}")
SPELLED = re.compile(r"[\[(]\s?(?:at|dot)\s?[\])]|\s(?:at|dot)\s[^.]{1,60}\sdot\s", re.I)
# Words that announce personal data, and words that announce other numbers.
NEAR = re.compile(r"\b(?:e-?mail|mail|contact|reach|write|phone|tel|telephone|call|mobile|fax|ip|address|host|server|card|visa|mastercard|amex|credit|payment)\b", re.I)
OTHER = re.compile(r"\b(?:version|license|licence|isbn|id|sha|token|password|key|page|chapter|section|figure|no|build|release|v)\b|=", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @: the pattern itself would try every letter of a long run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at - _LOCAL.match(text[done:at][::-1]).end()
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the IP pattern: each four parts in turn of numbers joined by dots."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") >= 3:
            parts = [m.span() for m in _PART.finditer(text, *chain.span())]
            for k in range(3, len(parts), 4):
                yield parts[k - 3][0], parts[k][1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: the leftmost matches of BASE that do not overlap, those that fail dropped."""
    if not text or not (DIGIT.search(text) or "@" in text):
        return []
    found = {"email": _emails(text) if "@" in text else (), "ip": _addresses(text) if "." in text else ()}
    found["card"] = (m.span() for m in BASE["card"].finditer(text))
    found["phone"] = (m.span() for m in BASE["phone"].finditer(text)) if "+" in text else ()
    return [(k, s, e) for k in KINDS for s, e in found[k] if _valid(k, text[s:e])]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans may overlap. A number may be proposed as several kinds."""
    out = []
    digits = DIGIT.search(text) is not None
    if "@" in text or SPELLED.search(text):
        out += [("email", m.start(), m.end()) for m in LOOSE["email"].finditer(text)]
    if digits:
        out += [(k, m.start(), m.end()) for k in KINDS[1:] for m in LOOSE[k].finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it; nothing that says whether a base pattern matched."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 25]
    digits = re.sub("[^0-9]", "", span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    parts = [int(g) for g in re.findall("[0-9]{1,9}", span)] or [0]
    letters = sum(map(str.isalpha, span))
    tail = re.split(r"[^A-Za-z0-9-]+", span.strip())[-1]
    last = before[-1:] or " "
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), max(groups), min(groups), groups[-1], letters, span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count("["), float(span[:1] == "+" or span[:2] == "00"), float("@" in span), float(bool(re.search(_AT, span, re.I))),
        float(bool(re.search(r"\Wdot\W", span, re.I))), float(len(tail) if tail.isalpha() else 0), float(tail.lower() in TOP), float(luhn(digits)) if len(digits) > 9 else 0.0, float(max(parts) <= 255), float(digits[:1] in ("3", "4", "5", "6")), len(set(digits)), float(last.isalnum() or last in "./-_=#:"), float((after[:1] or " ").isalnum() or after[:1] in "/-_=:@"),
        float(bool(NEAR.search(before))), float(bool(OTHER.search(before))), float(after[:1] == "." and after[1:2].isdigit()),
    ]


def _loosened(kind: str, found: str, rng: random.Random) -> str:
    """The same data in a form that the base patterns miss."""
    if kind == "email":
        if rng.random() < 0.6:  # another address, so that trees do not learn this corpus's names
            name = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(a, b)))
            found = name(3, 9) + rng.choice(("", "." + name(3, 8), "_" + name(2, 6), str(rng.randint(1, 999)))) + "@" + name(3, 10) + rng.choice(("", "." + name(2, 6))) + "." + rng.choice(("com", "org", "net", "de", "fr", "io", "edu", "co.uk"))
        at, dot = rng.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("[at]", ".")))
        return found.replace("@", at).replace(".", dot)
    if kind == "ip":
        return found.replace(".", rng.choice(("[.]", " . ", ". ")))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return rng.choice((".", "/", "  ", " - ")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:]
    return rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00{} {} {}", "{} {} {}", "{}/{}-{}")).format(own[:3], own[3:6], own[6:])


def learn(texts: list[str]) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and each kind's threshold. Without texts that hold personal data, none is passed."""
    rng, x, y, kinds = random.Random(7), [], [], []

    def take(text: str, of: set[str] | None = None, near: tuple[int, int] | None = None) -> None:
        known = base_spans(text)
        for kind, start, end in candidates(text):
            inside = [k for k, s, e in known if s < end and start < e]
            hit = any(k == kind for k in inside) if near is None else kind in of and start < near[1] and near[0] < end
            if near is not None and not (start < near[1] and near[0] < end):
                continue
            x.append(features(text, kind, start, end))
            y.append(float(hit))
            kinds.append(kind)

    for text in texts:
        take(text)
        base = base_spans(text)
        for own in KINDS:
            spans = [x for x in base if x[0] == own]
            for kind, start, end in spans if len(spans) <= REWRITES else rng.sample(spans, REWRITES):
                other = _loosened(kind, text[start:end], rng)
                take(text[:start] + other + text[end:], {kind}, (start, start + len(other)))
        words = [m.span() for m in WORDS.finditer(text)]
        if len(words) > 9 and rng.random() < 0.3:  # the same words in prose
            (a, b, c), at = (text[slice(*w)] for w in rng.sample(words, 3)), rng.choice(words)[1]
            plain = f" {a} at {b} dot {c} "
            take(text[:at] + plain + text[at:], set(), (at, at + len(plain)))
    if not any(y):
        return BoostedTrees(), dict.fromkeys(KINDS, 2.0)
    x, y, kinds = np.array(x), np.array(y), np.array(kinds)
    back = np.random.default_rng(3).random(len(y)) < 0.3
    trees = BoostedTrees().fit(x[~back], y[~back])
    score = trees.score(x[back])  # rows that these trees have not seen
    limits = {}
    for kind in KINDS:
        own = kinds[back] == kind
        order = np.argsort(-score[own], kind="stable")
        precise = np.cumsum(y[back][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(precise >= TARGET)
        limits[kind] = max(LEAST, float(score[own][order][good[-1]])) if len(good) else 2.0
    return trees, limits


class _Taken:
    """Spans that do not overlap."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def all_spans(text: str, base: list[tuple[str, int, int]], trees: BoostedTrees, limits: dict[str, float]) -> list[tuple[str, int, int]]:
    """The base spans and, of the candidates that overlap none of them, the best ones over their kind's threshold."""
    found = candidates(text)
    taken = _Taken([(s, e) for _, s, e in base]) if found else None
    free = [c for c in found if not taken.meets(c[1], c[2])]
    if free:
        score = np.concatenate([trees.score(np.array([features(text, *c) for c in free[k : k + 5000]])) for k in range(0, len(free), 5000)])
        out = list(base)
        for i in sorted(range(len(free)), key=lambda i: (-score[i], free[i])):
            if score[i] >= limits[free[i][0]] and not taken.meets(*free[i][1:]):
                out.append(free[i])
                taken.add(*free[i][1:])
        return sorted(out, key=lambda c: (KINDS.index(c[0]), c[1]))
    return base


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, from the left, as its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda c: (c[1], -c[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def _find(trees: BoostedTrees, limits: dict[str, float], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in values(batch.column(1)):
                text = text or ""
                base = base_spans(text)
                spans = all_spans(text, base, trees, limits)
                joined = [",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in (base, spans)]
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], len(spans), redacted(text, spans) if with_text else None))
            columns = list(zip(*rows)) or [[]] * 8
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.int64())]
            names = ["doc", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]
            if with_text:
                arrays, names = [*arrays, pa.array(columns[7], pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, with_text: bool = False, learn_chars: int = LEARN_CHARS) -> DataFrame:
    """One row per document: id, counts of base spans by kind, base_sha256, spans (kind:start:end), n_spans, and with_text: redacted.

    sample, learn_chars: the trees learn from so many texts at most, of so many characters at most.

    Null and empty texts have no spans. Null ids stay null, repeated rows repeat; an
    empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    with_hash = own.filter(F.col("text").rlike("[0-9@+]") & (F.length("text") <= learn_chars)).select(F.xxhash64("text").alias("h"), "text")
    last = with_hash.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = with_hash.filter(F.col("h") <= F.lit(last)).select("text").distinct().orderBy("text")  # texts to learn from
    trees, limits = learn([r["text"] for r in some.toLocalIterator()])
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + ", redacted string" * with_text
    return own.mapInArrow(_find(trees, limits, with_text), fields).withColumnRenamed("doc", id_col)
