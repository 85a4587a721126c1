"""Traces of scanning in pages and chunks: found, named and repaired into continuous paragraphs.

Lines are labelled as header, body or break by a hidden Markov model whose emissions are a linear conditional model over
layout features (place on the page, length, likeness to the file's title, journal and authors, page-number
forms, case, blank neighbours). It learns from the insides of a bounded sample of pages, into which headers, page
numbers, title blocks and number tables were put, and then from its own labels of that sample. Viterbi decoding
alone decides what is a header. Header lines are taken out. Words split over line ends and misread characters of
the remaining lines can't be told by line labels: the corpus's own words decide them.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.sources.tables import stage

HEADER, BODY, BREAK = 0, 1, 2
STATES = ("header", "body", "break")

# Hyphens at a line end, and how scans misread characters (what is read: what stood there).
HYPHENS = "-‐¬­"
MISREAD = {
    "€": ["e"], "!": ["i"], "(": ["c"], "0": ["o"], "1": ["l", "i"], "5": ["s"], "6": ["b"], "|": ["l", "i"], "$": ["s"], "8": ["b"],
    "o": ["a"], "c": ["e"], "l": ["i"], "f": ["t"], "b": ["h"], "q": ["g"], "v": ["y"], "e": ["c"], "a": ["o"], "i": ["l"], "t": ["f"], "h": ["b", "li"], "g": ["q"], "y": ["v"],
    "cl": ["d"], "ri": ["n"], "rn": ["m"], "ii": ["u"], "m": ["in", "rn"], "d": ["cl"], "vv": ["w"], "n": ["ri"], "u": ["ii"], "li": ["h"], "in": ["m"],
}

_NUMBER = r"(?:[0-9OoIlSBi]*[0-9][0-9OoIlSB]*|[ivxlc]{1,8})"
_PAGE = re.compile(rf"[-–—·•\[(]?\s*(?:(?:p|P|S|pp|pg|s)\.|Page|page|PAGE|Seite|Pagina|P[aá]g\.)?\s*({_NUMBER})(?:\s*(?:/|of|von|de)\s*({_NUMBER}))?\s*[-–—·•\])]?")
_DECORATED = re.compile(r"^[-–—·•\[(]|^(?:p|P|S|pp|pg|s)\.|^(?:Page|page|PAGE|Seite|Pagina|P[aá]g)\b|[/]|\bof\b")
_PARTS = re.compile(r"\s{3,}|\t+|\s+\|\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: A number with a letter in the place of a digit; codes of two capitals and four digits likewise.
_BAD_NUMBER = re.compile(r"(?:[A-Z]{2}-)?(?=[0-9.,OoIlSB]*[0-9])(?=[0-9.,]*[OoIlSB])[0-9OoIlSB]+(?:[.,][0-9OoIlSB]+)?")
#: A digit or sign that stands for a letter inside a word in small letters.
_BAD_WORD = re.compile(r"(?:[^\W\d_]*[a-zäöüßéè])?[€!|$](?=[a-z])[^\s]*|[^\W\d_]*[a-z][€](?![a-z])|[^\W\d_]*[a-z][0156(](?=[a-z])[^\s]*|[0156][a-z]{3,}|[A-Z]?[a-z]{3,}[0156]|[A-Z][0156](?=[a-z]{2})[^\s]*")


@dataclass(frozen=True)
class ScanParams:
    """sample_rows bounds the records that the line model is fitted on. frequent_words bounds the list of frequent sound words that
    is sent to the tasks; other words are joined. All shares below are of the corpus, so that they mean
    the same at every size: rare_share, the texts that may hold a word judged by its letter groups; usual_gram and
    rare_gram, the weight of a letter group; usual_word, the texts that hold a word known by itself. short_ratio: how
    much more often the right word must stand for words under four letters."""

    sample_rows: int = 2_000
    own_rounds: int = 1
    penalty: float = 1e-6
    frequent_words: int = 20_000
    ratio: int = 8
    short_ratio: int = 400
    usual_gram: float = 2e-4
    rare_gram: float = 1.5e-5
    rare_share: float = 0.0002
    usual_word: float = 0.001
    seed: int = 5


def page_number(part: str) -> int | None:
    """The printed page number that a part of a line consists of; 0 for a Roman one; None if it is none."""
    m = _PAGE.fullmatch(part.strip())
    if not m:
        return None
    n = m.group(1)
    if n.isalpha() and n == n.lower() and not any(ch in "oIlSB" for ch in n if ch not in "ivxlc"):
        return 0 if re.fullmatch(r"c?(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", n) and n else None
    return int("".join({"O": "0", "o": "0", "I": "1", "l": "1", "i": "1", "S": "5", "B": "8"}.get(ch, ch) for ch in n)[:9])


def _grams(text: str) -> set[str]:
    t = "".join(ch for ch in text.lower() if ch.isalpha())
    return {t[i : i + 3] for i in range(len(t) - 2)}


class _File:
    """What is known of the record's file: grams of title, journal and authors."""

    def __init__(self, title, journal, authors):
        names = [a for a in authors or [] if a]
        known = [("title", title), ("journal", journal)] + [("names", f"{a} et al") for a in names[:1]] + ([("names", " ".join(names)), ("names", " ".join(names[:2]))] if names else [])
        self.texts = [(kind, g) for kind, x in known if x and (g := _grams(x))]

    def likeness(self, text: str) -> tuple[float, str]:
        """How much of a text is one of these, and which of them."""
        g = _grams(text)
        if len(g) < 4:
            return 0.0, "none"
        return max(((len(g & t) / max(len(g), 0.8 * len(t)), kind) for kind, t in self.texts), default=(0.0, "none"))


@functools.lru_cache(maxsize=4_096)
def _file(title, journal, authors) -> _File:
    return _File(title, journal, authors)


_ET_AL = re.compile(r"(?:[^\W\d_]\.[\s-]?)+\S+ et a[l1I]\.?")
_HEADING = re.compile(r"\d{1,2}(?:\.\d{1,2})*\.?\s+[^\W\d_]+(?:\s[^\W\d_]+){0,4}")
_JOURNAL_END = re.compile(r"(?:,\s*Vol\.|\s)\s*[0-9OoIlSB]{1,3}(?:,\s*No\.\s*[0-9OoIlSB]{1,2}|\s*\([0-9OoIlSB]{4}\))\s*$")
_FIGURES = re.compile(r"\d+(?:\.\d+)?")
_LETTER = re.compile(r"[^\W\d_]")

#: A header stands at the head or foot of its page, among the outermost three lines; lines further in are inside.
OUTER = 3
INSIDE = ("page inside",)
_NAMES = ("place", "form", "like", "volume", "block", "figures", "letters", "size", "around", "stop", "lower", "after figures", "heading", "semicolon", "like what")
_TOGETHER = [(0, 1), (0, 2), (0, 3), (2, 3), (1, 5), (1, 11), (2, 4), (4, 13), (2, 7), (2, 9), (1, 6), (3, 6), (2, 12), (5, 6), (1, 12), (3, 12), (4, 14), (2, 14), (0, 14)]


def line_features(lines: list[str], known: _File, paged: bool, first_page: bool, offset_fits) -> list[tuple | None]:
    """The features of each line, as named in _NAMES; None for a blank one, INSIDE for one inside its page."""
    filled = [k for k, x in enumerate(lines) if x.strip()]
    out: list[tuple | None] = [None] * len(lines)
    if not filled:
        return out
    n = len(filled)
    usual = sorted(len(lines[k]) for k in filled)[n // 2] or 1
    for at, k in enumerate(filled):
        back = n - 1 - at
        if paged and at >= OUTER and back >= OUTER:
            out[k] = INSIDE
            continue
        x = lines[k].strip()
        place = ("page" if paged else "chunk") + (" only" if n == 1 else (f" head {at}" if at <= back else f" foot {back}") if paged else "")
        parts = [p for p in _PARTS.split(x) if p.strip()]
        numbers = [page_number(p) for p in parts]
        form = "none"
        for p, no in zip(parts, numbers):
            if no is not None:
                form = "decorated" if _DECORATED.search(p.strip()) else "roman" if no == 0 else "fits" if paged and offset_fits(no) else "bare"
        rest = " ".join(p for p, no in zip(parts, numbers) if no is None)
        like, what, volume = 0.0, "none", "no"
        if rest:
            short = _JOURNAL_END.sub("", rest)
            volume = "volume" if short != rest else "names" if _ET_AL.fullmatch(rest) else "no"
            like, what = known.likeness(short)
        letters = len(_LETTER.findall(x))
        figures = _FIGURES.findall(x)
        upper = sum(ch.isupper() for ch in x) / letters if letters else 0.0
        size = len(x) / usual
        before = lines[filled[at - 1]] if at else ""
        out[k] = (
            place, form if rest == "" or form == "none" else form + " and text", min(9, int(like * 10)) // 2 if like < 0.8 else 5 if like < 0.9 else 6, volume,
            "block" if first_page and paged and at < OUTER else "no", ("one" if len(figures) == 1 else "more" if figures else "none") + (" point" if "." in "".join(figures) else ""),
            "none" if not letters else "few" if letters < 3 else "upper" if upper > 0.7 and letters > 8 else "mixed", "short" if size < 0.45 else "medium" if size < 0.8 else "full" if size < 3 else "far",
            (k == 0 or not lines[k - 1].strip(), k + 1 >= len(lines) or not lines[k + 1].strip()), x[-1] in ".!?:;,", x[0].islower(),
            bool(before) and not _LETTER.search(before), bool(_HEADING.fullmatch(x)), ";" in x, what if like > 0.5 else "none",
        )
    return out


def _record_columns(batch: pa.RecordBatch):
    return zip(*[batch.column(c).to_pylist() for c in ("record_table", "record_id", "text", "page", "title", "journal", "authors", "offset")])


def _walk(batches: Iterator[pa.RecordBatch]):
    """(record columns, lines, features) of every row with text."""
    for batch in batches:
        for kind, record, text, page, title, journal, authors, offset in _record_columns(batch):
            if not text:
                continue
            lines = text.split("\n")
            fits = (lambda n, p=page, o=offset: p is not None and n - p == (o or 0))
            yield kind, record, lines, line_features(lines, _file(title, journal, tuple(authors or ())), kind == "loaded_documents", page == 1, fits)


def _printed_number(rng: random.Random, n: int) -> str:
    last = n + rng.randint(0, 60)
    return rng.choice([f"{n}", f"{n}", f"{n}", f"- {n} -", f"— {n} —", f"· {n} ·", f"[{n}]", f"({n})", f"p. {n}", f"S. {n}", f"Page {n}", f"Page {n} of {last}", f"{n} / {last}", rng.choice(["iv", "ix", "xii", "xvi"])])


def _printed_header(rng: random.Random, title, journal, authors) -> str | None:
    volume, number, year = rng.randint(1, 80), rng.randint(1, 12), rng.randint(1960, 2024)
    forms = [x for x in (title, title, journal, journal and f"{journal}, Vol. {volume}, No. {number}", journal and f"{journal} {volume} ({year})", authors and authors[0] and f"{authors[0]} et al.") if x]
    if not forms:
        return None
    t = rng.choice(forms)
    if rng.random() < 0.15:
        words = t.split(" ")
        t = " ".join(words[: max(2, len(words) - rng.randint(1, 3))])
    t = t.upper() if rng.random() < 0.25 else t
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        at = rng.randrange(len(t))
        t = t[:at] + rng.choice([k for k, v in MISREAD.items() if t[at].lower() in v] or [t[at]]) + t[at + 1 :]
    return t


def made_pages(rng: random.Random, lines: list[str], page: int | None, title, journal, authors, offset):
    """(lines, labels, whether a page, whether a first one, its page number): the inside of a page with headers, page numbers, title block or
    number rows put where they could stand; None for a page of few lines."""
    filled = [k for k, x in enumerate(lines) if x.strip()]
    if len(filled) < 2 * OUTER + 2:
        return None
    inner = lines[filled[OUTER] : filled[-OUTER - 1] + 1]
    at = rng.randrange(max(1, len(inner) - 3))
    inner = inner[at : at + rng.randint(3, 40)]
    rows = [(x, BODY if x.strip() else BREAK) for x in inner]
    while rows and rows[0][1] == BREAK:
        rows.pop(0)
    if not rows:
        return None
    paged, first = rng.random() < 0.7, rng.random() < 0.15
    figures = lambda least: "   ".join(f"{rng.uniform(1, 500):.{rng.choice([0, 1, 1, 2])}f}" for _ in range(rng.randint(least, 4)))
    if rng.random() < 0.25:
        table = [(figures(2), BODY)] + [(figures(1), BODY) for _ in range(rng.randint(1, 5))]
        where = rng.choice([0, len(rows), rng.randint(0, len(rows))])
        rows[where:where] = [("", BREAK)] * (where > 0) + table + [("", BREAK)] * (where < len(rows))
    if rng.random() < 0.2:
        words = [w for w in (title or "").split(" ") if len(w) > 5]
        name = rng.choice(["Results", "Experimental section", "Sampling", "Discussion", "Materials and methods"]) if rng.random() < 0.5 or not words else " ".join(rng.sample(words, 1) + ["of samples"] * rng.randint(0, 1)).capitalize()
        rows[0:0] = [(f"{rng.randint(1, 9)}. {name}", BODY), ("", BREAK)]
    if first and paged:
        names = [a for a in authors or [] if a]
        block = ([(title, BODY)] if title else []) + ([(rng.choice(["; ", ", "]).join(names), BODY)] if names else [])
        rows[0:0] = block + ([("", BREAK)] if block else [])
    n = max(1, (page or rng.randint(1, 400)) + (offset or 0) + (rng.randint(-40, 40) if rng.random() < 0.1 else 0))
    put = []
    text = _printed_header(rng, None if first else title, journal, authors)  # a first page has its title as title
    kind = rng.random()
    if kind < 0.3:
        put = [_printed_number(rng, n)]
    elif kind < 0.5 and text:
        put = [text]
    elif kind < 0.62 and text:
        put = [text, _printed_number(rng, n)] if rng.random() < 0.5 else [_printed_number(rng, n), text]
    elif kind < 0.75 and text:
        gap = rng.choice(["   ", "      ", "\t", " | "])
        put = [f"{n}{gap}{text}" if rng.random() < 0.5 else f"{text}{gap}{_printed_number(rng, n)}"]
    blank = [("", BREAK)] * (rng.random() < 0.7)
    extra = [(x, HEADER) for x in put]
    if extra and not paged:
        where = rng.randint(0, len(rows))
        rows[where:where] = extra + [("", BREAK)] * (rng.random() < 0.3)
    elif len(extra) == 2 and rng.random() < 0.5:
        rows = extra[:1] + blank + rows + blank + extra[1:]
    elif extra:
        rows = extra + blank + rows if rng.random() < 0.5 else rows + blank + extra
    return [x for x, _ in rows], [y for _, y in rows], paged, first, n


def _count_lines(feats: list[tuple | None], labels: list[int], counts: Counter) -> None:
    before = None
    for f, label in zip(feats, labels):
        if before is not None:
            counts[f"t|{before}|{label}"] += 1
        if f is not None and f is not INSIDE:
            counts[f"e|{label}|" + "|".join(map(str, f))] += 1
        before = label


def _made_counts(params: ScanParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, record, text, page, title, journal, authors, offset in _record_columns(batch):
                rng = random.Random(zlib.crc32(f"{params.seed}|{record}".encode()))
                for _ in range(3):
                    made = made_pages(rng, (text or "").split("\n"), page, title, journal, authors, offset)
                    if made:
                        lines, labels, paged, first, n = made
                        fits = lambda k, n=n: k == n
                        _count_lines(line_features(lines, _file(title, journal, tuple(authors or ())), paged, first, fits), labels, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    return run


def _own_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, _, _, feats in _walk(batches):
            _count_lines(feats, shared.value.labels(feats), counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    return run


def _terms(f: list[str]) -> list[str]:
    """The terms of a line in the linear model: each feature, and those that speak together."""
    return [f"{j}={v}" for j, v in enumerate(f)] + [f"{i}={f[i]}&{j}={f[j]}" for i, j in _TOGETHER]


class LineModel:
    """Transitions, and log ratios of header and body by line features; Viterbi decoding."""

    def __init__(self, steps: list[list[float]], weights: dict[str, float], bias: float, prior: float):
        self.steps, self.weights, self.bias, self.prior = steps, weights, bias, min(0.999, max(0.001, prior))
        self._seen: dict[tuple, tuple[float, float]] = {INSIDE: (-30.0, 0.0)}

    def _own(self, f: tuple) -> tuple[float, float]:
        got = self._seen.get(f)
        if got is None:
            z = self.bias + sum(self.weights.get(t, 0.0) for t in _terms([str(v) for v in f]))
            soft = math.log1p(math.exp(-abs(z)))
            got = self._seen[f] = (min(z, 0.0) - soft - math.log(self.prior), -max(z, 0.0) - soft - math.log(1 - self.prior))
        return got

    def labels(self, feats: list[tuple | None]) -> list[int]:
        h = b = k = 0.0
        back = []
        (hh, hb, hk), (bh, bb, bk), (kh, kb, kk) = self.steps
        for at, f in enumerate(feats):
            own = (-1e9, -1e9, 0.0) if f is None else (*self._own(f), -1e9)
            if at:
                to_h = max((h + hh, HEADER), (b + bh, BODY), (k + kh, BREAK))
                to_b = max((h + hb, HEADER), (b + bb, BODY), (k + kb, BREAK))
                to_k = max((h + hk, HEADER), (b + bk, BODY), (k + kk, BREAK))
                back.append((to_h[1], to_b[1], to_k[1]))
                h, b, k = to_h[0] + own[0], to_b[0] + own[1], to_k[0] + own[2]
            else:
                h, b, k = own
        if not feats:
            return []
        state = max((h, HEADER), (b, BODY), (k, BREAK))[1]
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def _fit_lines(spark, counts: Counter, params: ScanParams) -> LineModel:
    """The model of counted lines: distinct feature rows are few, whatever the number of lines."""
    steps = [[counts.get(f"t|{a}|{b}", 0) + 1.0 for b in range(3)] for a in range(3)]
    steps = [[math.log(x / sum(row)) for x in row] for row in steps]
    rows: dict[str, list[int]] = {}
    for key, n in counts.items():
        if key[0] == "e":
            _, label, f = key.split("|", 2)
            rows.setdefault(f, [0, 0])[int(label)] += n
    total = [sum(r[y] for r in rows.values()) for y in (HEADER, BODY)]
    if not total[HEADER] or not total[BODY]:
        return LineModel(steps, {}, -20.0, 0.5)
    place: dict[str, int] = {}
    for f in rows:
        for t in _terms(f.split("|")):
            place.setdefault(t, len(place))
    data = [(Vectors.sparse(len(place), sorted({place[t] for t in _terms(f.split("|"))}), [1.0] * len({place[t] for t in _terms(f.split("|"))})), float(y == HEADER), float(r[y])) for f, r in rows.items() for y in (HEADER, BODY) if r[y]]
    table = spark.createDataFrame(data, ["features", "label", "weight"]).coalesce(1).cache()
    fit = LogisticRegression(maxIter=80, tol=1e-8, regParam=params.penalty, standardization=False, weightCol="weight").fit(table)
    table.unpersist()
    w = fit.coefficients.toArray()
    return LineModel(steps, {t: float(w[i]) for t, i in place.items()}, fit.intercept, total[HEADER] / sum(total))


def _tokens(text: str):
    """Words of a line in small letters, with misread signs kept inside; hyphenated ones whole and in parts."""
    for raw in text.split():
        t = raw.strip("\"“”‘’'[]{}.,;:?)%…*")
        if t.startswith("(") and (")" in raw or len(t) < 4):
            t = t.lstrip("(")
        t = t.rstrip("!|")
        if any(ch.isalpha() for ch in t):
            yield t


def _body_words(lines: list[str], labels: list[int]) -> tuple[list[str], list[tuple[str, str, bool]]]:
    """Tokens of body lines (without the pieces of split words), and the splits: (left, right, plain hyphen)."""
    words: list[str] = []
    splits: list[tuple[str, str, bool]] = []
    held: tuple[str, bool] | None = None
    for line, label in zip(lines, labels):
        if label != BODY:
            continue
        x = line.strip(" \t\r")
        toks = x.split()
        if held is not None and toks:
            right = toks[0]
            if right[:1].islower() or right[:1].isdigit():
                splits.append((held[0], right, held[1]))
                toks = toks[1:]
            held = None
        end = line.rstrip()
        if toks and end[-1:] in HYPHENS and end[-2:-1].isalnum():
            held = (end.split()[-1][:-1], end[-1] == "-" and not line.rstrip("\r").endswith("- "))
            toks = toks[:-1]
        words.extend(_tokens(" ".join(toks)))
    return words, splits


_EDGE = "\"“”‘’'[](){}.,;:?!%…*"


@functools.lru_cache(maxsize=1 << 16)
def _bad_number(token: str) -> bool:
    return _BAD_NUMBER.fullmatch(token.strip(_EDGE)) is not None


@functools.lru_cache(maxsize=1 << 16)
def _bad_word(token: str) -> bool:
    return _BAD_WORD.fullmatch(token) is not None


def _inspect(shared, with_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for kind, record, lines, feats in _walk([batch]):
                labels = model.labels(feats)
                noise: set[str] = set()
                words, splits = _body_words(lines, labels)
                for line, label in zip(lines, labels):
                    if label == HEADER:
                        for p in _PARTS.split(line.strip()):
                            if page_number(p) is not None:
                                noise.add("page_number")
                            elif len(_WORD.findall(p)) > 0:
                                noise.add("running_header")
                                words.extend(_tokens(p))
                if any(_bad_number(t) for line in lines for t in line.split()) or any(_bad_word(t) for t in words):
                    noise.add("misread")
                vocabulary = set()
                for t in words:
                    low = t.lower()
                    vocabulary.add(low)
                    if "-" in low:
                        vocabulary.update(p for p in low.split("-") if len(p) > 1)
                pairs = []
                for left, right, plain in splits:
                    a, b = left.lstrip(_EDGE), right.rstrip(_EDGE)
                    if not a or not b or b[0].isdigit() or not a[-1].isalpha() or (a.isupper() and len(a) < 3):
                        continue
                    tail = a.rsplit("-", 1)[-1].lower()
                    pairs.append({"joined": tail + b.lower().split("-", 1)[0], "compound": f"{tail}-{b.lower().split('-', 1)[0]}", "left": tail, "right": b.lower().split("-", 1)[0], "plain": plain})
                digest = hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                rows.append((kind, record, digest, sorted(noise), sorted(vocabulary), pairs, [{"label": y, "text": x} for x, y in zip(lines, labels)] if with_lines else None))
            cols = list(zip(*rows)) or [[]] * 7
            split = pa.struct([("joined", pa.string()), ("compound", pa.string()), ("left", pa.string()), ("right", pa.string()), ("plain", pa.bool_())])
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(split), pa.list_(pa.struct([("label", pa.int32()), ("text", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["record_table", "record_id", "digest", "noise", "words", "splits", "lines"])

    return run


def variants(word: str) -> list[str]:
    """Words that a scan could have misread as ``word``, one place changed."""
    out = set()
    for read, stood in MISREAD.items():
        at = word.find(read)
        while at >= 0:
            for s in stood:
                out.add(word[:at] + s + word[at + len(read) :])
            at = word.find(read, at + 1)
    out.discard(word)
    return sorted(out)


def _code_grams(word: str) -> np.ndarray:
    x = np.frombuffer(f"`{word}`".encode("ascii"), dtype=np.uint8).astype(np.int64) - 96
    n = len(x) - 3
    return ((x[:n] * 27 + x[1 : n + 1]) * 27 + x[2 : n + 2]) * 27 + x[3 : n + 3] if n > 0 else np.empty(0, np.int64)


_SMALL = re.compile("[a-z]{4,}")


def _weight(n: int) -> float:
    """What a word's texts add to its letter groups: far less than their number, so that no word fills its groups alone."""
    return 1.0 + math.log2(n)


def _gram_counts(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**4)
        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if _SMALL.fullmatch(w):
                    np.add.at(total, _code_grams(w), _weight(n))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    return words.select("word", "n").mapInArrow(run, "gram bigint, n double").groupBy("gram").agg(F.sum("n").alias("n"))


#: Longer runs of letters aren't words, and one letter has nothing to be judged by.
LEAST, MOST = 2, 60


def _candidates(grams, texts: int, params: ScanParams):
    """Per word its variants, and those whose letter groups alone show the misreading: a word in two texts or in its
    share of them, with groups that next to no other word has."""
    few = max(2, int(params.rare_share * texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = grams.value
        table = np.zeros(27**4)
        table[at] = n
        usual_gram, rare_gram = max(12.0, params.usual_gram * table.sum() / 10), max(1.0, params.rare_gram * table.sum() / 10)
        for batch in batches:
            rows = []
            for w, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if not LEAST <= len(w) <= MOST:
                    continue
                others = float(table[_code_grams(w)].min()) - (_weight(count) if count else 0.0) if _SMALL.fullmatch(w) else math.inf
                for v in variants(w):
                    usual = _SMALL.fullmatch(v) is not None and float(table[_code_grams(v)].min()) >= usual_gram
                    rows.append((w, count, v, bool(usual and others <= rare_gram and count <= few and len(w) >= 5)))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.bool_()])], ["word", "n", "variant", "by_grams"])

    return run


def records_of(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages and chunks in one table with what their file tells: nulls in title, journal and authors are filled from other
    records of the file, and ``offset`` is the file's most frequent distance of printed and counted page number."""
    p = pages.filter("page_id is not null").select(F.lit("loaded_documents").alias("record_table"), F.col("page_id").cast("string").alias("record_id"), "text", "page", "title", "journal", "authors", "file_name")
    m = F.col("metadata")
    c = chunks.filter("chunk_id is not null").select(F.lit("document_chunks").alias("record_table"), F.col("chunk_id").alias("record_id"), "text", m["page"].alias("page"), m["title"].alias("title"), m["journal"].alias("journal"), m["authors"].alias("authors"), m["file_name"].alias("file_name")).dropDuplicates(["record_id", "text"])
    rows = p.unionByName(c)
    # a page's first or last line that is a number and little else
    edge = F.array(F.element_at(F.split(F.trim("text"), r"\n"), 1), F.element_at(F.split(F.trim("text"), r"\n"), -1))
    number = F.explode(F.transform(edge, lambda x: F.regexp_extract(x, r"^[-–—·\[\s]*(?:p\.|S\.|Page)?\s*([0-9]{1,5})\s*(?:(?:/|of)\s*[0-9]+)?[-–—·\]\s]*$", 1).try_cast("int")))
    seen = rows.filter("record_table = 'loaded_documents'").select("file_name", "page", number.alias("printed")).filter("printed is not null and page is not null")
    offsets = seen.groupBy("file_name", (F.col("printed") - F.col("page")).alias("o")).agg(F.count("*").alias("k"), F.countDistinct("page").alias("pages")).filter("pages > 1")
    offsets = offsets.groupBy("file_name").agg(F.max(F.struct("pages", (-F.abs("o")).alias("near"), "o"))["o"].alias("offset"))
    files = rows.groupBy("file_name").agg(F.max("title").alias("t"), F.max("journal").alias("j"), F.max("authors").alias("a")).join(offsets, "file_name", "left")
    filled = rows.join(files, "file_name", "left")
    return filled.select("record_table", "record_id", "text", "page", F.coalesce("title", "t").alias("title"), F.coalesce("journal", "j").alias("journal"), F.coalesce("authors", "a").alias("authors"), "offset")


def line_model(records: DataFrame, params: ScanParams = ScanParams()) -> LineModel:
    """The line model, fitted on a bounded sample of the records by hash of their id."""
    spark = records.sparkSession
    total = records.count()
    share = math.ceil(1_000_000 * min(1.0, params.sample_rows / max(1, total)))
    sample = stage(records.filter(F.pmod(F.xxhash64("record_table", "record_id"), F.lit(1_000_000)) < share).limit(2 * params.sample_rows).repartition(4))
    # headers stand inside chunks but not inside pages, so pages are what examples are made of, if there are any
    pages = sample.filter("record_table = 'loaded_documents'")
    pages = pages if pages.limit(1).count() else sample
    collect = lambda rows, run: Counter({r[0]: r[1] for r in rows.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()})
    made = collect(pages, _made_counts(params))
    model = _fit_lines(spark, made, params)
    for _ in range(params.own_rounds):
        model = _fit_lines(spark, made + collect(sample, _own_counts(spark.sparkContext.broadcast(model))), params)
    return model


def noise_of(records: DataFrame, params: ScanParams = ScanParams(), with_lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(found: record_table, record_id, noise), (misread words: word, right), (joins: joined, compound, is_split), the records as
    seen, with their labelled lines if asked for.

    Null and empty texts carry no noise. A record that stands there several times with one text counts once.
    """
    spark = records.sparkSession
    records = stage(records)
    model = line_model(records, params)
    schema = "record_table string, record_id string, digest string, noise array<string>, words array<string>, splits array<struct<joined:string,compound:string,left:string,right:string,plain:boolean>>, lines array<struct<label:int,text:string>>"
    seen = stage(records.mapInArrow(_inspect(spark.sparkContext.broadcast(model), with_lines), schema))
    texts = seen.groupBy("digest").agg(F.min_by("words", F.struct("record_table", "record_id")).alias("words"))  # copies count once
    different = seen.agg(F.countDistinct("digest")).first()[0]
    vocabulary = stage(texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    known = vocabulary.select(F.col("word").alias("k"), "n")

    # words split over a line end: the joined form or the compound with its own hyphen, whichever the corpus knows
    splits = seen.select("record_table", "record_id", F.explode("splits").alias("s")).select("record_table", "record_id", "s.*")
    forms = splits.select("joined", "compound", "left", "right", "plain").distinct()
    look = lambda df, c, name: df.join(known.withColumnsRenamed({"k": c, "n": name}), c, "left")
    forms = look(look(look(look(forms, "joined", "nj"), "compound", "nc"), "left", "nl"), "right", "nr")
    n = lambda c: F.coalesce(c, F.lit(0))
    least = max(3, int(params.usual_word * different))
    both_words = (n("nl") >= least) & (n("nr") >= least) & (n("nj") == 0)
    split = (n("nj") >= n("nc")) & ~F.coalesce(F.col("plain") & both_words, F.lit(False)) | ~F.col("plain") & (n("nc") == 0)
    forms = stage(forms.select("joined", "compound", "plain", split.alias("is_split")))
    hyphens = splits.join(forms.filter("is_split"), ["joined", "compound", "plain"], "left_semi").select("record_table", "record_id", F.lit("hyphenation").alias("noise"))

    # misread words: far rarer than a word they could be a misreading of, or with letter groups that the corpus lacks
    grams = _gram_counts(vocabulary).collect()  # at most 27^4 groups of four letters
    shared = spark.sparkContext.broadcast((np.array([g[0] for g in grams], np.int64), np.array([g[1] for g in grams], float)))
    joined_words = splits.join(forms.filter("is_split"), ["joined", "compound", "plain"], "left_semi").select("record_table", "record_id", F.col("joined").alias("word"))
    extra = joined_words.select("word").distinct().join(vocabulary, "word", "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    tried = vocabulary.unionByName(extra).repartition(F.col("word")).mapInArrow(_candidates(shared, different, params), "word string, n bigint, variant string, by_grams boolean")
    judged = tried.join(known.withColumnsRenamed({"k": "variant", "n": "nv"}), "variant", "left")
    ratio = F.when(F.length("word") < 4, params.short_ratio).otherwise(params.ratio)
    good = F.col("by_grams") | (n("nv") >= ratio * F.col("n") + 3)
    wrong = judged.filter(good).groupBy("word").agg(F.max(F.struct(n("nv").alias("nv"), "variant"))["variant"].alias("right"))
    wrong = stage(wrong)
    # words judged sound aren't shuffled again
    frequent = vocabulary.join(wrong, "word", "left_anti").filter("n >= 200 and length(word) <= 60").orderBy(F.desc("n"), "word").limit(params.frequent_words).select("word")
    uses = seen.select("record_table", "record_id", F.explode("words").alias("word")).join(F.broadcast(frequent), "word", "left_anti").unionByName(joined_words.select("record_table", "record_id", "word"))
    misread = uses.join(wrong, "word", "left_semi").select("record_table", "record_id", F.lit("misread").alias("noise"))
    direct = seen.select("record_table", "record_id", F.explode("noise").alias("noise"))
    found = direct.unionByName(hyphens).unionByName(misread).distinct()
    return found, wrong, forms, seen


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Body lines with their paragraph; those that end in a hyphen are marked."""
    for batch in batches:
        rows = []
        for kind, record, lines in zip(*[batch.column(c).to_pylist() for c in ("record_table", "record_id", "lines")]):
            at, para = 0, 0
            gap = False
            started = False
            for line, label in ((x["text"], x["label"]) for x in lines or []):
                if label == BREAK:
                    gap = started
                    continue
                if label == HEADER:
                    continue
                x = line.strip()
                if gap and not x[:1].islower():
                    para += 1
                gap, started = False, True
                rows.append((kind, record, para, at, x, x[-1:] in HYPHENS))
                at += 1
        cols = list(zip(*rows)) or [[]] * 6
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["record_table", "record_id", "paragraph", "line", "text", "broken"])


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kind, record, lines, fixes, joins in zip(*[batch.column(c).to_pylist() for c in ("record_table", "record_id", "lines", "fixes", "joins")]):
            fix = {f["word"]: f["right"] for f in fixes or []}
            split = set(joins or [])
            paragraphs: dict[int, str] = {}
            for x in lines:
                text, old = x["text"], paragraphs.get(x["paragraph"])
                if old is None:
                    paragraphs[x["paragraph"]] = text
                    continue
                broken = old[-1:] in HYPHENS and old[-2:-1].isalnum()
                first = text.split(" ", 1)[0]
                if broken and first:
                    tail = old.rsplit(None, 1)[-1][:-1].lstrip(_EDGE).rsplit("-", 1)[-1].lower()
                    key = tail + first.rstrip(_EDGE).lower().split("-", 1)[0]
                    paragraphs[x["paragraph"]] = (old[:-1] if key in split else old) + text
                else:
                    paragraphs[x["paragraph"]] = f"{old} {text}"

            def right(m: re.Match) -> str:
                w = m.group()
                new = fix.get(w.lower())
                if new is None:
                    core = w.strip(_EDGE)
                    new = fix.get(core.lower())
                    if new is None:
                        return w
                    new = new.upper() if core.isupper() else new.capitalize() if core[:1].isupper() else new
                    return w.replace(core, new, 1)
                return new.upper() if w.isupper() else new.capitalize() if w[:1].isupper() else new

            out = []
            for k in sorted(paragraphs):
                t = re.sub(r"\S+", right, paragraphs[k]) if fix else paragraphs[k]
                out.append(re.sub(r"\S+", lambda m: m.group().translate(str.maketrans("OoIlSB", "001158")) if _BAD_NUMBER.fullmatch(m.group().strip(_EDGE)) and not m.group()[:2].isalpha() else m.group(), t))
            rows.append((kind, record, "\n\n".join(out)))
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["record_table", "record_id", "clean_text"])


def clean_paragraphs(records: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """(record_table, record_id, clean_text, noise): paragraphs parted by blank lines, without headers and page numbers,
    split words joined, misread words and numbers put right; noise lists what was found (empty for none).

    A record of headers only has an empty text. Records with null or empty text don't come out.
    """
    found, wrong, forms, seen = noise_of(records, params, with_lines=True)
    lines = seen.select("record_table", "record_id", "lines").mapInArrow(_rebuild, "record_table string, record_id string, paragraph int, line int, text string, broken boolean")
    lines = stage(lines)
    key = ["record_table", "record_id"]
    body = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "paragraph", "text"))).alias("lines"))  # a record's own lines
    tokens = lines.select(*key, F.explode(F.split("text", r"\s+")).alias("t")).select(*key, F.lower(F.regexp_replace("t", r"^[\"“”‘’'\[\](){}.,;:?!%…*]+|[\"“”‘’'\[\](){}.,;:?!%…*]+$", "")).alias("word"))
    per = tokens.distinct().join(wrong, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "right")).alias("fixes"))
    # words behind a line end in lower case, as keys of the splits
    after = F.lead("text").over(Window.partitionBy(*key).orderBy("line"))
    ends = lines.withColumn("next", after).filter("broken and next is not null")
    tail = F.lower(F.element_at(F.split(F.regexp_extract("text", rf"(\S*\w)[{HYPHENS}]\s*$", 1), "-"), -1))
    head = F.lower(F.element_at(F.split(F.regexp_replace(F.element_at(F.split("next", " "), 1), r"[\"“”‘’'\[\](){}.,;:?!%…*]+$", ""), "-"), 1))
    joins = ends.select(*key, F.concat(F.regexp_replace(tail, r"^[\"“”‘’'\[\](){}.,;:?!%…*]+", ""), head).alias("joined")).join(forms.filter("is_split").select("joined").distinct(), "joined", "left_semi")
    joins = joins.groupBy(*key).agg(F.collect_set("joined").alias("joins"))
    kinds = found.groupBy(*key).agg(F.array_sort(F.collect_set("noise")).alias("noise"))
    mended = body.join(per, key, "left").join(joins, key, "left").mapInArrow(_mend, "record_table string, record_id string, clean_text string")
    return mended.join(kinds, key, "left").withColumn("noise", F.coalesce("noise", F.array().cast("array<string>")))
