"""Defective question and answer pairs, flagged with the kind of defect.

A multi-label linear classifier (one logistic regression per defect) over hashed n-grams of the whole answer and
measures of the pair. It is trained on answers that were truncated, copied, swapped with answers in another language,
refused or emptied on purpose, beside untouched and harmlessly changed ones; thresholds are calibrated on
held-out rows, whose refusals are worded otherwise than those of the fit. Which language a text is in is learnt from the
table's own language column.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from stillhouse.sources.tables import stage

DEFECTS = ["empty", "truncated", "refusal", "copied_question", "wrong_language"]


@dataclass(frozen=True)
class DefectParams:
    """Training examples are made from all pairs, unless sample_rows bounds them; then each language has up to language_rows more, of
    the most_languages most frequent ones. pool_rows bounds the answers lent for swaps.
    sound_weight: how much more often than in the examples a pair is taken to be sound when thresholds are set.
    doubtful: probability of a defect from which an untouched pair isn't taken as sound."""

    sample_rows: int | None = None
    language_rows: int = 120
    pool_rows: int = 300
    most_languages: int = 64
    first_iterations: int = 20
    iterations: int = 60
    #: Strong in the first fit, so that untouched pairs which are defective aren't learnt by heart and can be left out.
    first_penalty: float = 5e-3
    penalty: float = 5e-5
    sound_weight: float = 8.0
    doubtful: float = 0.2
    seed: int = 3


# How a refusal is worded in the examples: who, unable or unwilling, what, about what. Even and odd wordings of each list
# are kept apart: one half trains, the other calibrates.
_UNABLE = ["I cannot", "I can't", "I am unable to", "I'm unable to", "I am not able to", "I'm not able to", "I won't", "I will not", "I must decline to", "I have to decline to", "I would rather not", "I refuse to", "I am not allowed to", "I'm not permitted to", "I do not wish to", "I don't feel comfortable trying to"]
_DOING = ["answer", "answer questions about", "help with", "assist with", "discuss", "comment on", "provide information on", "give details on", "respond to", "say anything about", "talk about", "share data on", "speak to", "address"]
_WHAT = ["this", "that", "this question", "your request", "this request on {}", "questions about {}", "{}", "the topic of {}", "anything on {}"]
_OTHER = [
    "This is outside of what I can discuss.", "That lies beyond what I may talk about.", "This request is not something I can answer.", "That is not a matter I will comment on.", "I have no access to data on {}, so I can't answer.", "I lack access to information on {}.",
    "My guidelines don't allow an answer on {}.", "The rules I follow forbid me to answer.", "No answer can be given to this request.", "It isn't possible for me to answer.", "I don't have an opinion on {}.", "As a model I hold no view on {} and cannot respond.",
    "Ich kann diese Frage leider nicht beantworten.", "Dazu darf ich keine Auskunft über {} geben.", "Je ne peux pas répondre à cette question.", "Je suis désolé, je ne suis pas en mesure de vous aider.", "Lo siento, no puedo ayudar con eso.", "No me es posible responder a esta pregunta.",
    "Desculpe, não posso responder a essa pergunta.", "Infelizmente não estou autorizado a falar sobre {}.", "Извините, я не могу ответить на этот вопрос.", "К сожалению, я не вправе обсуждать {}.", "抱歉，我无法回答这个问题。", "对不起，我不能提供关于{}的信息。",
]
_BEFORE = ["", "", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "Regrettably, ", "Apologies, ", "My apologies - ", "As an assistant, ", "As a language model, ", "Thank you for asking. "]
_BEHIND = ["", "", "", " Please ask an expert.", " You may want to consult a specialist in {}.", " Is there anything else?", " Let me know if I can do something else.", " Please try another question."]
# What an emptied answer holds.
_EMPTIES = ["", " ", "\n", "　", "\t", "-", "--", "...", "?", "**", "N/A", "n/a", "NA", "none", "None.", "null", "nil", "TBD", "to be done", "(empty)", "[empty]", "<p></p>", "<br>", "Answer:", "A:", "[no answer]", ".", "''", "nan", "unknown", "pending", "_", "no answer"]

_TOKEN = re.compile(r"[一-鿿]|[^\W_]+")
_TAG = re.compile(r"<[^<>]{0,40}>")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_PLAIN = re.compile(r"[^\W\d_]+")
_DIGIT, _APART = re.compile(r"\d"), re.compile(r"[\W_]+")

GRAMS = 1 << 15
_BINS = 13  # 11 steps from 0 to 1 with the ends apart, one for "not given", and the value itself
MEASURES = ["size", "ending", "in_question", "of_question", "new", "new_count", "point_left", "has_points", "other_language", "language_gap", "open_brackets", "last_sentence"]
WIDTH = GRAMS + _BINS * len(MEASURES)
_LETTER_GRAMS = 1 << 14
GRAM_WEIGHT = 0.3
#: Up to so many examples the fits read two cached partitions; beyond them each has all cores.
_FEW_EXAMPLES = 60_000
#: Pairs per task when examples are made of them, and the thresholds that are tried.
_TASK_PAIRS = 2_000
#: Pairs whose examples a task holds at once, and questions that it remembers.
_HELD_PAIRS, _HELD_QUESTIONS = 64, 256
_THRESHOLDS = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99])


def _letter_grams(text: str) -> np.ndarray:
    """Hashed groups of three letters of a text, words parted by one blank."""
    t = " ".join(_PLAIN.findall(text.lower()))
    if len(t) < 3:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return (c[:-2] * 1_000_003 ^ c[1:-1] * 10_007 ^ c[2:]) & (_LETTER_GRAMS - 1)


class Languages:
    """Log probabilities of letter groups by language; without any language every text is in the same one."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        rows = np.array([counts[k] for k in self.names]).reshape(len(self.names), _LETTER_GRAMS)
        self.table = np.log((rows + 0.05) / (rows.sum(axis=1, keepdims=True) + 0.05 * _LETTER_GRAMS))
        self.held: dict[str, tuple] = {}

    def weigh(self, text: str) -> np.ndarray:
        """Mean log probability per letter group, by language (zeros for a text without letters)."""
        g = _letter_grams(text)
        return self.table[:, g].mean(axis=1) if len(g) and len(self.names) else np.zeros(len(self.names))

    def shares(self, mean: np.ndarray, groups: int) -> np.ndarray:
        """How likely each language is; no text counts for more than 40 groups."""
        x = np.exp((mean - mean.max()) * min(groups, 40)) if len(mean) else mean
        return x / x.sum() if len(x) else x

    def asked(self, question: str) -> tuple[set[str], set[tuple[str, ...]], np.ndarray, int, np.ndarray]:
        """What each answer to a question is compared with: its words, their threes, and what language it is in."""
        if question not in self.held:
            if len(self.held) >= _HELD_QUESTIONS:
                self.held.clear()
            words, mean, size = _TOKEN.findall(question.lower()), self.weigh(question), len(_alnum(question))
            self.held[question] = set(words), set(zip(words, words[1:], words[2:])), mean, size, self.shares(mean, size)
        return self.held[question]


def _alnum(text: str) -> str:
    return _APART.sub("", text.lower())


def _point_left(whole: str, end: str, points: list[str]) -> float | None:
    """What is left of the key point that the answer ends in, as a share of it: 0 where it ends with the whole point, None
    where it ends in none. ``end`` is the answer's last sentence."""
    best = None
    for p in points:
        n = 0
        if whole.endswith(p):
            n = len(p)
        elif end and p.startswith(end):
            n = len(end)
        elif len(whole) >= 8:
            at = p.rfind(whole[-8:])
            while at >= 0 and not n:
                n = at + 8 if whole.endswith(p[: at + 8]) else 0
                at = p.rfind(whole[-8:], 0, at + 7)
        if n and (best is None or 1 - n / len(p) < best):
            best = 1 - n / len(p)
    return best


def _ending(text: str) -> int:
    """The kind of the last sign: none, stop, question mark, ellipsis, comma, dash or operator, bracket, letter, digit, other."""
    if not text:
        return 0
    last = text[-1]
    if text.endswith("...") or last == "…":
        return 3
    for kind, signs in ((1, ".。"), (2, "!?！？"), (4, ",;:，；："), (5, "-–—/&+=*"), (6, ")]}）\"'”»")):
        if last in signs:
            return kind
    return 7 if last.isalpha() else 8 if last.isdigit() else 9


def measures(question: str, answer: str, points: list[str | None] | None, languages: Languages) -> list[float | None]:
    """Raw measures of a pair, each from 0 to 1 or None where it can't be taken."""
    bare = _TAG.sub(" ", answer)
    text = bare.strip()
    words = _TOKEN.findall(bare.lower())
    known, sq, mq, nq, pq = languages.asked(question)
    ga = list(zip(words, words[1:], words[2:]))
    sa = set(ga)
    new = sum(w not in known for w in words)
    sentences = [_alnum(s) for s in _SENTENCE.split(text) if s.strip()]
    keys = [k for k in (_alnum(p) for p in points or [] if p) if k]
    whole = _alnum(text)
    ma, na = languages.weigh(text), len(whole)
    other, gap = None, None
    if len(mq) and nq > 5 and na > 5:
        other = 1 - float(pq @ languages.shares(ma, na))
        gap = min(1.0, float(ma.max() - ma[mq.argmax()]) / 2)
    mean = sum(map(len, sentences)) / len(sentences) if sentences else 0
    return [
        min(1.0, np.log2(1 + len(whole)) / 10), _ending(text) / 10, sum(g in sq for g in ga) / len(ga) if ga else None, len(sa & sq) / len(sq) if sq and ga else None,
        new / len(words) if words else None, min(1.0, np.log2(1 + new) / 7), _point_left(whole, sentences[-1] if sentences else "", keys), float(bool(keys)), other, gap,
        min(1.0, max(0, text.count("(") + text.count("（") - text.count(")") - text.count("）")) / 3), min(1.0, len(sentences[-1]) / (2 * mean)) if len(sentences) > 1 and mean else None,
    ]


_KIND = {kind: zlib.crc32(f"{kind}|".encode()) for kind in ("w", "b", "first", "last", "last two", "all", "only")}


def _bucket(kind: str, what: str) -> int:
    return zlib.crc32(what.encode("utf-8", "surrogatepass"), _KIND[kind]) % GRAMS


def features(question: str | None, answer: str | None, points: list[str | None] | None, languages: Languages) -> dict[int, float]:
    """Sparse features: n-grams of the whole answer, its first and last words apart, and the steps of the measures. Nulls count
    as empty."""
    q, a = question or "", answer or ""
    out: dict[int, float] = {}
    words = _TOKEN.findall(_DIGIT.sub("0", _TAG.sub(" ", a).lower()))
    for w in words:
        out[_bucket("w", w)] = GRAM_WEIGHT
    for x, y in zip(words, words[1:]):
        out[_bucket("b", f"{x} {y}")] = GRAM_WEIGHT
    if words:
        out[_bucket("first", " ".join(words[:2]))] = GRAM_WEIGHT
        out[_bucket("last", words[-1])] = 1.0
        out[_bucket("last two", " ".join(words[-2:]))] = GRAM_WEIGHT
    if len(words) <= 3:
        out[_bucket("all", a.strip().lower())] = 1.0
        out[_bucket("only", " ".join(words))] = 1.0
    for j, m in enumerate(measures(q, a, points, languages)):
        at = GRAMS + j * _BINS
        step = 11 if m is None else 0 if m <= 0 else 10 if m >= 1 else 1 + int(m * 9)
        for i in (step,) if step in (0, 11) else range(1, step + 1):  # every step that the measure has reached
            out[at + i] = 1.0
        out[at + 12] = m or 0.0
    return out


def _refusal(rng: random.Random, topic: str, half: int) -> str:
    """A refusal whose wording stands in one half of the lists only."""
    pick = lambda xs: rng.choice(xs[half::2])
    core = pick(_OTHER) if rng.random() < 0.4 else f"{pick(_UNABLE)} {pick(_DOING)} {pick(_WHAT)}."
    before = pick(_BEFORE)
    return (before + (core[0].lower() + core[1:] if before.endswith((", ", "but ")) and core[0] != "I" else core) + pick(_BEHIND)).replace("{}", topic)


def _truncated(rng: random.Random, a: str) -> str | None:
    """An answer broken off inside its last sentence, with or without a sign put behind."""
    s = a.strip()
    starts = [m.end() for m in _SENTENCE.finditer(s) if m.end() < len(s)]
    at = starts[-1] if starts else 0
    size = len(s) - at
    if size < 12:
        return None
    cut = at + rng.randint(max(3, size // 8), size - 3)
    if rng.random() < 0.6:
        space = s.rfind(" ", at + 2, cut)
        cut = space if space > 0 else cut
    return s[:cut].rstrip(" .。") + rng.choice(["", "", "", "", "", "…", "...", ",", " ("])


def _copied(rng: random.Random, q: str) -> str:
    """The question again: as it stands, in capitals, announced, quoted, without its end, or most of its words."""
    t, w = q.strip(), q.strip().split(" ")
    sentences = [s for s in _SENTENCE.split(t) if s.strip()]
    forms = [t, t.upper(), f"The question is: {t}", f"Q: {t}", f'"{t}"', t.rstrip("?？. ") + rng.choice(["", "."]), " ".join(w[rng.randint(0, 2) :]), " ".join(w[: max(4, len(w) - rng.randint(0, 3))]), sentences[-1] if sentences else t]
    return rng.choice(forms)


def _examples(params: DefectParams, pool: list[tuple[str, str, str, list]], topics: list[str], shared):
    """Training pairs made from sound-looking ones: features as a sparse vector is stored, labels, fold, whether untouched. No more than
    the examples of _HELD_PAIRS pairs are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        for batch in (b.slice(at, _HELD_PAIRS) for b in batches for at in range(0, b.num_rows, _HELD_PAIRS)):
            rows = []
            for no, q, a, p in zip(*[batch.column(c).to_pylist() for c in ("id", "question", "answer_key", "key_points")]):
                rng = random.Random(zlib.crc32(f"{params.seed}|{no}".encode()))
                q = q or ""
                fold = zlib.crc32(str(no).encode()) % 5
                # some pairs lack key points, and some have such as say nothing on the answer
                draw = rng.random()
                other_points = [t for t in _SENTENCE.split(q) if t.strip()]

                def add(answer, label, points=p, own=False, q=q, fold=fold, draw=draw, other_points=other_points):
                    x = features(q, answer, points if own or draw > 0.4 else None if draw < 0.2 else other_points, languages)
                    at = sorted(x)
                    rows.append(({"type": 0, "size": WIDTH, "indices": at, "values": [x[i] for i in at]}, [float(d == label) for d in DEFECTS], fold, own, str(no)))

                add(a, None, own=True)
                add(rng.choice(_EMPTIES), "empty")
                for _ in range(2):
                    add(_refusal(rng, rng.choice(topics) if topics else "this", int(fold == 0)), "refusal")
                parts = [t for t in _SENTENCE.split(q) if t.strip()]
                add(_copied(rng, q), "copied_question", points=parts if rng.random() < 0.5 else p)
                add(f"{rng.uniform(20, 500):.1f} °C{rng.choice(['', '.'])}" if rng.random() < 0.5 else f"About {rng.uniform(20, 500):.1f} °C", None)
                if a and len(a) > 60:
                    t = _truncated(rng, a)
                    if t:
                        add(t, "truncated")
                    add(a.strip().rstrip(".。"), None)
                    whole = [x for x in _SENTENCE.split(a.strip()) if x.strip()]
                    add(rng.choice(whole[:-1] or whole), None)  # one whole sentence of it
                    if rng.random() < 0.4:
                        add(f"{q.strip()} {a.strip()}", None)
                here = languages.names[int(languages.weigh(q).argmax())] if languages.names else None
                other = [x for x in pool if x[0] != here]
                if other:
                    for own_points in (True, False):
                        _, question, x, its_points = rng.choice(other)
                        add(x, None, q=question, points=its_points)  # the same answer is sound beside its own question
                        add(x, "wrong_language", points=[t for t in _SENTENCE.split(x) if t.strip()] if own_points else p if rng.random() < 0.6 else None)
            vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
            types = [vector, pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["features", "y", "fold", "own", "pair"])

    return run


def _fit(staged: DataFrame, iterations: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts from staged examples but those of fold 0.

    The files are read as what they hold, sparse vectors. Many aren't cached besides what a fit itself keeps of them.
    """
    schema = StructType([StructField("features", VectorUDT()), StructField("y", ArrayType(DoubleType())), StructField("fold", IntegerType())])
    vectors = staged.sparkSession.read.schema(schema).parquet(*staged.inputFiles()).filter("fold <> 0").select("features", "y")
    few = vectors.select("y").count() <= _FEW_EXAMPLES
    if few:
        vectors = vectors.coalesce(2).cache()
        vectors.count()

    fit = LogisticRegression(maxIter=iterations, regParam=penalty, standardization=False).fit
    models = [fit(vectors.select("features", F.col("y")[j].alias("label"))) for j in range(len(DEFECTS))]  # side by side they swell the driver
    if few:
        vectors.unpersist()
    return np.array([m.coefficients.toArray() for m in models]), np.array([m.intercept for m in models])


def _probabilities(rows: Iterable[tuple[np.ndarray, np.ndarray]], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.array([w[:, at] @ x for at, x in rows]).reshape(-1, len(DEFECTS)) + b
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _stored(features: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each stored vector, without a copy."""
    at, x = features.field("indices"), features.field("values")
    ends, places, values = at.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
    for lo, hi in zip(ends[:-1], ends[1:]):
        yield places[lo:hi], values[lo:hi]


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, least, languages = shared.value
        for batch in batches:
            out: list[tuple] = []
            for no, q, a, k in zip(*[batch.column(c).to_pylist() for c in ("id", "question", "answer_key", "key_points")]):
                x = features(q, a, k, languages)
                p = _probabilities([(list(x), np.array(list(x.values())))], w, b)[0]
                over = [j for j in range(len(DEFECTS)) if p[j] >= least[j]]
                if over:  # one defect a pair: the one that stands furthest above its threshold
                    j = max(over, key=lambda j: np.log(p[j] / (1 - p[j] + 1e-12)) - np.log(least[j] / (1 - least[j])))
                    out.append((no, DEFECTS[j], float(p[j])))
            c = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c[0]), pa.string()), pa.array(list(c[1]), pa.string()), pa.array(list(c[2]), pa.float64())], ["id", "defect", "probability"])

    return run


def _taught(pairs: DataFrame, params: DefectParams) -> DataFrame:
    """The pairs that examples are made from: all, or where sample_rows is given so many by hash of the id, rare languages with a
    larger share."""
    named = pairs.withColumn("language", F.lower(F.trim("language"))) if "language" in pairs.columns else pairs.withColumn("language", F.lit(None).cast("string"))
    if params.sample_rows is None:
        return named.select("id", "question", "answer_key", "key_points", "language")
    sizes = {r["language"]: r["count"] for r in named.groupBy("language").count().orderBy(F.desc("count"), "language").limit(params.most_languages).collect()}
    total = max(1, sum(sizes.values()))
    share = F.lit(min(1.0, params.sample_rows / total))
    for k, n in sizes.items():
        if k is not None:
            share = F.when(F.col("language") == k, min(1.0, max(params.sample_rows / total, params.language_rows / n))).otherwise(share)
    drawn = named.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.ceil(share * 1_000_000))
    return drawn.select("id", "question", "answer_key", "key_points", "language").limit(params.sample_rows + params.most_languages * params.language_rows)


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for k, q in zip(batch.column("language").to_pylist(), batch.column("question").to_pylist()):
            if k and q:
                counts.setdefault(k, np.zeros(_LETTER_GRAMS))
                counts[k] += np.bincount(_letter_grams(q), minlength=_LETTER_GRAMS)
    for k, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], ["language", "at", "n"])


def learn_languages(pairs: DataFrame) -> Languages:
    """Letter groups of the questions of all rows, by the language that stands beside them."""
    counts: dict[str, np.ndarray] = {}
    each = pairs.select("language", "question").mapInArrow(_count_letters, "language string, at int, n double").groupBy("language", "at").agg(F.sum("n").alias("n"))
    for r in each.groupBy("language").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")).toLocalIterator():  # one row per language
        counts[r["language"]] = np.zeros(_LETTER_GRAMS)
        counts[r["language"]][r["at"]] = r["n"]
    return Languages(counts)


def _rater(shared, sound_weight: float):
    """One row per partition: by defect and threshold the weight of the hits and of the right ones among them, then that of all cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(DEFECTS), 2 * len(_THRESHOLDS) + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _probabilities(_stored(batch.column("features")), *shared.value)
            y = np.array(batch.column("y").to_pylist())
            weight = np.where(y.sum(axis=1) > 0, 1.0, sound_weight)
            for j in range(len(DEFECTS)):
                hit = (p[:, j, None] >= _THRESHOLDS) * weight[:, None]
                total[j] += np.concatenate([hit.sum(axis=0), hit[y[:, j] > 0].sum(axis=0), [(weight * y[:, j]).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n"])

    return run


def train(pairs: DataFrame, params: DefectParams = DefectParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray, Languages]:
    """(weights, intercepts, thresholds, languages) of the classifier, fitted on examples of all ``pairs``."""
    taught = _taught(pairs, params)
    sample = stage(taught.repartition(max(6, -(-taught.count() // _TASK_PAIRS))))
    languages = learn_languages(sample)
    shared = pairs.sparkSession.sparkContext.broadcast(languages)
    lent = sample.filter("length(answer_key) > 80 and question is not null").select("question", "answer_key", "key_points").orderBy(F.xxhash64("answer_key", F.lit(params.seed))).limit(8 * params.pool_rows).collect()
    told = lambda x: languages.names[int(languages.weigh(x).argmax())] if languages.names else ""
    by: dict[str, list[tuple]] = {}
    for q, a, p in lent:
        repeated = measures(q, a, p, languages)[2]
        if told(a) == told(q) and _ending(a.strip()) == 1 and (repeated or 0.0) < 0.5:  # lent answers look whole
            by.setdefault(told(a), []).append((told(a), q, a, p))
    most = max(1, params.pool_rows // max(1, len(by)))
    pool = [x for xs in by.values() for x in xs[:most]]
    rng = random.Random(params.seed)
    topics = [" ".join(w[at : at + rng.randint(1, 2)]) for w in (_TOKEN.findall(r[1]) for r in lent[:200]) if len(w) > 3 for at in [rng.randrange(len(w) - 2)]]
    made = stage(sample.mapInArrow(_examples(params, pool, topics, shared), "features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>, y array<double>, fold int, own boolean, pair string"))
    if made.limit(1).count() == 0:
        return np.zeros((len(DEFECTS), WIDTH)), np.full(len(DEFECTS), -50.0), np.ones(len(DEFECTS)), languages
    first = pairs.sparkSession.sparkContext.broadcast(_fit(made, params.first_iterations, params.first_penalty))

    # pairs that look defective as they stand are left out of the second fit, with all that was made of them
    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(_stored(batch.column("features")), *first.value)
            yield pa.RecordBatch.from_arrays([batch.column("pair").filter(pa.array(p.max(axis=1, initial=0) >= params.doubtful))], ["pair"])

    left_out = made.filter("own").mapInArrow(doubtful, "pair string")  # ids only
    clean = stage(made.join(F.broadcast(left_out), "pair", "left_anti"))
    if clean.filter("fold <> 0").limit(1).count() == 0:  # all look defective: nothing tells which do
        clean = made
    w, b = _fit(clean, params.iterations, params.penalty)
    last = pairs.sparkSession.sparkContext.broadcast((w, b))

    least = np.full(len(DEFECTS), 0.5)
    seen = clean.filter("fold = 0").mapInArrow(_rater(last, params.sound_weight), "n array<double>")  # one row per partition
    total = sum((np.array(r["n"]) for r in seen.collect()), np.zeros(len(DEFECTS) * (2 * len(_THRESHOLDS) + 1))).reshape(len(DEFECTS), -1)
    for j in range(len(DEFECTS)):
        best = -1.0
        for i, t in enumerate(_THRESHOLDS):
            hits, right, cases = total[j, i], total[j, len(_THRESHOLDS) + i], total[j, -1]
            f1 = 2 * right / max(1.0, hits + cases)
            if cases and (f1 > best + 1e-9 or abs(f1 - best) <= 1e-9 and abs(t - 0.5) < abs(least[j] - 0.5)):
                best, least[j] = f1, t
    return w, b, least, languages


def defects(pairs: DataFrame, params: DefectParams = DefectParams()) -> DataFrame:
    """(id, defect, probability) of the defective pairs; one row per pair.

    ``pairs`` has id, question, answer_key and key_points, and language where known. A null answer is empty; a null question
    can't be copied; null key points are no defect. Repeated ids come out once per defect, with the highest
    probability. An empty table gives an empty result.
    """
    model = train(pairs, params)
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    scored = pairs.filter("id is not null").select(F.col("id").cast("string").alias("id"), "question", "answer_key", "key_points").mapInArrow(_scorer(shared), "id string, defect string, probability double")
    return scored.groupBy("id", "defect").agg(F.max("probability").alias("probability"))
