"""Texts that were decoded with a wrong character encoding: marked and, where possible, restored.

Adjacent character pairs are counted over the whole corpus. Each pair is scored by its contribution to the
corpus's mutual information; pairs that contribute next to nothing count as improbable. Maximum-scoring segments
isolate improbable runs, and inverse mappings (encode with a wrong table, decode with the right one) are tried
only inside those runs, accepted where the pairs of the result are far more usual than those of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables a text may have been decoded with, for text that was UTF-8.
UTF8_AS = ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "iso8859_15", "cp1250", "cp1253", "cp1254", "cp852"]
# Fixed values: (decoded with, should have been) for texts in one-byte and Chinese encodings.
ONE_BYTE = [
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp1250", "cp1252"), ("cp1253", "cp1252"),
    ("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "koi8_r"), ("mac_roman", "cp1251"), ("cp850", "cp1251"), ("cp437", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"),
    ("cp1252", "gb18030"), ("latin-1", "gb18030"), ("cp1251", "gb18030"), ("cp1252", "big5"),
]

#: What a wrong table can have shown: characters beyond ASCII, without Chinese ones, which none of the tables has.
_NON_ASCII = re.compile(r"[^\x00-\x7f\u3000-\u303f\u3400-\u4dbf\u4e00-\u9fff]+")
_LOST = re.compile("[�\x80-\x9f]")


@dataclass(frozen=True)
class RepairParams:
    """least_information: bits per million pairs that a pair must contribute to be usual. gain: bits per changed
    character by which a restored run must be more usual (one-byte tables change every character and prove nothing
    by themselves, so they need more)."""

    least_information: float = 900.0
    utf8_gain: float = 0.25
    one_byte_gain: float = 1.8
    depth: int = 3


def _class_table() -> tuple[np.ndarray, int]:
    """Class of every code point: single characters below U+0530 and for symbols, one class for Chinese characters, one
    per 4,096 others. The number of classes is fixed, so tables of pairs are bounded whatever the corpus."""
    table = np.empty(0x110000, dtype=np.int32)
    points = np.arange(0x110000)
    table[:] = 2_400 + points // 4_096
    table[:0x530] = points[:0x530]
    table[0x2000:0x2300] = 1_400 + points[: 0x2300 - 0x2000]
    table[0x2500:0x2600] = 2_170 + points[:0x100]
    table[0x3000:0x3040] = 1_330 + points[:0x40]
    table[0x4E00:0xA000] = 2_168
    table[0xFF00:0xFFF0] = 2_167
    table[0xFFFD] = 2_169
    table[ord("0") : ord("9") + 1] = ord("0")
    return table, 2_400 + 0x110


def _classes(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n): how often each pair of character classes stands side by side, over all texts; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, k = _class_table()
        total: np.ndarray | None = None
        held, size = [], 0

        def add() -> None:
            nonlocal total, held, size
            if not held:
                return
            c = _classes("\n".join(held), table)
            found = np.bincount(c[:-1].astype(np.int64) * k + c[1:], minlength=k * k) if len(c) > 1 else np.zeros(k * k, np.int64)
            total = found if total is None else total + found
            held, size = [], 0

        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    held.append(t)
                    size += len(t)
                    if size > 3_000_000:
                        add()
        add()
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    return texts.select("text").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class _Model:
    """Pair tables inside a task: improbability of a pair, and bits of a pair given its first character."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, params: RepairParams):
        self.table, k = _class_table()
        self.k = k
        total = max(1.0, float(counts.sum()))
        first, second = np.zeros(k), np.zeros(k)
        np.add.at(first, pairs // k, counts)
        np.add.at(second, pairs % k, counts)
        share = counts / total
        information = share * np.log2(np.maximum(share / ((first[pairs // k] / total) * (second[pairs % k] / total)), 1 + 1e-9)) * 1e6
        self.improbable = np.full(k * k, 6, dtype=np.int8)
        self.improbable[pairs] = np.clip(np.rint(np.log2(params.least_information / np.maximum(information, 1e-3))), -4, 6).astype(np.int8)
        # no sound text has replacement and stray control characters, however usual they are in the corpus
        lost = np.unique(self.table[[0xFFFD, *range(0x80, 0xA0)]])
        square = self.improbable.reshape(k, k)
        square[lost, :] = 6
        square[:, lost] = 6
        ascii_pairs = (np.arange(k)[:, None] < 128) & (np.arange(k)[None, :] < 128)
        self.improbable[np.flatnonzero(ascii_pairs.ravel())] = np.minimum(self.improbable[np.flatnonzero(ascii_pairs.ravel())], -1)
        back = 0.5 * (second + 0.05) / (total + 0.05 * k)
        bits = -np.log2(back)[None, :] + np.log2(np.maximum(first, 0) + 0.5)[:, None]
        bits = bits.astype(np.float32).ravel()
        bits[pairs] = -np.log2((counts + back[pairs % k]) / (first[pairs // k] + 0.5))
        self.bits = bits

    def cost(self, text: str) -> float:
        """Bits of the text after its first character."""
        c = _classes(text, self.table)
        return float(self.bits[c[:-1].astype(np.int64) * self.k + c[1:]].sum())

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs, widened to whole words with characters beyond ASCII."""
        c = _classes("\n" + text + "\n", self.table).astype(np.int64)
        if int(c.max()) < 128:
            return []
        score = self.improbable[c[:-1] * self.k + c[1:]].astype(np.int64)
        score[(c[:-1] < 128) & (c[1:] < 128)] = -1
        hot = score > 0
        if not hot.any():
            return []
        edge = np.flatnonzero(np.diff(np.r_[0, hot.astype(np.int8), 0]))
        starts, ends = edge[::2], edge[1::2]
        sums = np.add.reduceat(np.r_[score, 0], np.ravel(np.column_stack([starts, ends])))[::2]
        run_total = np.r_[0, np.cumsum(score)]
        out: list[list[int]] = []
        held = 0
        for s, e, v in zip(starts.tolist(), ends.tolist(), sums.tolist()):
            gap = int(run_total[s] - run_total[out[-1][1]]) if out else 0
            if out and held + gap > 0 and v + gap > 0:
                out[-1][1] = e
                held += gap + v
            else:
                out.append([s, e])
                held = v
        wide: list[tuple[int, int]] = []
        n = len(text)
        for s, e in out:
            s, e = max(0, s - 1), min(n, e)  # pair i joins characters i - 1 and i of the text
            while s > 0 and not text[s - 1] in " \n\t":
                s -= 1
            while e < n and not text[e] in " \n\t":
                e += 1
            if wide and s <= wide[-1][1]:
                wide[-1] = (wide[-1][0], max(e, wide[-1][1]))
            else:
                wide.append((s, e))
        return wide


def _bytes_of(run: str, table: str) -> bytes | None:
    """The bytes that ``table`` shows as ``run``; bytes that cp125x leave undefined stand for themselves."""
    try:
        return run.encode(table)
    except UnicodeEncodeError:
        if not table.startswith("cp125"):
            return None
        out = bytearray()
        for ch in run:
            try:
                out += ch.encode(table)
            except UnicodeEncodeError:
                if not 0x80 <= ord(ch) <= 0x9F:
                    return None
                out.append(ord(ch))
        return bytes(out)


_MAPPINGS = [(x, "utf-8") for x in UTF8_AS] + ONE_BYTE
_DIGIT = re.compile("[0-9]")


class Mapped(dict):
    """A run beyond ASCII to what each inverse mapping makes of it; mappings that its bytes don't allow are left out."""

    def __missing__(self, run: str) -> dict[int, str]:
        if len(self) > 200_000:
            self.clear()
        out: dict[int, str] = {}
        coded: dict[str, bytes | None] = {}
        for k, (wrong, right) in enumerate(_MAPPINGS):
            if wrong not in coded:
                coded[wrong] = _bytes_of(run, wrong)
            data = coded[wrong]
            if data is None:
                continue
            try:
                new = data.decode(right)
            except UnicodeDecodeError:
                continue
            if new != run and (right == "utf-8" or not _LOST.search(new)):
                out[k] = new
        self[run] = out
        return out


def _best_mapping(run: str, model: _Model, params: RepairParams, mapped: Mapped) -> int | None:
    """The inverse mapping that makes the run's pairs most usual, if it gains enough."""
    pieces = _NON_ASCII.findall(run)
    ways = [mapped[p] for p in pieces]
    tried = sorted(set().union(*ways)) if ways else []
    if not tried:
        return None
    here, top, best = model.cost(f" {run} "), 0.0, None
    between = _NON_ASCII.split(run)
    for k in tried:
        least = params.utf8_gain if _MAPPINGS[k][1] == "utf-8" else params.one_byte_gain
        changed = sum(len(p) for p, w in zip(pieces, ways) if k in w)
        if here < (least + 1.0) * changed:  # no text costs less than a bit a character
            continue
        new = "".join(x for p, w, t in zip([*pieces, ""], [*ways, {}], between) for x in (t, w.get(k, p)))
        gain = here - model.cost(f" {new} ")
        if gain >= least * changed and gain > top:
            top, best = gain, k
    return best


def repair_text(text: str, model: _Model, params: RepairParams, mapped: Mapped, known: dict) -> tuple[str, list[str]]:
    """The text with its garbled runs restored as far as possible, and the mappings used."""
    kinds: list[str] = []
    for _ in range(params.depth):
        if not any(mapped[p] for p in _NON_ASCII.findall(text)):
            break
        out, at, did = [], 0, False
        for s, e in model.runs(text):
            run = text[s:e]
            key = _DIGIT.sub("0", run)  # all digits are of one class
            if key in known:
                k = known[key]
            else:
                if len(known) > 200_000:
                    known.clear()
                k = known[key] = _best_mapping(run, model, params, mapped)
            if k is not None:
                out.append(text[at:s])
                out.append(_NON_ASCII.sub(lambda m: mapped[m.group()].get(k, m.group()), run))
                at, did = e, True
                name = f"{_MAPPINGS[k][1]} as {_MAPPINGS[k][0]}"
                if name not in kinds:
                    kinds.append(name)
        if not did:
            break
        out.append(text[at:])
        text = "".join(out)
    return text, kinds


def repaired(documents: DataFrame, params: RepairParams = RepairParams(), changed_only: bool = False) -> DataFrame:
    """(doc_id, garbled, restored, lost, mappings, text): every document with its text restored where possible.

    garbled: characters from a wrong decoding were found, restorable or not; restored: a mapping was applied;
    lost: replacement or stray control characters remain. Null text gives garbled false and null text; repeated ids
    come out as often as they stand there. With changed_only just garbled rows come out. Counts are over all texts.
    """
    spark = documents.sparkSession
    counted = pair_counts(documents).collect()  # bounded: at most (number of classes)^2 pairs, whatever the corpus
    pairs = np.array([r[0] for r in counted], dtype=np.int64)
    counts = np.array([r[1] for r in counted], dtype=np.float64)
    shared = spark.sparkContext.broadcast((pairs, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mapped, known = None, Mapped(), {}
        for batch in batches:
            model = model or _Model(*shared.value, params)
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                new, kinds = (text, []) if not text or text.isascii() else repair_text(text, model, params, mapped, known)
                # what stays lost stands in the segments of the text as it came out
                lost = bool(new and not new.isascii() and any(_LOST.search(new, s, e) for s, e in model.runs(new)))
                if kinds or lost or not changed_only:
                    rows.append((doc, bool(kinds) or lost, bool(kinds), lost, kinds, new))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "garbled", "restored", "lost", "mappings", "text"])

    schema = "doc_id bigint, garbled boolean, restored boolean, lost boolean, mappings array<string>, text string"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
