"""Operator 10: benchmark questions in documents, also with other numbers, names and units, by templates.

Texts become template tokens: numbers, units and names (capitalised words inside a sentence) are typed placeholders,
all else is the lower-cased word. A text with names on end, numbers before units or groups of three digits has a second
template where each of these is one placeholder, and each template is searched for each. A capitalised word that opens
a sentence may be a name or not: windows are cut for both readings, on both sides.

Windows of WIDTH template tokens of benchmark items, with at least half of their tokens literal, are a table of hashes.
A bit sieve made of it, of bounded size, passes the windows of documents that may be in it; those are joined with the
table by hash, so what is looked up grows with what is found. For each document and item found, its hits are gathered
and judged. Hits on one diagonal (equal distance between places in item and document) belong together, and so do those
on diagonals that an item's length holds, for words put in or left out move what follows. A place is judged if its
hits are LEAST_COVER of an item's windows, or hold LEAST_COVER of its tokens and LEAST_RUN at least (a changed word
takes WIDTH windows away, but one token), or if LEAST_RUN words on end are verbatim, whatever share of the item they
are. Then the slots of the aligned part are compared: each value of the item must stand for one value of the document,
and the other way round; where they do not, the windows that read no opening word as a name are judged alone. If all
are equal the passage is verbatim, else re-parameterised; if they contradict each other it is no leak. Each diagonal is
judged alone too.

Defined cases: null and empty texts and items have no windows; items of fewer than LEAST_WORDS tokens, or without any
window that is literal enough, are too short to tell and are not searched; shorter ones than WIDTH are one window;
repeated rows are each reported; equal items are each reported; of equally good places the one on the first diagonal
counts; a null doc_id or item_id is reported as null; empty tables give no rows; other columns of the inputs are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, small_side, written
from .shingles import mixed

WIDTH = 8
LEAST_WORDS = 5
LEAST_COVER = 0.5
LEAST_RUN = 13
#: Words that a task keeps; beyond, it starts anew.
KEPT_WORDS = 300_000
#: Windows read at a time: each opening word among its tokens doubles the readings of a window.
PIECE = 20_000
#: Bits of the sieve for each window, and at most, as powers of two.
SIEVE_SHARE, SIEVE_MOST = 4, 26
LITERAL, NUMBER, UNIT, NAME = range(4)
#: Units.
UNITS = frozenset("kg g mg lb lbs oz ton tons km m cm mm mile miles ft feet foot inch inches yard yards l ml liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent degrees degree mph kph watt watts volt volts".split())
_NUMBER = re.compile(r"[$€£]?[+-]?[0-9]+(?:[.,:/][0-9]+)*%?")
_NUMBER_UNIT = re.compile(r"[$€£]?[0-9]+(?:[.,][0-9]+)*-?([A-Za-z]+)")
_LEAD = re.compile(r"[$€£]?[+-]?[0-9]{1,3}")
_GROUP = re.compile(r"[0-9]{3}")
_PARTS = re.compile(r"(.*?)-?([a-z]*)", re.DOTALL)
_EDGE = "\"'`.,;:!?()[]{}*#&%$|<>"
LEAKS = "th long, item long, n_windows long, n_item_windows long, cover double, kind string, n_slots long, n_changed long"


def _placeholder(kind: int) -> int:
    return xxhash.xxh3_64_intdigest(f"<{kind}>".encode(), seed=10)


class Words(dict):
    """Numbers of words as met, with what each becomes in a template."""

    def __init__(self) -> None:
        self.kind: list[int] = []
        self.hash: list[int] = []
        self.capital: list[bool] = []
        self.ends: list[bool] = []
        self.joins: list[bool] = []
        self.plain: list[bool] = []
        self.lead: list[bool] = []
        self.group: list[bool] = []
        self.value: list[str] = []
        self.held: tuple[np.ndarray, ...] = ()

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode()
        bare = word.strip(_EDGE) or word
        kind, low = LITERAL, bare.lower()
        digits = not bare.isalpha()  # may have some; each pattern asks for one
        if digits and _NUMBER.fullmatch(bare):
            kind = NUMBER
        elif digits and (m := _NUMBER_UNIT.fullmatch(bare)) and m[1].lower() in UNITS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        self.kind.append(kind)
        self.hash.append(_placeholder(kind) if kind else xxhash.xxh3_64_intdigest(low.encode()))
        self.capital.append(not kind and bare[:1].isupper() and bare[1:].islower())
        self.ends.append(word.rstrip("\"')]")[-1:] in (".", "!", "?", ":"))
        self.joins.append(word[-1:] not in _EDGE or word[-1:] in "$%#&")
        self.plain.append(kind == NUMBER and not bare[-1:].isalpha())
        self.lead.append(digits and bool(_LEAD.fullmatch(bare)))
        self.group.append(digits and bool(_GROUP.fullmatch(bare)))
        self.value.append(low)
        self[raw] = len(self)
        return self[raw]

    def tables(self) -> tuple[np.ndarray, ...]:
        columns = (self.hash, np.uint64), (self.kind, np.int8), *((c, bool) for c in (self.capital, self.ends, self.joins, self.plain, self.lead, self.group))
        n = len(self.held[0]) if self.held else 0
        if not n or n < len(self.kind):
            new = tuple(np.array(c[n:], kind) for c, kind in columns)
            self.held = tuple(map(np.concatenate, zip(self.held, new))) if n else new
        return self.held


@dataclass
class Template:
    codes: np.ndarray
    kinds: np.ndarray
    opens: np.ndarray  # capitalised words that open a sentence
    words: np.ndarray
    starts: np.ndarray  # first word of each token, and the number of words

    def __len__(self) -> int:
        return len(self.codes)

    def value(self, k: int, values: list[str]) -> str:
        return "".join(values[w] for w in self.words[self.starts[k] : self.starts[k + 1]])


def templates(texts: list[str | None], words: Words) -> list[list[Template]]:
    """For each text a template with a token for each word and, if it is another, the folded one."""
    numbers = [np.fromiter(map(words.__getitem__, (t or "").encode().split()), np.int64) for t in texts]
    hashes, kinds, capital, ends, joins, plain, lead, group = words.tables()
    out, name = [], np.uint64(_placeholder(NAME))
    for w in numbers:
        if not len(w):
            out.append([Template(np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), w, np.zeros(1, np.int64))])
            continue
        upper = capital[w]
        inside = np.concatenate([[False], ~ends[w[:-1]]]) & upper
        kind, opens = np.where(inside, NAME, kinds[w]).astype(np.int8), upper & ~inside
        codes = np.where(inside, name, hashes[w])
        out.append([Template(codes, kind, opens, w, np.arange(len(w) + 1))])
        before, after = w[:-1], w[1:]
        names = upper[:-1] & inside[1:] & joins[before]
        more = names | (plain[before] & (kind[1:] == UNIT) | lead[before] & group[after]) & joins[before]
        if more.any():
            run = np.append(names, False)
            first = np.flatnonzero(np.concatenate([[True], ~more]))
            codes, kind = np.where(run, name, codes)[first], np.where(run, NAME, kind).astype(np.int8)[first]
            out[-1].append(Template(codes, kind, (opens & ~run)[first], w, np.append(first, len(w))))
    return out


_BASE = 0x9E3779B97F4A7C15


def readings(t: Template, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and hash of each window, in pieces; a window has a hash for each reading of its opening words."""
    powers = [np.uint64(pow(_BASE, width - 1 - j, 1 << 64)) for j in range(width)]
    to_name = np.uint64(_placeholder(NAME)) - t.codes
    for at in range(0, len(t) - width + 1, PIECE):
        place = np.arange(at, min(at + PIECE, len(t) - width + 1))
        h = np.zeros(len(place), np.uint64)
        for j in range(width):
            h += t.codes[at + j : at + j + len(place)] * powers[j]
        if t.opens[at : at + len(place) + width].any():
            for j in range(width):
                both = np.flatnonzero(t.opens[place + j])
                h = np.concatenate([h, h[both] + to_name[place[both] + j] * powers[j]])
                place = np.concatenate([place, place[both]])
        yield place, mixed(h + np.uint64(width))


def _window_width(n: int) -> int:
    return min(WIDTH, n)


def usable_windows(t: Template) -> np.ndarray:
    """Whether each window of an item is literal enough."""
    if len(t.words) < LEAST_WORDS:
        return np.zeros(0, bool)
    width = _window_width(len(t))
    return np.convolve(t.kinds == LITERAL, np.ones(width), "valid") * 2 >= width


def widened(hashed: np.ndarray, width: int) -> np.ndarray:
    """The hash of a window with its width in it."""
    return mixed(hashed ^ np.uint64(width * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


class Pair:
    """An item and a document that share windows, and whether that is a leak."""

    def __init__(self, item: list[Template], values: list[str]):
        self.items, self.values = item, values
        self.counts = [int(usable_windows(t).sum()) for t in item]

    def leak(self, docs: list[Template], values: list[str], hits: Iterable[tuple[int, int, int, int]]) -> tuple | None:
        """Windows found, windows of the item, cover, kind, slots and changed slots of the best place. hits: template of
        the item, place there, template of the document, place there."""
        lines: dict[tuple[int, int], dict[int, set[int]]] = {}
        for n, q, d, p in hits:
            lines.setdefault((d, n), {}).setdefault(p - q, set()).add(q)
        best = None
        for d, n in sorted(lines):
            one = self._best(n, lines[d, n], docs[d], values)
            if one and (best is None or best[2] < one[2]):
                best = one
        return best

    def _best(self, n: int, lines: dict[int, set[int]], doc: Template, values: list[str]) -> tuple | None:
        """The place of an item with the most windows whose slots agree; lines has the windows found by diagonal."""
        item, shifts, places = self.items[n], sorted(lines), []
        for i, shift in enumerate(shifts):
            places.append((len(lines[shift]), [shift]))
            band = shifts[i : bisect_right(shifts, shift + len(item))]
            if len(band) > 1:
                places.append((len(set().union(*(lines[s] for s in band))), band))
        for found, band in sorted(places, key=lambda p: (-p[0], len(p[1]), p[1][0])):
            whole = self._aligned(lines, band)
            for at in (whole, self._literal(item, doc, values, whole)):
                found = len(at)
                if found < LEAST_COVER * self.counts[n] and not self._holds(item, at) and (len(band) > 1 or self._run(item, doc, values, band[0]) < LEAST_RUN):
                    break
                slots = self._slots(item, doc, values, at)
                if slots is not None:
                    return found, self.counts[n], found / self.counts[n], "re-parameterised" if slots[1] else "verbatim", *slots
        return None

    def _named(self, item: Template, doc: Template, values: list[str], p: int, d: int) -> bool:
        """Whether two tokens agree only if a word that opens a sentence is a name."""
        if item.opens[p] or doc.opens[d]:
            return NAME in (item.kinds[p], doc.kinds[d]) or item.value(p, self.values) != doc.value(d, values)
        return False

    def _literal(self, item: Template, doc: Template, values: list[str], at: dict[int, int]) -> dict[int, int]:
        """The windows found that read no opening word as a name."""
        width = _window_width(len(item))
        return {q: s for q, s in at.items() if not any(self._named(item, doc, values, p, p + s) for p in range(q, q + width))}

    def _aligned(self, lines: dict[int, set[int]], band: list[int]) -> dict[int, int]:
        """The diagonal of each window found in a band: the one before goes on where it can, else the nearest."""
        shift, ways = max(band, key=lambda s: len(lines[s])), {}
        for s in band:
            for q in lines[s]:
                ways.setdefault(q, []).append(s)
        at = {}
        for q in sorted(ways):
            shift = at[q] = min(ways[q], key=lambda s: abs(s - shift))
        return at

    def _holds(self, item: Template, at: dict[int, int]) -> bool:
        """Whether the windows found hold enough tokens."""
        width = _window_width(len(item))
        held = len({p for q in at for p in range(q, q + width)})
        return held >= max(LEAST_RUN, LEAST_COVER * len(item))

    def _run(self, item: Template, doc: Template, values: list[str], shift: int) -> int:
        """The most words on end that item and document share on a diagonal."""
        most = run = 0
        for p in range(max(0, -shift), min(len(item), len(doc) - shift)):
            same = item.value(p, self.values) == doc.value(p + shift, values)
            run = run + int(item.starts[p + 1] - item.starts[p]) if same else 0
            most = max(most, run)
        return most

    def _slots(self, item: Template, doc: Template, values: list[str], at: dict[int, int]) -> tuple[int, int] | None:
        """Slots of the aligned part and how many have another value; None if their values contradict each other."""
        width, there, back, changed, total = _window_width(len(item)), {}, {}, 0, 0
        spots: dict[int, int] = {}
        for q, shift in at.items():
            for p in range(q, q + width):
                spots.setdefault(p, p + shift)
        for p, d in sorted(spots.items()):
            named = self._named(item, doc, values, p, d)
            if item.kinds[p] == LITERAL and not named:
                continue
            kind, ours, theirs = NAME if named else int(item.kinds[p]), item.value(p, self.values), doc.value(d, values)
            total += 1
            changed += ours != theirs
            pairs = zip((NUMBER, UNIT), _PARTS.fullmatch(ours).groups(), _PARTS.fullmatch(theirs).groups()) if kind == NUMBER else [(kind, ours, theirs)]
            for part, a, b in pairs:
                if not a or not b:
                    continue
                if there.setdefault((part, a), b) != b or back.setdefault((part, b), a) != a:
                    return None
        return total, changed


class _Task:
    """Templates with a task's own numbers of words, which start anew beyond a bound."""

    def __init__(self) -> None:
        self.words = Words()

    def templates(self, texts: list[str | None]) -> tuple[list[list[Template]], list[str]]:
        if len(self.words) > KEPT_WORDS:
            self.words = Words()
        return templates(texts, self.words), self.words.value


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item (a hash of its text), template, place and hash of each window of an item that is literal enough."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
            found, _ = task.templates(batch.column(1).to_pylist())
            for item, ts in zip(batch.column(0).to_pylist(), found):
                for n, t in enumerate(ts):
                    usable = usable_windows(t)
                    width = _window_width(len(t))
                    for place, hashed in readings(t, width) if usable.any() else ():
                        kept = usable[place]
                        out.append((np.full(kept.sum(), item), np.full(kept.sum(), n), place[kept], widened(hashed[kept], width).view(np.int64)))
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "ti", "q", "window"])

    return items.select("item", "text").mapInArrow(cut, "item long, ti long, q long, window long")


def sieve_of(windows: DataFrame) -> tuple[int, np.ndarray]:
    """A power of two and as many bits, set where the table has a window; of bounded size."""
    bits = min(SIEVE_MOST, max(12, SIEVE_SHARE + windows.count().bit_length()))
    place = F.shiftrightunsigned("window", 64 - bits)
    word = F.shiftright(place, 6).alias("word")
    rows = windows.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(window, {64 - bits}) & 63 as int))")).alias("set")).collect()
    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    for r in rows:
        out[r["word"]] = np.int64(r["set"]).view(np.uint64)
    return bits, np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def hits_of(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """th (hash of a text), template and place of each window of a text that a benchmark item has, with the item's."""
    held = docs.sparkSession.sparkContext.broadcast(sieve_of(windows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (bits, sieve) = _Task(), held.value
        for batch in batches:
            ths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
                found, _ = task.templates(texts[at : at + 500])
                for th, ts in zip(ths[at : at + 500], found):
                    for n, t in enumerate(ts):
                        for width in widths:
                            for place, hashed in readings(t, width):
                                hashed = widened(hashed, width)
                                some = np.flatnonzero(sieve[hashed >> np.uint64(64 - bits)])
                                if len(some):
                                    out.append((np.full(len(some), th), np.full(len(some), n), place[some], hashed[some].view(np.int64)))
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["th", "td", "p", "window"])

    sieved = docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(search, "th long, td long, p long, window long")
    return sieved.join(small_side(windows), "window").select("th", "td", "p", "item", "ti", "q")


def leaks_by_text(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each text (th, its hash) and item (a hash of its text) that leaked into it."""
    items = benchmark.where("text is not null").select(F.xxhash64("text").alias("item"), "text").distinct()
    items = written(items, "items")
    windows = written(benchmark_windows(items), "windows")
    sizes = written(items.mapInPandas(_widths, "width int"), "widths").distinct().collect()  # at most WIDTH rows
    hits = hits_of(docs, windows, sorted(r["width"] for r in sizes))
    hits = written(hits.groupBy("th", "item").agg(F.collect_set(F.struct("ti", "q", "td", "p")).alias("hits")), "hits")
    ths = written(hits.select("th").distinct(), "ths")
    texts = docs.select(F.xxhash64("text").alias("th"), "text").join(small_side(ths), "th").groupBy("th").agg(F.first("text").alias("text"))
    rows = hits.join(small_side(items.select("item", F.col("text").alias("question"))), "item").join(written(texts, "found-texts"), "th")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, last, out = _Task(), None, []
            for th, item, hits, question, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words = Words()
                pair = Pair(templates([question], words)[0], words.value)
                if last is None or last[0] != th:
                    found, values = task.templates([text])
                    last = th, found[0], values
                one = pair.leak(last[1], last[2], ((h["ti"], h["q"], h["td"], h["p"]) for h in hits))
                if one:
                    out.append((th, item, *one))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
            cols = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in LEAKS.split(", ")])

    out = written(rows.select("th", "item", "hits", "question", "text").mapInArrow(judge, LEAKS), "leaks")
    discard(windows, hits, ths)
    return out


def _widths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task = _Task()
    for batch in batches:
        found, _ = task.templates(batch["text"].tolist())
        yield pd.DataFrame({"width": sorted({_window_width(len(t)) for ts in found for t in ts if usable_windows(t).any()})})


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that leaked into it."""
    found = leaks_by_text(docs, benchmark)
    ids = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item")).distinct()
    named = written(found.join(ids, "item"), "named-leaks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).join(small_side(named), "th")
    return rows.select("doc_id", "item_id", "n_windows", "n_item_windows", "cover", "kind", "n_slots", "n_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    gone = written(leaks_by_text(docs, benchmark).select(F.col("th").alias("_th")).distinct(), "gone")
    return docs.join(small_side(gone), F.xxhash64(docs["text"]) == gone["_th"], "left_anti")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
