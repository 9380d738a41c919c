"""Operator 7: secrets by patterns, and by what they add to a compressor primed with their surroundings.

Candidates are unbroken strings of LEAST characters and more within REACH of a sensitive word, on either side of it and
over line breaks; what they are made of plays no part. A zstandard compressor is primed with a dictionary of
identifiers and the code around the candidate; the bytes a candidate adds to that text, against its length, are its
novelty. Prose, paths and known identifiers add little; keys add nearly all they have. The identifier dictionary holds
fixed programming words and the names most often assigned to anywhere in the corpus, counted over all documents.

What is novel is calibrated: all strings of the same documents far from any sensitive word are measured alike, counted by
length class over the corpus, and the cut of a class is what at most FALSE_SHARE of them reach, but LEAST_NOVELTY at
least, which alone counts where fewer than ENOUGH different strings are controls: a word again says nothing new.

Every text is scanned from left to right: a string near several sensitive words is one candidate. Texts are scanned once
for candidates and names, and once more for controls, which are many and so aren't written.

Defined cases: null and empty texts have no spans; repeated rows are each reported and each counted; equal spans of
several kinds are all listed; a candidate that overlaps a base span is none; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_id, written
from .spans import Cover, Span, digest, listed

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A run of 32 covers eight neighbours among every fourth character.
_SPARSE_HEX = re.compile(r"[0-9a-f]{8}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make what follows sensitive.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "auth", "bearer", "private_key", "access_key", "session_id", "signature")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE)
LEAST = 8
#: A string has a letter or digit on both ends; quotes, brackets and full stops around it aren't its own.
_STRING = re.compile(r"(?<![A-Za-z0-9+/_.=~-])[A-Za-z0-9+/_.=~-]{%d,}+" % LEAST)
_NAME = re.compile(r"""([A-Za-z_][A-Za-z0-9_]{2,63})["']?\x20*[:=]""")
#: Words of source code.
CODE_WORDS = "import return function class public private static void const string integer boolean true false null none self this config settings environment variable default value user name email address host port database connection server client request response header content type application json http https www com org localhost username login session account service version".split()
REACH = 80
AROUND = 384
LEVEL = 12
DICTIONARY_NAMES = 2000
FALSE_SHARE, ENOUGH = 0.001, 2000
#: Length classes begin at these lengths.
CLASSES = (8, 10, 12, 16, 24, 40)
#: Least cut of each class: short strings of any kind add about all they have, so few of them can be told.
LEAST_NOVELTY = (1.3, 1.2, 1.0, 0.62, 0.62, 0.55)
BINS = 100
SCANNED = "doc_id string, base array<struct<kind:string,start:int,end:int>>, found array<struct<start:int,end:int,text:string,around:string>>, names array<string>"


def base_spans(text: str) -> list[Span]:
    low, out = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if _SPARSE_HEX.search(text[::4]):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def strings(text: str, cover: Cover) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Candidates, and strings of the same text out of reach of any sensitive word."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return [], []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    near: list[tuple[int, int]] = []
    far: list[tuple[int, int]] = []
    at = 0
    for m in _STRING.finditer(text):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] in ".-=~+/":
            b -= 1
        if b - a < LEAST or not cover.free(a, b) or _SENSITIVE.fullmatch(text, a, b):
            continue
        while at < len(words) and words[at][1] + REACH < a:
            at += 1
        if at < len(words) and words[at][0] - REACH <= b:
            near.append((a, b))
        else:
            far.append((a, b))
    return near, far


def length_class(n: int) -> int:
    return bisect_right(CLASSES, n) - 1


def cuts_of(counts: dict[tuple[int, int], int], different: dict[int, int] | None = None) -> list[float]:
    """The cut of each length class, from controls counted by (class, bin of novelty); different ones by class, if some
    are equal."""
    out: list[float] = []
    for k, least in enumerate(LEAST_NOVELTY):
        tally = [counts.get((k, b), 0) for b in range(2 * BINS)]
        total, above, cut = sum(tally), 0, 2 * BINS
        if (total if different is None else different.get(k, 0)) < ENOUGH:
            out.append(least)
            continue
        while cut and above + tally[cut - 1] <= FALSE_SHARE * total:
            cut -= 1
            above += tally[cut]
        out.append(max(least, cut / BINS))
    return out


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor primed with the dictionary, which takes its time to read: one for a task."""
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, around: str, pack: zstandard.ZstdCompressor) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its own."""
    raw = around.encode()
    return (len(pack.compress(raw + candidate.encode())) - len(pack.compress(raw))) / len(candidate.encode())


def surroundings(text: str, a: int, b: int) -> str:
    return text[max(0, a - AROUND) : a] + text[b : b + AROUND]


def scanned(docs: DataFrame) -> DataFrame:
    """Base spans, candidates with their surroundings, and assigned names, for each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, found, names = [], [], []
            for text in batch["text"]:
                text = text or ""
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                near, _ = strings(text, Cover(spans))
                found.append([{"start": a, "end": b, "text": text[a:b], "around": surroundings(text, a, b)} for a, b in near])
                names.append([m[1] for m in _NAME.finditer(text)] if "=" in text or ":" in text else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": base, "found": found, "names": names})

    return docs.select(text_id("doc_id"), "text").mapInPandas(scan, SCANNED)


def dictionary_of(scan: DataFrame, most: int = DICTIONARY_NAMES) -> bytes:
    """Code words and the names assigned most often, the most frequent last, where the compressor finds them soonest."""
    counts = scan.select(F.explode("names").alias("name")).groupBy("name").count()
    top = counts.orderBy(F.col("count").desc(), "name").limit(most).collect()
    return " ".join([*CODE_WORDS, *(r["name"] for r in reversed(top))]).encode()


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every row of docs."""
    scan = written(scanned(docs), "secrets")
    raw = dictionary_of(scan)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts by class and bin; in bin -1 hashes of different strings, as many of a class as are enough."""
        pack, counts, seen = compressor(raw), Counter(), [set() for _ in CLASSES]
        for batch in batches:
            for text in batch["text"]:
                _, far = strings(text, Cover(base_spans(text)))
                for a, b in far:
                    bin_ = min(2 * BINS - 1, max(0, int(novelty(text[a:b], surroundings(text, a, b), pack) * BINS)))
                    k = length_class(b - a)
                    counts[k, bin_] += 1
                    if len(seen[k]) < ENOUGH:
                        seen[k].add(xxhash.xxh3_64_intdigest(text[a:b].encode()) >> 1)
        rows = [(k, b, n) for (k, b), n in counts.items()] + [(k, -1, h) for k, hashes in enumerate(seen) for h in hashes]
        yield pd.DataFrame(rows, columns=["k", "b", "n"]).astype("int64")

    found = docs.where("text is not null").select("text").mapInPandas(measure, "k long, b long, n long")
    told = F.col("b") >= 0
    tally = found.groupBy("k", "b").agg(F.sum(F.when(told, F.col("n"))).alias("n"), F.count_distinct(F.when(~told, F.col("n"))).alias("different")).collect()  # classes x bins rows at most
    cuts = cuts_of({(r["k"], r["b"]): r["n"] for r in tally if r["b"] >= 0}, {r["k"]: r["different"] for r in tally if r["b"] < 0})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = compressor(raw)
        for batch in batches:
            rows = []
            for doc_id, base, found in zip(batch["doc_id"], batch["base"], batch["found"]):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                more = [("novel", s["start"], s["end"]) for s in found if novelty(s["text"], s["around"], pack) > cuts[length_class(len(s["text"]))]]
                kinds = [s[0] for s in spans]
                rows.append((doc_id, *map(kinds.count, KINDS[:3]), len(more), digest(listed(spans, KINDS)), listed(spans + more, KINDS)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    judged = scan.select("doc_id", "base", "found").mapInPandas(
        judge, "doc_id string, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    )
    return judged.withColumn("doc_id", F.col("doc_id").cast("long"))


def op7_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))
