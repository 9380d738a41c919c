"""Operator 3: personal data by labelers that vote, expectation-maximisation, and a span classifier.

Candidates are the matches of the base patterns, and looser ones: numbers that miss a check, cards, phones and addresses
that a base match swallowed with their neighbours, phones without +, emails in words, national numbers, bank accounts,
and names. Each labeler votes for, against or not at all: the strict pattern, a checksum, gazetteers (top-level
domains, card issuers, country codes, given names), words in the context before, the usual shape, and whether the span
stands free. Candidates are counted by kind and votes, which gives a table of bounded size; expectation-maximisation
over it estimates how reliable each labeler is and how likely each pattern is personal data. Those soft labels train a
logistic classifier on TRAINED spans (those with the smallest hashes; all, if there are fewer), which sees the span as
well: its shape, its length and the words around it, hashed. It decides on candidates outside base spans.

All scans are linear in the text: no pattern starts inside a run that it would read again.

Defined cases: null and empty texts have no spans; repeated rows are each reported and each counted; of candidates that
overlap, the better shaped stays, then the earlier, then the longer; with no candidates at all nothing is added; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_id, written
from .spans import Cover, Span, digest, listed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "iban", "name")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: No match starts inside a run of digits: it would end as the one from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BARE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_FREE_CARD = re.compile(r"(?<![0-9.])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_FREE_PHONE = re.compile(r"\+[0-9]{1,3}[\x20-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_FREE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")
_NAME = re.compile(r"\b[A-Z][a-z]{1,15}\.?\x20[A-Z][a-z]{1,20}\b")
#: Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl".split())
CARD_PREFIXES = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
COUNTRY_CODES = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
GIVEN_NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah Hans Klaus Jürgen Petra Sabine Pierre Jean Marie Claire Luc Carlos Lucía Javier Carmen Juan".split())
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme".split())
#: Context words for and against.
FOR_WORDS = re.compile(r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|e-?mail|mail|contact|write|reach|card|visa|mastercard|amex|credit|debit|account|iban|bank|ssn|social|passport|ip|host|server|address|login|from|to|by|of|dear|name|named|signed)\b")
AGAINST_WORDS = re.compile(r"(?i)\b(?:order|invoice|isbn|version|release|build|item|sku|part|serial|page|section|chapter|ticket|figure|table|line|model)\b")
CONTEXT = 40
LABELERS = 6
TRAINED = 20_000
#: Buckets of hashed words and shapes.
BUCKETS = 256
ROUNDS = 60
FOUND = "doc_id string, found array<struct<kind:string,start:int,end:int,base:boolean,votes:string,seen:array<int>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def in_byte(digits: str) -> bool:
    """Whether a number, however long, is at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def emails(text: str) -> list[Span]:
    """Leftmost matches: an @ with the whole run of local characters before it, back to the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", m.start(), m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_and_missed(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and matches of the base patterns that fail their check."""
    base, missed = emails(text), []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (base if all(in_byte(p) for p in m[0].split(".")) else missed).append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 12 <= len(digits) <= 19:
                (base if luhn(digits) else missed).append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    base.append(("phone", m.start(), m.end()))
    return base, missed


def looser(text: str) -> list[Span]:
    """Well-shaped spans that base matches may have missed."""
    out = []
    if _DIGIT.search(text):
        shapes = (("card", _FREE_CARD), ("phone", _FREE_PHONE), ("ip", _FREE_IP), ("phone", _BARE_PHONE), ("national_id", _NATIONAL), ("iban", _IBAN))
        out += [(kind, m.start(), m.end()) for kind, pattern in shapes for m in pattern.finditer(text)]
    if "at]" in text or "at)" in text:
        out += [("email", m.start(), m.end()) for m in _SPELT_EMAIL.finditer(text)]
    for m in _NAME.finditer(text):
        first = m[0].split(" ")[0].rstrip(".")
        if first in GIVEN_NAMES or first in TITLES:
            out.append(("name", m.start(), m.end()))
    return out


def found_in(text: str) -> list[tuple[Span, bool]]:
    """Base spans, and candidates outside them."""
    base, missed = base_and_missed(text)
    cover = Cover(base)
    out = [(s, True) for s in base]
    for some in (looser(text), missed):
        for s in sorted(some, key=lambda s: (s[1], -s[2])):
            if cover.free(s[1], s[2]):
                cover.add(s[1], s[2])
                out.append((s, False))
    return out


def seen_in(text: str, span: Span) -> list[int]:
    """Buckets of what the classifier sees of a span: its shape and length, and the words before and behind it."""
    kind, a, b = span
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", text[a : min(b, a + 40)]))
    before, behind = text[max(0, a - CONTEXT) : a].lower().split()[-2:], text[b : b + CONTEXT].lower().split()[:1]
    marks = [f"shape {kind} {shape}", f"size {kind} {min(b - a, 64) // 4}", *(f"before {w}" for w in before), *(f"behind {w}" for w in behind)]
    return sorted({zlib.crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marks})


def votes(text: str, span: Span, is_base: bool) -> str:
    """A character for each labeler: + for, - against, 0 no vote."""
    kind, a, b = span
    found, before = text[a:b], text[max(0, a - CONTEXT) : a]
    digits = re.sub(r"[^0-9]", "", found)
    strict = "+" if is_base else "-" if kind in ("card", "ip") else "0"
    check = "0"
    if kind == "card":
        check = "+" if luhn(digits) else "-"
    elif kind == "iban":
        moved = found[4:] + found[:4]
        check = "+" if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else "-"
    known = "0"
    if kind == "email":
        known = "+" if re.split(r"[.\]) ]+", found.lower())[-1] in TOP_DOMAINS else "0"
    elif kind == "card":
        known = "+" if CARD_PREFIXES.match(digits) else "-"
    elif kind == "name":
        known = "+"  # candidates begin with a given name or a title
    elif kind == "phone" and found[0] == "+":
        known = "+" if COUNTRY_CODES.match(digits) else "-"
    context = "+" if FOR_WORDS.search(before) else "-" if AGAINST_WORDS.search(before) else "0"
    usual = True
    if kind in ("email", "iban"):
        usual = 15 <= len(found) <= 64 if kind == "iban" else len(found) <= 64
    elif kind == "ip":
        usual = all(p == "0" or p[0] != "0" for p in found.split("."))
    elif kind == "card":
        usual = len(digits) in (15, 16)
    elif kind == "phone":
        usual = 10 <= len(digits) <= 13
    elif kind == "national_id":
        usual = digits[:3] not in ("000", "666") and digits[0] != "9"
    free = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
    return strict + check + known + context + "-+"[usual] + "-+"[free]


def candidates_of(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                rows.append([
                    {"kind": s[0], "start": s[1], "end": s[2], "base": is_base, "votes": votes(text, s, is_base), "seen": seen_in(text, s)}
                    for s, is_base in found_in(text)
                ])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "found": rows})

    return docs.select(text_id("doc_id"), "text").mapInPandas(scan, FOUND)


def reliabilities(ballots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over distinct ballots (rows of -1, 0, 1) with counts.

    Returns each ballot's probability of being personal data, each labeler's probabilities of its votes given the
    class (labeler x class x vote), and the share of the class.
    """
    p = np.clip(0.5 + 0.12 * ballots.sum(axis=1), 0.05, 0.95)
    rates = np.zeros((ballots.shape[1], 2, 3))
    share = 0.5
    # before any data, a labeler that votes is right three times in four
    prior = 4.0 * np.array([[0.45, 0.40, 0.15], [0.15, 0.40, 0.45]])
    for _ in range(ROUNDS):
        share = float((p * counts).sum() + 1) / (counts.sum() + 2)
        for k in range(ballots.shape[1]):
            for c, weight in enumerate(((1 - p) * counts, p * counts)):
                tally = np.bincount(ballots[:, k] + 1, weights=weight, minlength=3) + prior[c]
                rates[k, c] = tally / tally.sum()
        log = np.log([1 - share, share]) + sum(np.log(rates[k][:, ballots[:, k] + 1]).T for k in range(ballots.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p, rates, share


def span_features(kinds: list[str], ballots: np.ndarray, seen: list[list[int]]) -> np.ndarray:
    """Votes for and against, the kind, the kind with its context vote, and what is seen of the span."""
    kind = np.array([[k == x for x in KINDS] for k in kinds], float).reshape(-1, len(KINDS))
    marks = np.zeros((len(kinds), BUCKETS))
    for row, buckets in zip(marks, seen):
        row[buckets] = 0.5
    return np.hstack([ballots == 1, ballots == -1, kind, kind * ballots[:, 3:4], marks, np.ones((len(ballots), 1))])


def trained(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights for soft labels by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - soft)) + ridge * w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return w


def ballots_of(votes_column: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in v] for v in votes_column], np.int64).reshape(-1, LABELERS)


def label_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every row of docs."""
    found = written(candidates_of(docs), "personal")
    each = found.select(F.explode("found").alias("f"))
    patterns = each.groupBy("f.kind", "f.votes").count().orderBy("kind", "votes").collect()  # at most kinds x 3^labelers
    weights = None
    if patterns:
        kinds, seen = [r["kind"] for r in patterns], [r["votes"] for r in patterns]
        ballots, counts = ballots_of(seen), np.array([r["count"] for r in patterns], float)
        soft = dict(zip(zip(kinds, seen), reliabilities(ballots, counts)[0].tolist()))
        order = F.xxhash64("f", "doc_id")
        some = found.select("doc_id", F.explode("found").alias("f")).orderBy(order, "f").limit(TRAINED).select("f.kind", "f.votes", "f.seen").collect()
        x = span_features([r["kind"] for r in some], ballots_of([r["votes"] for r in some]), [r["seen"] for r in some])
        weights = trained(x, np.array([soft[r["kind"], r["votes"]] for r in some]), np.ones(len(some)))

    def accepted(spans: list) -> list[bool]:
        """Whether the classifier takes each of the candidates for personal data."""
        if not spans:
            return []
        x = span_features([s["kind"] for s in spans], ballots_of([s["votes"] for s in spans]), [list(s["seen"]) for s in spans])
        return (x @ weights >= 0).tolist()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, spans in zip(batch["doc_id"], batch["found"]):
                base = [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]]
                loose = [s for s in spans if not s["base"]]
                more = [(s["kind"], s["start"], s["end"]) for s, good in zip(loose, accepted(loose)) if good]
                kinds = [s[0] for s in base]
                rows.append((doc_id, *map(kinds.count, BASE), len(more), digest(listed(base, KINDS)), listed(base + more, KINDS)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE), "n_added", "base_sha256", "spans"])

    judged = found.mapInPandas(
        judge, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    )
    return judged.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(read(spark, sf_dir, "documents"))
