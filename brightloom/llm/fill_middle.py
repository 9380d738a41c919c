"""Operator 12: fill-in-middle transformation from an Aho-Corasick scan for sparse events.

One automaton of the six ASCII white space characters and the three sentinels goes over a text. Units are runs of
white space with the word behind them, and a last run without one. Between two white space events lies a word exactly
if they leave a gap, so the events alone give all units: the word's unit ends where the gap does, the number of gaps is
the number of words, and the end of unit k is a look-up among the gaps. Words are never cut out.

A text is split behind two units that hash digits of `seed:doc_id` choose, and written as prefix, suffix and middle
between sentinels (psm), as suffix first (spm), or left plain. `restored` makes the text again of output and form.

Defined cases: a null text is treated as an empty one, which stays plain; a text with a sentinel stays plain; a null
doc_id is hashed as no digits; repeated rows are each transformed, alike; n = 0, or cuts at either end, make empty
parts; texts of any length are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SPACES = " \t\n\v\f\r"
#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Texts looked at at a time.
TEXTS = 256


@lru_cache(8)
def automaton(sentinels: tuple[str, ...]):
    """White space events carry 0 and sentinels carry 1."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for c in SPACES:
        out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, 1)
    out.make_automaton()
    return out


def unit_ends(text: str, sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, bool]:
    """Ends of the text's units, and whether it holds a sentinel."""
    events = list(automaton(sentinels).iter(text)) if text else []
    held = any(kind for _, kind in events) if "<" in text else False
    spaces = np.fromiter((at for at, kind in events if not kind), np.int64) if held else np.fromiter((at for at, _ in events), np.int64, len(events))
    spaces = np.append(spaces, len(text))  # the end closes the last word
    gaps = np.diff(spaces, prepend=-1) > 1
    ends = spaces[gaps]
    if text and (not len(ends) or ends[-1] < len(text)):  # white space without a word behind
        ends = np.append(ends, len(text))
    return ends, held


def draws(doc_id: object, seed: int) -> list[int]:
    """Four unsigned numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def transformed(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n units, form (plain, psm, spm), prefix_chars, middle_chars and the output text.

    Of texts without a sentinel, `rate` in a hundred are transformed, and of these `spm_rate` in a hundred start with
    the suffix. Sentinels must begin with < and end with >, with neither between, so that a cut can't make one.
    """
    if any(len(s) < 3 or s[0] != "<" or s[-1] != ">" or set(s[1:-1]) & {"<", ">"} for s in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must be three different strings like <P>")
    before, behind, between = sentinels

    def one(doc_id: object, text: str) -> tuple:
        ends, held = unit_ends(text, sentinels)
        n = len(ends)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not text or held or h3 % 100 >= rate:
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, f"{behind}{suffix}{before}{prefix}{between}{middle}"
        return n, "psm", a, b - a, f"{before}{prefix}{behind}{suffix}{between}{middle}"

    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                rows = [one(i, t or "") for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([some.column(0), *made], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(df: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df with `restored`, the text that its output and form stand for."""
    before, behind, between = sentinels
    out = F.col("output")
    middle = F.substring_index(out, between, -1)
    head = F.substring_index(out, between, 1)
    first, last = (F.substring_index(F.substring_index(head, mark, -1), other, 1) for mark, other in ((before, behind), (behind, before)))
    return df.withColumn("restored", F.when(F.col("form") == "plain", out).otherwise(F.concat(first, middle, last)))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restored(transformed(read(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
