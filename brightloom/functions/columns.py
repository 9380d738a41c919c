"""Scalar functions as columns: built-ins only, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Z90 = 1.6449
Z95 = 1.95996
#: Languages written without spaces between words: their length counts in characters.
UNSPACED = ("schinese", "tchinese", "japanese", "thai")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole; null, never 0, where whole is 0 or null."""
    return F.when(col(whole) > 0, col(part).cast("double") / col(whole))


def wilson(positive: Column | str, n: Column | str, z: float = Z90) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, cut to 0..1; null for n = 0."""
    x, m = col(positive).cast("double"), col(n).cast("double")
    share, zz = x / m, z * z
    middle = share + zz / (2 * m)
    spread = z * F.sqrt(share * (1 - share) / m + zz / (4 * m * m))
    low, high = (middle - spread) / (1 + zz / m), (middle + spread) / (1 + zz / m)
    some = col(n) > 0  # outside, as greatest() passes over null
    return F.when(some, F.greatest(F.lit(0.0), low)), F.when(some, F.least(F.lit(1.0), high))


def newcombe(x1: Column | str, n1: Column | str, x0: Column | str, n0: Column | str, z: float = Z90) -> tuple[Column, Column]:
    """Hybrid score interval of the difference x1/n1 - x0/n0; null if either n is 0."""
    p1, p0 = ratio(x1, n1), ratio(x0, n0)
    (l1, h1), (l0, h0) = wilson(x1, n1, z), wilson(x0, n0, z)
    d = p1 - p0
    return d - F.sqrt((p1 - l1) ** 2 + (h0 - p0) ** 2), d + F.sqrt((h1 - p1) ** 2 + (p0 - l0) ** 2)


def bucket_of_minutes(minutes: Column | str) -> Column:
    """Groups of play time; null stays null."""
    m = col(minutes)
    # fixed values: upper bounds in minutes and names
    steps = ((120, "lt_2h"), (600, "2h_10h"), (3000, "10h_50h"), (12000, "50h_200h"))
    out = F.when(m.isNull(), F.lit(None).cast("string"))
    for below, name in steps:
        out = out.when(m < below, name)
    return out.otherwise("200h_plus")


def word_count(text: Column | str) -> Column:
    """Spaces plus one, after line breaks became spaces and the ends were trimmed; runs of spaces count."""
    t = F.trim(F.regexp_replace(col(text), "[\r\n]", " "))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def long_enough(text: Column | str, language: Column | str, chars: int = 40, words: int = 20, unspaced: tuple[str, ...] = UNSPACED) -> Column:
    dense = col(language).isin(*unspaced)
    return F.when(dense, F.length(col(text)) >= chars).otherwise(word_count(text) >= words)


def in_holdout(key: Column | str, fraction: float = 0.2) -> Column:
    """The first byte of the SHA-256 of the key as decimal text, against fraction of 256."""
    first = F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, 2), 16, 10)
    return first.cast("int") < int(fraction * 256)


def date_key(day: Column | str) -> Column:
    return F.date_format(col(day), "yyyyMMdd").cast("int")


def day_of_key(key: Column | str) -> Column:
    k = col(key)
    return F.make_date(F.floor(k / 10000).cast("int"), F.floor(k / 100).cast("int") % 100, k % 100)


def fingerprint(*fields: Column | str, charset: str = "UTF-16LE") -> Column:
    """SHA-256 of the fields joined by a bar; null counts as empty, booleans as 1 and 0."""
    parts = F.concat_ws("|", *[F.coalesce(col(f).cast("string"), F.lit("")) for f in fields])
    return F.sha2(F.encode(parts, charset), 256)


def evidence_fingerprint(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*[col(p) for p in parts]), {"ignoreNullFields": "false"}), 256)


# Markup tags.
_BLOCK_TAGS = r"(?i)\[/?(?:h1|h2|h3|list|olist|\*|quote|code|table|tr|th|td|hr|previewyoutube)(?:=[^\]]*)?\]"
_INLINE_TAGS = r"(?i)\[/?(?:b|i|u|strike|spoiler|noparse|url|img)(?:=[^\]]*)?\]"


def clean_text(text: Column | str, most: int = 2000) -> Column:
    """Line breaks unified, block tags to line breaks, inline tags away, links to <url>, blanks and empty lines squeezed,
    cut at the last space in the second half of `most` characters. Combining forms: see nfc()."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(t, _BLOCK_TAGS, "\n")
    t = F.regexp_replace(t, _INLINE_TAGS, "")
    t = F.regexp_replace(t, r"(?i)(?:https?://|www\.)\S+", "<url>")
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    t = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    head = F.substring(t, 1, most)
    back = most - F.least(F.instr(F.reverse(F.translate(head, "\n", " ")), " "), F.lit(most))
    spaced = F.instr(F.translate(head, "\n", " "), " ") > 0
    short = F.when(spaced & (back >= most // 2), F.rtrim(F.substr(head, F.lit(1), back))).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(short)


def plain_notes(html: Column | str, most: int = 400) -> tuple[Column, Column]:
    """Text of release notes without markup, cut; and whether it was cut."""
    t = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    t = F.regexp_replace(t, r"\{[A-Z_]+\}\S*", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.substring(t, 1, most), F.length(t) > most


def escaped_markdown(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"([\\`*_{}\[\]()#+!|<>~-])", r"\\$1")


def spaced_words(text: Column | str) -> Column:
    """Lower-cased words with one blank between, punctuation as blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def words(text: Column | str) -> Column:
    """Lower-cased words, punctuation as blank."""
    return F.filter(F.split(spaced_words(text), " "), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often and inside whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def shingles(word_array: Column, n: int = 8) -> Column:
    """Distinct runs of n words, joined by a space; none for shorter texts."""

    def runs(w: Column) -> Column:
        last = F.size(w) - n + 1
        each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return bound(word_array, runs)


def share_words_run(a: Column | str, b: Column | str, n: int = 8) -> Column:
    return F.arrays_overlap(shingles(words(a), n), shingles(words(b), n))


def holds_quote(quote: Column | str, text: Column | str) -> Column:
    def squeezed(c: Column | str) -> Column:
        return F.trim(F.regexp_replace(col(c), r"\s+", " "))

    return F.contains(squeezed(text), squeezed(quote))


# What names things and states no value, and what stands behind a number that is a length of time.
LABELS = (
    r"(?i)\b\d{4}-\d{2}-\d{2}\b|\bhorizons?\s+\d+\b|\b(?:v|ver\.?|version)\s*\d+(?:\.\d+)*[a-z0-9]*|\b\d+(?:\.\d+){2,}[a-z0-9]*|\bs\d+\.\d+\b"
    r"|\b(?:patch|update|hotfix|season)\s+\d+(?:\.\d+)?\b(?!\s*(?:%|percent|points?|pp\b|reviews?))|\b\d+(?:\.\d+)?(?=\s*(?:patch|update|hotfix)\b)"
    r"|\b\d+\s*(?:-|to|and)\s*\d+\s*\+?\s*(?:h|hrs?|hours?)\b|\b\d+\s*\+?\s*(?:h|hrs?|hours?)\b(?:\s*plus)?"
)
SPANS = r"\s*-?\s*(?:days?\b|weeks?\b|%\s(?:range|interval)\b|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b)"
NUMBER = rf"(?<![\w.])((?>\d{{1,3}}(?:,\d{{3}})+|\d++)(?:\.\d++)?+)(?!(?i:{SPANS}))"


def stated_numbers(text: Column | str) -> Column:
    """Numbers a sentence states, as (value, decimals): not dates, years 1990 to 2100, lengths of time or versions."""
    found = F.regexp_extract_all(F.regexp_replace(col(text), LABELS, " "), F.lit(NUMBER), 1)
    each = F.transform(
        found,
        lambda x: F.struct(
            F.replace(x, F.lit(","), F.lit("")).cast("double").alias("value"),
            F.when(F.contains(x, F.lit(".")), F.length(F.substring_index(x, ".", -1))).otherwise(0).alias("decimals"),
        ),
    )
    return F.filter(each, lambda v: ~((v["decimals"] == 0) & v["value"].between(1990, 2100)))


def is_rounding_of(stated: Column, decimals: Column, actual: Column | str) -> Column:
    return F.abs(stated - F.abs(col(actual))) <= 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9


def parsed_labels(cell: Column | str, known: list[str]) -> Column:
    """A bar-separated cell as array in the known order; `none` is empty; an unknown label raises."""
    given = F.filter(F.transform(F.split(F.coalesce(col(cell), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: ~x.isin("", "none"))
    strange = F.array_except(given, F.array(*map(F.lit, known)))
    checked = F.filter(F.array(*map(F.lit, known)), lambda k: F.array_contains(given, k))
    return F.when(F.size(strange) == 0, checked).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.array_join(strange, ", "))).cast("array<string>"))


def label_cell(labels: Column | str) -> Column:
    return F.when(F.size(col(labels)) == 0, "none").otherwise(F.array_join(col(labels), "|"))


def list_parts(text: Column | str, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(col(text), separator), lambda x: F.trim(x)), lambda x: x != "")


def calendar(day: Column | str) -> dict[str, Column]:
    d = col(day)
    return {
        "date_key": date_key(d),
        "iso_week": F.weekofyear(d),
        "day_of_week": F.weekday(d) + 1,
        "month": F.month(d),
        "year": F.year(d),
    }


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a naive UTC time; the session's zone must be UTC."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def next_local_midnight(ts: Column | str, zone: str = "America/Los_Angeles") -> Column:
    local = F.from_utc_timestamp(col(ts).cast("timestamp"), zone)
    return F.to_utc_timestamp(F.date_add(F.to_date(local), 1).cast("timestamp"), zone)


def first_date(text: Column | str, formats: tuple[str, ...] = ("d MMM, yyyy", "MMM d, yyyy", "MMM yyyy", "yyyy-MM-dd")) -> Column:
    """The first of the formats that reads the text, as a date."""
    return F.coalesce(*[F.try_to_timestamp(col(text), F.lit(f)) for f in formats]).cast("date")


def window_iou(start_a: Column | str, end_a: Column | str, start_b: Column | str, end_b: Column | str) -> Column:
    """Overlap over union of two windows of days, ends included."""
    a0, a1, b0, b1 = map(col, (start_a, end_a, start_b, end_b))
    both = F.greatest(F.datediff(F.least(a1, b1), F.greatest(a0, b0)) + 1, F.lit(0))
    union = F.datediff(a1, a0) + 1 + F.datediff(b1, b0) + 1 - both
    return both / union


def normalised_question(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def retry_delay(attempt: Column | str, base: float = 1.0, most: float = 60.0) -> Column:
    """Capped exponential: the upper half of the wait is drawn by the caller."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), col(attempt)))
