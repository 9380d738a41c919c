"""Rule cascades: the first rule that holds decides. Patterns and thresholds are data, so another set may be passed."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# What tells a public release from other announcements, in order; the first rule that finds its pattern in
# a title decides. A rule without a pattern is a condition of `announcement_class`.
ANNOUNCEMENT_RULES = (
    # rule, class, pattern (letters in either case)
    ("not_official", "other", None),
    ("test_build", "other", r"\b(?:beta|experimental)\b|\b(?:stress test|playtest|public test|test server|test branch)"),
    ("hotfix_keyword", "hotfix", r"\bhot-?fix"),
    (
        "announcement",
        "other",
        r"\b(?:coming|upcoming|incoming|preview|showcase|maintenance|releasing|plans|roadmap)\b"
        r"|\b(?:announc|delay|postpone|dev diary|developer diary|livestream)"
        r"|\ban update (?:about|on|regarding)\b"
        r"|\b(?:arrives|available|launches)\s+(?:on\s+)?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday"
        r"|january|february|march|april|may|june|july|august|september|october|november|december)\b",
    ),
    ("studio_release_title", "major_update", None),
    ("major_update_signal", "major_update", r"\bmajor update\b|\bremaster|\bupdate\b.*\b(?:available now|is live|now live|out now)\b"),
    ("patch_signal", "patch", r"\bpatch\b"),
    ("marketing_keyword", "marketing", r"\b(?:sale|awards?|vote|trailer|bundle)\b|\bsave \d+%|\d+% off|\b(?:discount|merch|wishlist|pre-?order)|copies sold"),
    ("event_keyword", "event", r"\b(?:anniversary|festival|event|expedition|tournament)\b|\bcelebrat"),
)
# A number reads as a build where something marks it (the title's start, a colon, bracket or dash, a word
# for versions), by three parts or more, or by a suffix of a small letter, with or without digits. A letter k, m or x
# makes a count of it, and so do a per cent sign and a word for a large number behind it.
BUILD = r"""(?x)
(?:
    (?: ^ | [:(\[] \s* | [-–—] \s* | \b (?i: version | ver\.? | v | update | patch ) \s* )
    (?i:v)? \d+ (?: \.\d+ )+ (?: [a-z]\d+ | [a-jln-wyz] )?
  | \b \d+ (?: \.\d+ ){2,} (?: [a-z]\d+ | [a-jln-wyz] )?
  | \b \d+ \.\d+ (?: [a-z]\d+ | [a-jln-wyz] )
)
(?! [\w%] ) (?! \s* (?i: million | thousand | billion ) \b )
"""
#: The first version in a build: its first three parts.
VERSION = r"\b[vV]?(\d+)\.(\d+)(?:\.(\d+))?(?:[a-z]\d+)?\b"
#: Classes of public releases, whose effects are estimated.
TREATMENTS = ("major_update", "patch")
# Thresholds of the hypotheses, in points, and of the gate.
NULL_BAND, NEW_PLAYERS, COMPOSITION_SHARE, SMALL = 2.0, 5.0, 0.5, 1.0
PLACEBO_P = 0.10


def cascade(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule whose condition holds; null conditions don't."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def has_major_version(title: Column) -> Column:
    """Whether the first version of a build in the title is x.0 or x.0.0 with x at least 1."""

    def zero(build: Column) -> Column:
        major, minor, third = (F.regexp_extract(build, VERSION, k) for k in (1, 2, 3))
        return major.rlike("[1-9]") & minor.rlike("^0+$") & third.rlike("^0*$")

    return F.exists(F.regexp_extract_all(title, F.lit(BUILD), 0), zero)


def announcement_class(title: Column | str, feed: Column | str, tags: Column | str, entity: Column | str, studio_titles: dict[int, str] | None = None, official_feed: str = "official", notes_tag: str = "patchnotes") -> Column:
    """A struct of type, rule and ambiguous. studio_titles: for an entity, a pattern of its release titles."""
    t = col(title)
    studio = F.lit(False)
    for key, pattern in (studio_titles or {}).items():
        studio = studio | ((col(entity) == key) & t.rlike(pattern))
    also = {
        "not_official": ~col(feed).eqNullSafe(official_feed),
        "studio_release_title": studio,
        "major_update_signal": has_major_version(t),
        "patch_signal": F.array_contains(col(tags), notes_tag) | t.rlike(BUILD),
    }
    rules = []
    for rule, kind, pattern in ANNOUNCEMENT_RULES:
        holds = [c for c in (also.get(rule), None if pattern is None else t.rlike(f"(?i){pattern}")) if c is not None]
        found = F.struct(F.lit(kind).alias("type"), F.lit(rule).alias("rule"), F.lit(False).alias("ambiguous"))
        rules.append((reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), holds), found))
    return cascade(rules, F.struct(F.lit("other").alias("type"), F.lit("no_rule").alias("rule"), F.lit(True).alias("ambiguous")))


def is_candidate(kind: Column | str, rule: Column | str, published: Column | str, since: Column | str) -> Column:
    """A treatment type, official, and not before the entity's start (no start: any day)."""
    early = col(since).isNotNull() & (F.to_date(col(published)) < col(since))
    return col(kind).isin(*TREATMENTS) & (col(rule) != "not_official") & ~early


def excludes_zero(low: Column | str, high: Column | str) -> Column:
    """Null where a bound is missing."""
    return ~((col(low) <= 0) & (col(high) >= 0))


@dataclass(frozen=True)
class GateConfig:
    validated: bool = True
    spike_causal_ok: bool = True
    outcome: str = "positive_share"
    sample: str = "all"


def gate_blocker(config: GateConfig = GateConfig(), review_bomb: Column | str | bool = False) -> Column:
    """What forbids causal wording of an estimate row (effect, lo90, hi90, method, p_value, outcome, sample, flags); null if nothing."""
    bomb = F.lit(review_bomb) if isinstance(review_bomb, bool) else col(review_bomb)
    missing = F.col("effect").isNull() | F.col("lo90").isNull() | F.col("hi90").isNull()
    unproven = (F.col("method") == "synth") & (F.col("p_value").isNull() | (F.col("p_value") > PLACEBO_P))
    other = F.lit(not config.validated) | (F.col("outcome") != config.outcome) | (F.col("sample") != config.sample)
    spike = F.array_contains("flags", "volume_spike")
    return cascade(
        [
            (missing, F.lit("no_estimate")),
            (~excludes_zero("lo90", "hi90"), F.lit("range_includes_zero")),
            (unproven, F.lit("placebo_failed")),
            (other, F.lit("not_validated")),
            (F.array_contains("flags", "confounded"), F.lit("confounded")),
            (spike & F.lit(not config.spike_causal_ok), F.lit("volume_spike")),
            (bomb, F.lit("review_bomb")),
        ],
        F.lit(None).cast("string"),
    )


def gate_caveats() -> Column:
    """Codes of the caveats an allowed estimate carries."""
    named = [F.when(F.array_contains("flags", f), f) for f in ("volume_spike", "discounts_unknown")]
    return F.array_compact(F.array(*named))


@dataclass(frozen=True)
class Hypothesis:
    status: Column
    rule: Column


def _decided(code: str, rules: list[tuple[Column, str, str]], status: str, rule: str) -> Hypothesis:
    return Hypothesis(
        cascade([(c, F.lit(s)) for c, s, _ in rules], F.lit(status)),
        cascade([(c, F.lit(f"{code}.{r}")) for c, _, r in rules], F.lit(f"{code}.{rule}")),
    )


def hypotheses(config: GateConfig = GateConfig()) -> dict[str, Hypothesis]:
    """H1 to H5 over a row of evidence.

    Columns: those of gate_blocker (null without an estimate), sale_days, discount_days, price_unknown_days,
    new_players_change, new_players_lo90, off_topic_lo90, off_topic_hi90, composition, composition_lo90,
    composition_hi90, total_change, total_lo90, total_hi90, and has_estimate.
    """
    yes, no, open_ = "supported", "rejected", "inconclusive"
    spike = F.when(F.col("has_estimate"), F.array_contains("flags", "volume_spike"))
    risen = F.when(F.col("off_topic_lo90").isNotNull() & F.col("off_topic_hi90").isNotNull(), F.col("off_topic_lo90") > 0)
    h3 = _decided("H3", [(spike & risen, yes, "spike_and_off_topic"), (~spike & ~risen, no, "neither"), (spike.isNull() | risen.isNull(), open_, "unknown")], open_, "one_moved")
    blocked = gate_blocker(config, h3.status == yes)
    band = (F.col("lo90") >= -NULL_BAND) & (F.col("lo90") <= 0) & (F.col("hi90") >= 0) & (F.col("hi90") <= NULL_BAND)
    h1 = Hypothesis(
        cascade([(blocked.eqNullSafe("no_estimate"), F.lit(open_)), (blocked.isNull(), F.lit(yes)), (band, F.lit(no))], F.lit(open_)),
        cascade(
            [
                (blocked.eqNullSafe("no_estimate"), F.lit("H1.no_estimate")),
                (blocked.isNull(), F.lit("H1.gate_allows")),
                (band, F.lit("H1.null_band")),
                (~excludes_zero("lo90", "hi90"), F.lit("H1.wide_range")),
            ],
            F.concat(F.lit("H1.blocked."), blocked),
        ),
    )
    on_sale = (F.col("sale_days") > 0) | (F.col("discount_days") > 0)
    up = F.coalesce((F.col("new_players_change") >= NEW_PLAYERS) & (F.col("new_players_lo90") > 0), F.lit(False))
    moved = F.coalesce(excludes_zero("composition_lo90", "composition_hi90"), F.lit(False))
    h2 = _decided(
        "H2",
        [(on_sale & (up | moved), yes, "sale_and_mix"), (~on_sale & (F.col("price_unknown_days") == 0), no, "no_sale"), (~on_sale, open_, "discounts_unknown")],
        open_,
        "mix_steady",
    )
    size, total = F.abs(F.col("composition")), F.abs(F.col("total_change"))
    large = moved & (size >= COMPOSITION_SHARE * total)
    h4 = _decided(
        "H4",
        [
            (F.col("composition").isNull() | F.col("total_change").isNull(), open_, "no_decomposition"),
            (large & (h2.status == yes), open_, "explained_by_price"),
            (large, yes, "composition_large"),
            (~moved & (size < SMALL), no, "composition_small"),
        ],
        open_,
        "otherwise",
    )
    effect_moved = F.coalesce(excludes_zero("lo90", "hi90"), F.lit(False))
    total_moved = excludes_zero("total_lo90", "total_hi90")
    others = (h1.status == yes) | (h2.status == yes) | (h3.status == yes) | (h4.status == yes)
    h5 = _decided(
        "H5",
        [(effect_moved | F.coalesce(total_moved, F.lit(False)), no, "change_established"), (total_moved.isNull(), open_, "unknown"), (others, open_, "other_explanation")],
        yes,
        "no_change",
    )
    return {"H1": h1, "H2": h2, "H3": h3, "H4": h4, "H5": h5}


def breached(value: Column | str, threshold: Column | str) -> Column:
    """Three-valued: null where either is missing."""
    return col(value) > col(threshold)


def agreement_breached(high: Column | str, floor: Column | str) -> Column:
    """Only if the whole interval lies under the floor."""
    return col(high) < col(floor)


def stale(age_hours: Column | str, most: float, readable: Column | str) -> Column:
    """What can't be read counts as stale; what was not measured stays null."""
    return F.when(~col(readable), True).otherwise(col(age_hours) > most)


@dataclass(frozen=True)
class Reasons:
    """Conditions with their names, all of which are reported."""

    named: list[tuple[Column, str]] = field(default_factory=list)

    def column(self) -> Column:
        return F.array_compact(F.array(*[F.when(c, n) for c, n in self.named]))
