"""Claims against the results they cite, as columns over claim rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, holds_quote, is_rounding_of, share_words_run, stated_numbers
from ..functions.rules import GateConfig, cascade, gate_blocker

# Words of direction and of cause, and numbers in words.
RISE = r"(?i)\b(?:rose|rise|rises|rising|risen|increas(?:e|ed|es|ing)|higher|grew|grow|grows|growing|grown|gain(?:s|ed)?|climb(?:s|ed)?|jump(?:s|ed)?)\b"
FALL = r"(?i)\b(?:fell|fall(?:s|ing)?|drop(?:s|ped|ping)?|declin(?:e|ed|es|ing)|decreas(?:e|ed|es|ing)|lower(?:ed)?|shrank|shrunk|shrinks?|dip(?:s|ped)?|slip(?:s|ped)?|reduc(?:e|ed|es|ing)|cut)\b"
CAUSE = (
    r"(?i)\b(?:caus(?:e|es|ed|ing)|(?:lead|leads|led|leading)\s+to|due\s+to|because|as\s+a\s+result\s+of|result(?:s|ed|ing)?\s+in|drove|driven\s+by|triggered"
    r"|owing\s+to|thanks\s+to|responsible\s+for|attribut(?:able|ed)\s+to|brought\s+about|impacted)\b"
)
NUMBER_WORDS = (
    r"(?i)\b(?:zero|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty"
    r"|seventy|eighty|ninety|hundred|thousand|million|billion)\b|\bone(?=[\s-]+(?:point|percent|percentage|hundred|thousand)\b)"
)
# Fields that hold a signed change; tolerances of a value by its unit; the run of words that repeats a source.
CHANGES = ("change", "effect", "total", "composition", "within", "interaction")
POINTS, POINTS_OFF, SHARE_OFF, SLACK = ("pp", "%"), 0.5, 0.02, 1e-9
LEAK_WORDS = 8
# The rows behind a figure of a tool's result. Parts of the decomposition count both periods.
PERIOD_FIGURES = ("reviews", "positives", "share", "lo90", "hi90", "new_players", "new_players_share")
PARTS = ("total", "composition", "within", "interaction")


def value_at(result: Column | str, path: Column | str) -> Column:
    """The number behind a JSON path of a result; null if there is none."""
    return F.expr(f"try_cast(get_json_object({result}, {path}) as double)") if isinstance(result, str) else F.try_variant_get(F.try_parse_json(result), path, "double")


def numbers_in(result: Column | str) -> Column:
    """All numbers of a JSON text, wherever they stand in it; strings and names are left out."""
    bare = F.regexp_replace(col(result), r'"(?:[^"\\]|\\.)*"', '""')
    return F.transform(F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), 1), lambda x: x.cast("double"))


def direction_holds(text: Column, change: Column, negative: Column) -> Column:
    """Words of rise or fall agree with the sign, which turns around for shares of negatives; without such words true."""
    signed = F.when(negative, -change).otherwise(change)
    rise, fall = text.rlike(RISE), text.rlike(FALL)
    return F.when(rise & ~fall, signed > 0).when(fall & ~rise, signed < 0).otherwise(F.lit(True))


def within_tolerance(stated: Column, actual: Column, unit: Column) -> Column:
    """Half a point for shares, two per cent of the actual value for others."""
    most = F.when(F.coalesce(unit.isin(*POINTS), F.lit(False)), POINTS_OFF).otherwise(SHARE_OFF * F.abs(actual))
    return F.abs(stated - actual) <= most + SLACK


def hedge(row: str, reasons: dict[str, str], methods: dict[str, str], subject: str = "release") -> Column:
    """The fixed rewording of a causal claim that the gate blocks: it states the estimate and credits nothing."""
    e, words = F.col(row), lambda named, key: cascade([(key == k, F.lit(v)) for k, v in named.items()], key)
    signed = lambda c: F.format_string("%+.1f", c)
    unit = F.when(e["outcome"] == "volume", "%").otherwise(" points")
    return F.concat(
        F.lit("Over the "), e["horizon"].cast("string"), F.lit(f" days from the {subject}, "), e["outcome"], F.lit(" was "), signed(e["effect"]), unit, F.lit(" against the "),
        words(methods, e["method"]), F.lit(f" estimate of what it would have been without the {subject} (90% range "), signed(e["lo90"]), F.lit(" to "), signed(e["hi90"]),
        F.lit(f"). That isn't enough to credit the {subject}: "), F.coalesce(words(reasons, F.col("blocked_by")), F.lit("the causal checks didn't pass")), F.lit("."),
    )


def judged(claims: DataFrame, config: GateConfig = GateConfig(), reasons: dict[str, str] | None = None, methods: dict[str, str] | None = None, caveats: dict[str, str] | None = None) -> DataFrame:
    """claims with decision (shipped, reworded:V4, withheld:<rule>), blocked_by, final_text and based_on.

    A claim: text, claim_type, value, unit; tool, outcome, path and result of the call it cites (a null path cites none,
    a null result is a call that the trace has not); pool, the numbers in the run's results of that tool; quotes, structs
    of text and source (null: not retrieved); reviews_found, whether all reviews it cites were retrieved; retrieved, the
    texts that were; estimate, the row it cites (effect, lo90, hi90, method, p_value, outcome, sample, flags, horizon),
    or null; review_bomb. The first rule that fails withholds it:

    V1 the call is in the trace, or a claim without a call has no value but quotes. V2 the value is the result's, every
    stated number is the value or one of the pool, in digits, and words of direction agree with a change. V3 quotes stand
    in what was retrieved. V4 a causal claim needs an estimate that the gate allows; a blocked one is reworded, one
    without an effect is withheld. V5 other claims have no causal words. V7 text and unit repeat no run of retrieved words.
    """
    false, text, value = F.lit(False), F.col("text"), F.col("value")
    cites = F.col("path").isNotNull()
    v1 = F.when(cites, F.col("result").isNotNull()).otherwise(value.isNull() & (F.size("quotes") > 0))
    actual = F.expr("try_cast(get_json_object(result, path) as double)")
    is_number = F.expr("get_json_object(result, path)").rlike(r"^-?[0-9]")
    matches = value.isNull() | F.coalesce(cites & is_number & within_tolerance(value, actual, F.col("unit")), false)
    pool = F.concat(F.array(value), F.coalesce("pool", F.array().cast("array<double>")))
    stated = stated_numbers("text")
    backed = F.forall(stated, lambda n: within_tolerance(n["value"], F.abs(value), F.col("unit")) | F.exists(pool, lambda x: is_rounding_of(n["value"], n["decimals"], x)))
    numbers = ~text.rlike(NUMBER_WORDS) & ((F.size(stated) == 0) | (value.isNotNull() & backed))
    leaf = F.element_at(F.split(F.regexp_replace("path", r"\[(\d+)\]", ".$1"), r"\."), -1)
    share = (F.col("tool") == "decomposition") | ((F.col("tool") == "estimate") & (F.coalesce("outcome", F.lit(config.outcome)) == config.outcome))
    says = direction_holds(text, value, F.coalesce(share, false) & text.rlike(r"(?i)\bnegative\b"))
    v2 = matches & numbers & F.coalesce(value.isNull() | (value == 0) | ~cites | ~leaf.isin(*CHANGES) | says, F.lit(True))
    quoted = F.forall("quotes", lambda q: F.coalesce((F.trim(F.regexp_replace(q["text"], r"\s+", " ")) != "") & holds_quote(q["text"], q["source"]), false))
    v3 = F.coalesce("reviews_found", F.lit(True)) & F.coalesce(quoted, F.lit(True))
    causal = (F.col("claim_type") == "causal") | text.rlike(CAUSE)
    fields = ("effect", "lo90", "hi90", "method", "p_value", "outcome", "sample", "flags")
    rows = claims.withColumns({"_own": F.struct(*claims.columns), **{f: F.col("estimate")[f] for f in fields if f not in claims.columns or f == "outcome"}})
    rows = rows.withColumn("blocked_by", F.when(F.col("estimate").isNull(), "no_estimate_cited").otherwise(gate_blocker(config, "review_bomb")))
    own = rows.select("_own.*", "blocked_by").withColumn("blocked_by", F.when(causal, F.col("blocked_by")))
    known = F.coalesce(F.col("estimate.effect").isNotNull() & F.col("estimate.lo90").isNotNull() & F.col("estimate.hi90").isNotNull(), false)
    reworded = causal & F.col("blocked_by").isNotNull()
    noted = F.concat_ws(" ", text, *[F.when(causal & F.array_contains("estimate.flags", flag), F.lit(note)) for flag, note in (caveats or {}).items()])
    said = F.when(reworded & known, hedge("estimate", reasons or {}, methods or {})).otherwise(noted)
    typed = ~reworded & (F.col("claim_type") == "causal")
    leaks = F.exists(F.coalesce("retrieved", F.array().cast("array<string>")), lambda t: share_words_run(t, "_said", LEAK_WORDS) | share_words_run(t, F.coalesce("unit", F.lit("")), LEAK_WORDS))
    decision = cascade(
        [
            (~F.coalesce(v1, false), F.lit("withheld:V1")),
            (~F.coalesce(v2, false), F.lit("withheld:V2")),
            (~v3, F.lit("withheld:V3")),
            (reworded & ~known, F.lit("withheld:V4")),
            (~typed & F.col("_said").rlike(CAUSE), F.lit("withheld:V5")),
            (leaks, F.lit("withheld:V7")),
            (reworded, F.lit("reworded:V4")),
        ],
        F.lit("shipped"),
    )
    out = own.withColumn("_said", said).withColumn("decision", decision)
    kept = ~F.col("decision").startswith("withheld")
    return out.select(*claims.columns, "decision", "blocked_by", F.when(kept, F.col("_said")).alias("final_text"), F.when(kept, basis("tool", "result", "path")).alias("based_on"))


def summary_holds(summary: Column | str, backed: Column | str, most_words: int = 120) -> Column:
    """At most so many words, and every stated number is backed by a shipped claim (array of doubles)."""
    text = F.col(summary) if isinstance(summary, str) else summary
    held = F.forall(stated_numbers(text), lambda v: F.exists(backed, lambda b: is_rounding_of(v["value"], v["decimals"], b)))
    return (F.size(F.split(F.trim(text), r"\s+")) <= most_words) & held


def injected(cases: DataFrame) -> DataFrame:
    """cases (payload, markers, drafted, shipped): whether markers or long runs of the payload got through, before and after."""

    def through(text: str) -> Column:
        marked = F.exists("markers", lambda m: F.contains(F.lower(F.col(text)), F.lower(m)))
        return marked | share_words_run("payload", text, 8)

    return cases.withColumns({"in_draft": through("drafted"), "in_report": through("shipped")})


def claim_statistics(judged_claims: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("decision")
    return judged_claims.groupBy(*by).agg(
        F.count("*").alias("drafted"), F.count_if(d == "shipped").alias("shipped"), F.count_if(d.startswith("reworded")).alias("reworded"), F.count_if(d.startswith("withheld")).alias("withheld"),
        F.count_if(F.col("text").rlike(CAUSE)).alias("causal"),
    )


def predicted_category(statuses: Column | str) -> Column:
    """The first supported of H1, H3, H2, H4 in a map from hypothesis to status."""
    s = F.col(statuses) if isinstance(statuses, str) else statuses
    named = (("H1", "patch"), ("H3", "review_bomb"), ("H2", "price"), ("H4", "composition"))
    return cascade([(F.try_element_at(s, F.lit(h)) == "supported", F.lit(n)) for h, n in named], F.lit("none"))


def basis(tool: str, result: str, path: str) -> Column:
    """How many rows the figure at a path of a tool's result was computed from; null where no count stands behind it."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^\$?\.?", ""), r"\[(\d+)\]", ".$1"), r"\.")
    leaf, n, at = F.element_at(parts, -1), F.size(parts), lambda k: F.try_element_at(parts, F.lit(k))
    above = F.expr(f"regexp_replace({path}, '[.][^.]+$', '')")

    def count(base: Column, name: str) -> Column:
        return F.call_function("get_json_object", F.col(result), F.concat(base, F.lit(f".{name}"))).cast("double").cast("long")

    def periods(base: Column, name: str, of: Column) -> Column:
        window, baseline = count(base, f"window_{name}"), count(base, f"baseline_{name}")
        return F.when(of == "window", window).when(of == "baseline", baseline).when(of == "both", window + baseline)

    period = F.when(leaf.startswith("window_"), "window").when(leaf.startswith("baseline_"), "baseline")
    aspect = F.when(leaf.rlike("^(window|baseline)_(mentions|share|scored)$"), period).when(leaf.isin("change", "lo90", "hi90"), "both")
    root, of = F.lit("$"), F.col(tool)
    return cascade(
        [
            (of.isin("overview", "timeseries") & leaf.isin(*PERIOD_FIGURES), count(above, "reviews")),
            ((of == "aspects") & (n == 4) & (at(1) == "aspects"), periods(above, "scored", aspect)),
            ((of == "decomposition") & (at(1).isin(*PARTS) | ((at(1) == "intervals") & at(2).isin(*PARTS))), periods(root, "reviews", F.lit("both"))),
            ((of == "decomposition") & (n == 1) & leaf.isin("window_reviews", "baseline_reviews"), periods(root, "reviews", period)),
            ((of == "decomposition") & (at(1) == "buckets") & (n == 3) & leaf.isin("window_mix", "baseline_mix"), periods(root, "reviews", period)),
            ((of == "decomposition") & (at(1) == "buckets") & (n == 3) & leaf.rlike("^(window|baseline)_(share|reviews)$"), periods(above, "reviews", period)),
        ],
        F.lit(None).cast("long"),
    )


def blame_counts(judged_claims: DataFrame, by: list[str], names: str) -> DataFrame:
    """Claims that are causal and name a treatment, as drafted and as shipped."""
    blames = F.col("text").rlike(CAUSE) & F.col("text").rlike(names)
    return judged_claims.groupBy(*by).agg(F.count_if(blames).alias("drafted"), F.count_if(blames & (F.col("decision") == "shipped")).alias("shipped"))
