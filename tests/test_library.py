"""Hand-worked values for the library's columns and operators."""

import collections
import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import columns as c
from brightloom.functions import rules, text_udfs
from brightloom.operators import checks, estimators, joins, measures, monitoring, sampling, series, text_model, verify, versions
from brightloom.plans import nightly
from brightloom.sources import exports, landing
from brightloom.streaming import events

D = dt.date


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_wilson(spark):
    rows = [(8, 10), (0, 5), (5, 5), (0, 0)]
    lo, hi = c.wilson("x", "n")
    out = [tuple(r) for r in spark.createDataFrame(rows, "x int, n int").select(lo, hi).collect()]
    assert abs(out[0][0] - 0.5408) < 1e-3 and abs(out[0][1] - 0.9314) < 1e-3
    assert out[1][0] == 0.0 and out[2][1] == 1.0 and out[3] == (None, None)


def test_scalars(spark):
    r = one(
        spark,
        a=c.word_count(F.lit(" two  words\n")), b=c.word_count(F.lit("")), bucket=c.bucket_of_minutes(F.lit(None).cast("int")), edge=c.bucket_of_minutes(F.lit(120)),
        key=c.date_key(F.lit(D(2024, 2, 3))), back=c.day_of_key(F.lit(20240203)), clean=c.clean_text(F.lit("a[h1]b[/h1] [b]c[/b]\r\n\r\n see https://x.y/z  d")),
        cut=c.clean_text(F.lit("aaaa bbbb cccc"), 11), iou=c.window_iou(*[F.lit(D(2024, 1, x)) for x in (1, 10, 6, 15)]), labels=c.parsed_labels(F.lit("b| a"), ["a", "b"]),
        none=c.label_cell(F.array().cast("array<string>")), numbers=c.stated_numbers(F.lit("In 2024 it rose 3.5 points to 1,200 over 14 days (v1.2.3)")), first=c.first_date(F.lit("3 Feb, 2024")),
        never=c.first_date(F.lit("soon")), run=c.share_words_run(F.lit("x a b c d e f g h y"), F.lit("A, b c d e; f g h!")), quote=c.holds_quote(F.lit("b  c"), F.lit("a b c")),
        midnight=c.next_local_midnight(F.lit("2024-07-01 12:00:00").cast("timestamp")),
    )
    assert (r.a, r.b, r.bucket, r.edge) == (3, 0, None, "2h_10h")
    assert (r.key, r.back) == (20240203, D(2024, 2, 3))
    assert r.clean == "a\nb\nc\nsee <url> d" and r.cut == "aaaa bbbb"
    assert r.iou == 5 / 15 and r.labels == ["a", "b"] and r.none == "none"
    assert [(v.value, v.decimals) for v in r.numbers] == [(3.5, 1), (1200.0, 0)]
    assert r.first == D(2024, 2, 3) and r.never is None and r.run and r.quote
    assert r.midnight == dt.datetime(2024, 7, 2, 7)


def test_text_functions(spark):
    df = spark.createDataFrame([("é", "a b c d", "x b c y"), (None, None, "q")], "t string, a string, b string")
    out = df.select(text_udfs.nfc("t"), text_udfs.keyed_hash(b"k")("a"), text_udfs.longest_shared_run("a", "b")).collect()
    assert out[0][0] == "é" and len(out[0][1]) == 64 and out[0][2] == 2 and out[1][1] is None


@pytest.mark.parametrize(
    ("title", "tags", "feed", "want"),
    [
        ("Update 2.0 is here", [], "official", ("major_update", "major_update_signal")),
        ("Deep Harbour: 7.1.1", ["patchnotes"], "official", ("patch", "patch_signal")),
        ("Deep Harbour: 7.1.0", [], "official", ("patch", "patch_signal")),
        ("Deep Harbour: 7.0.0", [], "official", ("major_update", "major_update_signal")),
        ("Patch 1.2.0", [], "official", ("patch", "patch_signal")),
        ("0.1.0 notes", [], "official", ("patch", "patch_signal")),
        ("3.10.0", [], "official", ("patch", "patch_signal")),
        ("Version 1.0.0.5", [], "official", ("major_update", "major_update_signal")),
        ("1.2.0 and 2.0.0 in one", [], "official", ("major_update", "major_update_signal")),
        ("v1.0 launch", [], "official", ("major_update", "major_update_signal")),
        ("The sky opens (7.0)", [], "official", ("major_update", "major_update_signal")),
        ("1.0f1 - first snow", [], "official", ("major_update", "major_update_signal")),
        ("01.002.105", [], "official", ("patch", "patch_signal")),
        ("Notes (Ver.1.030)", [], "official", ("patch", "patch_signal")),
        ("5.00c", [], "official", ("patch", "patch_signal")),
        ("Farming 2.0 - part 1", [], "official", ("other", "no_rule")),
        ("Challenge 3.0", [], "official", ("other", "no_rule")),
        ("3.0 million players", [], "official", ("other", "no_rule")),
        ("Weekend: 1.5x rewards", [], "official", ("other", "no_rule")),
        ("1.5 million copies sold", [], "official", ("marketing", "marketing_keyword")),
        ("River update out now", [], "official", ("major_update", "major_update_signal")),
        ("Major Update #8: wells", [], "official", ("major_update", "major_update_signal")),
        ("Hotfix 1.0.1", [], "official", ("hotfix", "hotfix_keyword")),
        ("Small beta hotfix 0.8.090", [], "official", ("other", "test_build")),
        ("Playtests are open", [], "official", ("other", "test_build")),
        ("Update coming Friday", [], "official", ("other", "announcement")),
        ("v1.0 available on Wednesday", [], "official", ("other", "announcement")),
        ("An update regarding Farming 2.0", [], "official", ("other", "announcement")),
        ("Now 4.5k players and 50% off", [], "official", ("marketing", "marketing_keyword")),
        ("Anniversary celebration", [], "official", ("event", "event_keyword")),
        ("Notes", ["patchnotes"], "official", ("patch", "patch_signal")),
        ("Notes", None, "official", ("other", "no_rule")),
        (None, [], "official", ("other", "no_rule")),
        ("Patch 1.2.3", [], "press", ("other", "not_official")),
        ("Patch 1.2.3", [], None, ("other", "not_official")),
        ("Hello", [], "official", ("other", "no_rule")),
    ],
)
def test_announcements(spark, title, tags, feed, want):
    df = spark.createDataFrame([(title, feed, tags, 1)], "title string, feed string, tags array<string>, entity int")
    r = df.select(rules.announcement_class("title", "feed", "tags", "entity").alias("k")).first().k
    assert (r.type, r.rule) == want and r.ambiguous == (r.rule == "no_rule")


def test_hypotheses(spark):
    columns = "effect double, lo90 double, hi90 double, method string, p_value double, outcome string, sample string, flags array<string>, has_estimate boolean, sale_days int, discount_days int, price_unknown_days int, new_players_change double, new_players_lo90 double, off_topic_lo90 double, off_topic_hi90 double, composition double, composition_lo90 double, composition_hi90 double, total_change double, total_lo90 double, total_hi90 double"
    ok = (5.0, 2.0, 8.0, "its", None, "positive_share", "all", [], True, 0, 0, 0, 1.0, -1.0, -1.0, 1.0, 0.5, -0.5, 0.9, 5.0, 1.0, 9.0)
    bomb = (-5.0, -8.0, -2.0, "its", None, "positive_share", "all", ["volume_spike"], True, 2, 0, 0, 6.0, 1.0, 0.5, 1.0, -4.0, -5.0, -3.0, -5.0, -9.0, -1.0)
    none = (None, None, None, None, None, None, None, None, False, 0, 0, 1, None, None, None, None, None, None, None, None, None, None)
    h = rules.hypotheses()
    df = spark.createDataFrame([ok, bomb, none], columns).select(*[F.concat_ws("/", v.status, v.rule).alias(k) for k, v in h.items()])
    a, b, n = df.collect()
    assert tuple(a) == ("supported/H1.gate_allows", "rejected/H2.no_sale", "rejected/H3.neither", "rejected/H4.composition_small", "rejected/H5.change_established")
    assert tuple(b)[:4] == ("inconclusive/H1.blocked.review_bomb", "supported/H2.sale_and_mix", "supported/H3.spike_and_off_topic", "inconclusive/H4.explained_by_price")
    assert tuple(n) == ("inconclusive/H1.no_estimate", "inconclusive/H2.discounts_unknown", "inconclusive/H3.unknown", "inconclusive/H4.no_decomposition", "inconclusive/H5.unknown")


def test_bundles_are_anchored(spark):
    rows = [(1, D(2024, 1, 1) + dt.timedelta(days=k), f"e{k:02d}") for k in (0, 5, 10, 24)]
    out = series.anchored_bundles(spark.createDataFrame(rows, "g int, day date, id string"), "g", "day", "id").orderBy("start").collect()
    assert [r.event_ids for r in out] == [["e00", "e05"], ["e10"], ["e24"]]
    assert [r.allow_long for r in out] == [False, True, True]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, run int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "id int, v string, run int")
    out = {tuple(r) for r in versions.upserted(old, new, ["id"], ["v", "run"], [F.col("run").desc()]).collect()}
    assert out == {(1, "a", 1), (2, "d", 3), (3, "e", 2)}
    assert {r.id for r in versions.missing(new, old, ["id"]).collect()} == {3}
    gone = versions.replaced(old, spark.createDataFrame([(2,)], "id int"), old.limit(0), ["id"])
    assert [r.id for r in gone.collect()] == [1]
    again = versions.appended_if_changed(old, new.withColumn("v", F.lit("b")), ["id"], "v", "run")
    assert again.where("id = 2").count() == 1 and again.where("id = 3").count() == 1


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b")], "k int, t int, v string")
    assert {tuple(r) for r in joins.as_of(left, right, ["k"], "t", "v", "got").collect()} == {(1, 5, "a"), (1, 10, "b"), (1, 1, None), (2, 9, None)}


def test_agreement_and_calibration(spark):
    pairs = [(True, True)] * 4 + [(True, False)] * 2 + [(False, True)] * 1 + [(False, False)] * 3
    k = measures.kappa(spark.createDataFrame(pairs, "a boolean, b boolean"), [], "a", "b").first().kappa
    assert abs(k - 0.4) < 1e-9
    same = spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean")
    assert measures.kappa(same, [], "a", "b").first().kappa is None
    p = spark.createDataFrame([(False, 0.1), (False, 0.4), (True, 0.6), (True, 0.9)], "t boolean, p double")
    assert abs(measures.calibration(p, [], "t", "p", 2).first().ece - 0.25) < 1e-9
    assert abs(measures.best_cut(p, [], "t", "p").first().cut - 0.5) < 1e-9
    m = measures.mean_of_known(spark.createDataFrame([(0.5,), (None,), (1.0,), (None,)], "v double"), [], "v").first()
    assert tuple(m) == (0.75, 2, 2)


def planted(step, days=190, at=150, seed=3):
    draw = np.random.default_rng(seed)
    first = (D(2026, 1, 5) - D(1970, 1, 1)).days
    share = np.where(np.arange(days) >= at, 0.8 + step, 0.8)
    total = np.full(days, 150.0)
    return estimators.Series(first, draw.binomial(150, share).astype(float), total, np.ones(days, bool)), first + at


def test_a_planted_step_is_found():
    s, start = planted(-0.1)
    found = estimators.its(s, start, 14, [], "share")
    assert found["lo90"] < -10 < found["hi90"] and found["hi90"] < 0
    calm = estimators.its(*planted(0.0), 14, [], "share", busy=set())
    assert calm["placebos"] >= estimators.LEAST_PLACEBOS and calm["lo90"] < 0 < calm["hi90"]
    assert "reason" in estimators.its(s, s.last, 14, [], "share")


def test_synthetic_control():
    (s, start), pool = planted(0.05), {k: planted(0.0, seed=20 + k)[0] for k in range(6)}
    found = estimators.synth(s, pool, start, 14, "share")
    assert abs(found["effect"] - 5) < 2.5 and abs(sum(found["weights"].values()) - 1) < 1e-9
    ends = estimators.conformal_interval(s, pool, start, 14, "share")
    assert ends[0] <= found["effect"] <= ends[1]


def test_effects_over_dataframes(spark):
    rows = []
    for k in range(5):
        s, start = planted(-0.1 if k == 0 else 0.0, seed=30 + k)
        rows += [(f"u{k}", D(1970, 1, 1) + dt.timedelta(days=s.first + i), int(x), int(n), True) for i, (x, n) in enumerate(zip(s.positives, s.totals))]
    daily = spark.createDataFrame(rows, "unit string, day date, x int, n int, observed boolean")
    arrays = estimators.series_arrays(daily, "unit", "day", "x", "n")
    assert sorted((r.unit, len(r.positives)) for r in arrays.collect()) == [(f"u{k}", 190) for k in range(5)]
    units = arrays.withColumns({"start": F.lit(start), "horizon": F.lit(14), "kind": F.lit("share")})
    out = {r.unit: r for r in estimators.its_effects(units.withColumns({"earlier": F.array().cast("array<int>"), "busy": F.lit(None).cast("array<int>")})).collect()}
    alone = estimators.its(planted(-0.1, seed=30)[0], start, 14, [], "share")
    assert abs(out["u0"].effect - alone["effect"]) < 1e-9 and out["u0"].hi90 < 0
    counts = ["first", "positives", "totals", "observed"]
    members = arrays.select(F.lit("u0").alias("unit"), F.col("unit").alias("name"), (F.col("unit") == "u0").alias("treated"), *counts)
    got = estimators.synth_effects(units.where("unit = 'u0'").select("unit", "start", "horizon", "kind"), members).first()
    pool = {f"u{k}": planted(0.0, seed=30 + k)[0] for k in range(1, 5)}
    want = estimators.synth(planted(-0.1, seed=30)[0], pool, start, 14, "share")
    assert abs(got.effect - want["effect"]) < 1e-9 and got.lo90 <= got.effect <= got.hi90
    ratios = [estimators.error_ratio(estimators.synth(pool[k], {j: v for j, v in pool.items() if j != k}, start, 14, "share")) for k in pool]
    assert got.p_value == (1 + sum(r >= estimators.error_ratio(want) for r in ratios)) / (1 + len(ratios))


def test_covariance_equals_the_sum_over_lags():
    draw = np.random.default_rng(1)
    x, e = draw.normal(size=(30, 3)), draw.normal(size=30)
    s = x * e[:, None]
    middle = sum((1 - abs(d) / 4) * sum(np.outer(s[i], s[i + d]) for i in range(30) if 0 <= i + d < 30) for d in range(-3, 4))
    inverse = np.linalg.inv(x.T @ x)
    assert np.allclose(estimators.newey_west(x, e, 3), inverse @ middle @ inverse * 30 / 27)


def test_injected_shares_move_by_points():
    s, start = planted(0.0)
    for points in (-10.0, 8.0):
        moved = estimators.injected(s, start, points, "step", 4)
        at = start - s.first
        assert (moved.positives[:at] == s.positives[:at]).all() and (moved.positives <= s.totals).all() and (moved.positives >= 0).all()
        assert abs((moved.positives - s.positives)[at:].sum() / s.totals[at:].sum() - points / 100) < 0.02
    ramp = estimators.injected(s, start, -10.0, "ramp", 4)
    assert (ramp.positives[: start - s.first] == s.positives[: start - s.first]).all() and ramp.positives.sum() < s.positives.sum()


def test_queries_over_former_limits(spark):
    items = spark.range(60).select(F.col("id").alias("item"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    asked = items.select(F.col("item").alias("query"), "v").where("item % 2 = 0")
    from brightloom.operators import retrieval

    whole = retrieval.dense_search(items, asked, "item", "query", "v", 5, 9)
    blocks = retrieval.dense_search(items, asked, "item", "query", "v", 5, 9, block=7)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect())) and whole.count() == 150
    with pytest.raises(Exception, match="out of range"):
        measures.weighted_kappa(spark.createDataFrame([(0, 1), (1, 5)], "a int, b int"), "a", "b", 3).collect()
    sets = versions.field_updates(spark.range(1000).withColumn("f", F.lit(1)), "id", ["f"], most=100).collect()
    assert sum(len(r["keys"]) for r in sets) == 1000 and max(len(r["keys"]) for r in sets) < 200
    text = " ".join(f"w{i}" for i in range(20_000))
    assert spark.createDataFrame([(text,)], "t string").select(F.size(c.shingles(c.words("t")))).first()[0] == 19_993


def test_simplex_weights_meet_the_conditions():
    draw = np.random.default_rng(0)
    for _ in range(20):
        pool, target = draw.normal(size=(40, 7)), draw.normal(size=40)
        w = estimators.simplex_weights(target, pool)
        p, t = pool - pool.mean(0), target - target.mean()
        slope = p.T @ (p @ w - t)
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-9
        assert slope[w > 1e-8].max() - slope.min() < 1e-6


def test_allocations():
    assert sampling.equal_allocation(10, {"a": 2, "b": 9, "c": 9}) == {"a": 2, "b": 4, "c": 4}
    assert sampling.proportional_allocation(3, {"a": 1, "b": 2, "c": 3}) == {"a": 1, "b": 1, "c": 1}
    assert sampling.packed([("a", 3), ("b", 3), ("c", 2)], 5) == [["a"], ["b", "c"]]


CLAIM = (
    "text string, claim_type string, value double, unit string, tool string, outcome string, path string, result string, pool array<double>, quotes array<struct<text: string, source: string>>,"
    " reviews_found boolean, retrieved array<string>, estimate struct<effect: double, lo90: double, hi90: double, method: string, p_value: double, outcome: string, sample: string, flags: array<string>, horizon: int>, review_bomb boolean"
)


def claim(text, **own):
    base = {
        "claim_type": "comparative", "value": -3.46, "unit": "pp", "tool": "estimate", "outcome": None, "path": "$.a.effect", "result": '{"a": {"effect": -3.46}}', "pool": None,
        "quotes": [], "reviews_found": True, "retrieved": [], "estimate": None, "review_bomb": False,
    }
    return (text, *(base | own).values())


def test_claims(spark):
    good = (-3.46, -5.0, -1.0, "its", None, "positive_share", "all", [], 14)
    cases = [
        (claim("The share fell 3.5 points"), "shipped"),
        (claim("The share fell 3.5 points", result=None), "withheld:V1"),
        (claim("The share fell", path=None), "withheld:V1"),
        (claim("Players say so", path=None, value=None, result=None, quotes=[("b  c", "a b c")]), "shipped"),
        (claim("Players say so", path=None, value=None, result=None), "withheld:V1"),
        (claim("The share fell 4.5 points"), "withheld:V2"),
        (claim("The share fell 4.5 points", pool=[4.46]), "shipped"),
        (claim("The share fell 3.5 points", path="$.b"), "withheld:V2"),
        (claim("The share fell 3.5 points", result='{"a": {"effect": "-3.46"}}', value=-3.46), "shipped"),
        (claim("The share fell 3.5 points", result='{"a": {"effect": true}}'), "withheld:V2"),
        (claim("The share fell 3.5 points", value=-4.0), "withheld:V2"),
        (claim("It fell 3.5", value=-3.46, unit="hours", result='{"a": {"effect": -3.3}}'), "withheld:V2"),
        (claim("It fell three points"), "withheld:V2"),
        (claim("No one fell 3.5 points over 14 days since 2024-05-01 in v1.2"), "shipped"),
        (claim("It fell 3.5", value=None), "withheld:V2"),
        (claim("The share rose 3.5 points"), "withheld:V2"),
        (claim("The negative share rose 3.5 points"), "shipped"),
        (claim("The level rose to 3.5", path="$.a.share", result='{"a": {"share": -3.46}}'), "shipped"),
        (claim("It fell 3.5 points", quotes=[("not there", "some text")]), "withheld:V3"),
        (claim("It fell 3.5 points", quotes=[("  ", "some text")]), "withheld:V3"),
        (claim("It fell 3.5 points", quotes=[("some", None)]), "withheld:V3"),
        (claim("It fell 3.5 points", reviews_found=False), "withheld:V3"),
        (claim("It fell 3.5 points because of it"), "withheld:V4"),
        (claim("It fell 3.5 points because of it", estimate=(None, *good[1:])), "withheld:V4"),
        (claim("It fell 3.5 points because of it", estimate=good, claim_type="causal"), "shipped"),
        (claim("It fell 3.5 points because of it", estimate=good), "withheld:V5"),
        (claim("It fell 3.5 points", estimate=good, claim_type="causal"), "shipped"),
        (claim("It fell 3.5 points because of it", estimate=good, claim_type="causal", review_bomb=True), "reworded:V4"),
        (claim("It fell 3.5 points because of it", estimate=(-3.46, -5.0, 1.0, *good[3:]), claim_type="causal"), "reworded:V4"),
        (claim("It fell 3.5 points because of it", estimate=(*good[:3], "synth", 0.4, *good[5:])), "reworded:V4"),
        (claim("It fell 3.5 points as a, b c d e f g", retrieved=["x points as a b c d e f"]), "withheld:V7"),
        (claim("It fell 3.5 points", unit="a b c d e f g h", value=-3.46, retrieved=["a b c d e f g h i"]), "withheld:V7"),
    ]
    rows = spark.createDataFrame([(*c, w, i) for i, (c, w) in enumerate(cases)], CLAIM + ", want string, i int")
    out = verify.judged(rows, reasons={"range_includes_zero": "zero is in it"}, methods={"its": "time series"}).orderBy("i").collect()
    assert [(r.i, r.decision) for r in out] == [(r.i, r.want) for r in out]
    hedged = "Over the 14 days from the release, positive_share was -3.5 points against the time series estimate of what it would have been without the release (90% range -5.0 to +1.0). That isn't enough to credit the release: zero is in it."
    assert out[28].final_text == hedged and out[28].blocked_by == "range_includes_zero" and out[5].final_text is None
    noted = verify.judged(rows.where("i = 24").withColumn("estimate", F.col("estimate").withField("flags", F.array(F.lit("volume_spike")))), caveats={"volume_spike": "A burst."}).first()
    assert noted.final_text == "It fell 3.5 points because of it A burst." and noted.decision == "shipped"


def test_rows_behind_a_figure(spark):
    overview = '{"total": {"reviews": 12, "share": 5}, "points": [{"reviews": 3, "share": 1}]}'
    aspects = '{"aspects": {"x": {"negative": {"window_scored": 4, "baseline_scored": 6}}}}'
    parts = '{"window_reviews": 10, "baseline_reviews": 20, "buckets": {"new": {"window_reviews": 2, "baseline_reviews": 3}}}'
    cases = [
        ("overview", overview, "$.total.share", 12), ("timeseries", overview, "$.points[0].share", 3), ("overview", overview, "$.total.price", None), ("estimate", overview, "$.total.share", None),
        ("aspects", aspects, "$.aspects.x.negative.change", 10), ("aspects", aspects, "$.aspects.x.negative.window_share", 4), ("aspects", aspects, "$.aspects.x.negative.other", None),
        ("aspects", aspects, "$.aspects.x.change", None), ("decomposition", parts, "$.composition", 30), ("decomposition", parts, "$.intervals.within.lo90", 30), ("decomposition", parts, "$.window_reviews", 10),
        ("decomposition", parts, "$.buckets.new.baseline_share", 3), ("decomposition", parts, "$.buckets.new.window_mix", 10), ("decomposition", parts, "$.buckets.new.other", None), ("overview", "no json", "$.total.share", None),
    ]
    out = spark.createDataFrame(cases, "tool string, result string, path string, want long").withColumn("got", verify.basis("tool", "result", "path")).collect()
    assert [(r.path, r.got) for r in out] == [(r.path, r.want) for r in out]


def test_checks(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0), (None, None)], "k int, v double")
    got = {r.name: r.violations for r in checks.report({"null": checks.nulls(df, "k"), "unique": checks.repeated(df, ["k"]), "unit": checks.outside_unit(df, "v")}).collect()}
    assert got == {"null": 1, "unique": 1, "unit": 1}


def test_incremental_nights_equal_one_full_night(spark, tmp_path):
    def rows(run, ids):
        return [(i, D(2024, 1, 1 + run), run, i % 3, D(2024, 1, 1 + i % 9), f"t{i}", (i + run) % 2 == 0, 60 * i) for i in ids]

    schema = "review_id int, version date, run_id int, entity int, day date, text string, positive boolean, minutes int"
    first, second = spark.createDataFrame(rows(1, range(30)), schema), spark.createDataFrame(rows(2, range(20, 45)), schema)
    a = nightly.Night(str(tmp_path / "a"), 1)
    nightly.run_nightly(spark, a, first)
    a.run_id = 2
    two = nightly.run_nightly(spark, a, second, before=1)
    full = nightly.run_nightly(spark, nightly.Night(str(tmp_path / "b"), 1), first.unionByName(second))
    for name in ("latest", "days", "daily"):
        assert sorted(map(str, two[name].collect())) == sorted(map(str, full[name].collect()))
    assert {r.violations for r in two["quality"].collect()} == {0}


def test_landed_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"success": 1, "cursor": "c", "reviews": [{"recommendationid": "7", "author": {"account": "x", "num_reviews": 3}, "review": "hi", "timestamp_created": 5, "timestamp_updated": 6, "voted_up": true}, {"recommendationid": null}]}')
    out = landing.review_pages(spark, str(tmp_path / "p.json"))
    assert "account" not in out.columns
    assert [(r.recommendationid, r.num_reviews, r.voted_up) for r in out.collect()] == [("7", 3, True)]


def test_exports_are_stable(spark):
    days = spark.createDataFrame([(1, "b", 0.123456), (1, "a", 1.0), (2, "a", 2.0)], "g int, day string, v double")
    out = {r.g: r.document for r in exports.documents(days.select("g").distinct(), {"days": (days, "day")}, "g").collect()}
    assert out[1] == '{"days":[{"day":"a","v":1.0},{"day":"b","v":0.1235}],"g":1}'
    with pytest.raises(ValueError):
        exports.allowed(days, {"g", "day"})


def test_drift(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=k), "en" if k % 2 else "fr") for k in range(30)]
    df = monitoring.full_weeks(spark.createDataFrame(rows, "day date, lang string"), "day")
    out = monitoring.drift(df, df, {"language": F.col("lang")}).collect()
    assert len(out) == 4 and all(abs(r.value) < 0.1 for r in out)


def word_and_char_grams(text):
    """By plain loops."""
    words = [w for w in re.findall(r"\w+", text.lower()) if len(w) > 1]
    chars = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            chars += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return words + [" ".join(p) for p in zip(words, words[1:])], chars


def test_grams_equal_plain_loops(spark):
    texts = ["", None, "a", "ab", "Ab cd, x ef", "été  über\nab_1", "日本語のテキスト", "x" * 9, "  two  words "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text_model.word_grams("t").alias("w"), text_model.char_grams("t").alias("c")).collect()
    for r in got:
        words, chars = word_and_char_grams(texts[r.i] or "")
        assert (sorted(r.w), sorted(r.c)) == (sorted(words), sorted(chars)), texts[r.i]


def test_scores_equal_the_sum_over_weighted_grams(spark):
    rows = [(i, t, i % 2 == 0) for i, t in enumerate(["crash crash freeze", "lovely music", "it crashed", "music music", "", "the freeze"] * 4)]
    df = spark.createDataFrame(rows, "id int, text string, bad boolean")
    model = text_model.trained(df, ["bad"], buckets=4096)
    place = {g: b for r in text_model.prepared(df, "text", 4096).select(text_model.word_grams("text").alias("w"), "_words").collect() for g, b in zip(r.w, r._words)}

    def places(text):
        """Buckets of both kinds; those of a character gram are taken alone, in a word of its own."""
        words, chars = word_and_char_grams(text)
        alone = [text_model.char_places([g], 4096)[1] for g in chars]
        return [place[g] for g in words], [4096 + int(a[-1]) for a in alone]

    df_of = collections.Counter(b for _, t, _ in rows for kind in places(t) for b in set(kind))
    for r in text_model.scored(df, model, {"bad": 0.5}).collect():
        total = model.intercepts["bad"]
        for kind in places(r.text):
            weights = {b: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df_of[b])) + 1) for b, n in collections.Counter(kind).items()}
            size = math.sqrt(sum(w * w for w in weights.values())) or 1
            total += sum(model.coefficients["bad"][b] * w / size for b, w in weights.items())
        assert abs(r.p_bad - 1 / (1 + math.exp(-total))) < 1e-9


def test_character_grams_of_many_texts_at_once():
    texts = ["", "Ab cd, x ef", "été  über\nab_1", "日本語のテキスト", "x", "a " * 40]
    padded = ["".join(f" {w} " for w in t.lower().split()) for t in texts]
    row, place = text_model.char_places(padded, 1 << 40)
    for i, t in enumerate(texts):
        want = collections.Counter(int(text_model.char_places([g], 1 << 40)[1][-1]) for g in word_and_char_grams(t)[1])
        assert collections.Counter(place[row == i].tolist()) == want


def test_text_model_tells_classes_apart(spark):
    rows = [(i, "crash and freeze" if i % 2 else "lovely music", i % 2 == 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, stability boolean")
    out = text_model.scored(df, text_model.trained(df, ["stability"], buckets=1024), {"stability": 0.5})
    assert out.where("l_stability = stability").count() == 40
    assert abs(text_model.auc(out, "stability", "p_stability").first().auc - 1) < 1e-9


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 5, i % 24), "view" if i % 2 else "buy", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = events.daily_counts(events.event_stream(spark, str(tmp_path / "in"), df)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("counts").collect()}
    want = df.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*"), F.sum("value"))
    assert got == {tuple(r) for r in want.collect()}
