"""Registered queries over labels, lists and counters: (Spark query, SQL) by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.functions import labels as L
from wattline.functions import scalars as S
from wattline.operators import catalog as C
from wattline.operators import maintenance as M
from wattline.operators import phases as E
from wattline.operators import profiles as A
from wattline.plans.cycle_tables import CYC, PAT, PROFILE, STAGED, cycles, patterns, profiled, staged
from wattline.plans.pattern_queries import UNKNOWN_CLASS
from wattline.plans.series_queries import events, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Texts that stand in for what users and sensors call their devices, as the supplied tables have none.
NAMES = ("Kühlschrank Küche", "wasserkocher", "Pump A", "unknown_motor", "kitchen_fridge", " ", "Space_Heater", "Fridge_like", "Mikrowelle", "unknown_constant_load", "motor", "my oven")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def named(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (number % len(NAMES) + 1).cast("int"))


_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_NAME = lambda number: f"{_LIST}[CAST(({number}) % {len(NAMES)} + 1 AS INTEGER)]"


def _map(names: dict[str, str], text: str) -> str:
    return f"CASE {text} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


def _inferred(names: dict[str, str]) -> str:
    held = " ".join(f"WHEN contains(low, '{t}') THEN '{t}'" for t in L.DEVICE_TYPES)
    return f"CASE WHEN low = '' THEN 'unknown' ELSE coalesce({_map(names, 'low')}, CASE {held} END, low) END"


@query("p16_device_labels", f"""WITH a AS (SELECT event_id, lower(trim({_NAME('event_id')})) AS low FROM events)
SELECT event_id, coalesce({_map(L.FOREST_ALIASES, "replace(low, ' ', '_')")}, CASE WHEN replace(low, ' ', '_') IN {L.FOREST_CLASSES} THEN replace(low, ' ', '_') END, 'unknown') AS forest, {_inferred(L.ALIASES)} AS offline, {_inferred(L.ANALYZER_ALIASES)} AS analyzer FROM a""")
def p16(spark, sf_dir):
    name = named(F.col("event_id"))
    return events(spark, sf_dir).select("event_id", L.forest_label(name).alias("forest"), L.inferred_label(name).alias("offline"), L.inferred_label(name, L.ANALYZER_ALIASES).alias("analyzer"))


def _public(text: str) -> str:
    from wattline.functions.scalars import PUBLIC_KEYWORDS, PUBLIC_LABELS

    low = f"replace(lower(trim({text})), ' ', '_')"
    words = " ".join(f"WHEN contains({low}, '{word}') THEN '{plain}'" for word, plain in PUBLIC_KEYWORDS)
    return f"CASE WHEN {low} = '' THEN 'unknown' WHEN {low} IN {PUBLIC_LABELS} THEN {low} {words} WHEN starts_with({low}, 'unknown') THEN 'unknown' ELSE 'custom_user_label' END"


@query("p15_public_names", f"""WITH a AS (SELECT event_id, {_public(_NAME('event_id'))} AS u, {_public(_NAME('event_id // 5'))} AS s, {_public('event_type')} AS c,
lower(trim(coalesce(nullif(trim({_NAME('event_id')}), ''), event_type))) AS eff FROM events)
SELECT event_id, CASE WHEN u NOT IN ('custom_user_label', 'unknown') THEN u WHEN s <> 'custom_user_label' THEN s WHEN c <> 'custom_user_label' THEN c ELSE 'unknown' END AS public_name, trim(replace(replace(eff, '_like', ''), '_', ' ')) AS group_key FROM a""")
def p15(spark, sf_dir):
    user, other = named(F.col("event_id")), named(F.floor(F.col("event_id") / 5))
    return events(spark, sf_dir).select("event_id", L.public_name(user, other, F.col("event_type")).alias("public_name"), L.device_group_key(user, F.col("event_type"), other).alias("group_key"))


_ONLY = "(name LIKE '%\\_candidate' ESCAPE '\\' OR starts_with(name, 'unknown_') OR name = 'constant_load_pattern')"


@query("p33_learning_labels", f"""WITH {CYC}, a AS (SELECT *, CASE WHEN trim({_NAME('user_id + cycle')}) = '' THEN 'unknown' ELSE trim({_NAME('user_id + cycle')}) END AS name, peak_to_avg >= 1.25 AS motor FROM cyc)
SELECT user_id, cycle, {_ONLY} AS only_candidate, CASE WHEN avg_w <= 220 AND duration_s >= 120 AND peak_to_avg < 1.25 AND NOT motor THEN 'electronics_cluster' WHEN name = 'unknown_constant_load' THEN 'constant_load_pattern' WHEN {_ONLY} THEN name
WHEN name IN ('fridge', 'fridge_like') THEN 'fridge_candidate' WHEN name IN ('small_pump_motor', 'large_pump_motor', 'pump') THEN 'pump_candidate' WHEN name IN ('motor', 'unknown_motor', 'unknown_high_inrush') THEN 'motor_candidate' ELSE name END AS learning_label FROM a""")
def p33(spark, sf_dir):
    name = named(F.col("user_id") + F.col("cycle"))
    c = {"avg": F.col("avg_w"), "dur": F.col("duration_s"), "inrush": F.col("peak_to_avg"), "motor": F.col("peak_to_avg") >= 1.25}
    return cycles(spark, sf_dir).select("user_id", "cycle", L.only_candidate(name).alias("only_candidate"), L.learning_label(name, c).alias("learning_label"))


@query("p35_device_subclass", f"""WITH {STAGED}, r AS (SELECT *, variance / avg_w AS nv, peak_to_avg AS inrush, peak_to_avg >= 1.6 AS motor FROM staged)
SELECT user_id, cycle, CASE WHEN contains(label, 'fridge') THEN 'fridge_compressor' WHEN motor AND inrush >= 1.35 THEN CASE WHEN avg_w >= 700 THEN 'large_pump_motor' ELSE 'compressor_candidate' END
WHEN motor THEN 'small_pump_motor' WHEN rise_rate > 100 THEN 'heater_resistive' WHEN starts_with(label, 'unknown') THEN {UNKNOWN_CLASS} ELSE label END AS subclass FROM r""")
def p35(spark, sf_dir):
    c = {"avg": F.col("avg_w"), "delta_avg": F.col("avg_w"), "dur": F.col("duration_s"), "nv": F.col("variance") / F.col("avg_w"), "inrush": F.col("peak_to_avg"), "motor": F.col("peak_to_avg") >= 1.6, "heating": F.col("rise_rate") > 100}
    c |= {"multi": (F.col("n_substates") >= 2) | (F.col("steps") >= 2), "flat": F.col("std_w") <= F.greatest(0.08 * F.col("avg_w"), F.lit(15.0))}
    return staged(spark, sf_dir).select("user_id", "cycle", E.device_subclass(F.col("label"), c).alias("subclass"))


_SIGNATURES = ("[1, 2, 3, 4, 5, 6, 7, 8]", "[1, 2]", "no list", "", "[0.5, 1, 1, 1, 1, 1, 1, 1, 0]")
_SIG = "[" + ", ".join(f"'{x}'" for x in _SIGNATURES) + f"][CAST(event_id % {len(_SIGNATURES)} + 1 AS INTEGER)]"


@query("p41_signature_status", f"""WITH a AS (SELECT event_id, {_SIG} AS sig, event_id % 13 AS samples FROM events), b AS (SELECT *, CASE WHEN starts_with(sig, '[') THEN len(string_split(sig, ',')) ELSE 0 END AS k FROM a)
SELECT event_id, CASE WHEN k >= 8 THEN 'valid' ELSE 'missing' END AS status, CASE WHEN k >= 8 THEN 'waveform_signature_ready' WHEN sig <> '' THEN 'invalid_shape_signature_payload' WHEN samples >= 8 THEN 'waveform_present_but_signature_missing' ELSE 'waveform_insufficient_samples' END AS reason, CASE WHEN sig <> '' THEN k ELSE samples END AS n_values FROM b""")
def p41(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _SIGNATURES)), (F.col("event_id") % len(_SIGNATURES) + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in L.signature_status(text, F.col("event_id") % 13).items()))


@query("p43_classifier_phase", f"WITH {CYC}, a AS (SELECT *, CASE cycle % 3 WHEN 0 THEN 'multi_phase' WHEN 1 THEN 'single_phase' END AS mode FROM cyc) SELECT user_id, cycle, CASE WHEN mode = 'multi_phase' OR (mode IS NULL AND 50 * peak_w > 5000) THEN 'three_phase' ELSE 'single_phase' END AS phase_mode FROM a")
def p43(spark, sf_dir):
    mode = F.when(F.col("cycle") % 3 == 0, "multi_phase").when(F.col("cycle") % 3 == 1, "single_phase")
    return cycles(spark, sf_dir).select("user_id", "cycle", L.classifier_phase(mode, 50 * F.col("peak_w")).alias("phase_mode"))


@query("r01_thinned_profiles", f"""WITH {PROFILE}, a AS (SELECT *, greatest(1, n // 4) AS k FROM prof), b AS (SELECT *, list_filter(range(1, n + 1), lambda i: (i - 1) % k = 0 OR i = n) AS kept,
CASE WHEN n > 5 THEN list_transform(range(0, 5), lambda i: CAST(floor(i * (n - 1) / 4) AS BIGINT) + 1) ELSE range(1, n + 1) END AS even FROM a)
SELECT user_id, cycle, len(kept) AS n_thinned, round(list_sum(list_transform(kept, lambda i: v[i])), 6) AS thinned_w, len(even) AS n_sampled, round(list_sum(list_transform(even, lambda i: v[i])), 6) AS sampled_w FROM b""")
def r01(spark, sf_dir):
    """Profiles hold a handful of readings here, so four and five points stand for 96 and 64."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda m, x: m + x["p"])
    out = profiled(spark, sf_dir).withColumns({"thin": L.thinned(F.col("points"), 4), "even": L.sampled(F.col("points"), 5)})
    return out.select("user_id", "cycle", F.size("thin").cast("long").alias("n_thinned"), F.round(total("thin"), 6).alias("thinned_w"), F.size("even").cast("long").alias("n_sampled"), F.round(total("even"), 6).alias("sampled_w"))


_FEATURES = ("avg_w", "peak_w", "duration_s", "energy_wh", "variance", "rise_rate", "fall_rate", "peak_to_avg", "duty")
_WEIGHTS = (0.20, 0.20, 0.15, 0.10, 0.08, 0.07, 0.07, 0.05)


@query("r17_feature_distance", f"""WITH {CYC}, a AS (SELECT *, {', '.join(f'lag({c}) OVER w AS q_{c}' for c in _FEATURES)} FROM cyc WINDOW w AS (PARTITION BY user_id ORDER BY start_s, cycle))
SELECT user_id, cycle, round(least(1.0, {' + '.join(f'{w} * abs({c} - q_{c}) / greatest(abs({c}), abs(q_{c}), 1.0)' for c, w in zip(_FEATURES, _WEIGHTS, strict=False))} + 0.05 * abs(duty - q_duty)
+ CASE WHEN (rise_rate > 100) <> (q_rise_rate > 100) THEN 0.02 ELSE 0.0 END + CASE WHEN (peak_to_avg >= 1.25) <> (q_peak_to_avg >= 1.25) THEN 0.01 ELSE 0.0 END), 6) AS distance FROM a WHERE q_avg_w IS NOT NULL""")
def r17(spark, sf_dir):
    """Each cycle against the one before it."""
    w = Window.partitionBy("user_id").orderBy("start_s", "cycle")
    out = cycles(spark, sf_dir).withColumns({f"q_{c}": F.lag(c).over(w) for c in _FEATURES}).where(F.col("q_avg_w").isNotNull())
    side = lambda q: {c: F.col(q + c) for c in _FEATURES} | {"heating": F.col(q + "rise_rate") > 100, "motor": F.col(q + "peak_to_avg") >= 1.25}
    return out.select("user_id", "cycle", F.round(L.feature_distance(side(""), side("q_")), 6).alias("distance"))


def rated(spark, sf_dir):
    return patterns(spark, sf_dir).withColumn("status", C.status(F.col("seen"), 10))


@query("a06_provisional_count", f"WITH {PAT} SELECT count(*) AS n FROM pat WHERE seen < 10")
def a06(spark, sf_dir):
    return rated(spark, sf_dir).where(F.col("status") == "weak_pattern").agg(F.count("*").alias("n"))


@query("o11_provisional", f"WITH {PAT} SELECT phase, label, seen, last_s FROM pat WHERE seen < 10 ORDER BY last_s DESC, phase, label LIMIT 20")
def o11(spark, sf_dir):
    return C.provisional(rated(spark, sf_dir), 20, ("phase", "label")).select("phase", "label", "seen", "last_s")


@query("a24_learning_counters", f"WITH {PAT} SELECT CASE WHEN seen < 10 THEN 'weak_pattern' ELSE 'active' END AS status, count(*) AS n FROM pat GROUP BY 1")
def a24(spark, sf_dir):
    return C.learning_counters(rated(spark, sf_dir), "status")


_LOCKS = (("unknown_3", "l2", 1), ("Unknown 3", "L1", 2), ("unknown_0", "L9", 3), (" ", "L1", 4), ("unknown_1", "L3", 5))
_LOCKED = "locks(label, phase, seq) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _LOCKS) + """),
kept AS (SELECT trim(replace(replace(lower(trim(label)), '_like', ''), '_', ' ')) AS label_key, arg_max(upper(phase), seq) AS phase FROM locks WHERE upper(phase) IN ('L1', 'L2', 'L3') AND trim(label) <> '' GROUP BY 1)"""


def locks(spark):
    return C.phase_locks(spark.createDataFrame(_LOCKS, "label string, phase string, seq int"), F.col("seq"))


@query("o12_phase_locks", f"WITH {_LOCKED} SELECT label_key, phase FROM kept")
def o12(spark, sf_dir):
    return locks(spark)


@query("m02_locked_patterns", f"WITH {PAT}, {_LOCKED} SELECT coalesce(k.phase, p.phase) AS phase, p.label, seen, k.phase IS NOT NULL AS locked FROM pat p LEFT JOIN kept k ON replace(p.label, '_', ' ') = k.label_key")
def m02(spark, sf_dir):
    return C.aligned(patterns(spark, sf_dir), locks(spark)).select("phase", "label", "seen", "locked")


@query("k03_upserted_patterns", f"WITH {PAT} SELECT phase, label, CASE WHEN phase = 'L1' THEN seen + 1 ELSE seen END AS seen FROM pat")
def k03(spark, sf_dir):
    known = patterns(spark, sf_dir).select("phase", "label", "seen")
    return M.upserted(known, known.where("phase = 'L1'").withColumn("seen", F.col("seen") + 1), ("phase", "label"))


@query("j09_dataset_rows", f"WITH {PAT}, good AS (SELECT phase, label, CASE WHEN seen >= 20 THEN 'brauchbar' ELSE 'sehr_gut' END AS q FROM pat WHERE seen >= 10) SELECT user_id, cycle, coalesce(g.label, 'unknown') AS target_candidate, coalesce(q, 'unsicher') AS target_quality, round(avg_w, 6) AS avg_w FROM cyc c LEFT JOIN good g ON c.phase = g.phase AND c.label = g.label")
def j09(spark, sf_dir):
    good = rated(spark, sf_dir).where("status = 'active'").withColumns({"name": F.col("label"), "q": F.when(F.col("seen") >= 20, "brauchbar").otherwise("sehr_gut")})
    return C.dataset_rows(cycles(spark, sf_dir), good, ("phase", "label"), "name", "q").select("user_id", "cycle", "target_candidate", "target_quality", *r6("avg_w"))


@query("w31_primed_baseline", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT user_id, round(avg(value), 6) AS base, round(greatest(stddev_pop(value), 2.0), 6) AS spread FROM a WHERE back <= 40 AND value <= 150 GROUP BY user_id")
def w31(spark, sf_dir):
    return C.primed(events(spark, sf_dir), 150.0, 40).select("user_id", *r6("base", "spread"))


@query("w37_diagnostics", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events), b AS (SELECT user_id, avg(value) AS base, greatest(stddev_pop(value), 2.0) AS spread FROM p WHERE back <= 40 AND value <= 150 GROUP BY user_id)
SELECT event_id, round(avg(value) OVER w, 6) AS recent_avg_w, round(var_pop(value) OVER w, 6) AS recent_var, round(base + 1.4 * spread, 6) AS startup_w, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) < 30 AS learning
FROM events e JOIN b USING (user_id) WINDOW w AS (PARTITION BY e.user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w37(spark, sf_dir):
    e = events(spark, sf_dir)
    out = C.diagnostics(e.join(C.primed(e, 150.0, 40), "user_id"), F.col("base"), F.col("spread"))
    return out.select("event_id", *r6("recent_avg_w", "recent_var", "startup_w"), "learning")


@query("w39_routes", "WITH d AS (SELECT c_custkey, lower(c_mktsegment) AS k FROM customer), t AS (SELECT c_custkey, CASE k WHEN 'building' THEN 'inverter' WHEN 'machinery' THEN 'adaptive' ELSE 'fridge' END AS k FROM d) SELECT c_custkey, unnest(CASE k WHEN 'inverter' THEN ['inverter', 'adaptive'] WHEN 'adaptive' THEN ['adaptive'] ELSE ['fridge', 'adaptive'] END) AS detector FROM t")
def w39(spark, sf_dir):
    """Market segments stand in for device types."""
    kind = F.when(F.lower("c_mktsegment") == "building", "Inverter").when(F.lower("c_mktsegment") == "machinery", "adaptive")
    return C.routed(spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("detector_type", F.coalesce(kind, F.lit("fridge")))).select("c_custkey", "detector")


@query("c05_shape_match")
def c05(spark, sf_dir):
    """The pattern of its phase whose curve fits each cycle best, by distance, warping, duration and power."""
    from wattline.plans.cycle_tables import shaped
    from wattline.sources.steps import written

    c = written(shaped(spark, sf_dir).select("user_id", "cycle", "phase", "label", "curve", "duration_s", "avg_w"), "shaped")
    return shape_match(c).select("user_id", "cycle", "label", "score")


def shape_match(c: DataFrame) -> DataFrame:
    """Cycles (phase, label, curve, duration_s, avg_w) that have a curve, with the label of the pattern that fits best and its score.

    A phase has as many patterns as it has labels, so those of all phases travel to the cycles."""
    p = c.groupBy("phase", F.col("label").alias("name")).agg(A.mean_curve().alias("curve"), F.avg("duration_s").alias("s"), F.avg("avg_w").alias("w")).where("curve IS NOT NULL")
    held = p.groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("name", "curve", "s", "w"))).alias("held"))
    both = c.where("curve IS NOT NULL").join(F.broadcast(held), "phase").withColumn("scores", V.curve_scores(F.col("curve"), F.transform("held", lambda x: x["curve"])))

    def fit(x: Column, of: Column) -> Column:
        apart = F.least(S.rel(x["s"], F.col("duration_s")) + S.rel(x["w"], F.col("avg_w")), F.lit(1.0))
        return F.struct(F.round(S.clamp(0.48 * of["euclid"] + 0.42 * of["dtw"] + 0.10 * (1 - apart)), 6).alias("score"), x["name"].alias("name"))

    best = both.withColumn("best", F.array_max(F.zip_with("held", "scores", fit)))
    return best.withColumns({"label": F.col("best.name"), "score": F.col("best.score")}).drop("held", "scores", "best")


#: Readings of a day as one JSON list of mixed form: numbers, objects, texts with a decimal comma, nulls and lists.
_TEXT = """CASE event_id % 5 WHEN 0 THEN CAST(v AS {text}) WHEN 1 THEN '{{"t_s": ' || CAST(k AS {text}) || ', "power_w": ' || CAST(v - 20 AS {text}) || ', "t_norm": ' || CAST(CAST(k AS DOUBLE) / 64 AS {text}) || '}}'
WHEN 2 THEN '{{"watts": "' || replace(CAST(v AS {text}), '.', ',') || '"}}' WHEN 3 THEN 'null' ELSE '{{"power_w": "none", "p": 3}}' END"""
_ELEMENT = "json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL')"
_FLOAT = "coalesce(TRY_CAST(replace(trim(json_extract_string({0}, '$')), ',', '.') AS DOUBLE), 0.0)"


def mixed_points(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).withColumn("v", F.round("value", 2))
    parts = rows.select("user_id", "k", F.expr(_TEXT.format(text="STRING")).alias("part"))
    ordered = parts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    return ordered.select("user_id", F.concat(F.lit("["), F.array_join(F.transform("parts", lambda x: x["part"]), ", "), F.lit("]")).alias("text"))


MIXED = f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, round(value, 2) AS v FROM events),
t AS (SELECT user_id, '[' || string_agg({_TEXT.format(text="VARCHAR")}, ', ' ORDER BY k) || ']' AS text FROM k GROUP BY user_id),
e AS (SELECT user_id, CAST(CAST(text AS JSON) AS JSON[]) AS e FROM t)"""


@query("r09_mixed_values", f"""{MIXED}, n AS (SELECT user_id, list_filter(list_transform(e, lambda x: CASE WHEN {_ELEMENT} THEN greatest({_FLOAT.format("x")}, 0.0)
WHEN json_type(x) = 'OBJECT' AND json_exists(x, '$.power_w') THEN greatest({_FLOAT.format("json_extract(x, '$.power_w')")}, 0.0)
WHEN json_type(x) = 'OBJECT' AND json_exists(x, '$.watts') THEN greatest({_FLOAT.format("json_extract(x, '$.watts')")}, 0.0) END), lambda y: y IS NOT NULL) AS v FROM e)
SELECT user_id, CAST(len(v) AS INTEGER) AS n_values, round(coalesce(list_sum(v), 0), 4) AS total, round(coalesce(list_max(v), 0), 4) AS most FROM n""")
def r09(spark, sf_dir):
    from wattline.functions.points import point_values

    rows = mixed_points(spark, sf_dir).withColumn("v", point_values(F.col("text")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.select("user_id", F.size("v").alias("n_values"), F.round(total, 4).alias("total"), F.round(F.coalesce(F.array_max("v"), F.lit(0.0)), 4).alias("most"))


@query("r07_profile_points", f"""{MIXED}, o AS (SELECT user_id, list_transform(list_filter(e, lambda x: json_type(x) = 'OBJECT' AND (NOT json_exists(x, '$.power_w') OR TRY_CAST(json_extract_string(x, '$.power_w') AS DOUBLE) IS NOT NULL)),
lambda x: {{'t': coalesce(TRY_CAST(json_extract_string(x, '$.t_s') AS DOUBLE), 0.0), 'p': round(coalesce(TRY_CAST(json_extract_string(x, '$.power_w') AS DOUBLE), 0.0), 3), 'n': coalesce(TRY_CAST(json_extract_string(x, '$.t_norm') AS DOUBLE), 0.0)}})[1:128] AS a FROM e)
SELECT user_id, CAST(len(a) AS INTEGER) AS n_points, round(coalesce(list_sum(list_transform(a, lambda x: x.t)), 0), 3) AS t_sum, round(coalesce(list_sum(list_transform(a, lambda x: x.p)), 0), 3) AS p_sum,
round(coalesce(list_sum(list_transform(a, lambda x: round(least(greatest(x.n, 0.0), 1.0), 6))), 0), 5) AS n_sum FROM o""")
def r07(spark, sf_dir):
    from wattline.functions.points import profile_points

    rows = mixed_points(spark, sf_dir).withColumn("a", profile_points(F.col("text")))
    total = lambda c: F.aggregate(F.transform("a", lambda x: x[c]), F.lit(0.0), lambda m, x: m + x)
    return rows.select("user_id", F.size("a").alias("n_points"), F.round(total("t_s"), 3).alias("t_sum"), F.round(total("power_w"), 3).alias("p_sum"), F.round(total("t_norm"), 5).alias("n_sum"))


@query("p24_frequency_labels", f"""WITH {PAT} SELECT phase, label, CASE WHEN per_day >= 1.5 THEN CAST(CAST(round(per_day) AS BIGINT) AS VARCHAR) || 'x taeglich' WHEN per_day >= 0.5 THEN 'taeglich'
WHEN per_day >= 0.2 THEN 'mehrmals pro Woche' WHEN per_day >= 0.05 THEN 'woechentlich' ELSE 'selten' END AS often, trim(replace(replace(lower(trim(label)), '_like', ''), '_', ' ')) || ':' || phase AS device_group FROM pat""")
def p24(spark, sf_dir):
    """How often each pattern is seen, in words, and the device group that it belongs to."""
    from wattline.functions import scalars as S

    return patterns(spark, sf_dir).select("phase", "label", S.frequency_label(F.col("per_day")).alias("often"), S.device_group(F.col("label"), F.col("phase")).alias("device_group"))


@query("p37_guessed_devices", """SELECT event_id, CASE WHEN value BETWEEN 50 AND 200 THEN 'fridge' WHEN value BETWEEN 200 AND 500 THEN 'pump' WHEN value BETWEEN 500 AND 1500 THEN 'microwave'
WHEN value BETWEEN 1500 AND 2500 THEN 'washing_machine' WHEN value > 2500 THEN 'heater' ELSE 'unknown' END AS device FROM events""")
def p37(spark, sf_dir):
    """A device for each reading by its power alone."""
    from wattline.functions import scalars as S

    return events(spark, sf_dir).select("event_id", S.guess_device(F.col("value")).alias("device"))


@query("p28_overlapping_cycles", f"""WITH {CYC}, b AS (SELECT a.user_id, a.cycle, b.user_id AS other, b.cycle AS other_cycle FROM cyc a JOIN cyc b
ON a.user_id + 3 = b.user_id AND greatest(a.start_s, b.start_s) <= least(a.end_s, b.end_s)) SELECT user_id, cycle, count(*) AS n_overlapping, min(other_cycle) AS first_cycle FROM b GROUP BY user_id, cycle""")
def p28(spark, sf_dir):
    """Cycles that share time with cycles of the next series of their phase."""
    from wattline.functions import scalars as S

    c = cycles(spark, sf_dir).select("user_id", "cycle", "start_s", "end_s")
    other = c.select((F.col("user_id") - 3).alias("user_id"), F.col("cycle").alias("other_cycle"), F.col("start_s").alias("other_s"), F.col("end_s").alias("other_e"))
    both = c.join(other, "user_id").where(S.overlaps(F.col("start_s"), F.col("end_s"), F.col("other_s"), F.col("other_e")))
    return both.groupBy("user_id", "cycle").agg(F.count("*").alias("n_overlapping"), F.min("other_cycle").alias("first_cycle"))
