"""Labels: from free text to device types, what may be published, and what a pattern may learn under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.functions import scalars as S

# Device types of the offline pipeline and the analyzer, classes of the forest, and other names of both.
DEVICE_TYPES = ("fridge", "pump", "kettle", "microwave", "oven", "heater")
FOREST_CLASSES = ("fridge", "pump", "heater", "kettle", "microwave", "washing_machine", "dishwasher", "unknown")
ALIASES = {
    "kuehlschrank": "fridge", "kuhlschrank": "fridge", "wasserkocher": "kettle", "mikrowelle": "microwave", "ofen": "oven", "heizung": "heater",
    "waermepumpe": "pump",
}
ANALYZER_ALIASES = {**ALIASES, "kitchen_fridge": "fridge", "wärmepumpe": "pump"}
FOREST_ALIASES = {
    "kuehlschrank": "fridge", "kuhlschrank": "fridge", "wasserkocher": "kettle", "mikrowelle": "microwave", "heizung": "heater", "waermepumpe": "pump",
    "space_heater": "heater",
}


def _plain(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def _known(text: Column, names: dict[str, str]) -> Column:
    """The value of a literal map, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), text)


def inferred_label(label: Column, names: dict[str, str] = ALIASES) -> Column:
    """A device type from free text: another name of it, else the first type that the text holds, else the text itself."""
    text = _plain(label)
    held = F.coalesce(*(F.when(text.contains(t), t) for t in DEVICE_TYPES))
    return F.coalesce(F.when(text == "", "unknown"), _known(text, names), held, text)


def forest_label(label: Column) -> Column:
    """One of the classes that the forest knows; unknown for every other text."""
    text = F.replace(_plain(label), F.lit(" "), F.lit("_"))
    return F.coalesce(_known(text, FOREST_ALIASES), F.when(text.isin(*FOREST_CLASSES), text), F.lit("unknown"))


def public_name(user: Column, suggestion: Column, candidate: Column) -> Column:
    """The first label that may be published: the user's if it says something, else the suggestion, else the candidate."""
    private = "custom_user_label"
    user, suggestion, candidate = (S.public_label(c) for c in (user, suggestion, candidate))
    return F.coalesce(F.when(~user.isin(private, "unknown"), user), F.when(suggestion != private, suggestion), F.when(candidate != private, candidate), F.lit("unknown"))


def device_group_key(user: Column, candidate: Column, suggestion: Column) -> Column:
    return S.normalize_label(S.effective_label(user, candidate, suggestion))


def only_candidate(label: Column) -> Column:
    """Labels that name a guess and no device."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return text.endswith("_candidate") | text.startswith("unknown_") | (text == "constant_load_pattern")


def calm_low_power(c: dict[str, Column]) -> Column:
    """c: avg, dur, inrush, motor."""
    return (c["avg"] <= 220) & (c["dur"] >= 120) & (c["inrush"] < 1.25) & ~c["motor"]


def learning_label(label: Column, c: dict[str, Column], candidates: Column | None = None) -> Column:
    """The name that a cycle is learned under until it is confirmed. candidates: array of labels, best first."""
    text = F.trim(F.coalesce(label, F.lit("")))
    text = F.when(text == "", "unknown").otherwise(text)
    out = F.when(calm_low_power(c), "electronics_cluster").when(text == "unknown_constant_load", "constant_load_pattern").when(only_candidate(text), text)
    if candidates is not None:
        guess = F.try_element_at(F.filter(candidates, only_candidate), F.lit(1))
        out = out.when(guess.isNotNull(), F.trim(guess))
    return (
        out.when(text.isin("fridge", "fridge_like"), "fridge_candidate").when(text.isin("compressor_small", "compressor_large", "compressor"), "compressor_candidate")
        .when(text.isin("small_pump_motor", "large_pump_motor", "pump"), "pump_candidate").when(text.isin("motor", "unknown_motor", "unknown_high_inrush"), "motor_candidate").otherwise(text)
    )


def signature_values(text: Column) -> Column:
    """The numbers of a stored signature; an empty array for anything that isn't one, zero for a value that isn't a number."""
    values = F.from_json(F.trim(text), "array<string>")
    return F.coalesce(F.transform(values, lambda x: S.safe_float(x)), F.array().cast("array<double>"))


def signature_status(text: Column, samples: Column) -> dict[str, Column]:
    """Whether a stored signature can be compared, why not, and how many values or samples there are."""
    given, n = F.trim(F.coalesce(text, F.lit(""))) != "", F.size(signature_values(F.coalesce(text, F.lit(""))))
    reason = F.when(given & (n >= 8), "waveform_signature_ready").when(given, "invalid_shape_signature_payload").when(samples >= 8, "waveform_present_but_signature_missing").otherwise("waveform_insufficient_samples")
    return {"status": F.when(given & (n >= 8), "valid").otherwise("missing"), "reason": reason, "n_values": F.when(given, n).otherwise(samples).cast("long")}


def classifier_phase(mode: Column, peak: Column) -> Column:
    """three_phase or single_phase; by power alone where the mode says neither."""
    return F.when(mode == "multi_phase", "three_phase").when(mode == "single_phase", "single_phase").when(peak > 5000, "three_phase").otherwise("single_phase")


def thinned(points: Column, most: int = 96) -> Column:
    """Every k-th point of a profile, k = n / most, and its last."""
    n = F.size(points)
    stride = F.greatest(F.lit(1), F.floor(n / most).cast("int"))
    return F.filter(points, lambda x, i: (i % stride == 0) | (i == n - 1))


def sampled(points: Column, most: int = 64) -> Column:
    """`most` points at even positions, the first and last among them; shorter profiles stay."""
    n = F.size(points)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.try_element_at(points, F.floor(i * (n - 1) / (most - 1)).cast("int") + 1))
    return F.when(n > most, even).otherwise(points)


def feature_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of two cycles by their features alone, in [0, 1]."""
    weights = (("avg_w", 0.20), ("peak_w", 0.20), ("duration_s", 0.15), ("energy_wh", 0.10), ("variance", 0.08), ("rise_rate", 0.07), ("fall_rate", 0.07), ("peak_to_avg", 0.05))
    out = sum((w * S.rel(a[c], b[c]) for c, w in weights), 0.05 * F.abs(a["duty"] - b["duty"]))
    out = out + F.when(a["heating"] != b["heating"], 0.02).otherwise(0.0) + F.when(a["motor"] != b["motor"], 0.01).otherwise(0.0)
    return F.least(out, F.lit(1.0))
