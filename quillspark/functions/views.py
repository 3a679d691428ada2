"""Rules that name a study's view from its description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Study types by confidence, and keywords of views.
HIGH = ["Chest Single AP view", "DG CHEST 1V"]
MEDIUM = ["DG CHEST 1V PORT", "PORTABLE CHEST - 1 VIEW", "XR chest 1V portable"]
TWO_VIEW = ["DG CHEST 2V", "Chest PA and Left Lateral", "Chest AP Left Lateral", "CHEST - 2 VIEW"]
KEYWORDS = {
    "PA": ["PA", "posteroanterior", "posterior-anterior"],
    "AP": ["AP", "anteroposterior", "anterior-posterior"],
    "Lateral": ["lateral", "lat", "side"],
    "Frontal": ["frontal", "front"],
    "Portable": ["port", "portable", "PORT"],
    "Single": ["single", "1v", "1 view", "1V"],
    "Two": ["2v", "2 view", "2V", "two"],
}


def holds(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in parts))


def study_type(c: Column) -> Column:
    """The tiers in their order; the first one's 'DG CHEST 1V' is part of the second one's first entry, which so is never reached."""
    return F.when(holds(c, HIGH), "single_view").when(holds(c, MEDIUM), "portable").when(holds(c, TWO_VIEW), "two_view").otherwise("unknown")


def confidence(c: Column) -> Column:
    return F.when(holds(c, HIGH), "high").when(holds(c, MEDIUM), "medium").when(holds(c, TWO_VIEW), "high").otherwise("low")


def simple_view(c: Column) -> Column:
    return F.when(holds(c, ["2V"]), "PA").when(holds(c, ["AP"]), "AP").when(holds(c, ["PORT"]), "AP").when(holds(c, ["1V"]), "PA").otherwise("Unknown")


def view(c: Column, kind: Column) -> Column:
    low = F.lower(c)
    return F.when(holds(low, ["ap"]), "AP").when(holds(low, ["pa"]), "PA").when(kind.isin("two_view", "single_view"), "PA").when(kind == "portable", "AP").otherwise("Unknown")


def detected(c: Column, text: Column | None = None) -> Column:
    """Views whose keywords the description holds, then those only found in the text, with '_in_text'."""
    low = F.lower(c)
    in_desc = {k: holds(low, sorted({w.lower() for w in ws})) for k, ws in KEYWORDS.items()}
    out = [F.when(x, F.lit(k)) for k, x in in_desc.items()]
    if text is not None:
        out += [F.when(~in_desc[k] & holds(F.lower(text), sorted({w.lower() for w in ws})), F.lit(f"{k}_in_text")) for k, ws in KEYWORDS.items()]
    return F.array_compact(F.array(*out))


def frontal_images(names: Column) -> Column:
    """Names without 'lateral'; all of them if none is left."""
    found = F.filter(names, lambda x: ~F.contains(F.lower(F.element_at(F.split(x, "/"), -1)), F.lit("lateral")))
    return F.when(F.size(found) == 0, names).otherwise(found)


def flags(desc: Column, text: Column, whole_words: bool = False) -> dict[str, Column]:
    """Booleans of the view breakdown. As stated, 'pa' and 'ap' count inside words too; whole_words asks for words."""
    d, t = F.lower(desc), F.lower(text)
    has = (lambda c, w: c.rlike(rf"\b{w}\b")) if whole_words else (lambda c, w: F.contains(c, F.lit(w)))
    pa, ap, lat = has(d, "pa"), has(d, "ap"), F.contains(d, F.lit("lateral"))
    tpa, tap, tlat = has(t, "pa"), has(t, "ap"), F.contains(t, F.lit("lateral"))
    frontal, lateral = pa | ap | tpa | tap, lat | tlat
    return {
        "frontal": frontal, "lateral": lateral, "pa_lateral": frontal & pa & lat, "ap_lateral": frontal & ~(pa & lat) & ap & lat,
        "pa_only": frontal & ~(pa & lat) & ~(ap & lat) & (pa | tpa), "ap_only": frontal & ~(pa & lat) & ~(ap & lat) & ~(pa | tpa),
        "lateral_only": lateral & ~frontal, "portable": holds(d, ["port"]), "two_view": holds(d, ["2v", "2 view"]),
        "single_view": holds(d, ["1v", "1 view", "single"]), "unclear": ~frontal & ~lateral,
    }
