"""Semantic queries: term rules, confidences, series, rectangles, shapes, numeric states and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.text import ascii_lower
from catalith.operators.store import live

# The bits of match terms.
TERMS = {
    "crop": 0, "border": 1, "margin": 2, "padding": 3, "active_area": 4, "origin": 5, "offset": 6, "size": 7, "sensor": 8, "image": 9,
    "exposure": 10, "bias": 11, "gain": 12, "white_balance": 13, "color": 14, "matrix": 15, "calibration": 16, "profile": 17,
    "lens": 18, "correction": 19, "orientation": 20, "black_level": 21, "white_level": 22, "linearization": 23, "cfa": 24, "raw": 25,
    "storage": 26, "source_processing": 27, "title": 28, "description": 29, "creator": 30, "keywords": 31,
}
# Per query kind the terms and the phrases that give them; ~ is a blank or nothing, ^ the beginning of a name.
RULES = (
    ("crop", "crop", "crop"), ("crop", "border", "border"), ("crop", "margin", "margin"),
    ("crop", "padding", "padding|masked~area|optical~black"), ("crop", "active_area", "active~area"), ("crop", "origin", "origin"),
    ("crop", "offset", "offset"), ("crop", "size", "size|width|height"), ("crop", "sensor", "sensor"), ("crop", "image", "image"),
    ("exposure_gain", "exposure", "exposure|ae~program|shutter|aperture|f~number|f-number|brightness|iso"),
    ("exposure_gain", "bias", "bias|compensation"), ("exposure_gain", "gain", "gain"),
    ("white_balance", "white_balance", "white~balance|asshotneutral|asshotwhitexy|colortemp|color temperature|^wb|_wb| wb"),
    ("color", "color", "color|colour|illuminant|profile|tone~curve|creative~style|picture~style|film~simulation|dynamic range optimizer|dynamicrangeoptimizer|matrix|camera to xyz|cameratoxyz|camera to rgb|cameratorgb|ccm"),
    ("color", "matrix", "matrix|camera to xyz|cameratoxyz|camera to rgb|cameratorgb|ccm"), ("color", "calibration", "calibration"), ("color", "profile", "profile"),
    ("lens_correction", "lens", "lens|distort|vignet|aberration|shading|peripheral|diffraction|opcode|radial~correction|optical~correction|afmicroadj|af micro adj|microadjustment"),
    ("lens_correction", "correction", "corr|distort|vignet|aberration|shading|opcode|afmicroadj|af micro adj|microadjustment"),
    ("orientation", "orientation", "orientation"),
    ("raw_processing", "black_level", "black~level|optical~black|black~mask"), ("raw_processing", "white_level", "white~level|white~clip|saturation~level"),
    ("raw_processing", "linearization", "linearization|linearity|linear~response|raw~curve|klut"), ("raw_processing", "cfa", "cfa|bayer"),
    ("raw_processing", "raw", "raw~data|raw~file|raw~format|raw~image|originalraw"),
    ("raw_processing", "storage", "storage|strip|byte~count|file~offset|data~offset|data~length|compressed~data|byte~order"),
    ("raw_processing", "sensor", "sensor|valid~bits|bit~depth|raw~depth|raw~value~range|rawvaluemedian|raw value median|masked~pixels"),
    ("raw_processing", "source_processing", "pixel~shift|multi~shot|multi~frame|deep~fusion|smart hdr|image~fusion|creative~style|picture~style|film~simulation|dynamic range optimizer|dynamicrangeoptimizer"
     "|active~dlighting|raw~develop|ambience|thermal|radiometric|emissivity|planck|ir~window|real2ir|real to ir|stitch|panorama|panoramic"),
    ("descriptive", "title", "title|object~name|headline"), ("descriptive", "description", "description|caption|abstract|comment"),
    ("descriptive", "creator", "creator|author|byline|by-line"), ("descriptive", "keywords", "keyword|subject"),
)
# Directories whose name alone gives a term.
GROUP_RULES = (("crop", "sensor", "phaseone"), ("raw_processing", "sensor", "phaseone"))
# The confidence of a kind's terms; the highest that holds counts.
CONFIDENCES = (
    ("crop", "crop", 90), ("crop", "active_area", 88), ("crop", "border", 70), ("crop", "margin", 70), ("crop", "padding", 70), ("crop", "sensor", 45), ("crop", "image", 45),
    ("exposure_gain", "exposure", 90), ("exposure_gain", "gain", 90), ("exposure_gain", "bias", 82), ("white_balance", "white_balance", 90),
    ("color", "matrix", 94), ("color", "calibration", 88), ("color", "profile", 88), ("color", "color", 70), ("orientation", "orientation", 95),
    ("raw_processing", "black_level", 92), ("raw_processing", "white_level", 92), ("raw_processing", "linearization", 92), ("raw_processing", "cfa", 92),
    ("raw_processing", "raw", 86), ("raw_processing", "storage", 86), ("raw_processing", "source_processing", 84), ("raw_processing", "sensor", 78),
    ("descriptive", "title", 90), ("descriptive", "description", 90), ("descriptive", "creator", 90), ("descriptive", "keywords", 90),
)
LENS_BOTH, LENS_ONE = 92, 68


def bit(term: str) -> int:
    return 1 << TERMS[term]


def match_terms(df: DataFrame, name: str, group: str | None = None, rules: tuple = RULES) -> DataFrame:
    """df with one row for each query kind whose rules match name: kind and terms (long), the bits of the rules that do.

    group: a column with the directory, whose name can give terms too. The rules are constants of the plan, so matching
    is a projection without a join; a null or empty name matches nothing.
    """
    tests: dict[str, dict[str, Column]] = {}
    for kind, term, phrases in rules:
        tests.setdefault(kind, {})[term] = phrases
    own_dir = {(k, t): F.coalesce(F.contains(ascii_lower(group), F.lit(part)), F.lit(False)) for k, t, part in GROUP_RULES} if group is not None else {}

    def cells(low: Column) -> Column:
        out = []
        for kind, own in tests.items():
            bits = F.lit(0).cast("long")
            for term in dict.fromkeys([*own, *(t for k, t in own_dir if k == kind)]):
                hit = F.coalesce(_holds(low, own[term]), F.lit(False)) if term in own else F.lit(False)
                if (kind, term) in own_dir:
                    hit = hit | own_dir[kind, term]
                bits = bits + F.when(hit, F.lit(bit(term)).cast("long")).otherwise(F.lit(0).cast("long"))
            out.append(F.struct(F.lit(kind).alias("kind"), bits.alias("terms")))
        return F.filter(F.array(*out), lambda c: c["terms"] > 0)

    # the name is lowered once a row, however many rules read it
    once = F.element_at(F.transform(F.array(ascii_lower(name)), cells), 1)
    return df.select("*", F.explode(once).alias("_m")).select("*", "_m.*").drop("_m")


def _holds(low: Column, phrases: str) -> Column:
    """Whether one of the phrases stands in low: they are plain texts, so no regular expression is needed."""
    out = F.lit(False)
    for p in phrases.split("|"):
        for text in dict.fromkeys([p.replace("~", ""), p.replace("~", " ")]):
            out = out | (F.startswith(low, F.lit(text[1:])) if text.startswith("^") else F.contains(low, F.lit(text)))
    return out


def confidence(kind: Column, terms: Column, table: tuple = CONFIDENCES) -> Column:
    """The highest confidence of the bits in terms; lens correction needs both of its bits for the full one."""
    per = [F.when((kind == k) & (terms.bitwiseAND(F.lit(bit(t)).cast("long")) != 0), c).otherwise(0) for k, t, c in table]
    both = bit("lens") | bit("correction")
    lens = F.when(kind == "lens_correction", F.when(terms.bitwiseAND(F.lit(both)) == both, LENS_BOTH).when(terms.bitwiseAND(F.lit(both)) != 0, LENS_ONE).otherwise(0)).otherwise(0)
    return F.greatest(lens, *per)


def series_groups(entries: DataFrame, tags: list[int], least: int = 2) -> DataFrame:
    """Per directory the first live entry of each tag of a series, where at least `least` tags are there."""
    first = live(entries).where(F.col("tag").isin(tags)).groupBy("asset_id", "block_id", "ifd", "tag").agg(F.min("entry_id").alias("id"))
    g = first.groupBy("asset_id", "block_id", "ifd").agg(F.count("*").alias("n_tags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag", "id"))), lambda x: x["id"].cast("string")), ",").alias("sources"))
    return g.where(F.col("n_tags") >= least)


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y, w, h) of a crop with its origin at 0 or beyond and a positive size; else null."""
    return F.when((x >= 0) & (y >= 0) & (w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def bounds_rectangle(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    return rectangle(left, top, right - left, bottom - top)


def numeric_status(values: Column) -> Column:
    """not_numeric without values, invalid with any null or non-finite one, else complete."""
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(values.isNull() | (F.size(values) == 0), "not_numeric").when(bad, "invalid").otherwise("complete")


def shape(n: Column) -> Column:
    """Shape of a value of n numbers."""
    side = F.floor(F.sqrt(n.cast("double")) + 0.5).cast("int")
    return F.when(n == 0, "empty").when(n == 1, "scalar").when(n <= 4, F.concat(F.lit("vec"), n.cast("string"))).when(side * side == n, F.concat(F.lit("matrix"), side.cast("string"), F.lit("x"), side.cast("string"))).when(
        n % 3 == 0, F.concat(F.lit("matrix"), F.floor(n / 3).cast("int").cast("string"), F.lit("x3"))).otherwise("table")


def budgeted(df: DataFrame, partition: list[str], order: list[str], n: str, cap: int) -> DataFrame:
    """df with returned: how many of n values a shared budget of cap still gives, in order."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(n).over(w)
    return df.withColumn("returned", (F.least(run, F.lit(cap)) - F.least(run - F.col(n), F.lit(cap))).cast("long")).withColumn("status", F.when(F.col("returned") < F.col(n), "partial").otherwise("complete"))
