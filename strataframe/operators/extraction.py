"""Facts from report text: event category, severity, depths, lost hours, well names; and how well they were found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.encode import encode_contains
from strataframe.functions.numeric import round_half_up

# Event phrases and severity words.
LEXICON = [
    ("loss of mud", "MUD_LOSS"), ("mud loss", "MUD_LOSS"), ("losses observed", "MUD_LOSS"),
    ("annular pressure drop", "MUD_LOSS"),
    ("pack-off", "STUCK_PIPE"), ("differential sticking", "STUCK_PIPE"), ("stuck pipe", "STUCK_PIPE"),
    ("freeze pipe", "STUCK_PIPE"),
    ("overpressure", "KICK"), ("influx", "KICK"), ("flow check positive", "KICK"), ("kick", "KICK"),
    ("torque spike", "TORQUE_SPIKE"), ("high torque", "TORQUE_SPIKE"),
    ("fishing", "FISHING"),
]
SEVERITY_WORDS = [("minor", 1), ("slight", 1), ("moderate", 3), ("severe", 5), ("major", 5), ("significant", 5)]
DEPTH = r"(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*[mM]\b"


def normalise(text) -> Column:
    """Lower case, dashes folded, white space collapsed."""
    from strataframe.functions.text import DASHES

    t = F.lower(text if isinstance(text, Column) else F.col(text))
    return F.trim(F.regexp_replace(F.translate(t, DASHES, "-" * len(DASHES)), r"\s+", " "))


def _metres(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("bigint")


def extract_facts(df: DataFrame, text: str) -> DataFrame:
    """Adds category, severity, from_m, to_m and npt_hours; null where the text says nothing."""
    t = normalise(text)
    between = r"between (\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*m? and " + DEPTH
    single = r"(?:at|reaching) " + DEPTH
    lo = F.coalesce(_metres(F.nullif(F.regexp_extract(t, between, 1), F.lit(""))),
                    _metres(F.nullif(F.regexp_extract(t, single, 1), F.lit(""))))
    hi = F.coalesce(_metres(F.nullif(F.regexp_extract(t, between, 2), F.lit(""))), lo)
    hours = F.nullif(F.regexp_extract(t, r"npt[a-z ]*? (?:at|of) (\d+(?:\.\d+)?) hours", 1), F.lit(""))
    return df.withColumns({
        "category": encode_contains(t, LEXICON, None),
        "severity": encode_contains(t, SEVERITY_WORDS, None).cast("int"),
        "from_m": lo, "to_m": hi, "npt_hours": hours.try_cast("double"),
    })


def name_key(name) -> Column:
    """Well name without spaces and dashes, letters that OCR confuses with digits made digits after the first letter."""
    s = F.upper(F.regexp_replace(name if isinstance(name, Column) else F.col(name), r"[\s_-]+", ""))
    tail = F.translate(F.substring(s, F.lit(2), F.length(s)), "LIO", "110")
    return F.concat(F.substring(s, 1, 1), tail)


def resolve_names(df: DataFrame, name: str, wells: DataFrame, well_name: str, well_id: str) -> DataFrame:
    """Rows with the well whose name is the same up to spacing, dashes and look-alike characters."""
    known = wells.select(F.col(well_id), name_key(well_name).alias("_key"))
    return df.withColumn("_key", name_key(name)).join(known, "_key", "left").drop("_key")


def fuzzy_names(df: DataFrame, name: str, wells: DataFrame, well_name: str, well_id: str, edits: int = 1) -> DataFrame:
    """As `resolve_names`, also allowing up to `edits` wrong, missing or extra characters; the nearest name wins.

    Keys that many edits apart agree on some form with that many characters left out, so the join is an equi join on
    these forms.
    """
    from strataframe.operators.joins import first_match_join

    def shorter(forms: Column) -> Column:
        drop = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(k))), lambda i: F.concat(
            F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
        return F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, drop))))

    def forms(df: DataFrame, key: str) -> DataFrame:
        out = F.array(F.col(key))
        for _ in range(edits):
            out = shorter(out)
        return df.withColumn("_form", F.explode(out))

    known = forms(wells.select(F.col(well_id), name_key(well_name).alias("_wk")), "_wk")
    asked = df.select(name).distinct().withColumn("_key", name_key(name))
    cand = forms(asked, "_key").join(known, "_form")
    cand = cand.withColumn("_d", F.levenshtein("_key", "_wk")).where(F.col("_d") <= edits)
    return first_match_join(df, cand.select(name, well_id, "_d"), [name], ["_d", well_id], [well_id])


def entity_scores(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Precision, recall and F1 per entity; both sides are (key..., entity, value) and values match as text."""
    cols = [*key, "entity", "value"]
    f = found.where(F.col("value").isNotNull()).select(*cols).distinct().withColumn("_f", F.lit(1))
    t = truth.where(F.col("value").isNotNull()).select(*cols).distinct().withColumn("_t", F.lit(1))
    both = f.join(t, cols, "full")
    agg = both.groupBy("entity").agg(F.count(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1)).alias("tp"),
                                     F.count("_f").alias("_nf"), F.count("_t").alias("_nt"))
    p = F.when(F.col("_nf") > 0, F.col("tp") / F.col("_nf")).otherwise(0.0)
    r = F.when(F.col("_nt") > 0, F.col("tp") / F.col("_nt")).otherwise(0.0)
    return agg.select(
        "entity", "tp", (F.col("_nf") - F.col("tp")).alias("fp"), (F.col("_nt") - F.col("tp")).alias("fn"),
        round_half_up(p, 4).alias("precision"), round_half_up(r, 4).alias("recall"),
        F.when(p + r > 0, round_half_up(2 * p * r / (p + r), 4)).otherwise(0.0).alias("f1"))
