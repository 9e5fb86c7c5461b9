"""Labelled sample set: clean records with ground truth, and copies with one seeded defect each.

Every value is a hash of (record number, seed, slot), so the set is the same for any partitioning and a value of
another record can be written down without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import constants as K

# Ranges of the generated numbers.
YEARS = (1990, 2024)
SERIALS = (100, 99999)
SURVEY_BLOCKS = (1, 999)
SURVEY_PARTS = (1, 9)
PLAUSIBLE_YEARS = (1981, 2023)
OLD_YEARS = (1900, 1979)
FUTURE_YEARS = (2027, 2030)
BAD_SURVEYS = (10000, 99999)
EXTENT_HUNDREDTHS = (10, 990)


def _draw(index: Column, seed: int, slot: str, low: int, high: int) -> Column:
    return F.pmod(F.xxhash64(index, F.lit(seed), F.lit(slot)), F.lit(high - low + 1)) + F.lit(low)


def _pick(index: Column, seed: int, slot: str, bank: list[str]) -> Column:
    at = _draw(index, seed, slot, 1, len(bank)).cast("int")
    return F.element_at(F.array(*[F.lit(w) for w in bank]), at)


def property_id(index: Column, seed: int) -> Column:
    return F.format_string(
        "WQ/%s/%d/%05d", _pick(index, seed, "district", K.DISTRICTS), _draw(index, seed, "year", *YEARS),
        _draw(index, seed, "serial", *SERIALS),
    )


def _name(index: Column, seed: int, given: list[str], family: list[str]) -> Column:
    return F.concat(_pick(index, seed, "given", given), F.lit(" "), _pick(index, seed, "family", family))


def _survey(index: Column, seed: int) -> Column:
    plain = F.format_string("%d/%d", _draw(index, seed, "block", *SURVEY_BLOCKS), _draw(index, seed, "part", *SURVEY_PARTS))
    suffix = F.concat(F.lit("-"), _pick(index, seed, "suffix", ["A", "B", "C"]))
    return F.concat(plain, F.when(_draw(index, seed, "suffixed", 0, 1) == 1, suffix).otherwise(""))


def _date(index: Column, seed: int, slot: str, year: Column) -> Column:
    return F.format_string(
        "%04d-%02d-%02d", year, _draw(index, seed, slot + "-month", 1, 12), _draw(index, seed, slot + "-day", 1, 28)
    )


def _extent(index: Column, seed: int, unit: Column) -> Column:
    hundredths = _draw(index, seed, "extent", *EXTENT_HUNDREDTHS)
    return F.format_string("%d.%02d %s", F.floor(hundredths / 100), F.pmod(hundredths, F.lit(100)), unit)


def _clean(indices: DataFrame, seed: int) -> DataFrame:
    i = F.col("i")
    urdu = F.pmod(i, F.lit(2)) == 0
    by_script = lambda u, m: F.when(urdu, u).otherwise(m)
    values = {
        "property_id": property_id(i, seed),
        "mutawalli_name": by_script(_name(i, seed, K.URDU_GIVEN, K.URDU_FAMILY), _name(i, seed, K.MARATHI_GIVEN, K.MARATHI_FAMILY)),
        "survey_number": _survey(i, seed),
        "registration_date": _date(i, seed, "date", _draw(i, seed, "date-year", *PLAUSIBLE_YEARS)),
        "extent": _extent(i, seed, by_script(_pick(i, seed, "unit", K.URDU_UNITS), _pick(i, seed, "unit", K.MARATHI_UNITS))),
        "village": by_script(_pick(i, seed, "village", K.URDU_VILLAGES), _pick(i, seed, "village", K.MARATHI_VILLAGES)),
    }
    return indices.withColumns(values | {
        "script_type": by_script(F.lit(K.URDU), F.lit(K.MARATHI)),
        "doc_id": F.concat(by_script(F.lit("urd-"), F.lit("mar-")), F.format_string("%03d", i)),
        "_title": by_script(F.lit(K.URDU_TITLE), F.lit(K.MARATHI_TITLE)),
    })


def _line(field: str) -> Column:
    label = F.when(F.col("script_type") == K.URDU, K.URDU_LINE_LABELS[field]).otherwise(K.MARATHI_LINE_LABELS[field])
    return F.concat(label, F.lit(" "), F.col(field))


def _finish(df: DataFrame, kind: Column, rule: Column) -> DataFrame:
    # A dropped field is null, and so is its line: array_join leaves nulls out.
    text = F.array_join(F.array(F.col("_title"), *[_line(f) for f in K.FIELDS]), "\n")
    return df.select(
        "doc_id",
        F.concat(F.lit("synthetic-"), "doc_id", F.lit(".png")).alias("filename"),
        "script_type",
        F.lit(True).alias("is_synthetic"),
        kind.cast("string").alias("seeded_error_type"),
        rule.cast("string").alias("expected_failing_rule"),
        F.struct(*K.FIELDS).alias("fields"),
        text.alias("rendered_text"),
    )


def clean_records(indices: DataFrame, seed: int = 42) -> DataFrame:
    """Manifest rows for record numbers ``i``; scripts alternate."""
    return _finish(_clean(indices.select("i"), seed), F.lit(None), F.lit(None))


def seeded_records(numbers: DataFrame, n_clean: Column | int, seed: int = 42) -> DataFrame:
    """One defective copy for each number ``k`` of a clean record: ``k`` modulo the number of clean records.

    The defect is one of four kinds, and the copy names the rule that should catch it.
    """
    n = n_clean if isinstance(n_clean, Column) else F.lit(n_clean)
    k = F.col("k")
    copies = _clean(numbers.select("k", F.pmod(k, n).alias("i")), seed)
    kinds = list(K.SEEDED_DEFECTS)
    copies = copies.withColumn("kind", _pick(k, seed, "kind", kinds)).withColumn(
        "_dropped", _pick(k, seed, "dropped", K.MANDATORY_FIELDS)
    )
    step = F.pmod(F.xxhash64(k, F.lit(seed), F.lit("other")), F.greatest(n - 1, F.lit(1)))
    other = F.pmod(F.col("i") + 1 + step, n)
    bad_year = F.when(_draw(k, seed, "era", 0, 1) == 0, _draw(k, seed, "old", *OLD_YEARS)).otherwise(
        _draw(k, seed, "future", *FUTURE_YEARS)
    )
    is_kind = lambda name: F.col("kind") == name
    changed = {f: F.col(f) for f in K.FIELDS}
    for f in K.MANDATORY_FIELDS:
        changed[f] = F.when(~(is_kind("missing_mandatory") & (F.col("_dropped") == f)), changed[f])
    changed["survey_number"] = F.when(
        is_kind("bad_survey_format"), _draw(k, seed, "bad-survey", *BAD_SURVEYS).cast("string")
    ).otherwise(changed["survey_number"])
    changed["registration_date"] = F.when(is_kind("bad_date"), _date(k, seed, "bad-date", bad_year)).otherwise(
        changed["registration_date"]
    )
    changed["property_id"] = F.when(is_kind("duplicate_property_id"), property_id(other, seed)).otherwise(
        changed["property_id"]
    )
    rule = F.lit(None).cast("string")
    for name, caught_by in K.SEEDED_DEFECTS.items():
        rule = F.when(is_kind(name), caught_by).otherwise(rule)
    copies = copies.withColumns(changed | {"doc_id": F.concat("doc_id", F.lit("-err-"), "kind")})
    return _finish(copies, F.col("kind"), rule)


def generate(spark: SparkSession, n_clean: int = 80, n_seeded: int = 20, seed: int = 42) -> DataFrame:
    """A manifest of ``n_clean`` clean and ``n_seeded`` defective documents."""
    clean = clean_records(spark.range(n_clean).withColumnRenamed("id", "i"), seed)
    seeded = seeded_records(spark.range(n_seeded).withColumnRenamed("id", "k"), n_clean, seed)
    return clean.unionByName(seeded)


def perfect_reads(manifest: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Engine reads that return each page's text unchanged, for scoring what comes after reading."""
    return manifest.select(
        F.col("doc_id").alias("document_id"), F.lit("primary").alias("engine"), F.lit(1).alias("priority"),
        F.col("rendered_text").alias("text"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("error"),
    )
