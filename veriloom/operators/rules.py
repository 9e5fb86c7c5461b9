"""Rule engine: row rules as column expressions, and the duplicate check across all records.

A record is a row ``(document_id, filename, <six fields>)``. Row rules never shuffle. Only the duplicate check
does, and it moves three narrow columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.functions import text as X
from veriloom.operators import skew
from veriloom.sources import tables

# Survey number shapes, date shapes and date limits.
SURVEY_FULL = r"^\p{Nd}{3,4}/\p{Nd}{1,2}(-[A-Za-z])?$"
SURVEY_SHORT = r"^\p{Nd}{1,2}/\p{Nd}{1,2}(-[A-Za-z])?$"
MONTH = r"(1[0-2]|0[1-9]|[1-9])"
DAY = r"(3[01]|[12]\p{Nd}|0[1-9]|[1-9]| [1-9])"
YEAR = r"\p{Nd}{4}"
DATE_YMD = rf"^{YEAR}-{MONTH}-{DAY}$"
DATE_DMY = rf"^({DAY}-{MONTH}-{YEAR}|{DAY}/{MONTH}/{YEAR})$"
EARLIEST_DATE = "1900-01-01"
REGISTER_START = "1980-01-01"

# Outcome messages.
ALL_PRESENT = "All mandatory fields extracted."
SURVEY_EMPTY = "Field is empty — manual entry required."
SURVEY_OK = "Matches expected survey number pattern."
SURVEY_SHORT_FORM = "Short-form survey number — verify against register."
SURVEY_BAD = "' does not match the expected survey number pattern (e.g. 412/2-A)."
DATE_MISSING = "Registration date is missing."
DATE_BAD = "' is not a recognised date (expected YYYY-MM-DD)."
DATE_FUTURE = "Registration date is in the future."
DATE_TOO_EARLY = "Registration date predates any plausible record."
DATE_BEFORE_REGISTER = "Registration date predates digitised register (pre-1980); confirm manually."
DATE_OK = "Registration date falls within valid range."
ID_MISSING = "Property ID not extracted — cannot cross-check against other records."
ID_UNIQUE = "No conflicting property ID found in other processed records."
ID_DUPLICATE = " — possible duplicate filing."

RESULT_COLUMNS = ["document_id", "rule_name", "result", "message"]
Fields = dict[str, Column]


def outcome(result: str, message: Column | str) -> Column:
    message = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(result).alias("result"), message.alias("message"))


def mandatory_fields_present(fields: Fields) -> Column:
    missing = F.filter(
        F.array(*[F.when(X.is_blank(fields[f]), F.lit(K.FIELD_LABELS[f])) for f in K.MANDATORY_FIELDS]),
        lambda label: label.isNotNull(),
    )
    listed = F.array_join(missing, ", ")
    many = F.concat(F.size(missing).cast("string"), F.lit(" mandatory field(s) could not be extracted: "), listed, F.lit("."))
    return (
        F.when(F.size(missing) == 0, outcome("pass", ALL_PRESENT))
        .when(F.size(missing) == 1, outcome("fail", F.concat(listed, F.lit(" could not be extracted."))))
        .otherwise(outcome("fail", many))
    )


def survey_number_format(fields: Fields) -> Column:
    """Needs ``survey_text``, the stripped survey number."""
    raw, value = fields["survey_number"], fields["survey_text"]
    return (
        F.when(X.is_blank(raw), outcome("fail", SURVEY_EMPTY))
        .when(value.rlike(SURVEY_FULL), outcome("pass", SURVEY_OK))
        .when(value.rlike(SURVEY_SHORT), outcome("warning", SURVEY_SHORT_FORM))
        .otherwise(outcome("fail", F.concat(F.lit("'"), value, F.lit(SURVEY_BAD))))
    )


def date_parts(value: Column) -> Column:
    """Pieces of a stripped date text, native digits made Western."""
    return F.split(X.to_western(value), "[-/]")


def parse_date(value: Column, parts: Column) -> Column:
    """Date from stripped Y-M-D, D-M-Y or D/M/Y text and its pieces; null for other text and days that do not exist."""
    def iso(year: int, day: int) -> Column:
        padded = [F.lpad(F.trim(F.get(parts, F.lit(i))), 2, "0") for i in (1, day)]
        return F.concat(F.nullif(F.get(parts, F.lit(year)), F.lit("0000")), F.lit("-"), padded[0], F.lit("-"), padded[1])

    return F.when(value.rlike(DATE_YMD), iso(0, 2)).when(value.rlike(DATE_DMY), iso(2, 0)).try_cast("date")


# Values the default rules share, in layers; each is computed once per record however often a rule looks at it.
STAGES: list[dict[str, Callable[[Fields], Column]]] = [
    {
        "survey_text": lambda f: X.strip(f["survey_number"]),
        "date_text": lambda f: X.strip(f["registration_date"]),
    },
    {"date_parts": lambda f: date_parts(f["date_text"])},
    {"date": lambda f: parse_date(f["date_text"], f["date_parts"])},
]


def date_plausibility(as_of: Column | str) -> Callable[[Fields], Column]:
    """``as_of`` is the day the check is made for; never the clock, so a rerun gives the same results.

    Needs ``date``, the parsed registration date.
    """
    today = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")

    def check(fields: Fields) -> Column:
        raw, day = fields["registration_date"], fields["date"]
        return (
            F.when(X.is_blank(raw), outcome("fail", DATE_MISSING))
            .when(day.isNull(), outcome("fail", F.concat(F.lit("'"), raw, F.lit(DATE_BAD))))
            .when(day > today, outcome("fail", DATE_FUTURE))
            .when(day < F.lit(EARLIEST_DATE).cast("date"), outcome("fail", DATE_TOO_EARLY))
            .when(day < F.lit(REGISTER_START).cast("date"), outcome("warning", DATE_BEFORE_REGISTER))
            .otherwise(outcome("pass", DATE_OK))
        )

    return check


def duplicate_groups(
    members: DataFrame, id_col: str = "document_id", key: str = "property_id", label: str = "filename",
    slice_rows: int = skew.SLICE_ROWS,
) -> DataFrame:
    """For each member with a key: how many others share it exactly, as ``n_others``.

    The same form for groups of every size. Keys are counted before they are shuffled, and members of hot keys meet
    their count in many tasks. ``duplicate_members`` and ``duplicate_names`` say who the others are.
    """
    carried = [id_col, key, label, *(["_mine"] if "_mine" in members.columns else [])]
    rows = members.select(*carried).filter(~X.is_blank(F.col(key)))
    shared = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    counted = skew.salted_join(rows, shared, key, id_col, "left", slice_rows)
    return counted.select(*carried, (F.coalesce("_n", F.lit(1)) - 1).alias("n_others"))


def duplicate_members(members: DataFrame, key: str = "property_id", **kwargs) -> DataFrame:
    """Every member of every shared key, one row each: linear in the input for groups of any size."""
    return duplicate_groups(members, key=key, **kwargs).filter("n_others > 0")


def duplicate_names(
    members: DataFrame, keys: DataFrame, id_col: str = "document_id", key: str = "property_id", label: str = "filename"
) -> DataFrame:
    """All members of the keys asked for, one row per key: ``(key, members)`` in order of label and id.

    A list per key, not one per member, so it is as long as the group and not as its square; the others of a record
    are the list without itself. Keys without members have no row.
    """
    asked = members.join(keys.select(key).distinct(), key, "left_semi").filter(~X.is_blank(F.col(key)))
    entry = F.struct(F.col(label).alias("label"), F.col(id_col).alias("id"))
    return asked.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("members"))


def key_counts(members: DataFrame, key: str = "property_id") -> DataFrame:
    """How many members have each key, as ``(key, n)``: the state that ``shifted_counts`` keeps up to date."""
    return members.filter(~X.is_blank(F.col(key))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def shifted_counts(counts: DataFrame, gone: DataFrame, come: DataFrame, key: str = "property_id") -> DataFrame:
    """Counts after members ``gone`` have left or changed their key and members ``come`` are there: a sum of ones."""
    change = gone.select(key, F.lit(-1).cast("long").alias("n")).unionByName(come.select(key, F.lit(1).cast("long").alias("n")))
    both = counts.select(key, "n").unionByName(change.filter(~X.is_blank(F.col(key))))
    return both.groupBy(key).agg(F.sum("n").alias("n")).filter("n > 0")


def cross_document_consistency(
    records: DataFrame, registry: DataFrame | None = None, slice_rows: int = skew.SLICE_ROWS, counts: DataFrame | None = None
) -> DataFrame:
    """Results of the duplicate check for ``records``, against themselves and the rest of ``registry``.

    A record present in both counts once, in its ``records`` version. The message says how many others there are. Where
    ``counts`` of all keys are known, ``records`` included, they are looked up and ``registry`` is not read.
    """
    if counts is not None:
        known = counts.select("property_id", (F.col("n") - 1).alias("n_others"))
        keyed = records.filter(~X.is_blank(F.col("property_id"))).select("document_id", "property_id")
        return _duplicate_results(records, keyed.join(known, "property_id", "left").fillna(0, ["n_others"]))
    columns = ["document_id", "filename", "property_id"]
    members = records.select(*columns)
    if registry is not None:
        asked = members.filter(~X.is_blank(F.col("property_id"))).select("property_id").distinct()
        shared = skew.salted_join(
            registry.select(*columns), asked, "property_id", "document_id", "left_semi", slice_rows
        )
        older = shared.join(members.select("document_id"), "document_id", "left_anti")
        members = members.withColumn("_mine", F.lit(True)).unionByName(older.withColumn("_mine", F.lit(False)))
    groups = duplicate_groups(members, slice_rows=slice_rows)
    if registry is not None:
        groups = groups.filter("_mine").drop("_mine")
    return _duplicate_results(records, groups)


def _duplicate_results(records: DataFrame, groups: DataFrame) -> DataFrame:
    n = F.col("n_others")
    others = F.concat(n.cast("string"), F.when(n == 1, " other document").otherwise(" other documents"))
    shared_message = F.concat(F.lit("Property ID "), F.col("property_id"), F.lit(" also appears in "), others, F.lit(ID_DUPLICATE))
    decided = F.when(n > 0, outcome("fail", shared_message)).otherwise(outcome("pass", ID_UNIQUE))
    found = groups.select("document_id", decided.alias("o"))
    absent = records.filter(X.is_blank(F.col("property_id"))).select("document_id", outcome("warning", ID_MISSING).alias("o"))
    name = F.lit("cross_document_consistency").alias("rule_name")
    return found.unionByName(absent).select("document_id", name, "o.result", "o.message")


@dataclass(frozen=True)
class RowRule:
    """A rule decided by one record: ``check`` maps field columns to ``struct(result, message)``.

    ``check`` sees the six fields and the shared values of ``STAGES``.
    """

    name: str
    check: Callable[[Fields], Column]


@dataclass(frozen=True)
class SetRule:
    """A rule decided across records: ``check(records, registry)`` gives result rows."""

    name: str
    check: Callable[[DataFrame, DataFrame | None], DataFrame]


def default_rules(as_of: Column | str) -> list[RowRule | SetRule]:
    return [
        RowRule("mandatory_fields_present", mandatory_fields_present),
        RowRule("survey_number_format", survey_number_format),
        RowRule("date_plausibility", date_plausibility(as_of)),
        SetRule("cross_document_consistency", cross_document_consistency),
    ]


def records(documents: DataFrame, fields_wide: DataFrame) -> DataFrame:
    """Documents with their six fields; a document without fields keeps nulls, so its rules still run."""
    return documents.select("document_id", "filename").join(
        fields_wide.select("document_id", *K.FIELDS), "document_id", "left"
    )


def validate(
    records: DataFrame,
    *,
    as_of: Column | str,
    registry: DataFrame | None = None,
    config: DataFrame | dict[str, bool] | None = None,
    rules: list[RowRule | SetRule] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Run the enabled rules; one row ``(document_id, rule_name, result, message)`` per record and rule.

    ``config`` as a dict leaves disabled rules out of the plan; as a table ``(key, enabled)`` it is joined, and a
    rule without a row is enabled. ``counts`` are passed to the shipped duplicate rule.
    """
    rules = default_rules(as_of) if rules is None else rules
    if isinstance(config, dict):
        rules = [r for r in rules if config.get(r.name, True)]
    parts = []
    row_rules = [r for r in rules if isinstance(r, RowRule)]
    if row_rules:
        staged, fields = records, {f: F.col(f) for f in K.FIELDS if f in records.columns}
        for layer in STAGES:
            staged = staged.withColumns({f"_{name}": body(fields) for name, body in layer.items()})
            fields |= {name: F.col(f"_{name}") for name in layer}
        checks = [F.struct(F.lit(r.name).alias("rule_name"), r.check(fields).alias("o")) for r in row_rules]
        parts.append(
            staged.select("document_id", F.explode(F.array(*checks)).alias("r")).select(
                "document_id", "r.rule_name", "r.o.result", "r.o.message"
            )
        )
    for r in rules:
        if isinstance(r, SetRule):
            known = {"counts": counts} if counts is not None and r.check is cross_document_consistency else {}
            parts.append(r.check(records, registry, **known).select(*RESULT_COLUMNS))
    if not parts:
        return records.limit(0).select("document_id", *[F.lit("").alias(c) for c in RESULT_COLUMNS[1:]])
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    if isinstance(config, DataFrame):
        known = (
            config.filter(F.col("key").isin([r.name for r in rules]))
            .groupBy(F.col("key").alias("rule_name"))
            .agg(F.max("enabled").alias("_enabled"))
        )
        results = (
            results.join(F.broadcast(known), "rule_name", "left")
            .filter(F.coalesce("_enabled", F.lit(True)))
            .select(*RESULT_COLUMNS)
        )
    return results


def revalidate(
    keys: DataFrame, records: DataFrame, registry: DataFrame | None = None, counts: DataFrame | None = None, **kwargs
) -> DataFrame:
    """Results for the given documents only; duplicates are still sought among all records.

    The given documents' records are written once. ``counts`` of all keys after the change, if they are kept
    (``key_counts``, ``shifted_counts``), make a batch cost what its own records cost; otherwise the keys of these
    records, and no others, are counted among all.
    """
    asked = keys.select("document_id").distinct()
    chosen = tables.spool(records.join(asked, "document_id", "left_semi"))
    if counts is None:
        touched = chosen.filter(~X.is_blank(F.col("property_id"))).select("property_id").distinct()
        if registry is None:
            members = records.select("property_id")
        else:
            older = registry.select("document_id", "property_id").join(chosen.select("document_id"), "document_id", "left_anti")
            members = older.select("property_id").unionByName(chosen.select("property_id"))
        counts = key_counts(members.join(touched, "property_id", "left_semi"))
    return validate(chosen, counts=counts, **kwargs)


def advance_status(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Move validated documents from ``extracted`` to ``validated``; every other status stays."""
    done = results.select("document_id").distinct().withColumn("_validated", F.lit(True))
    status = F.when(F.col("_validated") & (F.col("status") == "extracted"), F.lit("validated")).otherwise(F.col("status"))
    return documents.join(done, "document_id", "left").withColumn("status", status).drop("_validated")


def auto_decision(results: DataFrame) -> DataFrame:
    """Flag a document with any failed rule, approve it otherwise; with the number of failures."""
    return (
        results.groupBy("document_id")
        .agg(F.count_if(F.col("result") == "fail").alias("fail_count"))
        .select(
            "document_id",
            "fail_count",
            F.when(F.col("fail_count") > 0, "flag").otherwise("approve").alias("action"),
            F.when(F.col("fail_count") > 0, "flagged").otherwise("reviewed").alias("status"),
        )
    )


def rule_position(rule_name: Column) -> Column:
    """Display position of a rule; unknown rules come last."""
    position = F.array_position(F.array(*[F.lit(r) for r in K.RULE_ORDER]), rule_name) - 1
    return F.when(position >= 0, position).otherwise(99).cast("int")
