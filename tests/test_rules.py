import pytest
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.operators import rules

AS_OF = "2024-06-30"
RECORD = "document_id string, filename string, " + ", ".join(f"{f} string" for f in K.FIELDS)


def record(spark, *rows):
    return spark.createDataFrame(rows, RECORD)


def outcomes(results):
    return {(r.document_id, r.rule_name): (r.result, r.message) for r in results.collect()}


@pytest.fixture()
def queue(spark):
    return record(
        spark,
        ("d1", "s812.tiff", "WQ/MH/2024/00812", "Abdul Rahman Sheikh", "412/2-A", "1998-03-14", "0.82 ha", "Bhiwandi"),
        ("d2", "s813.tiff", "WQ/MH/2024/00813", "यूसुफ पटेल", None, "2003-11-02", "1.15 ha", "Malegaon"),
        ("d3", "s814.tiff", "WQ/MH/2024/00814", "Imran Qureshi", "88/1", "1975-06-30", "0.4 ha", "Aurangabad"),
        ("d4", "s815.tiff", "WQ/MH/2024/00815", "अन्वर शेख", "215/3", "2011-09-19", "0.63 ha", "Nashik"),
        ("d5", "s816.tiff", None, "Ghulam Nabi", "56/2-B", None, "0.29 ha", "Malegaon"),
        ("d6", "s817.tiff", "WQ/MH/2024/00817", "सलीम अहमद", "301/1-C", "2007-01-22", "0.51 ha", "Bhiwandi"),
        ("d7", "s818.tiff", "WQ/MH/2024/00812", "अब्दुल रहमान शेख", "412/2-A", "1998-03-14", "0.82 ha", "Bhiwandi"),
    )


def test_seed_queue(queue):
    got = outcomes(rules.validate(queue, as_of=AS_OF))
    assert len(got) == 7 * 4
    assert got["d2", "mandatory_fields_present"] == ("fail", "Survey number could not be extracted.")
    assert got["d5", "mandatory_fields_present"] == ("fail", "Property ID could not be extracted.")
    assert got["d3", "survey_number_format"] == ("warning", rules.SURVEY_SHORT_FORM)
    assert got["d2", "survey_number_format"] == ("fail", rules.SURVEY_EMPTY)
    assert got["d3", "date_plausibility"] == ("warning", rules.DATE_BEFORE_REGISTER)
    assert got["d5", "date_plausibility"] == ("fail", rules.DATE_MISSING)
    shared = "Property ID WQ/MH/2024/00812 also appears in %s — possible duplicate filing."
    assert got["d1", "cross_document_consistency"] == ("fail", shared % "1 other document")
    assert got["d7", "cross_document_consistency"] == ("fail", shared % "1 other document")
    assert got["d5", "cross_document_consistency"] == ("warning", rules.ID_MISSING)
    assert got["d4", "cross_document_consistency"] == ("pass", rules.ID_UNIQUE)


def test_any_partitioning_gives_the_same_results(queue):
    assert outcomes(rules.validate(queue.repartition(1), as_of=AS_OF)) == outcomes(rules.validate(queue.repartition(7), as_of=AS_OF))


def test_survey_shapes(spark):
    shapes = {
        "412/2-A": "pass", "301/1-C": "pass", " 215/3\t": "pass", "४१२/२": "pass", "88/1": "warning", "8/1": "warning", "": "fail",
        "54321": "fail", "412/2-AB": "fail", "4125/123": "fail", "  ": "fail",
    }
    rows = [(s, "f", "p", "n", s, None, None, None) for s in shapes]
    got = outcomes(rules.validate(record(spark, *rows), as_of=AS_OF))
    assert {s: got[s, "survey_number_format"][0] for s in shapes} == shapes
    # Blank spaces count as present for the mandatory rule.
    assert got["  ", "mandatory_fields_present"][0] == "pass"
    assert got["", "mandatory_fields_present"][0] == "fail"
    assert got["54321", "survey_number_format"][1].startswith("'54321' does not match")


def test_dates(spark):
    dates = {
        "2023-2-3": "pass", "03-02-2023": "pass", "3/2/2023": "pass", "2001-02-30": "fail", "2023/02/03": "fail", "98-01-01": "fail",
        "2031-01-01": "fail", "1899-12-31": "fail", "1979-12-31": "warning", "1980-01-01": "pass", AS_OF: "pass", "0000-01-01": "fail",
        "१९९८-03-14": "pass", "१९९८-०३-१४": "fail", "03-02/2023": "fail", " 1998-03-14 ": "pass", "1999-13-01": "fail",
    }
    rows = [(d, "f", "p", "n", "s", d, None, None) for d in dates]
    got = outcomes(rules.validate(record(spark, *rows), as_of=AS_OF))
    assert {d: got[d, "date_plausibility"][0] for d in dates} == dates
    assert got["0000-01-01", "date_plausibility"][1].endswith("is not a recognised date (expected YYYY-MM-DD).")


def test_config_as_table_or_dict(spark, queue):
    table = spark.createDataFrame([("date_plausibility", False), ("survey_number_format", True)], "key string, enabled boolean")
    by_table = outcomes(rules.validate(queue, as_of=AS_OF, config=table))
    by_dict = outcomes(rules.validate(queue, as_of=AS_OF, config={"date_plausibility": False}))
    assert by_table == by_dict
    assert {rule for _, rule in by_dict} == set(K.RULE_ORDER) - {"date_plausibility"}


def test_own_rule(queue):
    has_unit = rules.RowRule("extent_unit", lambda f: F.when(f["extent"].endswith("ha"), rules.outcome("pass", "ok")).otherwise(rules.outcome("fail", "no unit")))
    got = outcomes(rules.validate(queue, as_of=AS_OF, rules=[has_unit]))
    assert len(got) == 7 and got["d1", "extent_unit"] == ("pass", "ok")


def test_hot_ids_are_counted_and_never_gathered(spark):
    # A third of all records share one id; one in three rows is looked at to find such ids.
    rows = [(f"d{i:03d}", f"f{i:03d}", "HOT" if i % 3 == 0 else f"P{i // 2}") for i in range(240)]
    members = spark.createDataFrame(rows, "document_id string, filename string, property_id string")
    got = {r.document_id: r for r in rules.duplicate_groups(members, slice_rows=3).collect()}
    assert len(got) == 240
    by_id = {}
    for d, f, p in rows:
        by_id.setdefault(p, []).append((f, d))
    for d, f, p in rows:
        assert got[d].n_others == len(by_id[p]) - 1
    whole = rules.duplicate_members(members, slice_rows=3)
    assert whole.filter("property_id = 'HOT'").count() == 80
    results = rules.cross_document_consistency(members, slice_rows=3)
    message = results.filter("document_id = 'd000'").first().message
    assert message == "Property ID HOT also appears in 79 other documents — possible duplicate filing."


def test_groups_of_every_size_have_one_form(spark):
    sizes = {"A": 1, "B": 2, "C": 1001, "D": 5000}
    rows = [(f"{k}{i:04d}", f"f{k}{i:04d}", k) for k, n in sizes.items() for i in range(n)]
    members = spark.createDataFrame(rows, "document_id string, filename string, property_id string")
    results = rules.cross_document_consistency(members)
    found = results.groupBy(F.substring("document_id", 1, 1).alias("k"), "result", "message").count().collect()
    told = {r.k: (r.result, r.message, r["count"]) for r in found}
    assert len(found) == len(told) == 4
    assert told["A"] == ("pass", rules.ID_UNIQUE, 1)
    for k in "BCD":
        many = f"{sizes[k] - 1} other document" + "s" * (sizes[k] > 2)
        assert told[k] == ("fail", f"Property ID {k} also appears in {many}{rules.ID_DUPLICATE}", sizes[k])
    named = {r.property_id: r.members for r in rules.duplicate_names(members, members.filter("document_id IN ('B0000', 'D0001')")).collect()}
    assert {k: len(m) for k, m in named.items()} == {"B": 2, "D": 5000}
    assert [m.id for m in named["D"]] == sorted(f"D{i:04d}" for i in range(5000))


def test_registry_and_batch_see_each_other(spark, queue):
    registry = queue
    batch = record(
        spark,
        ("n1", "new1", "WQ/MH/2024/00815", "a", "412/2", "1999-01-01", None, None),
        ("n2", "new2", "WQ/MH/2024/00815", "a", "412/2", "1999-01-01", None, None),
        # A document processed again counts in its new version only.
        ("d7", "s818.tiff", "WQ/NEW/1", "a", "412/2", "1999-01-01", None, None),
    )
    got = outcomes(rules.validate(batch, as_of=AS_OF, registry=registry))
    assert {d for d, _ in got} == {"n1", "n2", "d7"}
    assert "also appears in 2 other documents" in got["n1", "cross_document_consistency"][1]
    named = rules.duplicate_names(registry.unionByName(batch), batch.filter("document_id = 'n1'")).collect()
    assert [[(m.label, m.id) for m in r.members] for r in named] == [[("new1", "n1"), ("new2", "n2"), ("s815.tiff", "d4")]]
    assert got["d7", "cross_document_consistency"][0] == "pass"


def test_revalidate_looks_at_all_records(spark, queue):
    keys = spark.createDataFrame([("d1",)], "document_id string")
    got = outcomes(rules.revalidate(keys, queue, as_of=AS_OF))
    assert len(got) == 4 and got["d1", "cross_document_consistency"][0] == "fail"


def test_status_and_decisions(spark, queue):
    documents = spark.createDataFrame([("d1", "extracted"), ("d4", "extracted"), ("d5", "flagged"), ("zz", "extracted")], "document_id string, status string")
    results = rules.validate(queue, as_of=AS_OF)
    moved = {r.document_id: r.status for r in rules.advance_status(documents, results).collect()}
    assert moved == {"d1": "validated", "d4": "validated", "d5": "flagged", "zz": "extracted"}
    decided = {r.document_id: (r.action, r.status) for r in rules.auto_decision(results).collect()}
    assert decided["d4"] == ("approve", "reviewed") and decided["d3"] == ("approve", "reviewed") and decided["d1"] == ("flag", "flagged")


def test_documents_without_fields_still_get_results(spark, queue):
    documents = spark.createDataFrame([("d1", "a"), ("bare", "b")], "document_id string, filename string")
    got = outcomes(rules.validate(rules.records(documents, queue), as_of=AS_OF))
    assert got["bare", "mandatory_fields_present"] == (
        "fail", "3 mandatory field(s) could not be extracted: Property ID, Mutawalli name, Survey number."
    )


def test_rule_position(column_values):
    assert column_values(rules.rule_position, ["date_plausibility", "mandatory_fields_present", "other"]) == [2, 0, 99]


def test_kept_counts_give_the_results_of_a_full_check(spark, queue):
    """Counts moved on by what a batch changed say the same as counting everything again."""
    before = rules.key_counts(queue)
    edited = queue.filter("document_id IN ('d1', 'd4', 'd5')").withColumn(
        "property_id", F.when(F.col("document_id") == "d1", None).when(F.col("document_id") == "d4", "NEW/1").otherwise("NEW/1")
    )
    rest = queue.join(edited.select("document_id"), "document_id", "left_anti")
    after = rest.unionByName(edited)
    moved = rules.shifted_counts(before, queue.join(edited.select("document_id"), "document_id", "left_semi"), edited)
    assert {tuple(r) for r in moved.collect()} == {tuple(r) for r in rules.key_counts(after).collect()}
    keys = after.select("document_id")
    want = outcomes(rules.validate(after, as_of=AS_OF))
    assert outcomes(rules.revalidate(keys, after, as_of=AS_OF, counts=moved)) == want
    assert outcomes(rules.revalidate(keys, edited, registry=queue, as_of=AS_OF)) == {k: v for k, v in want.items() if k[0] in ("d1", "d4", "d5")}
