"""The batch upsert against a row-by-row simulation."""

import random

import pytest
from conftest import plan
from pyspark.sql import functions as F

from kinmatch.operators import upsert
from kinmatch.plans.presets import PROJECT_UPSERT as SPEC

FIELDS = ["project_name", "grade_code", "project_from_date", "business_type", "summary"]
CELLS = {
    "project_name": ["Alpha", " Alpha ", "Beta", None, "  ", "n" * 201],
    "grade_code": ["A", "B", None, " ", "NaT", "too long a grade"],
    "project_from_date": ["2026-01-01", "2026-01-01 00:00:00", None, "soon", "2026-02-30"],
    "business_type": ["신규", "지원", None, "other", ""],
    "summary": ["one", "two", None, "\t", "one "],
}
BASE_SCHEMA = (
    "project_code string, project_name string, grade_code string, sap_phase string, "
    "project_from_date date, business_type string, summary string"
)


def normalized(value, is_date=False):
    if value is None:
        return None
    value = str(value).strip()
    if value in ("", "None", "nan", "NaT"):
        return None
    return value[:10] if is_date else value


def broken(field, value):
    if value is None:
        return False
    if field == "project_from_date":
        return value not in ("2026-01-01",)
    if field == "business_type":
        return value not in ("유지보수", "신규", "지원")
    return len(value) > {"project_name": 200, "grade_code": 10}.get(field, 10**6)


def simulate(base, batch):
    """Final records and one action per batch row, applying rows one after the other."""
    records = {r["project_code"]: dict(r) for r in base}
    actions = []
    for row in batch:
        key = (row["project_code"] or "").strip()
        if key in ("", "None", "nan"):
            actions.append("error")
            continue
        new = {f: normalized(row[f], f == "project_from_date") for f in FIELDS}
        illegal = any(broken(f, new[f]) for f in FIELDS)
        old = records.get(key)
        if old is None:
            if illegal:
                actions.append("error")
                continue
            records[key] = {"project_code": key, "sap_phase": None, **new}
            records[key]["project_name"] = new["project_name"] or ""
            actions.append("inserted")
            continue
        changed = any(new[f] != normalized(old[f]) for f in FIELDS)
        name_missing = row["project_name"] is not None and new["project_name"] is None
        if illegal or (changed and name_missing):
            actions.append("error")
        elif changed:
            for f in FIELDS:
                if row[f] is not None:
                    old[f] = new[f]
            actions.append("updated")
        else:
            actions.append("skipped")
    return records, actions


def random_case(seed, n_keys, n_rows):
    rng = random.Random(seed)
    base = [
        {
            "project_code": f"K{i}", "project_name": rng.choice([" Alpha", "Beta"]),
            "grade_code": rng.choice(["A", None]), "sap_phase": None,
            "project_from_date": rng.choice(["2026-01-01", None]),
            "business_type": rng.choice(["신규", None]), "summary": rng.choice(["one", " one", None]),
        }
        for i in range(n_keys // 2)
    ]
    batch = []
    for i in range(n_rows):
        key = rng.choice([f"K{rng.randrange(n_keys)}"] * 12 + [" K0 ", "K0", "K0", None, " ", "nan"])
        row = {"project_code": key, "row_no": i + 2}
        for f in FIELDS:
            # illegal values are rarer
            row[f] = rng.choice(CELLS[f] + CELLS[f][:3] * 3)
        batch.append(row)
    return base, batch


def frames(spark, base, batch):
    base_df = spark.createDataFrame(
        [tuple(r[c.split()[0]] for c in BASE_SCHEMA.split(", ")) for r in base],
        BASE_SCHEMA.replace("date date", "date string"),
    ).withColumn("project_from_date", F.col("project_from_date").cast("date"))
    columns = ["row_no", "project_code", *FIELDS]
    schema = "row_no long, " + ", ".join(f"{c} string" for c in columns[1:])
    batch_df = spark.createDataFrame([tuple(r[c] for c in columns) for r in batch], schema)
    return base_df, batch_df.repartition(4)


@pytest.mark.parametrize("segments", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upsert_equals_simulation(spark, monkeypatch, seed, segments):
    if segments:
        monkeypatch.setattr(upsert, "SMALL_BATCH", 0)
        monkeypatch.setattr(upsert, "SEGMENT_ROWS", 7)
    base, batch = random_case(seed, 8, 120)
    records, actions = simulate(base, batch)
    base_df, batch_df = frames(spark, base, batch)
    changes = upsert.upsert_changes(base_df, batch_df, SPEC)
    got = {r.row_no: r.action for r in changes.collect()}
    assert [got[i + 2] for i in range(len(batch))] == actions
    merged = upsert.merged_records(base_df, changes, SPEC)
    after = {
        r.project_code: {
            c: (str(r[c]) if c == "project_from_date" and r[c] else r[c])
            for c in merged.columns if c != "_written"
        }
        for r in merged.collect()
    }
    assert after == records


def test_second_run_changes_nothing(spark):
    base, batch = random_case(9, 6, 1)
    rows = [
        {"row_no": i + 2, "project_code": f"N{i}", "project_name": "x", "grade_code": "A",
         "project_from_date": "2026-01-01", "business_type": "신규", "summary": " s "}
        for i in range(5)
    ]
    base_df, batch_df = frames(spark, base, rows)
    first = upsert.upsert_changes(base_df, batch_df, SPEC)
    merged = upsert.merged_records(base_df, first, SPEC).drop("_written")
    again = upsert.upsert_changes(merged, batch_df, SPEC)
    assert {r.action for r in first.collect()} == {"inserted"}
    assert {r.action for r in again.collect()} == {"skipped"}


def test_absent_columns_are_kept(spark):
    base, _ = random_case(4, 4, 1)
    base_df, _ = frames(spark, base, [])
    batch = spark.createDataFrame([(2, "K0", "Gamma")], "row_no long, project_code string, project_name string")
    changes = upsert.upsert_changes(base_df, batch, SPEC)
    row = changes.first()
    assert row.action == "updated" and len(row.changed_fields) == 1
    after = upsert.merged_records(base_df, changes, SPEC).filter("project_code = 'K0'").first()
    assert after.project_name == "Gamma" and after.grade_code == base[0]["grade_code"]


def test_time_stamps_and_vectors(spark):
    base = spark.createDataFrame(
        [("a", "one", [1.0], 1, 1), ("b", "two", [2.0], 1, 1)],
        "project_code string, project_name string, embedding array<float>, created long, updated long",
    )
    batch = spark.createDataFrame(
        [(2, "a", "one!"), (3, "c", "new"), (4, "b", "two")],
        "row_no long, project_code string, project_name string",
    )

    def factory():
        def embed(texts):
            if "new" in texts:
                raise RuntimeError("refused")
            return [[len(t)] for t in texts]

        return embed

    changes = upsert.upsert_changes(base, batch, SPEC)
    merged = upsert.merged_records(
        base, changes, SPEC, run_time=F.lit(5), created_col="created", updated_col="updated"
    )
    after = upsert.reembedded(merged, SPEC, text_cols=["project_name"], model=factory, size=1)
    got = {r.project_code: (r.embedding, r.created, r.updated, r.embed_error) for r in after.collect()}
    assert got == {
        "a": ([4.0], 1, 5, None), "b": ([2.0], 1, 1, None), "c": (None, 5, 5, "refused"),
    }
    summary = upsert.upsert_summary(changes, SPEC).first()
    assert (summary.inserted_count, summary.updated_count, summary.skipped_count) == (1, 1, 1)
    assert summary.inserted_ids == ["c"] and summary.updated_more == 0


def test_summary_without_rows(spark):
    base, _ = random_case(4, 4, 1)
    base_df, empty = frames(spark, base, [])
    row = upsert.upsert_summary(upsert.upsert_changes(base_df, empty, SPEC), SPEC).first()
    assert row.inserted_count == row.error_count == 0 and row.inserted_ids is None


def test_append_keeps_the_first_of_equal_keys(spark):
    base = spark.createDataFrame([("a", 0)], "k string, seq long")
    items = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), (None, 4)], "k string, seq long")
    fits, rejected = upsert.append_new(base, items, key_col="k", order_col="seq")
    assert [tuple(r) for r in fits.collect()] == [("b", 2)]
    assert rejected.count() == 3


def test_keys_and_values_take_the_types_of_the_base(spark):
    base = spark.createDataFrame([(7, "old", 1)], "id long, name string, size int")
    rows = [(2, "007", "new", "2"), (3, "abc", "x", "1"), (4, "8", "y", "many"), (5, "9", "z", "3")]
    batch = spark.createDataFrame(rows, "row_no long, id string, name string, size string")
    spec = upsert.UpsertSpec(key_col="id", name_col="name", fields=["name", "size"])
    changes = upsert.upsert_changes(base, batch, spec)
    assert {r.row_no: r.action for r in changes.collect()} == {
        2: "updated", 3: "error", 4: "error", 5: "inserted",
    }
    merged = upsert.merged_records(base, changes, spec)
    assert sorted((r.id, r.name, r["size"]) for r in merged.collect()) == [(7, "new", 2), (9, "z", 3)]


def test_a_hot_key_is_dealt_by_segment(spark, monkeypatch):
    """A key with a third of the rows: its rows spread, and each sees what came before it."""
    monkeypatch.setattr(upsert, "SMALL_BATCH", 0)
    monkeypatch.setattr(upsert, "SEGMENT_ROWS", 10_000)
    base = spark.createDataFrame([("hot", "n0", None), ("b", "x", None)], "id string, name string, kind string")
    rows = spark.range(300_000).select(
        (F.col("id") + 2).alias("row_no"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("id"),
        F.when((F.col("id") % 3 == 0) & (F.col("id") % 90_000 != 0), None).otherwise(F.concat(F.lit("n"), F.col("id"))).alias("name"),
        F.lit("z").alias("kind"),
    )
    spec = upsert.UpsertSpec(key_col="id", name_col="name", fields=["name", "kind"])
    changes = upsert.upsert_changes(base, rows, spec)
    text = plan(changes)
    for line in text.splitlines():
        if "hashpartitioning(_group" in line and "_segment" not in line:
            # only tables with a row per key and segment go by key alone
            assert "row_no" not in line
    assert "hashpartitioning(_group" in text.replace("#", " #").replace(" #", "#") and "_segment" in text
    hot = {r.row_no - 2: r for r in changes.filter("id = 'hot'").select("row_no", "action", "changed_fields").collect()}
    assert len(hot) == 100_000 and all(r.action == "updated" for r in hot.values())
    # an empty name keeps what the last named row set, segments earlier
    for i in (0, 3, 89_997, 90_000, 90_003, 270_003, 299_997):
        last = "n0" if i == 0 else f"n{(i - 1) // 90_000 * 90_000}"
        shown = f"n{i}" if i % 90_000 == 0 else "None"
        wanted = [] if last == shown else [f"name: '{last}' → '{shown}'"]
        assert [c for c in hot[i].changed_fields if c.startswith("name")] == wanted, i
    parts = changes.select("id", F.spark_partition_id().alias("p")).filter("id = 'hot'").groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 60_000


def test_the_complete_result_of_a_run(spark):
    """Every id and error beside the summary; a failed embedding counts once, at the last row."""
    base = spark.createDataFrame(
        [("a", "one", [1.0]), ("b", "two", [2.0])], "project_code string, project_name string, embedding array<float>"
    )
    given = [(2, "a", "one!"), (3, "c", "bad"), (4, "b", "two"), (5, None, "x"), (6, "b", "bad"), (7, "b", "bad two")]
    given += [(10 + i, f"n{i}", f"name {i}") for i in range(30)]
    batch = spark.createDataFrame(given, "row_no long, project_code string, project_name string")
    def factory():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [[len(t)] for t in texts]

        return embed

    records, result = upsert.upserted(base, batch, SPEC, text_cols=["project_name"], model=factory, size=1)
    rows = [tuple(r) for r in result.select("section", "row_no", "id", "message", "n").collect()]
    counts = {r[2]: r[4] for r in rows if r[0] == "count"}
    assert counts == {"inserted": 30, "updated": 2, "skipped": 1, "error": 3}
    (summary,) = [r for r in rows if r[0] == "summary"]
    assert summary[4] == 36 and "30" in summary[3]
    assert sorted(r[1:3] for r in rows if r[0] == "inserted") == sorted((10 + i, f"n{i}") for i in range(30))
    assert sorted(r[1:3] for r in rows if r[0] == "updated") == [(2, "a"), (6, "b")]
    assert sorted(r[1:4] for r in rows if r[0] == "error") == [
        (3, "c", "refused"), (5, None, "row 5: key is blank"), (7, "b", "refused"),
    ]
    kept = {r.project_code: (r.project_name, r.embedding, r.embed_error) for r in records.collect()}
    assert kept["b"] == ("bad two", [2.0], "refused") and kept["c"] == ("bad", None, "refused")
    assert kept["a"] == ("one!", [4.0], None) and len(kept) == 33
