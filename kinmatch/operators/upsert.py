"""Change-detecting batch upsert.

A batch row is compared with the record it would change, field by field, over the
columns the batch has. Cells have three states: an *empty* cell (NULL) keeps the old
value but counts as a difference, a *blank* text sets NULL, any other text sets itself.
Rows with the same key apply in row order, each seeing what the earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx
from kinmatch.operators.embedding import embed
from kinmatch.sources.tables import settled

# The keys of batches up to this many rows are broadcast to find the records they touch.
BROADCAST_KEYS = 200_000
# Batches up to this many rows need no splitting of repeated keys.
SMALL_BATCH = 1_000_000
# Larger batches: rows of one key are handled in runs of so many row numbers.
SEGMENT_ROWS = 1_000_000

Rule = Callable[[Column], Column]


def max_length(n: int) -> Rule:
    return lambda value: F.length(value) > n


def one_of(values: Sequence[str]) -> Rule:
    return lambda value: ~value.isin(list(values))


def castable(type_name: str) -> Rule:
    return lambda value: value.try_cast(type_name).isNull()


@dataclass(frozen=True)
class UpsertSpec:
    """Which columns take part and what makes a value illegal."""

    key_col: str
    name_col: str
    fields: Sequence[str]
    date_cols: Sequence[str] = ()
    # column -> {rule name: violated?}; NULL always passes
    rules: Mapping[str, Mapping[str, Rule]] = field(default_factory=dict)
    row_col: str = "row_no"
    # column with the field names a row's file had, for batches of mixed files
    present_col: str | None = None
    # column with a row's file; the files of a batch apply one after the other, by name
    file_col: str | None = None

    @property
    def place(self) -> list[str]:
        """The columns that order the rows of a batch."""
        return [self.file_col, self.row_col] if self.file_col else [self.row_col]


def failed_rules(values: Mapping[str, Column], rules: Mapping[str, Mapping[str, Rule]]) -> Column:
    """Names of violated rules as ``array<string>``, for values given by column name."""
    checks = [
        F.when(values[column].isNotNull() & violated(values[column]), F.lit(f"{column}: {name}"))
        for column, named in rules.items()
        if column in values
        for name, violated in named.items()
    ]
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def upsert_changes(base: DataFrame, batch: DataFrame, spec: UpsertSpec) -> DataFrame:
    """One row per batch row: what it does and why.

    Columns: file (where the spec names one), row number, key, ``action`` (inserted, updated,
    skipped, error), ``changed_fields``, ``errors``, and per field a ``cell_<field>`` struct
    with the value to write, NULL to leave the field alone. Keys are compared in the type they
    have in the base, and values that this type can't hold are errors of their row.

    A key may own a large part of a large batch. Its rows are dealt by key and segment of row
    numbers from the start: the record they touch is joined once per segment, and what earlier
    segments leave over comes from a table with one row per segment.
    """
    spec = _typed(spec, base)
    key, row = spec.key_col, spec.row_col
    n_rows = batch.limit(SMALL_BATCH + 1).count()
    small = n_rows <= SMALL_BATCH
    present = [f for f in spec.fields if f in batch.columns]

    rows = _cells(batch, spec, present, base.schema[key].dataType)
    few = n_rows <= min(BROADCAST_KEYS, SMALL_BATCH)
    part = F.floor(F.col(row) / SEGMENT_ROWS)
    segment = F.struct(F.col(spec.file_col), part) if spec.file_col else part
    rows = rows.withColumn("_segment", F.lit(0) if small else segment)
    touched = _touched_records(base, rows, spec, present, few)
    rows = rows.join(touched, ["_group", "_segment"], "left").withColumn(
        "_in_base", F.coalesce("_in_base", F.lit(False))
    )

    sound = F.col("_key_valid") & (F.size("_violations") == 0)
    rows = _last_before(rows, spec, small, {"_seen": F.when(sound, F.lit(True))})
    name_blank = F.col(f"cell_{spec.name_col}.value").isNull()
    name_set_blank = F.col(f"cell_{spec.name_col}").isNotNull() & name_blank
    rows = rows.withColumns(
        {
            "_inserts": sound & ~F.col("_in_base") & F.col("_seen").isNull(),
            "_name_set_blank": name_set_blank,
        }
    )
    applies = F.col("_inserts") | (sound & ~F.col("_name_set_blank"))
    rows = _last_before(
        rows, spec, small,
        {f"_last_{f}": F.when(applies, F.col(f"cell_{f}")) for f in present},
    )

    rows = rows.withColumn("changed_fields", _changes(spec, present))
    changed = F.size("changed_fields") > 0
    action = (
        F.when(~sound, "error")
        .when(F.col("_inserts"), "inserted")
        .when(changed & F.col("_name_set_blank"), "error")
        .when(changed, "updated")
        .otherwise("skipped")
    )
    errors = (
        F.when(
            ~F.col("_key_valid"),
            F.array(F.concat(F.lit("row "), F.col(row).cast("string"), F.lit(": key is blank"))),
        )
        .when(F.size("_violations") > 0, F.col("_violations"))
        .when(
            (F.col("action") == "error"), F.array(F.lit(f"{spec.name_col}: missing"))
        )
        .otherwise(F.array().cast("array<string>"))
    )
    new_name = F.struct(F.coalesce(f"cell_{spec.name_col}.value", F.lit("")).alias("value"))
    written = F.col("action").isin("inserted", "updated")
    return (
        rows.withColumn("action", action)
        .withColumn(
            f"cell_{spec.name_col}",
            F.when(F.col("_inserts"), new_name).otherwise(F.col(f"cell_{spec.name_col}")),
        )
        .select(
            *spec.place,
            key,
            "action",
            F.when(F.col("action") == "updated", F.col("changed_fields"))
            .otherwise(F.array().cast("array<string>"))
            .alias("changed_fields"),
            errors.alias("errors"),
            *[F.when(written, F.col(f"cell_{f}")).alias(f"cell_{f}") for f in present],
        )
    )


def _typed(spec: UpsertSpec, base: DataFrame) -> UpsertSpec:
    """The rules with one for each column whose base type is not text and that has none."""
    rules = dict(spec.rules)
    for column in base.schema:
        if column.name in (spec.key_col, *spec.fields) and not isinstance(column.dataType, StringType):
            kind = column.dataType.simpleString()
            rules.setdefault(column.name, {f"not a {kind}": castable(kind)})
    return replace(spec, rules=rules)


def _cells(
    batch: DataFrame, spec: UpsertSpec, present: Sequence[str], key_type: DataType
) -> DataFrame:
    """Key, row number, cells, key validity and violated rules per batch row."""
    key = tx.strip(F.col(spec.key_col).cast("string"))
    key = F.coalesce(key.try_cast(key_type).cast("string"), key)

    def here(name):
        return F.array_contains(spec.present_col, name) if spec.present_col else F.lit(True)

    def cell(name):
        text = F.col(name).cast("string")
        value = tx.normalized_cell(text, name in spec.date_cols)
        return F.when(here(name) & text.isNotNull(), F.struct(value.alias("value")))

    rows = batch.select(
        *spec.place,
        F.when(~key.isin(fixed.BLANK_KEY_TEXTS), key).alias(spec.key_col),
        *[cell(f).alias(f"cell_{f}") for f in present],
        *[here(f).alias(f"_has_{f}") for f in present],
    )
    values = {f: F.col(f"cell_{f}.value") for f in present}
    values[spec.key_col] = F.col(spec.key_col)
    # rows without a key belong together with nothing; spread them
    own_group = F.concat_ws("\0", F.lit(""), *[F.col(c).cast("string") for c in spec.place])
    return rows.withColumns(
        {
            "_group": F.coalesce(F.col(spec.key_col), own_group),
            "_key_valid": F.col(spec.key_col).isNotNull(),
            "_violations": failed_rules(values, spec.rules),
        }
    )


def _touched_records(
    base: DataFrame, rows: DataFrame, spec: UpsertSpec, present: Sequence[str], few: bool
) -> DataFrame:
    """The records whose key the batch names, once per segment of its rows.

    Columns: ``_group``, ``_segment``, ``_in_base``, ``_old_<field>``.
    """
    keys = rows.filter("_key_valid").select("_group", "_segment").distinct()
    records = base.select(
        F.col(spec.key_col).cast("string").alias("_group"),
        F.lit(True).alias("_in_base"),
        *[
            tx.normalized_cell(F.col(f).cast("string"), f in spec.date_cols).alias(f"_old_{f}")
            for f in present
        ],
    )
    return records.join(F.broadcast(keys) if few else keys, "_group")


def _last_before(
    rows: DataFrame, spec: UpsertSpec, small: bool, values: Mapping[str, Column]
) -> DataFrame:
    """Add, per value, its last non-NULL among the earlier rows of the same key.

    A key may own a large part of a large batch, so its rows are cut into segments; each
    segment gets what the earlier ones left over from a table with a row per segment.
    """
    place = F.struct(*spec.place)
    rows = rows.withColumns({f"_v{n}": v for n, v in values.items()})
    earlier = (
        Window.partitionBy("_group", "_segment")
        .orderBy(*spec.place)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    names = list(values)
    result = rows.withColumns({n: F.last(f"_v{n}", ignorenulls=True).over(earlier) for n in names})
    if not small:
        left_over = rows.groupBy("_group", "_segment").agg(
            *[
                F.max_by(f"_v{n}", F.when(F.col(f"_v{n}").isNotNull(), place)).alias(f"_v{n}")
                for n in names
            ]
        )
        before = (
            Window.partitionBy("_group")
            .orderBy("_segment")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = left_over.select(
            "_group", "_segment",
            *[F.last(f"_v{n}", ignorenulls=True).over(before).alias(f"_c{n}") for n in names],
        ).filter(F.coalesce(*[F.when(F.col(f"_c{n}").isNotNull(), True) for n in names]))
        result = result.join(carried, ["_group", "_segment"], "left").withColumns(
            {n: F.coalesce(n, f"_c{n}") for n in names}
        ).drop(*[f"_c{n}" for n in names])
    return result.drop(*[f"_v{n}" for n in names])


def _changes(spec: UpsertSpec, present: Sequence[str]) -> Column:
    """``field: 'old' → 'new'`` for every field that differs from the state before the row."""

    def change(name):
        new = F.col(f"cell_{name}.value")
        old = F.when(F.col(f"_last_{name}").isNotNull(), F.col(f"_last_{name}.value")).otherwise(
            F.col(f"_old_{name}")
        )
        shown = [F.coalesce(v, F.lit("None")) for v in (old, new)]
        text = F.concat(F.lit(f"{name}: '"), shown[0], F.lit("' → '"), shown[1], F.lit("'"))
        return F.when(F.col(f"_has_{name}") & ~new.eqNullSafe(old), text)

    return F.filter(F.array(*[change(f) for f in present]), lambda c: c.isNotNull())


def written_values(changes: DataFrame, spec: UpsertSpec) -> DataFrame:
    """Per written key: ``_inserted`` and the last cell of each field in row order."""
    cells = [c for c in changes.columns if c.startswith("cell_")]
    place = F.struct(*spec.place)
    return (
        changes.filter(F.col("action").isin("inserted", "updated"))
        .groupBy(spec.key_col)
        .agg(
            F.bool_or(F.col("action") == "inserted").alias("_inserted"),
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
                for c in cells
            ],
        )
    )


def merged_records(
    base: DataFrame,
    changes: DataFrame,
    spec: UpsertSpec,
    *,
    run_time: Column | None = None,
    created_col: str | None = None,
    updated_col: str | None = None,
) -> DataFrame:
    """The new snapshot: base columns plus ``_written``."""
    final = written_values(changes, spec).withColumn("_written", F.lit(True))
    types = {f.name: f.dataType for f in base.schema}

    def value(name):
        return F.col(f"cell_{name}.value").try_cast(types[name])

    def stamp(name):
        return run_time.cast(types[name])

    carried = {}
    inserted = {}
    for name in base.columns:
        carried[name], inserted[name] = F.col(name), F.lit(None).cast(types[name])
        if f"cell_{name}" in final.columns:
            carried[name] = F.when(F.col(f"cell_{name}").isNotNull(), value(name)).otherwise(
                F.col(name)
            )
            inserted[name] = value(name)
        elif name == updated_col:
            carried[name] = F.when(F.col("_written"), stamp(name)).otherwise(F.col(name))
            inserted[name] = stamp(name)
        elif name == created_col:
            inserted[name] = stamp(name)
    inserted[spec.key_col] = F.col(spec.key_col).try_cast(types[spec.key_col])

    updates = final.filter(~F.col("_inserted")).withColumn(
        spec.key_col, F.col(spec.key_col).try_cast(types[spec.key_col])
    )
    old = base.join(updates, spec.key_col, "left").select(
        *[carried[n].alias(n) for n in base.columns],
        F.coalesce("_written", F.lit(False)).alias("_written"),
    )
    new = final.filter("_inserted").select(
        *[inserted[n].alias(n) for n in base.columns], "_written"
    )
    return old.unionByName(new)


def reembedded(
    merged: DataFrame, spec: UpsertSpec, *, text_cols: Sequence[str],
    vector_col: str = "embedding", model=None, size: int = fixed.EMBEDDING_SIZE,
) -> DataFrame:
    """``merged_records`` with new vectors for the written rows.

    A row whose embedding fails keeps its old vector and gets ``embed_error``.
    """
    text = tx.embedding_text(*[F.col(c) for c in text_cols])
    others = [c for c in merged.columns if c not in (spec.key_col, vector_col)]
    fresh = embed(
        merged.filter("_written")
        .withColumn("_text", text)
        .withColumnRenamed(vector_col, "_old_vector"),
        key_col=spec.key_col, text_col="_text", model=model, size=size,
        keep=["_old_vector", *others],
    )
    written = fresh.withColumns(
        {vector_col: F.coalesce("embedding", "_old_vector"), "embed_error": F.col("error")}
    )
    untouched = merged.filter(~F.col("_written")).withColumn(
        "embed_error", F.lit(None).cast("string")
    )
    return untouched.unionByName(written.select(*merged.columns, "embed_error"))


def upsert_summary(changes: DataFrame, spec: UpsertSpec, *, shown: int = 10) -> DataFrame:
    """One row: counts, message, and a preview of the ids per written action.

    The id lists hold the first ``shown`` ids in row order plus how many more there are;
    ``result_rows`` has them all. Takes ``upsert_changes`` or ``row_outcomes``.
    """
    actions = list(fixed.COUNT_LABELS)
    order = Window.partitionBy("action").orderBy(*spec.place)
    first = (
        changes.filter(F.col("action").isin("inserted", "updated"))
        .select("action", *spec.place, F.col(spec.key_col).alias("id"))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= shown)
        .groupBy("action")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "id"))).alias("_first"))
    )
    per_action = (
        changes.groupBy("action")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(first, "action", "left")
        .withColumn("_ids", F.transform("_first", lambda pair: pair["id"]))
    )

    def of(action, column):
        return F.max(F.when(F.col("action") == action, F.col(column)))

    totals = per_action.agg(
        *[F.coalesce(of(a, "_n"), F.lit(0)).alias(f"{a}_count") for a in actions],
        *[of(a, "_ids").alias(f"{a}_ids") for a in ("inserted", "updated")],
    )
    return totals.withColumns(
        {
            "message": _message({a: F.col(f"{a}_count") for a in actions}),
            **{
                f"{a}_more": F.greatest(F.col(f"{a}_count") - shown, F.lit(0).cast("long"))
                for a in ("inserted", "updated")
            },
        }
    )


def _message(counts: Mapping[str, Column]) -> Column:
    """What was done, naming the counts that aren't zero."""
    parts = [
        F.when(counts[a] > 0, F.concat(F.lit(f"{label} "), counts[a].cast("string"), F.lit(fixed.COUNT_UNIT)))
        for a, label in fixed.COUNT_LABELS.items()
    ]
    return F.concat(F.lit(fixed.DONE_PREFIX), F.concat_ws(", ", *parts))


def row_outcomes(
    changes: DataFrame, spec: UpsertSpec, embedded: DataFrame | None = None
) -> DataFrame:
    """What became of each batch row: ``changes`` without cells, failed embeddings as errors.

    ``embedded`` is the result of ``reembedded``. A record whose embedding failed stays
    written, but the last row that wrote it counts as an error and says why.
    """
    rows = changes.select(*spec.place, spec.key_col, "action", "changed_fields", "errors")
    if embedded is None:
        return rows
    failed = embedded.filter(F.col("embed_error").isNotNull()).select(
        F.col(spec.key_col).cast("string").alias(spec.key_col), "embed_error"
    )
    last = (
        rows.filter(F.col("action").isin("inserted", "updated"))
        .join(failed, spec.key_col)
        .groupBy(spec.key_col)
        .agg(F.max(F.struct(*spec.place)).alias("_at"), F.first("embed_error").alias("_why"))
        .select(*[F.col(f"_at.{c}").alias(c) for c in spec.place], "_why")
    )
    why = F.col("_why").isNotNull()
    return rows.join(last, spec.place, "left").select(
        *spec.place, spec.key_col,
        F.when(why, "error").otherwise(F.col("action")).alias("action"),
        F.when(why, F.array().cast("array<string>")).otherwise(F.col("changed_fields")).alias("changed_fields"),
        F.when(why, F.array("_why")).otherwise(F.col("errors")).alias("errors"),
    )


def result_rows(outcomes: DataFrame, spec: UpsertSpec) -> DataFrame:
    """The complete result as rows: (section, *place, id, message, n).

    One ``summary`` row with the message and the number of batch rows, a ``count`` row per
    action, and a row per inserted, updated or failed batch row under the name of its action.
    """
    actions = list(fixed.COUNT_LABELS)
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("action") == a).alias(f"{a}_count") for a in actions]
    )
    types = dict(outcomes.dtypes)
    nowhere = [F.lit(None).cast(types[c]).alias(c) for c in spec.place]
    message = _message({a: F.col(f"{a}_count") for a in actions})
    lines = F.array(
        F.struct(F.lit("summary").alias("section"), F.lit(None).cast("string").alias("id"), message.alias("message"), F.col("n")),
        *[
            F.struct(F.lit("count").alias("section"), F.lit(a).alias("id"), F.lit(None).cast("string").alias("message"), F.col(f"{a}_count").alias("n"))
            for a in actions
        ],
    )
    totals = counts.select(F.explode(lines).alias("line")).select("line.section", *nowhere, "line.id", "line.message", "line.n")
    listed = outcomes.filter(F.col("action") != "skipped").select(
        F.col("action").alias("section"), *spec.place, F.col(spec.key_col).cast("string").alias("id"),
        F.when(F.col("action") == "error", F.array_join("errors", "; ")).alias("message"),
        F.lit(1).cast("long").alias("n"),
    )
    return totals.unionByName(listed)


def upserted(
    base: DataFrame, batch: DataFrame, spec: UpsertSpec, *, text_cols: Sequence[str],
    model=None, size: int = fixed.EMBEDDING_SIZE, run_time: Column | None = None,
    created_col: str | None = None, updated_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new records with ``embed_error``, ``result_rows``) of a whole run.

    Changes, records and outcomes are each computed once and stored, so the model is asked
    once per written record, and both results tell of the same run.
    """
    changes = settled(upsert_changes(base, batch, spec))
    merged = merged_records(
        base, changes, spec, run_time=run_time, created_col=created_col, updated_col=updated_col
    )
    records = settled(reembedded(merged, spec, text_cols=text_cols, model=model, size=size))
    outcomes = settled(row_outcomes(changes, spec, records))
    return records, result_rows(outcomes, spec)


# --- keyed batch writes without comparison ------------------------------------------


def append_new(
    base: DataFrame, items: DataFrame, *, key_col: str, order_col: str
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows): keys must be new, and the first of equals wins.

    Equal order values are settled by the other columns, so one row per key is appended.
    """
    others = [c for c in items.columns if c not in (key_col, order_col)]
    place = Window.partitionBy(key_col).orderBy(order_col, *others)
    known = base.select(key_col).distinct().withColumn("_known", F.lit(True))
    marked = items.withColumn("_place", F.row_number().over(place)).join(known, key_col, "left")
    fits = (
        F.col("_known").isNull() & F.col(key_col).isNotNull() & F.col(order_col).isNotNull()
        & (F.col("_place") == 1)
    )
    return tuple(
        marked.filter(c).select(items.columns) for c in (fits, ~fits)
    )


def overwrite_fields(
    base: DataFrame, items: DataFrame, *, key_col: str, fields: Sequence[str],
    updated_col: str | None = None, run_time: Column | None = None,
) -> DataFrame:
    """Set ``fields`` by key from ``items`` (one row per key); unknown keys change nothing."""
    new = items.select(
        key_col, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_new_{f}") for f in fields]
    )
    columns = {
        f: F.when(F.col("_hit"), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields
    }
    if updated_col:
        columns[updated_col] = F.when(F.col("_hit"), run_time).otherwise(F.col(updated_col))
    return base.join(new, key_col, "left").withColumns(columns).select(base.columns)


def delete_keys(base: DataFrame, keys: DataFrame, *, key_col: str) -> DataFrame:
    """Base without the given keys; unknown keys are no error."""
    return base.join(keys.select(key_col), key_col, "left_anti").select(base.columns)
