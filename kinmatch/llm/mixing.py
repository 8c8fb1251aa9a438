"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; a document's expected copies are target over source size.
Whole copies are certain, the fractions are rounded together: two documents meet, words move
between their fractions in a random direction until one fraction is 0 or 1, and the other goes
on. The direction is drawn so that each document keeps its expected number of copies, and what
one loses in words the other gains, so the words of a source stay at their target throughout.

Leaves of the reduction are groups of one source, salted to about ``LEAF_ROWS`` rows, worked
through from the largest document down. A document far larger than the next one meets all that
follow as one partner, so large documents are settled while small ones can still make up for
them. Each leaf ends with one open fraction at most, mostly a small one; these meet again in a
tree, ``FAN`` leaves at a time. The last fraction of a source goes to the nearer whole, which is
all that keeps the source off its target. Draws are hashes of the id, and where an id stands on
several rows of the text and a number among equal rows too, so reruns agree however the rows are
laid out and no id fills a leaf.

Chances are kept while either way can be made up for. A document of more than ``WEIGHTY`` of its
leaf's words that can only be made up for in one way goes that way, as in sources of a handful
of documents; a smaller one is paired.

Defined cases: null texts have no words; a null source is a source of its own and comes last;
documents without words are drawn one by one and take nothing; if no document has words
all targets are 0; a null id is drawn like any other; repeated rows are rows of their own. An
empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinmatch.llm import text as tx
from kinmatch.llm.shared import fresh, settled, small

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
LEAF_ROWS = 4096
FAN = 64
#: A row so many times larger than the next one is settled against all that follow.
LARGER = 1.5
#: Share of a leaf's words from which on a row's chance yields to the target.
WEIGHTY = 0.01


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    batch = pa.record_batch([texts], ["text"])
    out = [np.empty(0, np.int64)]
    for part in tx.chunks(batch, 0):
        out.append(np.bincount(tx.words(*tx.flat(part.column(0)))[2], minlength=part.num_rows))
    tx.tidy()
    return pa.array(np.concatenate(out))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, rows, target)``; one row per source, in one task.

    Targets are shares of all sizes by weight, held at ``MAX_COPIES`` times the source's size.
    Sources in order of cap over weight: the level of all sources that aren't capped is what
    the capped ones leave, by weight. Taken at each source as if all before it were capped, it
    rises up to the first that isn't and falls after it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1)
    totals = totals.withColumn("weight", weight.cast("double")).withColumn("cap", MAX_COPIES * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    totals = totals.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))
    return totals.select("source", "source_size", "rows", target.alias("target"))


def rounded(group: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Pivotal rounding of the fractions of a group; one row may keep a fraction.

    From the largest row down, pairs exchange words, so the sum of fractions by size stays what
    it was. A row far larger than the next meets all that follow at once, which take or give the
    words by their fractions; if they can only take or only give, a weighty row goes that way.
    ``last`` also settles the row that is left. Settled rows have ``part`` 0.
    """
    # Equal sizes stand in an order that says nothing of their draws.
    group = group.assign(_place=group["draw"] * 104_729 % 1).sort_values(["size", "_place", "row"], ascending=[False, True, True])
    group = group.drop(columns="_place")
    part, bit = group["part"].to_numpy(copy=True), group["bit"].to_numpy(copy=True)
    size, draw = group["size"].to_numpy(float), group["draw"].to_numpy()

    total, held = size.sum(), -1
    for k in range(len(part)):
        if part[k] <= 0:
            continue
        if held >= 0 and size[held] > LARGER * size[k]:
            give = part[k:] * size[k:]
            take = np.where(part[k:] > 0, size[k:], 0.0) - give
            a, s, chance = part[held], size[held], draw[held] * 7919 % 1
            rise, fall = give.sum() >= (1 - a) * s, take.sum() >= a * s
            # The same weights for both ways keep every chance, where they reach for both.
            even = np.minimum(give, take)
            if even.sum() >= s:
                give = take = even
            if give is take or (rise or fall) and s > WEIGHTY * total:
                rises = rise and (not fall or chance < a)
                moved = -(1 - a) * s * give / give.sum() if rises else a * s * take / take.sum()
                part[k:] = np.clip(part[k:] + moved / np.maximum(size[k:], 1), 0, 1)
                part[held], bit[held], held = 0, int(rises), -1
                full = np.flatnonzero(part[k:] > 1 - 1e-9) + k
                part[full], bit[full] = 0, 1
                part[k:][part[k:] < 1e-9] = 0
                if part[k] <= 0:
                    continue
        if held < 0:
            held = k
            continue
        a, b, s, t = part[held], part[k], size[held], size[k]
        # Words that can go from k to the held one, and back.
        up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
        if draw[k] * (up + down) < down:
            first = (1 - a) * s <= b * t
            a, b = (1.0, b - up / t) if first else (a + up / s, 0.0)
        else:
            first = a * s <= (1 - b) * t
            a, b = (0.0, b + down / t) if first else (a - down / s, 1.0)
        left = -1
        for row, value in ((held, a), (k, b)):
            if value < 1e-9 or value > 1 - 1e-9:
                part[row], bit[row] = 0, round(value)
            else:
                part[row], left = value, row
        held = left
    if last and held >= 0:
        part[held], bit[held] = 0, part[held] >= 0.5
    return group.assign(part=part, bit=bit)


def settle_pairs(group: pd.DataFrame) -> pd.DataFrame:
    return rounded(group, False)


def settle_all(group: pd.DataFrame) -> pd.DataFrame:
    return rounded(group, True)


def told_apart(sizes: DataFrame) -> DataFrame:
    """``content`` becomes ``mark``: null where the id stands once, else a hash of the text's
    hash and of a number that rows equal in id, source and text have in any order.

    Equal rows are numbered within ``LEAF_ROWS`` row numbers, which begin after the ones before.
    """
    many = settled(sizes.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_id"), "repeated")
    count = many.count()
    if not count:
        return sizes.withColumn("content", F.lit(None).cast("long")).withColumnRenamed("content", "mark")
    again = F.col("id").eqNullSafe(F.col("_id"))
    once = sizes.join(small(many, count), again, "left_anti").withColumn("content", F.lit(None).cast("long"))
    rows = sizes.join(small(many, count), again, "left_semi").withColumn("chunk", F.floor(F.col("row") / LEAF_ROWS))
    key = ["id", "source", "content"]
    counts = rows.groupBy(*key, "chunk").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = settled(counts.withColumn("before", F.sum("k").over(earlier)).where("before > 0").drop("k"), "before")
    counts = counts.toDF(*(f"_{c}" for c in counts.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "chunk"]]
    number = F.row_number().over(Window.partitionBy(*key, "chunk").orderBy("row"))
    rows = rows.withColumn("number", number).join(small(counts, counts.count()), same, "left")
    rows = rows.withColumn("content", F.xxhash64("content", F.col("number") + F.coalesce("_before", F.lit(0))))
    return settled(once.unionByName(rows.select(once.columns)), "told").withColumnRenamed("content", "mark")


def placed(sizes: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, Callable[[int], Column]]:
    """Each row with its whole copies and fraction, its leaf and draw; the number of leaves per
    source; and the draw of any level. Rows without words are settled here."""
    salts = sizes.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count(F.lit(1)) / LEAF_ROWS).cast("int").alias("salts"))
    salts = settled(salts, "salts")
    facts = targets.join(small(salts, salts.count()), F.col("source").eqNullSafe(F.col("_source"))).drop("source")
    rows = told_apart(sizes).join(small(facts, targets.count()), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    def draw(level: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "id", "size", "mark"), 11) / F.lit(float(1 << 53))

    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(expected + F.lit(1e-9))
    rows = rows.withColumn("copies", whole.cast("int")).withColumn("part", F.greatest(expected - whole, F.lit(0.0)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "mark"), F.col("salts")).cast("int"))
    rows = rows.withColumn("draw", draw(0)).withColumn("part", F.when(F.col("part") > 1e-9, F.col("part")).otherwise(F.lit(0.0)))
    wordless = F.col("size") == 0
    rows = rows.withColumn("bit", (wordless & (F.col("draw") < F.col("part"))).cast("int"))
    rows = rows.withColumn("part", F.when(wordless, F.lit(0.0)).otherwise(F.col("part")))
    return rows, salts, draw


def mixed_rows(documents: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, row_col: str | None = None) -> DataFrame:
    """``(row, id, size, source_size, target, copies)`` for each row of the table."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sizes = documents.select(
        row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("content"),
    )
    sizes = settled(sizes, "sizes")
    targets = settled(source_targets(sizes), "targets")
    rows, salts, draw = placed(sizes, targets, seed)

    leaves = settled(rows.groupBy("source", "salt").applyInPandas(settle_pairs, rows.schema), "leaves")
    open_rows = leaves.where("part > 0")
    levels = [leaves.where("part = 0").select("row", "bit")]
    most = salts.agg(F.max("salts")).first()[0] or 1
    level = 1
    while most > 1:
        most = -(-most // FAN)
        open_rows = open_rows.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).withColumn("draw", draw(level))
        met = open_rows.groupBy("source", "salt").applyInPandas(settle_pairs, rows.schema)
        met = settled(met, "level")
        levels.append(met.where("part = 0").select("row", "bit"))
        open_rows = met.where("part > 0")
        level += 1
    # The root of each source.
    roots = open_rows.withColumn("draw", draw(level)).groupBy("source").applyInPandas(settle_all, rows.schema)
    roots = settled(roots, "level")
    levels.append(roots.select("row", "bit"))
    later = levels[1]
    for x in levels[2:]:
        later = later.union(x)
    later = settled(later, "rounded").toDF("_row", "_bit")
    out = leaves.join(small(later, later.count()), F.col("row") == F.col("_row"), "left")
    copies = F.col("copies") + F.coalesce("_bit", "bit")
    return out.select("row", "id", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed_documents(documents: DataFrame, id_col="doc_id", source_col="source", text_col="text", seed=0) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    rows = mixed_rows(documents, id_col, source_col, text_col, seed)
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixture(documents: DataFrame, id_col="doc_id", source_col="source", text_col="text", seed=0) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with its own columns."""
    row, times = fresh(documents, "_at"), fresh(documents, "_times")
    names = documents.columns
    table = settled(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = mixed_rows(table, id_col, source_col, text_col, seed, row)
    copies = settled(copies.where("copies > 0").select(F.col("row").alias("_of_row"), F.col("copies").alias(times)), "copies")
    out = table.join(small(copies, copies.count()), F.col(row) == F.col("_of_row"))
    out = out.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(names)
