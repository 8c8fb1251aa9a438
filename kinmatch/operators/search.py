"""Key lookup, equality filters and substring search, for one request or many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx
from kinmatch.functions.text import let
from kinmatch.operators.blocks import rows_within
from kinmatch.sources.tables import settled

# Up to so many keywords become expressions tested in every row.
LITERAL_KEYWORDS = 16
# Up to so many, once the rows that rank first have settled the others.
LITERAL_LEFT = 128
# Up to so many are met with the vocabulary of the records.
BROADCAST_KEYWORDS = 1 << 16
# Bytes of words with their keywords that are broadcast.
BROADCAST_BYTES = 64 << 20
# Characters of a run, for the keywords long enough; a shorter one is its own run.
RUN_SIZES = (6, 3)
# Characters of a keyword whose runs are counted.
COUNTED_CHARS = 64
# What ends a word, in records and in keywords alike.
BETWEEN_WORDS = r"\s+"
# Up to so many ranked (keyword, key) rows are broadcast to fetch their records.
BROADCAST_HITS = 1 << 18
# Records that rank first and are searched first, and how much larger each further band is.
BAND_ROWS, BAND_GROWTH = 1 << 12, 16


def newest_first(order_col: str | None, key_col: str) -> list[Column]:
    return ([F.desc(order_col)] if order_col else []) + [F.col(key_col).asc()]


def lookup(keys: DataFrame, records: DataFrame, *, key_col: str) -> DataFrame:
    """One row per requested key with the record's columns and a ``found`` flag."""
    return (
        keys.join(records.withColumn("_hit", F.lit(True)), key_col, "left")
        .withColumn("found", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def detail_documents(
    keys: DataFrame, records: DataFrame, *, key_col: str, shown: Mapping[str, str], summary_col: str | None = None
) -> DataFrame:
    """(key, found, document): each requested record as JSON, or the text that there is none.

    ``shown`` names the columns and their labels; the fixed prefix is dropped from the summary.
    """
    def value(name):
        if name == summary_col:
            return tx.without_prefix(F.coalesce(name, F.lit("")))
        return F.col(name)

    document = F.to_json(
        F.struct(*[value(name).alias(label) for name, label in shown.items()]), {"ignoreNullFields": "false"}
    )
    before, after = fixed.NOT_FOUND_MESSAGE.split("{}")
    missing = F.concat(F.lit(before), F.coalesce(F.col(key_col).cast("string"), F.lit("None")), F.lit(after))
    return lookup(keys.select(key_col), records, key_col=key_col).select(
        key_col, "found", F.when(F.col("found"), document).otherwise(missing).alias("document")
    )


def filter_equal(
    records: DataFrame, column: str, value, *, order_col: str, key_col: str
) -> DataFrame:
    return records.filter(F.col(column) == value).orderBy(*newest_first(order_col, key_col))


def _any_contains(columns: Sequence[str], keyword: Column, wildcards: bool) -> Column:
    hit = F.lit(False)
    for name in columns:
        content = F.lower(F.coalesce(name, F.lit("")))
        if wildcards:
            hit = hit | F.like(content, F.concat(F.lit("%"), keyword, F.lit("%")))
        else:
            hit = hit | F.contains(content, keyword)
    return hit


def search_keyword(
    records: DataFrame, keyword: str, *, search_cols: Sequence[str], order_col: str | None,
    key_col: str, wildcards: bool = False,
) -> DataFrame:
    """Records with the keyword in any column, ignoring case. An empty keyword finds all.

    ``wildcards`` gives ``%`` and ``_`` their LIKE meaning.
    """
    hit = _any_contains(search_cols, F.lower(F.lit(keyword)), wildcards)
    return records.filter(hit).orderBy(*newest_first(order_col, key_col))


def char_grams(text: Column, sizes: Sequence[int] = (1, 2, 3)) -> Column:
    """Distinct runs of characters of the given sizes; size 0 stands for the empty run."""

    def of_size(n):
        if n == 0:
            return F.array(F.lit(""))
        # a look-ahead takes no characters, so the next run starts one further
        return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def probe_gram(needle: Column) -> Column:
    """A run of at most 3 characters that every text containing the needle contains."""
    return F.left(needle, F.lit(3))


def _longest(parts: Column) -> Column:
    return F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def _literal_part(pattern: Column) -> Column:
    """The longest stretch of a LIKE pattern that stands for itself."""
    return _longest(F.split(pattern, r"[%_\\]"))


def search_keywords(
    keywords: DataFrame,
    records: DataFrame,
    *,
    keyword_col: str,
    search_cols: Sequence[str],
    key_col: str,
    order_col: str | None = None,
    limit: int | None = None,
    wildcards: bool = False,
) -> DataFrame:
    """``search_keyword`` for many keywords: record columns, keyword[, rank].

    A few keywords are tested row by row. For more, the distinct words of all records are
    listed and met with the keywords, each waiting under the run of characters that is rarest
    in that vocabulary; then a row's distinct words find the keywords they hold. A keyword with
    white space is looked for by its longest word and verified in the record. Beyond
    ``BROADCAST_KEYWORDS`` both sides are joined on the first run. ``limit`` keeps the newest
    per keyword; the newest records are searched first, older ones only for keywords that have
    fewer hits so far. ``key_col`` names a record.
    """
    wanted = keywords.select(F.col(keyword_col).alias("_keyword")).filter(
        F.col("_keyword").isNotNull()
    ).distinct()
    rows = rows_within(wanted, BROADCAST_KEYWORDS)
    order_cols = [order_col] if order_col and order_col != key_col else []
    if rows is not None and len(rows) <= LITERAL_KEYWORDS:
        found = _test_each(records, sorted(r[0] for r in rows), search_cols, wildcards)
    elif rows is not None and limit is not None and order_cols:
        found = _first_hits(sorted(r[0] for r in rows), records, search_cols, key_col, order_col, limit, wildcards)
    elif rows is not None:
        found = _meet_words(sorted(r[0] for r in rows), records, search_cols, key_col, order_cols, wildcards)
        if limit is None:
            found = records.join(found.select("_keyword", key_col), key_col)
    else:
        found = _probe(wanted, records, search_cols, key_col, wildcards)
    if limit is None:
        return found.withColumnRenamed("_keyword", keyword_col)
    # rank on keys alone; whole records only travel for what is kept
    order = Window.partitionBy("_keyword").orderBy(*newest_first(order_col, key_col))
    kept = (
        found.select("_keyword", key_col, *order_cols)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(key_col, F.col("_keyword").alias(keyword_col), "rank")
    )
    few = rows is not None and len(rows) * limit <= BROADCAST_HITS
    return records.join(F.broadcast(kept) if few else kept, key_col)


def _test_each(records, keywords: list[str], search_cols, wildcards) -> DataFrame:
    if not keywords:
        return records.limit(0).withColumn("_keyword", F.lit(""))
    candidates = F.array(
        *[F.struct(F.lit(k).alias("keyword"), F.lower(F.lit(k)).alias("lowered")) for k in keywords]
    )
    contents = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in search_cols])

    def found_in(texts, keyword):
        if wildcards:
            pattern = F.concat(F.lit("%"), keyword, F.lit("%"))
            return F.exists(texts, lambda t: F.like(t, pattern))
        return F.exists(texts, lambda t: F.contains(t, keyword))

    hits = let(
        contents, lambda texts: F.filter(candidates, lambda c: found_in(texts, c["lowered"]))
    )
    # the outer form keeps the optimizer from computing the array a second time to test it
    return (
        records.select("*", F.explode_outer(hits).alias("_hit"))
        .filter(F.col("_hit").isNotNull())
        .select(*records.columns, F.col("_hit.keyword").alias("_keyword"))
    )


def _content(search_cols: Sequence[str]) -> Column:
    return F.concat_ws("\n", *[F.lower(c) for c in search_cols])


def _bands(records: DataFrame, order_col: str) -> list[Column]:
    """Conditions that part the records, the ones that rank first in the first and smallest band."""
    rows, size, shares = records.count(), BAND_ROWS, []
    while 2 * size <= rows:
        shares.append(1 - size / rows)
        size *= BAND_GROWTH
    if not shares or not isinstance(records.schema[order_col].dataType, (T.NumericType, T.DateType, T.TimestampType)):
        return [F.lit(True)]
    cuts = records.agg(F.percentile_approx(order_col, shares)).first()[0] or []
    value, bands, rest = F.col(order_col), [], F.lit(True)
    for cut in cuts:  # NaN is above every number
        bands.append(rest & (value >= F.lit(cut)))
        rest = (value < F.lit(cut)) | value.isNull()
    return [*bands, rest]


def _first_hits(
    keywords: list[str], records: DataFrame, search_cols, key_col: str, order_col: str, limit: int, wildcards: bool
) -> DataFrame:
    """(keyword, key, order) of hits that hold the first ``limit`` of every keyword.

    No record of a later band ranks before one of an earlier band, so a keyword with enough hits
    is left out of the bands that follow.
    """
    names = ["_keyword", key_col, order_col]
    asked = _asked(records, keywords, wildcards)
    left = sorted(r[0] for r in asked.filter("_part = _lowered AND _part != ''").select("_keyword").collect())
    others = sorted(set(keywords).difference(left))
    found = _meet_words(others, records, search_cols, key_col, [order_col], wildcards).select(names) if others else None
    order = Window.partitionBy("_keyword").orderBy(*newest_first(order_col, key_col))
    counts = dict.fromkeys(left, 0)
    for i, band in enumerate(_bands(records, order_col) if left else []):
        rows = records.filter(band)
        if i and len(left) <= LITERAL_LEFT:
            met = _test_each(rows, left, search_cols, wildcards).select(names).distinct()
        else:
            met = _meet_words(left, rows, search_cols, key_col, [order_col], wildcards).select(names)
        first = met.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit).drop("_place")
        first = settled(first, "first-hits")
        found = first if found is None else found.unionByName(first)
        for keyword, n in first.groupBy("_keyword").count().collect():
            counts[keyword] += n
        left = [k for k in left if counts[k] < limit]
        if not left:
            break
    return found


def _asked(records: DataFrame, keywords: list[str], wildcards: bool) -> DataFrame:
    """(keyword, lowered, part): each keyword with its longest word."""
    lowered = F.lower("_keyword")
    breaks = rf"[%_\\]|{BETWEEN_WORDS}" if wildcards else BETWEEN_WORDS
    return records.sparkSession.createDataFrame([(k,) for k in keywords], "_keyword string").select(
        "_keyword", lowered.alias("_lowered"), _longest(F.split(lowered, breaks)).alias("_part")
    )


def _meet_words(
    keywords: list[str], records: DataFrame, search_cols, key_col: str, order_cols: list[str], wildcards: bool
) -> DataFrame:
    """(keyword, key, order) of records with words that hold a keyword.

    Only words and keys are joined. A keyword that is more than one word is verified against the
    contents of the records its longest word finds; one without any word is tested in each.
    """
    asked = _asked(records, keywords, wildcards)
    wordless = sorted(r[0] for r in asked.filter("_part = ''").select("_keyword").collect())
    asked = asked.filter("_part != ''")
    names = ["_keyword", key_col, *order_cols]

    # words are a column of their own; the outer form keeps them from being made twice
    words = F.array_distinct(F.split(_content(search_cols), BETWEEN_WORDS)).alias("_words")
    cut = records.select(key_col, *order_cols, words).select(key_col, *order_cols, F.explode_outer("_words").alias("_word"))
    vocabulary = settled(cut.select("_word").distinct(), "vocabulary")
    # few bytes, but much work for each
    vocabulary = vocabulary.repartition(records.sparkSession.sparkContext.defaultParallelism)
    holding = settled(_holding(vocabulary, asked), "words-with-keywords")
    size = holding.agg(F.sum(F.octet_length("_word") + F.octet_length("_keyword") + 64)).first()[0] or 0
    holding = F.broadcast(holding) if size <= BROADCAST_BYTES else holding
    met = cut.join(holding, "_word").select(*names, "_lowered", "_whole").distinct()
    found = met.filter("_whole").select(names)
    if not asked.filter("_part != _lowered").isEmpty():
        contents = records.select(key_col, *search_cols)
        verified = _any_contains(search_cols, F.col("_lowered"), wildcards)
        found = found.unionByName(met.filter("NOT _whole").join(contents, key_col).filter(verified).select(names))
    if wordless:
        found = found.unionByName(_test_each(records, wordless, search_cols, wildcards).select(names))
    return found


def _holding(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, keyword, lowered, whole) for every word that has a keyword's longest word in it."""
    long, short = RUN_SIZES
    part = F.left("_part", F.lit(COUNTED_CHARS))
    runs = (
        F.when(F.length(part) >= long, char_grams(part, (long,)))
        .when(F.length(part) >= short, char_grams(part, (short,)))
        .otherwise(F.array(part))
    )
    runs = asked.select("*", runs.alias("_runs")).select(*asked.columns, F.explode_outer("_runs").alias("_run"))
    sizes = sorted(r[0] for r in runs.select(F.length("_run")).distinct().collect())
    of_words = vocabulary.select("_word", char_grams(F.col("_word"), sizes).alias("_runs"))
    of_words = of_words.select("_word", F.explode_outer("_runs").alias("_run"))
    counted = (
        of_words.select("_run").join(F.broadcast(runs.select("_run").distinct()), "_run")
        .groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    )
    # a keyword with a run that no word has is nowhere
    rarest = (
        runs.join(F.broadcast(counted), "_run", "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
        .groupBy(*asked.columns)
        .agg(F.min_by("_run", F.struct("_n", "_run")).alias("_run"), F.min("_n").alias("_n"))
        .filter("_n > 0").drop("_n")
    )
    return of_words.join(F.broadcast(rarest), "_run").filter(F.contains(F.col("_word"), F.col("_part"))).select(
        "_word", "_keyword", "_lowered", (F.col("_part") == F.col("_lowered")).alias("_whole")
    )


def _probe(wanted, records, search_cols, key_col, wildcards) -> DataFrame:
    """The same where the keywords are too many to travel: both sides meet on a run."""
    lowered = F.lower("_keyword")
    probes = wanted.withColumn(
        "_gram", probe_gram(_literal_part(lowered) if wildcards else lowered)
    )
    grams = F.explode_outer(char_grams(_content(search_cols), (0, 1, 2, 3))).alias("_gram")
    verified = _any_contains(search_cols, lowered, wildcards)
    candidates = records.select(key_col, grams).join(probes, "_gram").drop("_gram")
    return candidates.join(records, key_col).filter(verified)
