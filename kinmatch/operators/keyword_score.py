"""Keyword and fuzzy scoring of records for requests without a vector.

Score of a record for a prompt, capped at 1:
  per keyword in order: 0.4 when the record text contains it, otherwise 0.2 x closeness of
  the first word closer than 0.7; plus 0.3 x share of contained keywords; plus 0.3 x share
  of prompt words that contain, or are contained in, some word of the record.

Nearly every record gets some score for nearly every prompt, so building the pairs would
shuffle prompts x records rows. Instead a bounded block of prompts travels to the record
partitions; each task scores its records and lets only the k best per prompt out. Larger
request tables are joined block by block. A task compares strings once per distinct word
and remembers the outcome.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx
from kinmatch.functions.fuzzy import WordLengthGroups
from kinmatch.operators.blocks import pair_blocks, rows_within

# Fixed values of the score.
CONTAINED, CLOSE, RATIO, OVERLAP = 0.4, 0.2, 0.3, 0.3
CLOSE_ABOVE = 0.7

# Up to so many requests are broadcast; beyond, blocks of these sizes are paired.
BROADCAST_REQUESTS = 512
REQUEST_BLOCK = 256
RECORD_BLOCK = 8192
# Records scored together in a task.
RECORDS_PER_STEP = 4000
# Words a task remembers its string comparisons for, before it starts over.
REMEMBERED_WORDS = 200_000
# (term, record) hits expanded at a time.
HITS_PER_STEP = 1 << 22


def record_text(score_cols: Sequence[str]):
    """Lower-cased non-empty fields joined by one space."""
    return F.concat_ws(" ", *[F.nullif(F.lower(c), F.lit("")) for c in score_cols])


def nearest_by_keywords(
    requests: DataFrame,
    records: DataFrame,
    *,
    query_col: str,
    prompt_col: str,
    keywords_col: str,
    key_col: str,
    score_cols: Sequence[str],
    order_col: str | None,
    k: int = fixed.MAX_RESULTS,
) -> DataFrame:
    """The ``k`` best records per request: (query, rank, key, score).

    Equal scores rank newest first; records scoring zero can fill a ranking.
    """
    no_keywords = F.array().cast("array<string>")
    wanted = requests.select(
        F.col(query_col).alias("query"),
        F.transform(F.coalesce(keywords_col, no_keywords), lambda w: F.lower(w)).alias("keywords"),
        tx.split_words(F.lower(F.coalesce(prompt_col, F.lit("")))).alias("words"),
    )
    age = F.col(order_col) if order_col else F.lit(None).cast("timestamp")
    texts = records.select(
        F.col(key_col).alias("key"), age.alias("age"), record_text(score_cols).alias("text")
    )
    types = {f.name: f.dataType.simpleString() for f in (*wanted.schema, *texts.schema)}
    schema = f"query {types['query']}, key {types['key']}, age {types['age']}, score double"

    rows = rows_within(wanted, BROADCAST_REQUESTS)
    if rows is not None:
        shared = records.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def best_of_partition(batches):
            prompts = PromptBlock(shared.value, k)
            for pdf in batches:
                prompts.add(pdf)
            yield prompts.rows()

        hits = texts.mapInPandas(best_of_partition, schema)
    else:

        def best_of_blocks(prompts_pdf, records_pdf):
            block = PromptBlock(list(prompts_pdf[["query", "keywords", "words"]].values), k)
            block.add(records_pdf)
            return block.rows()

        hits = pair_blocks(
            wanted, texts, left_key="query", right_key="key", left_rows=REQUEST_BLOCK,
            right_rows=RECORD_BLOCK, kernel=best_of_blocks, schema=schema,
        )
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("age"), "key")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("query").alias(query_col), "rank", F.col("key").alias(key_col), "score"
    )


class PromptBlock:
    """Prompts scored against batches of records, with the k best seen per prompt."""

    def __init__(self, requests: Sequence[tuple], k: int):
        self.k = k
        self.queries = [r[0] for r in requests]
        keywords = [list(r[1]) for r in requests]
        words = [Counter(r[2]) for r in requests]
        self.keywords = list(dict.fromkeys(w for ws in keywords for w in ws))
        self.words = list(dict.fromkeys(w for ws in words for w in ws))
        place = {w: i for i, w in enumerate(self.keywords)}
        self.keyword_ids = [[place[w] for w in ws] for ws in keywords]
        place = {w: i for i, w in enumerate(self.words)}
        self.word_ids = [np.array([place[w] for w in ws], dtype=np.int64) for ws in words]
        self.word_weights = [np.array(list(ws.values()), dtype=np.int64) for ws in words]
        self.found: list[pd.DataFrame] = []
        self._forget()

    def _forget(self) -> None:
        """Start over with no known words."""
        self.known: dict[str, int] = {}
        self.compared = 0
        none = np.zeros(0, dtype=np.int64)
        # (term, word) pairs, and the closeness of the close ones
        self.inside = (none, none)
        self.common = (none, none)
        self.close = (none, none, np.zeros(0))

    def _compare_new_words(self) -> None:
        new = list(self.known)[self.compared :]
        if not new:
            return
        inside = _contained_in(self.keywords, new)
        common = _contained_either_way(self.words, new)
        close = _close_words(self.keywords, new)
        for name, (terms, words, *values) in (("inside", inside), ("common", common), ("close", close)):
            added = (terms, words + self.compared, *values)
            setattr(self, name, tuple(map(np.concatenate, zip(getattr(self, name), added))))
        self.compared = len(self.known)

    def add(self, records: pd.DataFrame) -> None:
        for start in range(0, len(records), RECORDS_PER_STEP):
            part = records.iloc[start : start + RECORDS_PER_STEP]
            # stable order for equal scores
            part = part.sort_values("key", kind="stable").sort_values(
                "age", ascending=False, na_position="last", kind="stable"
            )
            self._add(part)

    def _add(self, records: pd.DataFrame) -> None:
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        texts = RecordWords(records["text"].tolist(), self.known)
        self._compare_new_words()
        contained = texts.records_with(*self.inside, len(self.keywords))
        for i, keyword in enumerate(self.keywords):
            # only a keyword with white space can lie across words; "" lies everywhere
            if not keyword or re.search(r"\s", keyword):
                contained[i] = [keyword in t for t in texts.texts]
        close = texts.first_values(*self.close, len(self.keywords))
        common = texts.records_with(*self.common, len(self.words))
        best_rows = []
        for q, (ids, word_ids, weights) in enumerate(
            zip(self.keyword_ids, self.word_ids, self.word_weights)
        ):
            score = np.zeros(len(records))
            hits = np.zeros(len(records))
            for i in ids:
                score += np.where(contained[i], CONTAINED, CLOSE * close[i])
                hits += contained[i]
            if ids:
                score += hits / len(ids) * RATIO
            if len(word_ids):
                score += weights @ common[word_ids] / weights.sum() * OVERLAP
            score = np.minimum(score, 1.0)
            top = np.argsort(-score, kind="stable")[: self.k]
            best_rows.append(
                pd.DataFrame(
                    {
                        "q": q,
                        "key": records["key"].to_numpy()[top],
                        "age": records["age"].iloc[top].to_numpy(),
                        "score": score[top],
                    }
                )
            )
        if best_rows:
            self.found.append(pd.concat(best_rows, ignore_index=True))
        if len(self.found) >= 8:
            self.found = [self._best()]

    def _best(self) -> pd.DataFrame:
        rows = pd.concat(self.found, ignore_index=True)
        rows = rows.sort_values("key", kind="stable").sort_values(
            ["q", "score", "age"], ascending=[True, False, False], na_position="last", kind="stable"
        )
        return rows.groupby("q", sort=False).head(self.k)

    def rows(self) -> pd.DataFrame:
        if not self.found:
            return pd.DataFrame({"query": [], "key": [], "age": [], "score": []})
        best = self._best()
        names = pd.Series(self.queries, dtype=object)
        return pd.DataFrame(
            {
                "query": names.iloc[best["q"]].to_numpy(),
                "key": best["key"].to_numpy(),
                "age": best["age"].to_numpy(),
                "score": best["score"].to_numpy(),
            }
        )


class RecordWords:
    """The distinct words of each text in order of first occurrence, as one flat array."""

    def __init__(self, texts: Sequence[str], known: dict[str, int]):
        """Adds unseen words to ``known``, which numbers them."""
        self.texts = texts
        self.n = len(texts)
        flat, sizes = [], []
        for words in (dict.fromkeys(t.split()) for t in texts):
            flat += [known.setdefault(w, len(known)) for w in words]
            sizes.append(len(words))
        word = np.array(flat, dtype=np.int64)
        self.record = np.repeat(np.arange(self.n), sizes)
        # places of each word in the flat array, ascending
        self.places = np.argsort(word, kind="stable")
        self.counts = np.bincount(word, minlength=len(known))
        self.starts = np.cumsum(self.counts) - self.counts

    def _expanded(self, words: np.ndarray):
        """(pair numbers, places): every place of the word of every pair, in bounded steps."""
        n = self.counts[words]
        present = np.nonzero(n)[0]
        ends = np.cumsum(n[present])
        step = 0
        while step < len(present):
            done = ends[step - 1] if step else 0
            stop = max(int(np.searchsorted(ends, done + HITS_PER_STEP, side="right")), step + 1)
            pairs = present[step:stop]
            sizes = n[pairs]
            first = np.cumsum(sizes) - sizes
            offsets = np.repeat(self.starts[words[pairs]] - first, sizes) + np.arange(sizes.sum())
            yield np.repeat(pairs, sizes), self.places[offsets]
            step = stop

    def records_with(self, terms: np.ndarray, words: np.ndarray, n_terms: int) -> np.ndarray:
        """terms x records: does the record hold a word of a (term, word) pair?"""
        out = np.zeros((n_terms, self.n), dtype=bool)
        for pairs, places in self._expanded(words):
            out[terms[pairs], self.record[places]] = True
        return out

    def first_values(self, terms, words, values, n_terms: int) -> np.ndarray:
        """terms x records: the value of the record's first word among the pairs, or zero."""
        first = np.full(n_terms * self.n, len(self.places), dtype=np.int64)
        out = np.zeros(n_terms * self.n)
        for pairs, places in self._expanded(words):
            order = np.argsort(places, kind="stable")
            pairs, places = pairs[order], places[order]
            cells, at = np.unique(terms[pairs] * self.n + self.record[places], return_index=True)
            earlier = places[at] < first[cells]
            cells, at = cells[earlier], at[earlier]
            first[cells] = places[at]
            out[cells] = values[pairs[at]]
        return out.reshape(n_terms, self.n)


def _close_words(needles: Sequence[str], words: Sequence[str]):
    """(needle, word, closeness) of the pairs closer than the limit."""
    groups = WordLengthGroups(words)
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none, np.zeros(0))]
    for i, needle in enumerate(needles):
        for members, values in groups.closer_than(needle, CLOSE_ABOVE):
            found.append((np.full(len(members), i), members, values))
    return tuple(map(np.concatenate, zip(*found)))


def _contained_in(needles: Sequence[str], words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(needle, word) index pairs where the word contains the needle."""
    joined = "\n".join(words) + "\n"
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])
    found_needles, found_places = [], []
    for i, needle in enumerate(needles):
        if not needle or "\n" in needle:
            continue
        place = joined.find(needle)
        while place >= 0:
            found_needles.append(i)
            found_places.append(place)
            # on to the next word
            place = joined.find(needle, joined.find("\n", place))
    holders = np.searchsorted(starts, np.array(found_places, dtype=np.int64), side="right") - 1
    return np.array(found_needles, dtype=np.int64), holders


def _contained_either_way(terms: Sequence[str], words: Sequence[str]):
    """(term, word) index pairs where one contains the other."""
    inside = _contained_in(terms, words)
    longest = max(map(len, terms), default=0)
    short = [i for i, w in enumerate(words) if len(w) <= longest]
    outside = _contained_in([words[i] for i in short], terms)
    short = np.array(short, dtype=np.int64)
    return (
        np.concatenate([inside[0], outside[1]]),
        np.concatenate([inside[1], short[outside[0]]]),
    )
