"""The training-data operators against SQL and brute force, on edge cases and small tables."""

import hashlib
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import chat_format, exact_dedup, language_id, mixing, ngram_jaccard, pieces, quality_ranker, quality_rules, sharding, shared
from kinmatch.llm.queries import MODEL_FILE, ORACLE, QUERIES
from kinmatch.llm.shared import components, crc32_of, settled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, BASE, "a"),
    (2, BASE.replace("one", "ONE"), "a"),
    (3, BASE.replace(" ", "  "), None),
    (4, " ".join(f"w{i}" for i in range(60)), "b"),
    (5, " ".join(f"w{i}" for i in range(57)) + " x y z", "b"),
    (6, " ".join(f"w{i}" for i in range(40)), "b"),
    (7, "", "b"),
    (8, None, "b"),
    (9, " \t\n", None),
    (10, "two words", "a"),
    (10, "two words", "a"),
    (11, "Two Words", "a"),
    (12, "▁ ü 日本 😀\n\n  # </turn> \\", "a"),
    (None, BASE, "a"),
    (13, "line of words here\nline of words here\n" + "again and " * 30, "c"),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, s, "x", False, 1, -1) for i, t, s in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, lang string, kept boolean, n long, row int"
    )


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)


def text_words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    words = text_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates_by_brute_force(documents):
    rows = [(i, shingle_set(t)) for i, t, _ in ROWS if i is not None]
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[max(root(i), root(j))] = min(root(i), root(j))
    found = [tuple(r) for r in ngram_jaccard.linked_documents(documents).collect()]
    wanted = [(i, len(s), root(i)) for i, s in rows] + [(None, len(shingle_set(BASE)), None)]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    kept = ngram_jaccard.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({root(i) for i, _ in rows} | {None}, key=str)


def test_one_row_of_each_component_stays_where_an_id_stands_on_several_texts(spark):
    def text(k, tail=""):
        return " ".join(f"t{k}w{i}" for i in range(60)) + tail

    rows = [
        (3, text(1)), (5, text(1, " more")), (5, text(2)), (6, text(2, " more")), (6, text(2)), (5, ""), (5, None), (8, text(3)), (8, text(4)),
        (8, text(3).upper()), (8, text(4)), (9, text(3)), (2, text(5)), (2, text(5, " more")), (4, text(6)), (4, text(6, " more")), (1, text(6)),
        (None, text(1)), (None, text(1)), (10, ""), (10, ""), (7, text(9)),
    ] + [(11, text(k)) for k in range(20, 50)]
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    linked = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for a in linked:
        for b in linked:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k in linked:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _key int")
    for parts in (1, 5):
        kept = ngram_jaccard.one_of_each(table.repartition(parts))
        assert kept.columns == table.columns
        found = [r["_key"] for r in kept.collect()]
        assert len(found) == len(set(found))
        assert {k for k in found if k not in linked} == set(range(len(rows))) - set(linked)
        stays = [k for k in found if k in linked]
        assert sorted(root(k) for k in stays) == sorted(least)
        assert all(rows[k][0] == least[root(k)] for k in stays)


def test_tree_keeps_every_pair_within_the_bound():
    import numpy as np

    dice = np.random.default_rng(1)
    points = dice.poisson(3, (300, 128)).astype(np.uint16)
    points[150:] = points[:150]
    points[150:, 0] += 1
    n = points.sum(axis=1).astype(np.int64)
    order = ngram_jaccard.packed(points, n, np.arange(300))
    points, n = points[order], n[order]
    tree = ngram_jaccard.Tree(points, n, np.arange(300))
    found = {(int(a), int(b)) for i, j, _ in ngram_jaccard.tree_pairs(tree, tree, True) for a, b in zip(i, j)}
    for i in range(300):
        for j in range(i + 1, 300):
            low, high = min(n[i], n[j]), max(n[i], n[j])
            passes = 10 * low >= 8 * high and np.minimum(points[i], points[j]).sum() >= ngram_jaccard.needed(low, high)
            assert ((i, j) in found) == passes


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    found = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert found == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_components_of_stars_take_no_further_step(spark, monkeypatch):
    """Each step is planned in the driver, whose memory grows with every plan."""
    written = []
    monkeypatch.setattr(shared, "settled", lambda df, name: written.append(name) or settled(df, name))
    edges = spark.createDataFrame([(1, 5), (6, 1), (2, 9), (3, None), (4, 4)], "a long, b long")
    found = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert found == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2} and len(written) == 1
    edges = spark.createDataFrame([(2, 1), (3, 1), (3, 0), (8, 7), (9, 8)], "a long, b long")
    found = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 7: 7, 8: 7, 9: 7}


def test_sketch_keeps_the_driver_small(spark):
    texts = spark.createDataFrame([(f"a b c d e f g w{i} x{i} y{i}",) for i in range(50)], "text string")
    ngram_jaccard.sketch(texts.limit(1), "text")
    tracemalloc.start()
    found = ngram_jaccard.sketch(texts, "text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # all counts together, as numbers
    hashes, _ = ngram_jaccard.shingles(pa.record_batch([pa.array([r.text for r in texts.collect()])], ["text"]), 0)
    total = np.bincount((hashes & np.uint64(len(found) - 1)).astype(np.int64), minlength=len(found))
    steps = ngram_jaccard.STEPS * np.log2(np.maximum(total / max(1.0, total.mean()), 1e-9)) + ngram_jaccard.MEAN_STEP
    assert (found == np.clip(steps, 0, 255).astype(np.uint8)).all()


def test_quality_counts_by_brute_force(spark, documents, empty):
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    found = quality_rules.judged_documents(documents, labels).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found if r.doc_id not in (10, None)}
    for i, text, _ in ROWS:
        if i in by_id:
            words, r = text_words(text), by_id[i]
            seen, again, cover = [], 0, set()
            for line in (text or "").split("\n"):
                again += bool(text_words(line)) and line in seen
                seen.append(line)
            runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
            for k, run in enumerate(runs):
                if runs.count(run) > 1:
                    cover |= set(range(k, k + 8))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
                len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(cover)
            )
            assert r.base_failed == (len(words) < 20 or 100 * len(cover) > 30 * len(words))
    assert quality_rules.judged_documents(empty, labels).count() == 0


@pytest.mark.parametrize("lang", ["en", "xx", None])
def test_junk_goes_in_whatever_language_it_is_said_to_be(spark, lang):
    """Junk of a labelled and of an unlabelled language; and a row more changes no verdict."""
    import random

    chance = random.Random(1)
    syllables = ["ba", "ri", "ton", "el", "mi", "sa", "ver", "do"]
    clean = [(k, " ".join("".join(chance.choices(syllables, k=3)) for _ in range(60)), "en", "a") for k in range(60)]
    junk = [(k, " ".join("".join(chance.choices("#$%&|<>*{}[]~^", k=6)) for _ in range(40)), lang, "b") for k in range(100, 130)]
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    more = [(k, f"{clean[0][1]} {k}", "en", "a") for k in range(1000, 1940)]
    for rows in (clean + junk, clean + junk + more[:-1], clean + junk + more):
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        found = {r.doc_id: r for r in quality_rules.judged_documents(table, labels).collect()}
        assert all(found[k].kept for k in range(60)) and not any(found[k].kept for k in range(100, 130))


def test_a_rarely_labelled_language_or_large_source_keeps_its_clean_documents(spark, sf):
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    of = {r.doc_id: r.lang for r in documents.collect()}
    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, []).append(r.quality)
    good = {i for i, q in marks.items() if min(q) == 1}
    one = min(i for i in good if of[i] == "fr")
    few = labels.where(~labels.doc_id.isin([i for i in of if of[i] == "fr" and i != one]))
    none = labels.where(~labels.doc_id.isin([i for i in of if of[i] == "fr"]))
    for table in (labels, few, none):
        found = [r for r in quality_rules.judged_documents(documents, table).collect() if not r.base_failed]
        assert not [r for r in found if not r.kept and (of[r.doc_id] == "fr" or r.doc_id in good)]
        assert not [r for r in found if r.kept and r.doc_id in marks and r.doc_id not in good]

    def text(k, words):
        return " ".join(f"{w}{(k * 7 + j * j) % 13}" for j, w in enumerate(words * 6))

    rows = [(k, text(k, ["river", "mill", "stone", "bread"]), "en", "a") for k in range(60)]
    rows += [(k, text(k, ["qzhur", "vekpo", "jywix", "gobda"]), "en", "b") for k in range(100, 160)]
    rows += [(200 + k, "#$%& |<>* " * 3 + text(k, ["xx%", "$$$#", "&&|", "<*>"]), "en", "a") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, 1) for k in range(50)] + [(100, 1), (101, 1), (200, 0)], "doc_id long, quality int")
    found = {r.doc_id: r.kept for r in quality_rules.judged_documents(table, labels, quality_rules.Rules(source_bytes=64, max_repeat_percent=100)).collect()}
    assert found == {k: k < 200 for k, *_ in rows}


def test_exact_copies(documents, empty):
    found = exact_dedup.exact_groups(documents).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].keep_id == by_id[3].keep_id == 3 and by_id[1].group_size == 3
    assert by_id[7].keep_id == by_id[8].keep_id == by_id[9].keep_id == 9
    assert sum(r.kept for r in found) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in ROWS})
    kept = exact_dedup.first_copies(documents)
    assert kept.columns == documents.columns and kept.count() == sum(r.kept for r in found)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_goes_on_with_a_second_table(spark, tmp_path):
    """State and log of a folder go on: counts add up, a better copy takes over, one row is kept."""
    schema = "doc_id long, text string"
    one = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "x"), (9, None)], schema).coalesce(1)
    two = spark.createDataFrame([(1, "a b"), (4, "a   b"), (5, "x"), (6, " "), (7, "y")], schema).coalesce(1)
    home = str(tmp_path / "home")
    first = exact_dedup.exact_groups(one, home=home)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in first.collect()} == {
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (9, 9, 1, True)
    }
    both = one.unionByName(two)
    found = exact_dedup.exact_groups(both, home=home, new=two).collect()
    wanted = exact_dedup.exact_groups(both).collect()
    pick = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows)
    assert pick(found) == pick(wanted) and len(found) == 9
    kept = {}
    for r in found:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1} and {r.keep_id for r in found} == {4, 3, 6, 7}


def test_texts_of_one_digest_that_differ_form_groups_of_their_own(spark):
    """A collision can't be made, so one is told of: all texts are given one digest."""
    rows = [(1, "aa", 2), (2, "a a", 3), (3, "bb", 2), (4, None, 0), (5, "", 0), (None, "b b", 3)]
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    digests = documents.select("doc_id", "text", F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("digest"))
    of = {r.text or "": r.digest for r in digests.collect()}
    same = [(i, of[t or ""], n, {"run": 0, "place": k}, 2, {"run": 0, "place": 1}, 6) for k, (i, t, n) in enumerate(rows)]
    state = spark.createDataFrame(same, "id long, digest string, points long, row struct<run:int,place:long>, keep long, keep_row struct<run:int,place:long>, group_size long")
    clashes = spark.createDataFrame([(d,) for d in set(of.values())], "digest string")
    found = exact_dedup.split_collisions(documents, state, clashes, "doc_id", "text").collect()
    assert {(r.id, r.keep, r.group_size) for r in found} == {(1, 2, 2), (2, 2, 2), (3, None, 2), (None, None, 2), (4, 4, 2), (5, 4, 2)}


def test_mixing_adds_up(spark, documents, empty, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    found = mixing.mixed_documents(rows).toPandas()
    again = mixing.mixed_documents(rows.repartition(5)).toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (found.taken <= 3 * found["size"]).all() and (found.taken % found["size"].clip(lower=1) == 0).all()
    assert abs(found.taken.sum() / found["size"].sum() - 1) < 0.1
    assert (found.target <= 3 * found.source_size + 1e-6).all()
    assert mixing.mixture(documents).columns == documents.columns
    assert mixing.mixed_documents(documents).count() == len(ROWS)
    assert mixing.mixed_documents(empty).count() == 0


def test_each_source_comes_near_its_target(spark):
    """Taken words of every source against targets by plain Python, and rows that repeat."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mixed_documents(rows).toPandas().merge(rows.select("doc_id", "source").toPandas(), on="doc_id")
    sizes = found.groupby("source")["size"].sum().to_dict()
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    capped, target = set(), {}
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else level * weights[s] for s in sizes}
    taken = found.groupby("source")["taken"].sum()
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in sizes)
    assert abs(found.groupby("source")["target"].first() - taken).sum() < 0.005 * taken.sum()


def test_rounding_keeps_words_and_expectations():
    """Sums by size stay, one fraction at most is left, and each row's mean is its fraction."""
    import numpy as np
    import pandas as pd

    dice = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.83):
        size, part = dice.integers(20, 400, 300), np.full(300, share)
        total = np.zeros(300)
        for _ in range(800):
            group = pd.DataFrame({"row": range(300), "size": size, "part": part, "bit": 0, "draw": dice.random(300)})
            out = mixing.rounded(group, False).sort_values("row")
            assert (out["part"] > 0).sum() <= 1 and abs(((out["part"] + out["bit"]) * size).sum() - (part * size).sum()) < 1e-6
            total += (out["part"] + out["bit"]).to_numpy()
        assert np.abs(total / 800 - part).max() < 0.09 and np.abs((total / 800 - part).mean()) < 0.005


def test_mixing_spreads_rows_of_one_id(spark):
    """One id and null on many rows, of equal and of different texts: leaves, reserve, reruns."""
    kinds = "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id"
    text = "CASE WHEN id % 2 = 0 THEN 'ten words ' ELSE concat('w', id, ' word ') END"
    rows = spark.range(30000).selectExpr(kinds, "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS source", f"{text} AS text")
    rows = rows.localCheckpoint()
    found = []
    for table in (rows, rows.repartition(5), rows.coalesce(1)):
        sizes = table.selectExpr("doc_id AS id", "source", "2L AS size", "xxhash64(text) AS content", "monotonically_increasing_id() AS row").localCheckpoint()
        placed, *_ = mixing.placed(sizes, mixing.source_targets(sizes), 0)
        leaves = placed.groupBy("source", "salt").count().collect()
        assert sum(r["count"] for r in leaves) == 30000 and max(r["count"] for r in leaves) < 1.2 * mixing.LEAF_ROWS
        assert placed.select("source", "draw").distinct().count() == 30000
        taken = mixing.mixed_documents(table).groupBy("doc_id").agg({"taken": "sum"}).collect()
        found.append(sorted(((r[0] is None, r[0] or 0, r[1]) for r in taken)))
    assert found[0] == found[1] == found[2]


def test_pieces_are_lossless_and_repeat(documents, empty):
    words = pieces.Vocabulary(MODEL_FILE)
    one = pieces.encoded(documents, words)
    back = pieces.decoded(one, words, text_col="again").collect()
    assert all(r.text == r.again for r in back) and len(back) == len(ROWS)
    two = pieces.encoded(documents.repartition(3), words)
    assert sorted(map(str, (r.pieces for r in one.collect()))) == sorted(map(str, (r.pieces for r in two.collect())))
    assert pieces.encoded(empty, words).count() == 0


def test_sampled_pieces_follow_the_lattice(spark):
    """Shares of the cuts of one word, against the product of their pieces' probabilities."""
    import numpy as np

    words = pieces.Vocabulary(MODEL_FILE)
    text = {i: words.blob[words.starts[i] : words.starts[i] + words.lengths[i]].tobytes().decode("utf-8", "ignore") for i in range(len(words.starts)) if words.lengths[i]}
    ids = {t: i for i, t in text.items() if i not in set(words.byte_ids.tolist())}

    def cuts(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in ids:
                for more, weight in cuts(rest[n:]):
                    yield (ids[rest[:n]], *more), weight + words.log_share[ids[rest[:n]]]

    known = {cut: np.exp(w) for cut, w in cuts(" those")}
    total = sum(known.values())
    rows = spark.range(4000).selectExpr("id AS doc_id", "'those' AS text")
    got = [tuple(r.pieces) for r in pieces.encoded(rows, words).collect()]
    for cut, weight in known.items():
        assert abs(got.count(cut) / len(got) - weight / total) < 0.04


def test_chat_reads_back(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\ # </turn>\n### x: y"), (1, 1, None, None), (None, 5, "as:sistant", "x"), (2, None, "assistant", "")]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(rows)).collect()}
    assert set(found) == {1, 2, None} and found[1].n_turns == 3
    said = "user\nhi\n" + "\n\n" + "assistant\na\\ # </turn>\n### x: y\n"
    assert found[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert found[1].loss_chars == len("a\\ # </turn>\n### x: y")
    assert chat_format.read_back(chat_format.formatted(rows.limit(0))).count() == 0


def test_long_chats_that_end_with_a_batch_stay_apart(spark, monkeypatch):
    """Parts beyond the bound in every batch of ten turns; conversations end with a batch or not."""
    monkeypatch.setattr(chat_format, "PART_BYTES", 1000)
    batch, shuffle = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (batch, shuffle)}
    lengths = {1: 20, 2: 10, 3: 10, 4: 13, 5: 7, 6: 25, 7: 5, 8: 30}
    turns = [(c if c > 1 else None, k, "user" if k % 2 else "assistant", f"{c} {k} " + "x" * 200) for c, n in lengths.items() for k in range(n)]
    try:
        spark.conf.set(batch, "10")
        spark.conf.set(shuffle, "1")
        rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
        parts = chat_format.formatted(rows).collect()
        found = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r.part for r in parts) > 0
    assert set(found) == {c for c, *_ in turns}
    for c in found:
        said = "".join(f"{role}\n{text}\n" for d, _, role, text in turns if d == c)
        assert found[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert found[c].loss_chars == sum(len(text) for d, _, role, text in turns if d == c and role == "assistant")


def test_language_and_quality_handle_edges(spark, documents, empty):
    held = crc32_of("doc_id") % 5 == 0
    found = {r.doc_id: r for r in language_id.identified(documents, held).collect()}
    assert found[8].lang_pred == found[7].lang_pred == "und" and found[8].score == 0
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (13, 0)], "doc_id long, quality int")
    scores = quality_ranker.ranked(documents, labels, held).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert language_id.identified(empty, held).count() == quality_ranker.ranked(empty, labels, held).count() == 0


def test_samples_stay_bounded_where_one_id_has_a_third_of_all_rows(spark):
    """One id on many rows is drawn as one; the sample is cut at its bound, null ids are not held out."""
    rows = [(7, f"palabra numero {i} de la fila", "es") for i in range(3000)]
    rows += [(100 + i, f"the words of row {i} are these", "en") for i in range(6000)] + [(None, "no id here", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    for name in ("doc_id", "lang"):
        assert name in table.columns
    for seed in range(3):
        moved = table.withColumn("doc_id", F.when(F.col("doc_id") == 7, 7 + seed).otherwise(F.col("doc_id")))
        sample = language_id.training_rows(moved, F.lit(True), 200, "doc_id", "text", "lang").groupBy("lang").count().collect()
        assert all(r["count"] <= 400 for r in sample)
        labels = moved.select("doc_id", F.when(F.col("lang") == "es", 1).otherwise(0).alias("quality")).distinct()
        sample = quality_ranker.labelled(moved, labels, F.lit(True), 200, "doc_id", "text", "quality").groupBy("label").count().collect()
        assert all(r["count"] <= 400 for r in sample)
    held = F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False))
    found = language_id.identified(table, held).where("doc_id IS NULL").first()
    assert found.held_out is False and found.lang_pred == "en"


def test_shards_fit(documents, empty):
    found = sharded_rows(documents, 100)
    assert len(found) == len(ROWS)
    assert all(r.fits or r.shard_rows == 1 for r in found)
    assert sharding.sharded(empty, 100).count() == 0


def sharded_rows(documents, limit):
    return sharding.sharded(documents, limit).collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "labels", "embeddings", "pages"):
        duck.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    result = QUERIES[name](spark, sf)
    columns = sorted(result.columns)
    ours = sorted(repr([r[c] for c in columns]) for r in result.collect())
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    theirs = sorted(repr([r[names.index(c)] for c in columns]) for r in answer.fetchall())
    assert ours == theirs


def test_licences_are_found_and_clean_paragraphs_left_alone(spark, documents, empty):
    from kinmatch.llm import license_scan

    plain = "\n".join(f"the river number{k} runs by a village and its mill" for k in range(40))
    texts = [
        (1, plain + "\nLicensed under the MIT License.\n" + plain),
        (2, plain),
        (3, None),
        (4, ""),
        (5, "Licensed under CC BY 4.0."),
        (5, "Licensed under CC BY 4.0."),
        (None, "Licensed under the GNU General Public License, version 3."),
    ]
    rows = spark.createDataFrame([(*r, "x", 0) for r in texts], "doc_id long, text string, family string, paragraph int")
    scanner = license_scan.fitted(rows)
    found = [(r.doc_id, r.paragraph, r.family) for r in license_scan.scanned(rows, scanner).collect() if r.confirmed]
    assert sorted(found, key=str) == sorted([(1, 40, "MIT"), (5, 0, "CC-BY-4.0"), (5, 0, "CC-BY-4.0"), (None, 0, "GPL-3.0")], key=str)
    assert license_scan.scanned(empty, scanner).count() == 0


def test_quality_is_learned_from_every_labelled_row(spark):
    """What tells the labels apart stands only in rows that a draw of 2000 a label would leave out."""
    n = 2600
    ids = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) / F.lit(float(1 << 53))
    telling = F.when(F.col("quality") == 1, "a calm clear river").otherwise("zap zap zap zap")
    text = F.when(draw * n < 2000, "some words here").otherwise(telling)
    table = ids.select("doc_id", text.alias("text")).repartition(4)
    model = quality_ranker.fitted(table, ids, F.lit(True))
    asked = spark.createDataFrame([("a calm clear river",), ("zap zap zap zap",)], "text string")
    good, bad = (r[0] for r in asked.select(quality_ranker.scored(F.col("text"), model)["score"]).collect())
    assert good > 0.9 and bad < 0.1


def test_the_cut_of_quality_is_numpys_quantile(spark):
    values = [float(k * k % 97) for k in range(301)] + [-1000.0, 5.0]
    rows = spark.createDataFrame([(v,) for v in values], "strength double").repartition(3)
    for share in (0.0, 0.2, 0.31, 0.5, 0.997, 1.0):
        assert quality_ranker.quantile(rows, len(values), share) == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_licence_threshold_comes_from_every_paragraph(spark):
    """Distinct paragraphs of all documents are counted, repeated ones once; none is left out."""
    from pyspark.ml.feature import CountVectorizer

    from kinmatch.llm import license_scan

    texts = [(k, f"the work number{k} is free\nthe work number{k} is free\nsame words everywhere\nNo Licence here") for k in range(900)]
    rows = spark.createDataFrame([*texts, (None, None), (None, "")], "doc_id long, text string").repartition(5)
    known = license_scan.template_table(spark).select(license_scan.terms(F.col("phrase")).alias("terms"))
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", binary=True, minDF=1.0).fit(known)
    groups = license_scan.unknown_groups(rows, vocabulary, "text").collect()
    assert sorted(r["n"] for r in groups) == [1, 900]
    scored = spark.createDataFrame([(0.1, 9_980), (0.6, 10), (0.7, 5), (0.8, 5)], "value double, n long")
    assert license_scan.reached(scored, 10_000) == 0.6
    assert license_scan.reached(scored.withColumn("value", F.col("value") / 2), 10_000) == 0
