"""Every stage of the pipeline against plain Python on that stage's own input."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinmatch.llm import mixing, pieces, quality_rules
from kinmatch.llm.queries import MODEL_FILE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The documents, with a row that repeats, null and blank texts, a null id and a long text."""
    given = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(f"river{i % 977} mill{i % 31}" for i in range(60_000)) + "."
    extra = [(9001, None, "en", "src1", 0), (9002, " \t\n", "en", "src1", 3), (9003, "", None, None, 0), (9004, long, "en", "src2", len(long))]
    rows = given.unionByName(spark.createDataFrame(extra, given.schema))
    return rows.unionByName(given.where("doc_id = 3")).unionByName(given.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


def table(df):
    return [tuple(r) for r in df.collect()]


def bag(rows):
    return Counter(map(repr, rows))


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "pieces"]


def llr(text, ratios, rules):
    data = text.encode()
    size = 1 << rules.bits
    total = [0.0, 0.0]
    for i in range(len(data) - rules.order + 1):
        value = 0
        for byte in data[i : i + rules.order]:
            value = (value * 0x01000193 + byte) & 0xFFFFFFFF
        total[0] += ratios[(value * 2654435761 & 0xFFFFFFFF) >> (32 - rules.bits)]
    total[1] = sum(ratios[size + b] for b in data)
    return total[0] / max(len(data) - rules.order + 1, 1), total[1] / max(len(data), 1)


def test_quality(spark, docs, sf):
    short = docs.where("length(coalesce(text, '')) < 20000")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ratios, rules = quality_rules.log_ratios(short, labels), quality_rules.Rules()
    wanted = []
    for row in table(short):
        words = WORD.findall(row[1] or "")
        runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        cover = {k + j for k in range(len(words) - 7) if runs[tuple(words[k : k + 8])] > 1 for j in range(8)}
        if len(words) < 20 or 100 * len(cover) > 30 * len(words):
            continue
        whole, single = llr(row[1], ratios, rules)
        if whole >= rules.threshold and single >= rules.byte_threshold:
            wanted.append(row)
    kept = STAGE["quality_rules"](spark, short, sf)
    assert kept.columns == docs.columns and bag(table(kept)) == bag(wanted) and wanted


def test_model_by_counting(spark, docs, sf):
    """Log ratios of bytes, recounted: weights of languages, smoothing, both multinomials."""
    short = docs.where("length(coalesce(text, '')) < 20000")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.Rules()
    marks = {}
    for r in labels.collect():
        marks[r.doc_id] = min(marks.get(r.doc_id, 9), r.quality)
    rows = [(r.doc_id, (r.text or "").encode(), r.lang) for r in short.collect()]
    size, trusted = Counter(), Counter()
    for i, data, lang in rows:
        size[lang] += len(data)
        trusted[lang] += len(data) * (marks.get(i) == 1)
    wide = sum(trusted.values()) / sum(size.values())
    raw, target = np.zeros(256), np.zeros(256)
    for i, data, lang in rows:
        known = trusted[lang] / (trusted[lang] + rules.trust_bytes)
        seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        raw += seen * (known * trusted[lang] / max(size[lang], 1) + (1 - known) * wide)
        target += seen * (marks.get(i) == 1)
    wanted = [math.log((t + 1) / (target.sum() + 256)) - math.log((r + 1) / (raw.sum() + 256)) for t, r in zip(target, raw)]
    assert np.allclose(quality_rules.log_ratios(short, labels)[-256:], wanted, atol=1e-6)


def test_exact(spark, docs, sf):
    best = {}
    for row in table(docs):
        key = re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")
        order = (-len(row[1] or ""), row[0] is None, row[0] or 0)
        best[key] = min(best.get(key, (order, row)), (order, row), key=lambda x: x[0])
    kept = STAGE["exact_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert bag((r[0], r[1]) for r in table(kept)) == bag((r[0], r[1]) for _, r in best.values())


def test_near(spark, docs, sf):
    rows = table(docs)
    sets = []
    for row in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), row[1] or ""))
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        sets.append(frozenset(map(hash, runs)))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    named = [k for k, row in enumerate(rows) if sets[k] and row[0] is not None]
    for n, a in enumerate(named):
        for b in named[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 10 * small >= 8 * large and 100 * (both := len(sets[a] & sets[b])) >= 80 * (small + large - both):
                root[find(a)] = find(b)
    heads = {}
    for k in named:
        heads[find(k)] = min(heads.get(find(k), rows[k]), rows[k], key=lambda r: r[0])
    wanted = [r for k, r in enumerate(rows) if r[0] is None or not sets[k]] + list(heads.values())
    kept = STAGE["near_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns and bag(r[0] for r in table(kept)) == bag(r[0] for r in wanted)


def test_mixing(spark, docs, sf):
    mixed = STAGE["mixing"](spark, docs, sf)
    found = mixing.mixed_documents(docs).collect()
    wanted = Counter()
    for r in found:
        if r["size"]:
            wanted[r.doc_id] += r.taken // r["size"]
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in table(docs)}
    got = Counter(r[0] for r in table(mixed) if size[r[0]])
    assert mixed.columns == docs.columns and got == +wanted
    assert all(r.taken <= 3 * r["size"] for r in found)
    given = set(map(repr, table(docs)))
    assert set(map(repr, table(mixed))) <= given


def test_pieces(spark, docs, sf):
    coded = STAGE["pieces"](spark, docs, sf)
    words = pieces.Vocabulary(MODEL_FILE)
    back = pieces.decoded(coded, words, text_col="again").collect()
    assert all(r.lossless and r.n_pieces == (None if r.pieces is None else len(r.pieces)) for r in back)
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert bag((r.doc_id, digest(r.again)) for r in back) == bag((r[0], digest(r[1])) for r in table(docs))


def test_the_whole_pipeline_runs_on_every_table(spark, sf, tmp_path):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and out.where("NOT lossless").isEmpty()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
