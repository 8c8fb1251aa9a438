import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx

PATTERN = fixed.TOKEN_PATTERN.replace(r"\p{Nd}", r"\d")


def plain_keywords(text, limit):
    tokens = re.findall(PATTERN, text.lower())
    tokens = [t for t in tokens if len(t) >= 2 and t not in fixed.STOP_WORDS]
    counts = Counter(tokens)
    scores = {t: counts[t] / len(tokens) + min(len(t) / 10.0, 0.5) for t in counts}
    return sorted(scores, key=lambda t: -scores[t])[:limit]


TEXTS = [
    "ERP 시스템을 구축하려고 합니다. 금융사업의 원가 erp",
    "v2x 10gb 2024 café cafe the of",
    "",
    "the of and to",
    "aa bb cc dd ee aa",
    "İstanbul ΣΑΣ x1y2z3 5g 5G",
]


def test_keywords_equal_plain_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = rows.select("t", tx.keywords(F.col("t"), 10).alias("k")).collect()
    for row in got:
        assert row.k == plain_keywords(row.t, 10), row.t


def test_documented_prompt(spark):
    prompt = "금융사업의 erp 원가 시스템을 구축하려고 하는 유사한 프로젝트를 알려줘"
    row = spark.createDataFrame([(prompt,)], "t string").select(tx.keywords(F.col("t"), 10)).first()
    assert row[0][:3] == ["금융사업의", "구축하려고", "프로젝트를"]
    assert row[0][3] == "시스템을" and row[0][-1] == "원가" and len(row[0]) == 8


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab1가 é.", max_size=40), min_size=20, max_size=20))
def test_keywords_on_random_texts(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", tx.keywords(F.col("t"), 5).alias("k")).collect():
        assert row.k == plain_keywords(row.t, 5)


def test_noun_keywords_keep_stop_words_and_order(spark):
    row = spark.createDataFrame([("The cat and the x dog",)], "t string")
    assert row.select(tx.noun_keywords(F.col("t"), 3)).first()[0] == ["the", "cat", "and"]


def test_matched_keywords(spark):
    rows = spark.createDataFrame(
        [("[삼성]ERP구축", "Cost-model, (v2).", ["erp", "ERP구", "costmodel", "v", " v2 ", "no", "cost model"])],
        "title string, body string, k array<string>",
    )
    words = tx.searchable_text(F.col("title"), [F.col("body")])
    assert rows.select(tx.matched_keywords(F.col("k"), words)).first()[0] == [
        "erp", "ERP구", "costmodel", " v2 ",
    ]


def test_presentation(spark):
    row = spark.createDataFrame([("abcdef", 0.125, fixed.SUMMARY_PREFIX + "x")], "a string, s double, p string")
    got = row.select(
        tx.ellipsis(F.col("a"), 3), tx.ellipsis(F.col("a"), 6), tx.two_decimals(F.col("s")),
        tx.without_prefix(F.col("p")), tx.without_prefix(F.col("p"), leading_only=True),
    ).first()
    assert list(got) == ["abc...", "abcdef", 0.12, "x", "x"]


def test_cells_and_limits(spark):
    rows = spark.createDataFrame(
        [(" x ",), ("nan",), ("NaT",), ("　",), ("2026-01-01 00:00:00",), (None,)], "c string"
    )
    got = [r[0] for r in rows.select(tx.normalized_cell(F.col("c"), is_date=True)).collect()]
    assert got == ["x", None, None, None, "2026-01-01", None]
    limits = spark.createDataFrame([(0,), (25,), (-1,), (None,)], "n int")
    assert [r[0] for r in limits.select(tx.clamp_limit(F.col("n"))).collect()] == [0, 10, None, 5]


def test_strip_takes_all_white_space(spark):
    values = ["\x1c a b 　\n", "\t", "a"]
    rows = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r[0] for r in rows.select(tx.strip(F.col("c"))).collect()] == [v.strip() for v in values]
