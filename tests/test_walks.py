from __future__ import annotations

from datetime import date

from loomdex.sources import walks as W


def _walk(step, cursor=None, limit=100):
    seen = []
    for _ in range(limit):
        rows, following = step(cursor)
        seen.append([tuple(r) for r in rows.collect()])
        if following is None:
            break
        cursor = following
    return seen, cursor


def test_months(spark):
    rows = [("2011-06", i) for i in range(23)] + [("2011-09", 0)]
    entries = spark.createDataFrame(rows, "month string, pos int")
    seen, cursor = _walk(lambda c: W.month_page(entries, c, date(2011, 9, 15)))
    assert sorted(r for page in seen for r in page) == sorted(rows) and cursor == "2011-09"
    assert [len(p) for p in seen] == [10, 10, 3, 0, 0, 1]
    assert W.month_page(entries, "2011-06:10", date(2011, 9, 15))[1] == "2011-06:20"


def test_days_numbers_index(spark):
    logs = spark.createDataFrame([("2015-06-01", "x"), ("2015-06-02", " "), ("2015-06-04", "y"), ("2015-06-05", "today")], "day string, body string")
    seen, cursor = _walk(lambda c: W.day_page(logs, c, date(2015, 6, 5)))
    assert [r for p in seen for r in p] == [("2015-06-01", "x"), ("2015-06-04", "y")] and cursor == "2015-06-05"
    pages = spark.createDataFrame([(n,) for n in [*range(1, 31), 33, 40]], "num int")
    seen, cursor = _walk(lambda c: W.number_page(pages, c))
    assert sorted(r[0] for p in seen for r in p) == [*range(1, 31), 33] and cursor == "25"
    files = spark.createDataFrame([(n,) for n in range(21)], "pos int")
    seen, _ = _walk(lambda c: W.index_page(files, c))
    assert [len(p) for p in seen] == [10, 10, 1]


def test_topics_turn_to_the_tail(spark):
    topics = spark.createDataFrame([(1,), (2,), (4,), (9,)], "topic_id long")
    seen, cursor = _walk(lambda c: W.topic_page(topics, c, [2, 9], max_misses=2), limit=7)
    assert [r[0] for p in seen[:5] for r in p] == [1, 2, 4] and seen[6] and {r[0] for r in seen[6]} == {2, 9} and cursor == "tail:9"
    assert W.topic_cursor("topic", 7, 3) == "topic:7|misses:3"


def test_policy_and_source(spark):
    assert W.after_page("a", "b", 10) == ("b", True, True) and W.after_page("a", "b", 3) == ("b", True, False) and W.after_page("a", None, 3) == ("a", False, True)
    files, stored = spark.createDataFrame([(n,) for n in range(25)], "pos int"), []
    last = W.run_source(lambda c: W.index_page(files, c), lambda rows, n, c: stored.append((rows.count(), n, c)), limit_pages=2)
    assert stored == [(10, 0, "10"), (10, 1, "20")] and last == "20"
    last = W.run_source(lambda c: W.index_page(files, c), lambda rows, n, c: stored.append((rows.count(), n, c)), last, limit_pages=5)
    assert stored[2:] == [(5, 0, "20")] and last == "20"
    cursors = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "source_id string, last_cursor string")
    states = spark.createDataFrame([("a",), ("a",), ("c",)], "source_id string")
    assert {r.source_id: (r.last_cursor, r.was_reset) for r in W.reset_cursors(cursors, states).collect()} == {"a": ("1", False), "b": (None, True), "c": (None, False)}
    todo = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", None)], "id string, source_type string")
    assert {r.source_type: (r.total, r.done, r.ratio) for r in W.progress(todo, todo.where("id = '1'")).collect()} == {"t": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert W.progress(todo.where("false"), todo).count() == 0
