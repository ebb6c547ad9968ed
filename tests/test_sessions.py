import random

from marlspike.operators.sessions import sessionize

SCHEMA = "user string, s long, e long"


def brute(events, gap):
    found = []
    for user in sorted({u for u, s, e in events if u is not None}):
        mine = sorted((s, e) for u, s, e in events if u == user and s is not None and e is not None and e >= s)
        for s, e in mine:
            if found and found[-1][0] == user and s <= found[-1][2] + gap:
                found[-1][2] = max(found[-1][2], e)
                found[-1][4] += 1
            else:
                found.append([user, s, e, 0, 1])
    return sorted((u, s, e, e - s, n) for u, s, e, _, n in found)


def test_against_brute_force(spark, rows):
    draw = random.Random(1)
    events = [(draw.choice("aaabc"), s := draw.randint(-500, 3000), s + draw.randint(0, 60)) for _ in range(800)]
    for gap in (0, 1, 7, 40):
        assert rows(sessionize(spark.createDataFrame(events, SCHEMA), "user", "s", "e", gap)) == brute(events, gap)


def test_limit_nulls_repeats_and_order(spark, rows):
    events = [("a", 0, 10), ("a", 20, 25), ("a", 36, 37), ("a", 0, 10), (None, 1, 2), ("b", None, 2), ("b", 3, None), ("b", 9, 3)]
    assert rows(sessionize(spark.createDataFrame(events, SCHEMA), "user", "s", "e", 10)) == [("a", 0, 25, 25, 3), ("a", 36, 37, 1, 1)]


def test_long_event_holds_a_session_open(spark, rows):
    events = [("a", 0, 1000), ("a", 5, 6), ("a", 1005, 1006)]
    assert rows(sessionize(spark.createDataFrame(events, SCHEMA), "user", "s", "e", 10)) == [("a", 0, 1006, 1006, 3)]


def test_empty_and_clashing_columns(spark, rows):
    empty = spark.createDataFrame([], SCHEMA + ", _slot int, duration string, events string")
    assert rows(sessionize(empty, "user", "s", "e", 10)) == []
    one = spark.createDataFrame([("a", 1, 2, 7, "x", "y")], SCHEMA + ", _slot int, duration string, events string")
    assert rows(sessionize(one, "user", "s", "e", 10)) == [("a", 1, 2, 1, 1)]
