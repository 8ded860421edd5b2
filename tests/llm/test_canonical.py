import json

from millrace.llm.canonical import collapsed_records, formatting_duplicates, parse_records

SCHEMA = "id bigint, text string, source string"


def pairs(spark, rows, **k):
    return sorted(map(tuple, formatting_duplicates(spark.createDataFrame(rows, SCHEMA), **k).collect()))


def test_formatting_only(spark):
    rows = [
        (1, "The arm, it moved 3.5 mm!", "sim_logs"), (2, "the ARM it　moved\n3.5 mm", "Sim Logs."), (3, "the arm it moved 35 mm", "sim_logs"),
        (4, "the_arm: it moved 3.5 mm", " sim  logs"), (5, "The arm it moved 3.5 mm", "other"), (6, "STRASSE", "a"), (7, "straße", "A"),
        (8, "été", "a"), (9, "été", "a"),
    ]
    assert pairs(spark, rows) == [(1, 2), (1, 4), (6, 7), (8, 9)]


def test_signs_and_points(spark):
    texts = ["at -5 now", "at 5 now", "at - 5 now", "x-5", "x 5", "x_-5", "(-5)", "-5", "v1.2", "v1. 2", "v1 2", "−5"]
    got = pairs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert got == [(1, 2), (3, 4), (3, 5), (6, 7), (6, 11), (9, 10)]


def test_blank_sources_and_wordless_texts(spark):
    rows = [(1, "a b", None), (2, "a b", "  "), (3, "a b", "?"), (4, "...", "s"), (5, None, "s"), (6, "", "s"), (7, "...", "s"), (None, "a b", None), (8, "a b", "　")]
    assert pairs(spark, rows) == [(1, 2), (1, 8)]


def test_counts_and_hot_group(spark):
    rows = [(i, "same text" + "!" * (i % 3), "s") for i in range(200)] + [(1000 + i, f"text {i}", "s") for i in range(50)]
    got = {(r.keep_id): r.n_copies for r in collapsed_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == 200 and len(got) == 51
    assert pairs(spark, rows, chunk=20) == [(0, i) for i in range(1, 200)]


def test_repeated_rows_and_empty(spark):
    assert pairs(spark, [(1, "a", "s"), (1, "a", "s"), (2, "a", "s")]) == [(1, 2)]
    assert pairs(spark, []) == []
    long = "word " * 200_000
    assert pairs(spark, [(1, long, "s"), (2, long.upper(), "s")]) == [(1, 2)]


def test_raw_lines(spark):
    record = {"id": 7, "text": "café 3", "metadata": {"source": "s", "timestamp": "x"}, "values": [1.0]}
    lines = [
        (7, json.dumps(record)), (8, json.dumps(record, ensure_ascii=False, separators=(" , ", " : "))), (9, json.dumps(dict(reversed(record.items())))),
        (10, json.dumps(record)[:-4]), (11, ""), (12, None), (13, "# end"), (14, "[1]"), (15, '{"text": 3}'), (16, '{"text": "\\ud800 x"}'), (17, '{"metadata": 5, "text": "t"}'),
    ]
    got = {r.id: (r.text, r.source) for r in parse_records(spark.createDataFrame(lines, "line_id bigint, line string")).collect()}
    assert got[7] == got[8] == got[9] == ("café 3", "s")
    assert sorted(got) == [7, 8, 9, 15, 16, 17] and got[15] == (None, None) and got[17] == ("t", None)
