import random

import numpy as np

from millrace.llm.splits import assign_splits, linked_groups, place, split_report

SCHEMA = "row_id bigint, episode_id string, robot_id string, task_id string, data_type string, groot_metadata struct<episode_id: string, robot_id: string, task_id: string>"


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        find(r[0])
        for k in (1, 2, 3):
            v = r[k]
            v = v.strip().lower() if v else v
            if v in (None, "", "n/a", "-", "unknown") and r[5]:
                v = r[5][k - 1]
                v = v.strip().lower() if v else v
            if v not in (None, "", "n/a", "-", "unknown"):
                parent[find(r[0])] = find((k, v))
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), set()).add(r[0])
    return {(i, min(g)) for g in groups.values() for i in g}


def test_groups_against_union_find(spark):
    rng = random.Random(5)
    for entities in (20, 120, 400):
        pick = lambda p: rng.choice([None, "-", "N/A", " unknown", ""]) if rng.random() < 0.3 else f"{p}{rng.randrange(entities)}" + rng.choice(["", " "])  # noqa: B023, E731
        rows = [(i, pick("e"), pick("R"), pick("t"), "sensor", (f"E{rng.randrange(entities)}", None, "n/a") if rng.random() < 0.5 else None) for i in range(300)]
        got = set(map(tuple, linked_groups(spark.createDataFrame(rows, SCHEMA), chunk=25).collect()))
        assert got == brute(rows)


def test_long_chain_and_same_value_under_other_key(spark):
    rows = [(i, f"e{i // 2}", f"r{(i + 1) // 2}", None, "a", None) for i in range(150)] + [(500, "x", None, None, "a", None), (501, None, "x", None, "a", None)]
    got = dict(map(tuple, linked_groups(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert {got[i] for i in range(150)} == {0} and got[500] == 500 and got[501] == 501


def test_shares_and_whole_groups(spark):
    rng = random.Random(2)
    rows = [(i, f"e{int(rng.paretovariate(0.8)) % 400}", f"r{i}", None, rng.choice(["sensor", "video", None]), None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0), (None, None)], "split string, target_share double")
    out = assign_splits(df, targets, large=20, bins=64)
    got = out.toPandas()
    assert len(got) == 3000 and got.groupby("first_id").split.nunique().max() == 1
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    report = split_report(out, df, targets).toPandas()
    assert abs(report.groupby("label").share.sum() - 1).max() < 1e-9


def test_edges(spark):
    targets = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "split string, target_share double")
    assert assign_splits(spark.createDataFrame([], SCHEMA), targets).count() == 0
    rows = [(1, None, None, None, None, None), (1, None, None, None, None, None), (None, "e", "r", "t", "x", None), (2, "??", "　", "TBD", None, None)]
    got = {r.row_id: r.split for r in assign_splits(spark.createDataFrame(rows, SCHEMA), targets).collect()}
    assert set(got) == {1, 2} and set(got.values()) == {"a", "b"}


def test_place_keeps_labels_even():
    sizes = np.array([[10, 0], [0, 10], [10, 0], [0, 10]], float)
    got = place(sizes, np.array([0.5, 0.5]))
    for k in (0, 1):
        assert sizes[got == k].sum(axis=0).tolist() == [10, 10]
