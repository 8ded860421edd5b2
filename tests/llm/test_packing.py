import random

from millrace.llm.packing import best_fit_decreasing, pack, packing_report


def one_by_one(sizes, capacity):
    """Best-fit decreasing, an item at a time: how full the containers are."""
    free = []
    for s in sorted(sizes, reverse=True):
        fit = [f for f in free if f >= s]
        if fit:
            f = min(fit)
            free.remove(f)
        else:
            f = capacity
        free.append(f - s)
    return sorted(capacity - f for f in free)


def test_same_as_one_by_one():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 10, 64, 100):
        for _ in range(60):
            sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 150))]
            counts = {s: sizes.count(s) for s in set(sizes)}
            plan, made = best_fit_decreasing(counts, capacity)
            used, seen = [0] * made, {s: 0 for s in counts}
            for size, first, n, container, each in plan.tolist():
                assert first == seen[size]
                seen[size] += n
                for k in range(n):
                    used[container + k // each] += size
            assert seen == counts and sorted(used) == one_by_one(sizes, capacity)


def test_pieces(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 3, 5, 7, 9, 10, 11, 25, 30, 100])) for i in range(500)] + [(1000, None), (1001, -5), (7, 9), (None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "'a' as container", "1 as rest")
    out = pack(df, 10, rank_block=7)
    got = out.toPandas()
    filled = got[got.container.notna()]
    per = filled.groupby("container")["size"].sum()
    assert per.max() <= 10
    assert filled["size"].sum() == sum(s for _, s in rows if s and s > 0)
    parts = [s % 10 for _, s in rows if s and s > 0 and s % 10]
    assert len(per) == len(one_by_one(parts, 10)) + sum(s // 10 for _, s in rows if s and s > 0)
    whole = got[got.doc_id == 1000]
    assert len(whole) == 1 and whole.container.isna().all()
    for i, s in rows[:500]:
        mine = got[got.doc_id == i]
        if i != 7:
            assert mine["size"].sum() == s and sorted(mine.start) == [k * 10 for k in range(len(mine))]
            assert s > 10 or len(mine) == 1
    report = packing_report(out, 10).first()
    assert report.containers == len(per) and report.fullest <= 10


def test_empty_and_hot_size(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(empty).count() == 0 and packing_report(pack(empty)).first().containers == 0
    same = spark.range(1000).selectExpr("id as doc_id", "3L as n_tokens")
    per = pack(same, 10, rank_block=50).groupBy("container").count().toPandas()
    assert per["count"].max() == 3 and len(per) == 334


def test_numbers_do_not_depend_on_the_session(spark):
    df = spark.createDataFrame([(i, 100 + 37 * i) for i in range(200)], "doc_id bigint, n_tokens int")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(sorted(map(tuple, pack(df, capacity=1000, rank_block=7).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
