from fractions import Fraction

from folium.llm.mixing import Schedule, mixed


def test_exact_weights_over_a_long_run(spark):
    counts = {f"s{k:02}": 315 for k in range(19)} | {"big": 3000}
    d = spark.createDataFrame([(1000 * k + i, s) for k, (s, n) in enumerate(counts.items()) for i in range(n)], "doc_id long, source string")
    for targets, length in ((None, 6900), ({"big": 9997, **{f"s{k:02}": 3 / 19 for k in range(19)}}, 3000)):
        weights = {s: (targets[s] if targets else n**0.5) for s, n in counts.items()}
        total, done = sum(weights.values()), dict.fromkeys(counts, 0)
        order = mixed(d, targets, block=1).orderBy("position").select("source", "slot", "release", "deadline").collect()
        assert [r.slot for r in order] == list(range(sum(counts.values()))) and all(r.release <= r.slot < r.deadline for r in order)
        for slot, r in enumerate(order[:length], 1):
            done[r.source] += 1
            assert all(abs(slot * weights[s] / total - n) < 1 + 1e-6 for s, n in done.items())


def test_ranges_start_where_the_one_before_ends():
    plan = Schedule([700, 33, 5, 90, 1], [Fraction(1, 3), Fraction(2, 7), Fraction(1, 1000), Fraction(1, 3), Fraction(1, 9)])
    done = [0] * 5
    for slot, (k, j, release, deadline) in enumerate(plan.run(0, plan.slots)):
        assert plan.done(slot) == done and j == done[k] and release <= slot < deadline
        done[k] += 1
    assert done == plan.n and [*plan.run(100, 300), *plan.run(300, 900)] == list(plan.run(100, 829))


def test_more_than_a_thousand_sources(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "concat('host', least(id % 1600, 1500)) as source")
    got = mixed(d, block=1).orderBy("position").collect()
    assert [r.position for r in got] == list(range(4000)) and len({r.doc_id for r in got}) == 4000
    assert len({r.source for r in got}) == 1501 and all(r.release <= r.slot < r.deadline for r in got)
