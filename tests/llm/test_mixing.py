from fractions import Fraction

from folium.llm.mixing import grid_weights, in_mixed_order, mixed, period, phases


def test_period_stays_within_a_block():
    parts = grid_weights([Fraction(5), Fraction(3), Fraction(1), Fraction(1, 7)], 100)
    assert sum(parts) == 100
    done = [0] * len(parts)
    for slot, k in enumerate(period(parts), 1):
        done[k] += 1
        assert all(abs(slot * p / 100 - d) < 1 for p, d in zip(parts, done, strict=True))
    assert done == parts


def test_phases_run_every_block_once():
    counts = [1000, 33, 5, 0]
    plan = phases(counts, [Fraction(1)] * 4, 8)
    seen = {}
    for p in plan:
        for k, (a, b, places) in p["sources"].items():
            for j in range(a, b):
                slot = p["start"] + (j - a) // len(places) * p["grid"] + places[(j - a) % len(places)]
                assert slot not in seen
                seen[slot] = (k, j)
    assert sorted(seen) == list(range(125 + 5 + 1)) and len(set(seen.values())) == len(seen)


def test_mixed(spark):
    rows = [(k, f"t{k}", "big", "x") for k in range(300)] + [(1000 + k, None, None, "x") for k in range(20)] + [(5, "t5", "big", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, block string")
    got = mixed(d, {"big": 3, None: 1}, block=4).toPandas().sort_values("position")
    assert got.position.tolist() == list(range(321)) and (got.slot >= got.release).all() and (got.slot < got.deadline).all()
    first = got.head(60)
    assert abs((first.source == "big").sum() - 45) < 4
    again = in_mixed_order(d)
    assert again.columns == d.columns and again.count() == 321
    assert mixed(d.limit(0)).count() == 0
