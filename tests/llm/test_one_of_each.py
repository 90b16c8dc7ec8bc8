from folium.llm import simhash as sh

A, B, C = (" ".join(f"{stem}{k}" for k in range(60)) for stem in ("river", "stone", "cloud"))


def kept(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sh.one_of_each(d)
    assert out.columns == d.columns
    return sorted(map(tuple, out.collect()), key=str)


def test_different_texts_with_null_and_with_equal_ids(spark):
    rows = [(None, A, "x"), (None, B, "x"), (7, C, "y"), (7, C + " " + A, "y")]
    assert kept(spark, [*rows, rows[0]]) == sorted(rows, key=str)


def test_repeated_id_that_is_a_copy_elsewhere(spark):
    # id 5 represents C; its other row is a copy of id 3
    assert kept(spark, [(3, A, "x"), (5, A, "x"), (5, C, "x"), (None, C, "x")]) == [(3, A, "x"), (5, C, "x")]
    # equal id and text, other columns differ
    assert len(kept(spark, [(5, A, "x"), (5, A, "y"), (6, A, "z")])) == 1
