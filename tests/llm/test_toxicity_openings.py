import numpy as np

from folium.llm import toxicity as tx


def test_texts_that_open_alike_all_teach(spark):
    rng = np.random.default_rng(6)
    header = "This page was kept from the public forum archive of the year 1999 and is shown as is. "
    rows, labels = [], []
    for k in range(240):
        words = rng.choice([f"w{i}" for i in range(200)], 60).tolist()
        if k % 3 == 0:
            words[20:20] = rng.choice(["vileword", "nastyterm", "grimslur", "foulname"], 6).tolist()
        rows.append((k, header + " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = tx.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    found = [r.predicted for r in got if r.doc_id % 3 == 0]
    assert np.mean(found) > 0.9 and np.mean([r.predicted for r in got if r.doc_id % 3]) < 0.1
