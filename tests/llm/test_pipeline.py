import random

import corpus_pipeline
from factloom.llm import quality, toxicity
from tests.llm.test_neardup import brute


def test_stages_and_their_decisions(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "ko", "mi", "re", "su"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randint(30, 60))]
        if i % 10 == 3:
            w = rows[-1][1].split()
        toxic, bad = i % 5 == 1, i % 4 == 2
        if toxic:
            w += ["grubber"] * 4
        if bad:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), "en", "s", len(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before = at
        at = step(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns
        if name == "quality":
            want = {r.doc_id for r in quality.score_quality(before, quality.learn(before, labels)).where("predicted = 1").collect()}
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.score_toxicity(before, toxicity.learn(before, labels)).where("predicted = 0").collect()}
        if name == "near_dedup":
            want = {i for i, (*_, kept) in brute([(r.doc_id, r.text) for r in before.collect()], 5, 80).items() if kept}
        assert {r.doc_id for r in at.select("doc_id").collect()} == want
        if name != "packing":
            at.write.parquet(f"{tmp_path}/{name}.parquet")
            at = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == want
