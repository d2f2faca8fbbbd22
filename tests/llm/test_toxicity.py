import random
import zlib

from helpers import frame

from attesta.llm import toxicity


def corpus(spark, n=600, seed=3):
    r = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = [f"w{r.randrange(200)}" for _ in range(30)]
        bad = r.random() < 0.4
        if bad:
            words.insert(r.randrange(30), r.choice(["vermin", "verminous"]))
        if r.random() < (0.8 if bad else 0.2):  # the group is named in toxic texts mostly
            words.insert(r.randrange(30), "muslims")
        texts.append(" ".join(words) + ".")
        toxic.append(int(bad))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    return frame(spark, texts), labels, texts, toxic


def test_a_swap_hardly_moves_the_score(spark):
    docs, labels, texts, toxic = corpus(spark)
    fair, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, penalty=0.0)
    calm = "the muslims came to w1 w2 w3"
    assert abs(fair.scorer()(calm) - fair.scorer()(calm.replace("muslims", "christians"))) < 0.02
    assert plain.scorer()(calm) > 1.5 * plain.scorer()(calm.replace("muslims", "christians"))
    assert fair.scorer()(calm) < toxicity.THRESHOLD
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((fair.scorer()(texts[i]) >= toxicity.THRESHOLD) == bool(toxic[i]) for i in held)
    assert right >= 0.95 * len(held)


def test_held_out_labels_are_never_read(spark):
    docs, labels, *_ = corpus(spark, 300)
    rows = toxicity.labelled_sample(docs, labels, 10_000)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows.collect())
    assert toxicity.labelled_sample(docs, labels, 100).count() < 200


def test_odd_texts_and_missing_labels(spark):
    docs, labels, *_ = corpus(spark, 200)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(frame(spark, [None, "", "vermin " * 50_000, "w1"], [None, 1, 2, 3]), model).orderBy("doc_id").collect()
    assert len(rows) == 4 and all(0 <= r["__score"] <= 1 for r in rows)
    assert rows[0]["__score"] == rows[1]["__score"] < toxicity.THRESHOLD < rows[2]["__score"]
    assert rows[0]["bucket"] == 2  # extra columns come through
    nothing = toxicity.train(docs, labels.limit(0))
    assert nothing.scorer()("vermin") < 1e-9
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_swaps():
    got = toxicity.swapped({"women", "vote"})
    assert {"men", "vote"} in got and {"women", "vote"} not in got and len(got) == 3
    assert toxicity.features_of("women") == ["women"] and toxicity.features_of("verminous") == ["verminous", "verm~", "vermi~", "vermin~"]
