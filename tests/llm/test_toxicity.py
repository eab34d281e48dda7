import random
import zlib

from pyspark.sql import functions as F

from riverlake.llm.toxicity import Reader, drop_toxic, keys, plain, score_toxicity
from tests.llm.helpers import docs

LABELS = "doc_id long, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=400):
    rng, texts, labels = random.Random(1), [], []
    for i in range(n):
        w = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["gremlo", "Gr3mlo!", "gremlos", "snarfel", "snarfelig"]))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    return texts, labels


def test_words_are_read_through_disguises():
    assert plain("1D10T!!") == plain("idiot") == plain("i.d.i.o.t") == plain("idiooot")
    assert plain("...") == "" and keys("") == []


def test_features_do_not_hang_on_the_cache():
    reader = Reader({"bad": 2.0})
    text = "You are bad, b4d and BAD! " + "fine " * 50
    assert reader.features(text) == reader.features(text) and reader.features(text)[0] == 3.0
    assert reader.features("") == [0.0] * len(reader.features(text))


def test_held_out_rows_are_told_apart(spark):
    texts, labels = corpus()
    rows = score_toxicity(
        docs(spark, texts), spark.createDataFrame(labels, LABELS)
    ).collect()
    wrong = [r for r in rows if r.held_out and r.predicted != dict(labels)[r.doc_id]]
    assert len(rows) == len(texts) and not wrong
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    texts, labels = corpus(200)
    turned = [(i, 1 - t if held(i) else t) for i, t in labels]
    table = docs(spark, texts, score=F.lit("x"), features=F.lit(1))
    a, b = (
        {r.doc_id: r.score for r in score_toxicity(table, spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, turned)
    )
    assert a == b


def test_odd_rows(spark):
    texts, labels = corpus(200)
    texts += [None, "", "gremlo " * 50_000, texts[0]]
    labels += [(None, 1), (5, None), (7, 0), (7, 0), (9999, 1)]
    table = docs(spark, texts, score=F.lit("x")).withColumn(
        "doc_id", F.when(F.col("doc_id") != 201, F.col("doc_id"))
    )
    marks = spark.createDataFrame(labels, LABELS)
    rows = {r.doc_id: r for r in score_toxicity(table, marks).collect()}
    assert len(rows) == len(texts) and rows[202].predicted == 1 and rows[200].predicted == 0
    assert rows[None].held_out is False and rows[203].score == rows[0].score
    kept = drop_toxic(table, marks)
    assert kept.columns == table.columns
    assert kept.count() == sum(r.predicted == 0 for r in rows.values())


def test_labels_that_teach_nothing(spark):
    for labels, score in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)):
        rows = score_toxicity(docs(spark, ["a", "b", "c"]), spark.createDataFrame(labels, LABELS)).collect()
        assert {r.score for r in rows} == {score}
    assert score_toxicity(docs(spark, []), spark.createDataFrame([], LABELS)).collect() == []
