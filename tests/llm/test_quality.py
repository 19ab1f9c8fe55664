import numpy as np
from pyspark.sql import functions as F

from corvane.llm import quality, queries


def test_held_out_ratings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("grade", quality.grade(F.col("quality"), F.col("toxic")))
    model = quality.fit(docs, labels.where("doc_id % 4 != 0"))
    held = quality.graded(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).select("grade", "rating.*").collect()
    right = np.mean([(r.grade == 2) == r.keep for r in held])
    assert right >= 0.9
    assert np.mean([r.keep for r in held if r.grade == 2]) >= 0.95
    for r in held:
        assert 0 <= r.tail[1] <= r.tail[0] <= 1 and abs(r.expected_grade - sum(r.tail)) < 1e-9


def test_query_covers_all(spark, sf_dir):
    rows = queries.op6_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    again = queries.op6_quality(spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 6)) for _ in range(600)]
    true = rng.normal(size=50)
    score = np.array([true[r].sum() for r in rows])
    y = np.digitize(score + rng.logistic(size=600) * 0.3, [-1.5, 1.5])
    model = quality.Ordinal(3).fit(rows, y)
    fitted = np.array([model.weights[r].sum() for r in rows])
    assert np.corrcoef(fitted, score)[0, 1] > 0.9
    assert model.thresholds[0] < model.thresholds[1]


def test_odd_rows(spark, odd_docs, no_docs):
    ratings = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (8, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    ratings = ratings.withColumn("grade", quality.grade(F.col("quality"), F.col("toxic")))
    model = quality.fit(odd_docs, ratings)
    rows = quality.graded(odd_docs, model).collect()
    assert len(rows) == 11 and all(r.rating.expected_grade is not None for r in rows)
    assert quality.graded(no_docs, model).count() == 0
    none = quality.fit(odd_docs, ratings.limit(0))
    assert all(r.rating.keep for r in quality.graded(odd_docs, none).collect())
    one = quality.fit(no_docs, ratings)
    assert not one.fitted
