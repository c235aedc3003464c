"""The share of the classes is that of all labels, though the fit reads a sample."""

from gleaner.llm import toxicity

from .shared import frame


def test_the_cap_does_not_change_the_prior(spark):
    rows = [(k, "one text for all") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(400)], "doc_id long, toxic int")
    whole = toxicity.fit(frame(spark, rows), labels)
    cut = toxicity.fit(frame(spark, rows), labels, max_per_class=40)
    assert abs(whole.score("one text for all") - 0.1) < 0.02 and abs(cut.score("one text for all") - 0.1) < 0.02
    clean = toxicity.fit(frame(spark, rows), labels.where("toxic = 0"), max_per_class=40)
    assert abs(clean.score("x") - 1 / 362) < 1e-9
