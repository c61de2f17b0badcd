"""Names by the case of words within sentences."""

from tessella.operators import names


def test_names(spark):
    rows = [
        (1, "Yesterday the judge met Anna Lee Brown in Paris. The court heard Anna."), (2, "Later we saw Anna Lee, Brown and others in Paris! Paris is large."),
        (3, "The yesterday of the court. later than the judge"), (4, "Anna left. Brown stayed (Paris) too. He met Lee."), (4, "It was Brown. Lee came."), (5, None), (6, ""), (7, "later Later LATER x"),
        (None, "Only Anna"),
    ]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    counts = {r.word: (r.upper, r.lower, r.name) for r in names.case_counts(docs).collect()}
    assert counts["anna"] == (4, 0, True) and counts["paris"] == (3, 0, True) and counts["the"][2] is False and counts["later"] == (2, 2, False)
    assert counts["yesterday"] == (0, 1, False) and "he" not in counts
    got = sorted(((r.id, tuple(r.entities)) for r in names.entities(docs, names.case_counts(docs)).collect()), key=str)
    want = [
        (1, ("Anna", "Anna Lee Brown", "Paris")), (2, ("Anna Lee", "Brown", "Paris")), (3, ()), (4, ("Anna", "Brown", "Lee", "Paris")), (4, ("Brown", "Lee")), (5, ()), (6, ()), (7, ()), (None, ("Anna",)),
    ]
    assert got == sorted(want, key=str)
    assert names.entities(docs.limit(0), names.case_counts(docs.limit(0))).count() == 0
