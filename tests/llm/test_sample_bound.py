"""The bounded sample of the toxicity classifier does not depend on where rows lie."""

from strandline.llm import toxicity


def test_classes_are_cut_by_hash():
    sizes = [(f"{n:02}", n % 2, 10) for n in range(20)]
    assert toxicity.within(sizes, 1000) == {0: "18", 1: "19"}
    assert toxicity.within(sizes, 60) == {0: "04", 1: "05"} == toxicity.within(sizes[::-1], 60)
    assert toxicity.within(sizes, 1) == {0: "00", 1: "01"}
    assert toxicity.within([], 1) == {}


def test_both_classes_train_within_the_bound(spark, monkeypatch):
    """All of one class lie before the other; the bound is reached within the first."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, ys, weights: seen.append((sum(len(b) for b, _ in bags), sorted(ys))))
    rows = [(n, " ".join(f"w{n}x{k}" for k in range(60)), int(n >= 40)) for n in range(80)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, toxic int").coalesce(1)
        monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 10_000)
        toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert seen[0] == seen[1] and seen[0][0] <= 10_000 and set(seen[0][1]) == {0, 1}
