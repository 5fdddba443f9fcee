import numpy as np

from skyledger.llm.bloom import key_filter, passing
from skyledger.llm.common import most_frequent


def test_filter_passes_all_its_keys_and_few_others(spark):
    keys = [(int(x),) for x in np.random.default_rng(1).integers(-(2**63), 2**63, 5000)]
    words = key_filter(spark.createDataFrame(keys, "k long"), "k", bits=1 << 17).value
    assert passing(words, np.array([k for k, in keys])).all()
    assert passing(words, np.arange(100_000)).mean() < 0.02
    none = key_filter(spark.createDataFrame([], "k long"), "k", bits=1 << 10).value
    assert not passing(none, np.arange(1000)).any()


def test_most_frequent_keeps_within_the_bound(spark):
    counted = spark.createDataFrame([(f"w{k}", 1 + 1000 // (k + 1)) for k in range(500)], "word string, n long")
    for most in (0, 1, 10, 100, 1000):
        kept = {r.word: r.n for r in most_frequent(counted, most).collect()}
        assert len(kept) <= most
        left = [r.n for r in counted.collect() if r.word not in kept]
        assert not kept or not left or min(kept.values()) > max(left)
    assert len(most_frequent(counted, 1000).collect()) == 500
    assert most_frequent(counted.where("false"), 5).count() == 0
