from utterscope.operators.sweep import GRID, candidate_thresholds, threshold_sweep

SCHEMA = "label_speech boolean, duration_ms bigint"


def test_no_observations_still_has_every_threshold(spark):
    rows = threshold_sweep(spark.createDataFrame([], SCHEMA)).orderBy("threshold_ms").collect()
    assert [r["threshold_ms"] for r in rows] == list(GRID)
    assert all(r["speech_kept"] == 0 and r["speech_recall"] is None and r["noise_rejection_rate"] is None for r in rows)


def test_counts_and_candidates(spark):
    data = [(True, 100 + 10 * i) for i in range(20)] + [(False, 60), (False, 139), (False, 140), (None, 50), (True, None)]
    swept = threshold_sweep(spark.createDataFrame(data, SCHEMA))
    for r in swept.collect():
        t = r["threshold_ms"]
        speech = [d for s, d in data if s and d is not None]
        noise = [d for s, d in data if s is False]
        assert r["speech_kept"] == sum(d >= t for d in speech) and r["speech_rejected"] == sum(d < t for d in speech)
        assert r["non_speech_kept"] == sum(d >= t for d in noise) and r["non_speech_rejected"] == sum(d < t for d in noise)
    assert sorted(r["threshold_ms"] for r in candidate_thresholds(swept).collect()) == [100, 120]


def test_no_noise_means_no_candidates(spark):
    swept = threshold_sweep(spark.createDataFrame([(True, 500)], SCHEMA))
    assert candidate_thresholds(swept).count() == 0
