"""The detector's rows are read many times: they are Parquet, of which a pass reads its columns, not checkpoints of whole rows."""

import numpy as np

from flowsieve.models import detector


def test_rows_are_kept_as_columns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    rows = [(i, str(int(a)), str(int(b)), "tcp" if i % 3 else "udp", str(int(k))) for i, (a, b, k) in enumerate(zip(rng.normal(500, 90, 400) + 900 * y, rng.normal(500, 90, 400) + 900 * y, y, strict=True))]
    flows = spark.createDataFrame(rows, "row_id long, sbytes string, dbytes string, proto string, label string")
    held, kept = [], detector.kept
    monkeypatch.setattr(detector, "kept", lambda df: held.append(kept(df)) or held[-1])
    fitted = detector.train_detector(flows, "row_id", test=flows)
    # Rows with their part, with their fold, the scores of the held-out rows and of the test rows.
    assert [bool(df.inputFiles()) for df in held] == [True] * 4
    assert [df.count() for df in held[::3]] == [400, 400]
    assert held[1].count() + held[2].count() == 400
    assert set(fitted.metrics) == {"validation", "test"}
