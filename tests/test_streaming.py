import numpy as np
import pytest

from blockml.operators.naive_bayes import GaussianNB
from blockml.streaming.scoring import score_stream, start


def test_a_model_scores_a_stream(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(60, 2)) + 5 * (np.arange(60) % 2)[:, None]
    df = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "row_id long, X array<double>, y int")
    df.write.parquet(str(tmp_path / "in"))
    model = GaussianNB().fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = start(score_stream(stream, model), str(tmp_path / "out"), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 60 and got.where("y = prediction").count() == model.predict(df).where("y = prediction").count()
    with pytest.raises(ValueError):
        score_stream(df, model)
