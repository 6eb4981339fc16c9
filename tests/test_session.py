import pytest

from pyrogrid import session
from pyrogrid.operators import models


@pytest.fixture
def usual_limit(spark):
    """Method limit of a session that ``build_session`` did not make."""
    before = spark.conf.get(session.HUGE_METHOD)
    spark.conf.set(session.HUGE_METHOD, "65535")
    yield "65535"
    spark.conf.set(session.HUGE_METHOD, before)


@pytest.mark.parametrize(
    "key,block", [(session.SHUFFLE_CLEANUP, session.shuffles_removed), (session.HUGE_METHOD, session.wide_rows)]
)
def test_blocks_that_overlap_restore_the_setting(spark, usual_limit, key, block):
    before = spark.conf.get(key, None)
    first, second = block(spark), block(spark)
    first.__enter__()
    held = spark.conf.get(key)
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == held != before
    second.__exit__(None, None, None)
    assert spark.conf.get(key, None) == before


def test_written_tables_and_fits_avoid_long_methods(spark, usual_limit, monkeypatch):
    frame = spark.createDataFrame([(float(i), i % 2) for i in range(8)], "weather_x_mean_l7d double, y_occ_14d int")
    limits = []

    class Frame:
        sparkSession, schema = spark, frame.schema

        @property
        def write(self):
            limits.append(spark.conf.get(session.HUGE_METHOD))
            return frame.write

    class Recorded(models.Pipeline):
        def _fit(self, dataset):
            limits.append(spark.conf.get(session.HUGE_METHOD))
            return super()._fit(dataset)

    monkeypatch.setattr(models, "Pipeline", Recorded)
    session.materialise(Frame())
    models.fit_model(frame, "logreg", "classification", ["weather_x_mean_l7d"], "y_occ_14d", {"max_iter": 2})
    assert limits == [session.SESSION_CONF[session.HUGE_METHOD]] * 2
    assert spark.conf.get(session.HUGE_METHOD) == usual_limit
