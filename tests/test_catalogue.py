import pytest
from test_entry import compare

from findery.operators import metrics
from findery.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_bootstrap"])
def test_bootstraps_draw_as_often_as_the_library(spark, monkeypatch, name):
    """A query takes the library's number of resamples, and so does its SQL."""
    drawn, real = [], metrics.resampled

    def resampled(values, by, group, repeats, seed=0):
        drawn.append(repeats)
        return real(values, by, group, repeats, seed)

    monkeypatch.setattr(metrics, "resampled", resampled)
    compare(spark, name, FOLDER)
    assert drawn == [metrics.REPEATS] and f"range({metrics.REPEATS})" in catalogue.SQL[name]
