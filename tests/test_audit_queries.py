"""The registered audits run over all default buffers, block sizes and look-backs."""

from pyrogrid.plans import audits
from pyrogrid.plans.catalog import REGISTRY
from pyrogrid.plans.inputs import HORIZON

# The test tables have one block of 100 km, so that size has no fold to score.
SIZES = set(audits.BLOCK_SIZES_KM) - {100}
BUFFERS = set(range(0, 2 * HORIZON + 1, 5))


def steps(frame, column):
    return {r[column] for r in frame.select(column).collect()}


def test_full_curves(spark, sf_dir):
    temporal = REGISTRY["leakage_curve_full"].run(spark, sf_dir)
    assert steps(temporal, "buffer_days") == BUFFERS
    spatial = REGISTRY["spatial_leakage_full"].run(spark, sf_dir)
    assert steps(spatial, "block_size_km") >= SIZES


def test_lookbacks(spark, sf_dir):
    found = REGISTRY["lookback_ablation"].run(spark, sf_dir)
    assert steps(found, "max_window_days") == set(audits.LOOKBACK_WINDOWS)


def test_leakage_report(spark, sf_dir):
    found = REGISTRY["leakage_report"].run(spark, sf_dir)
    assert steps(found.where("curve = 'temporal'"), "step") == BUFFERS
    assert steps(found.where("curve = 'spatial'"), "step") >= SIZES
