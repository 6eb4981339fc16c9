"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Every query is run once on the
smallest scale to load classes, then timed once at the measured scale; results are consumed by a
sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyrogrid.config import BBox  # noqa: E402
from pyrogrid.operators import features, resampling  # noqa: E402
from pyrogrid.plans import inputs  # noqa: E402
from pyrogrid.plans.catalog import REGISTRY  # noqa: E402
from pyrogrid.session import build_session  # noqa: E402
from pyrogrid.sources.grid import bbox_frame, patch_grid  # noqa: E402
from pyrogrid.sources.panel import reference_spine  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
WARM_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")

HEADLINE = (
    "event_ahead",
    "panel_assemble",
    "zonal_weather",
    "zonal_optical",
    "burn_window",
    "nearest_road",
    "enrich_panel",
    "sequence_window",
    "materialize_labels",
    "spatiotemporal_split",
    "safe_metrics_by_split",
    "risk_ranking",
    "delong_test",
    "severity_pairs",
    "conformal_coverage",
    "risk_pipeline_panel",
)


def bootstrap_200(spark, sf):
    rows = inputs.scored(spark, sf)
    return resampling.block_bootstrap(
        rows, "patch_id", "y_occ_30d", "occurrence_prediction", n_bootstrap=200
    )


# The 10 km grid of this box has 8 736 cells; with 110 weekly dates that is 960 960 rows.
PILOT_BOX = BBox(lon_min=108.5, lon_max=118.5, lat_min=-3.5, lat_max=3.5)
PILOT_COLUMNS = [
    f"{stem}_l{w}d"
    for w in (7, 14, 30, 60)
    for stem in (features.TEMPERATURE, features.DEWPOINT, features.PRECIPITATION)
]


def pilot_panel(spark, _sf):
    dates = reference_spine(
        spark.range(1).select(
            F.make_date(F.lit(2019), F.lit(1), F.lit(1)).alias("reference_start"),
            F.make_date(F.lit(2020), F.lit(12), F.lit(31)).alias("reference_end"),
        ),
        7,
        37,
    ).agg(F.sort_array(F.collect_set("reference_date")).alias("days"))
    days = dates.first()["days"]
    spine = F.explode(F.array(*[F.lit(d) for d in days])).alias("reference_date")
    panel = patch_grid(bbox_frame(spark, PILOT_BOX), 10).select("patch_id", spine)
    hashed = [
        (F.pmod(F.xxhash64("patch_id", "reference_date", F.lit(n)), F.lit(1000)) / 25.0).alias(n)
        for n in PILOT_COLUMNS
    ]
    return features.enrich_panel(panel.select("patch_id", "reference_date", *hashed))


def main() -> None:
    spark = build_session(
        "pyrogrid-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: REGISTRY[name].run for name in HEADLINE}
    runs["block_bootstrap_200"] = bootstrap_200
    runs["pilot_enrich_960k"] = pilot_panel
    seconds = {}
    for name, run in runs.items():
        if os.path.isdir(WARM_DIR) and name != "pilot_enrich_960k":
            run(spark, WARM_DIR).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
