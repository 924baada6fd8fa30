"""Time the headline stages on $BENCH_SF_DIR and print one JSON line.

Every stage is warmed once on the smallest folder (JIT, code generation, Python workers),
then timed cold of data: nothing remembered, everything read from parquet again.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailhound.operators import correlate as cor  # noqa: E402
from trailhound.operators import library as lib  # noqa: E402
from trailhound.operators.catalog import built_in_catalog  # noqa: E402
from trailhound.operators.detect import detect, run_rule  # noqa: E402
from trailhound.plans import incidents as inc  # noqa: E402
from trailhound.plans import registry  # noqa: E402
from trailhound.session import build_session, materialize  # noqa: E402
from trailhound.sources.adapter import load_events  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM = "/root/testdata/sf0.001"


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark, folder):
    state = {}
    # Log text is made from the tables first and is not part of any timing.
    registry.host_lines(spark, folder).count()
    registry.cloud_lines(spark, folder).count()
    registry.written("outputs", spark, folder, registry.model_outputs).count()

    def store():
        state["events"] = materialize(load_events(spark, folder))

    def rule(r):
        def run():
            findings, evidence = run_rule(r, state["events"])
            drain(findings)
            drain(evidence)
        return run

    def run_detect():
        state["d"] = detect(state["events"]).materialized()

    def run_correlate():
        state["c"] = cor.correlate(state["d"], state["events"], built_in_catalog(spark))

    def query(name):
        return lambda: drain(registry.queries()[name](spark, folder))

    yield "store_events", store
    yield "entity_fan_out", query("entity_fan_out")
    yield "dedup_hashes", query("dedup_hashes")
    yield "dedup_first", query("dedup_first")
    for r in lib.DEFAULT_RULES:
        yield r.rule_id, rule(r)
    yield "detect_all_rules", run_detect
    yield "correlate", run_correlate
    yield "queue", lambda: drain(inc.incident_queue(state["c"].incidents))
    yield "details", lambda: drain(inc.incident_details(state["c"], built_in_catalog(spark)))
    yield "parse_hostlog", query("parse_hostlog")
    yield "parse_cloud_audit", query("parse_cloud_audit")
    yield "output_gate", query("output_gate")


def main() -> None:
    spark = build_session(f"local[{CPUS}]")
    for _, run in stages(spark, WARM):
        run()
    registry.forget()
    timings = {}
    for name, run in stages(spark, FOLDER):
        start = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    main_path = timings["store_events"] + timings["detect_all_rules"] + timings["correlate"] + timings["queue"]
    print(json.dumps({
        "metric": "raw events to ranked incident queue",
        "value": round(main_path, 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(FOLDER.rstrip("/")),
        "events": events,
        "events_per_sec": round(events / main_path),
        "cpus": int(CPUS),
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
