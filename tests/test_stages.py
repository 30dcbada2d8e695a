"""All stages from archives to the dashboard tables."""

import io
import random
import tarfile

from pyspark.sql import functions as F

from failscope.plans.stages import run

ERRORS = ["DUT does not transmit message", "Capture id does not exist", "CLI ERROR command rejected"]


def log_text(rng, case):
    lines = [f"DUT NAME : Box{case % 3}", "DUT VERSION = 1.2", "OS VERSION: L5", "CONFIGURATION: c", f"Test Case: tc_{case}"]
    for i in range(20):
        clock = f"10:{i:02d}:{rng.randrange(60):02d}.{rng.randrange(1000):03d}"
        if case % 3 == 0 and i % 2 == 0:
            lines.append(f"{clock} # Result: FAILED {rng.choice(ERRORS)}")
        elif case % 3 == 1 and i % 5 == 0:
            lines.append(f"{clock} # Result: ABORTED run stopped")
        else:
            lines.append(f"{clock} # Result: PASSED fine")
    return "\n".join(lines) + "\n"


def test_from_archive_to_dashboard(spark, tmp_path):
    rng = random.Random(0)
    (tmp_path / "in").mkdir()
    with tarfile.open(tmp_path / "in/a.tar.gz", "w:gz") as tar:
        for case in range(12):
            data = log_text(rng, case).encode()
            info = tarfile.TarInfo(f"logs/tc_{case}_{'ptp-oc' if case % 2 else 'sip'}_2025010{case % 5 + 1}.log")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    base = str(tmp_path / "run")
    run(spark, "extract", base, str(tmp_path / "in"))
    done = []
    for stage in ("preprocess", "profile", "features", "cluster", "root-cause", "correlate", "classify", "anomalies",
                  "test-cases", "prioritise", "dashboard"):
        options = {"trees": 5, "depth": 4, "rounds": 2} | ({"k": 3} if stage == "cluster" else {})
        done += run(spark, stage, base, csv=stage == "root-cause", **options)
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    assert read("logs").count() == 240
    assert read("logs").filter("dut like 'Box%' and dut_version = '1.2' and timestamp is not null").count() == 240
    assert read("labelled").filter("cluster >= 0").count() == read("logs").filter("status = 'FAIL'").count() == 40
    assert read("anomalies").count() == read("classified").count() == read("testcases").count() == 240
    assert read("testcases_alt").count() == 240
    assert read("prioritised").agg(F.count_distinct("row_id")).first()[0] == 240
    assert read("topk").count() == 20
    assert spark.read.option("header", True).csv(f"{base}/csv/labelled").count() == 240
    for name in done:
        assert read(name).columns
