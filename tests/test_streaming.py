from failscope.streaming.lines import parse_line_stream, read_line_stream


def test_lines_parse_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "x_ptp-oc_20250922.log").write_text("10:00:01.5 # Result: PASSED ok\nnothing\n# TEST CASE FAILED\n")
    parsed = parse_line_stream(read_line_stream(spark, str(source)))
    query = parsed.writeStream.format("memory").queryName("parsed_lines").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.status, r.suite, r.error_msg) for r in spark.table("parsed_lines").collect())
    assert got == [("FAIL", "ptp-oc", None), ("PASS", "ptp-oc", "ok")]
