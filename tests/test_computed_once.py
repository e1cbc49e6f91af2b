"""Costly parts of a row are computed once, and files grow in number with their rows."""

from boxweave.operators import filters as P
from boxweave.plans.queries_files import PER_STREAMED_FILE, streamed_files
from boxweave.sources import logs as L


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_label_line_is_split_once(spark):
    lines = spark.createDataFrame([("a", 1, "0 0.5 0.5 0.1 0.1"), ("a", 2, " "), ("a", 3, "x"), ("a", 4, None)], "image_stem string, line_no int, line string")
    made = lines.selectExpr("image_stem", "line_no", "concat(line, '') AS line")
    valid, rejects = P.validate_labels(made)
    assert valid.columns[:3] == ["image_stem", "line_no", "line"]
    assert [_plan(df.select("line_no")).count("split(") for df in (valid, rejects)] == [1, 1]
    assert [_plan(df.select("line_no")).count("concat(") for df in (valid, rejects)] == [1, 1]
    assert [r.line_no for r in valid.collect()] == [1] and [(r.line_no, r.reason) for r in rejects.collect()] == [(3, "fields")]


def test_words_of_a_log_line_are_not_sorted(spark):
    lines = spark.createDataFrame([(1, "[PullStats] channel=a b=1 b=2 c=x")], "line_no int, value string")
    for df in (L.parse_motion_stats(lines)[1], L.parse_runtime_stats(lines)):
        assert "array_sort" not in _plan(df) and "zip_with" not in _plan(df)
    assert _plan(L.parse_runtime_stats(lines)).count("regexp_extract(") == 1
    assert [(r.metric, r.value) for r in L.parse_runtime_stats(lines).collect()] == [("b", 2.0)]


def test_files_of_a_stream_hold_so_many_rows():
    for rows in (0, 1, PER_STREAMED_FILE, 36_000_000, 216_000_000):
        files = streamed_files(rows)
        assert files % 3 == 0 and files >= 3 and rows / files <= PER_STREAMED_FILE
