"""Reports of many employees in few files, and every one of them whole."""

from helpers import rows

from nightdesk.sources import sinks


def test_pooled_reports_come_back_whole_from_few_files(spark, tmp_path):
    odd = ["c/1", "a b+%2F", "ü\nx=y", "username=z", "\f\x1b", "tab\t"]
    texts = ["a\nb\n", "", "x\fy\x1bF\x1bE\f", "\r\nz\r", "username=c1\nq", "\n"]
    given = [(f"c{k}", "2024-03-05" if k % 2 else "2024-03-06", f"report\nof {k}\n") for k in range(2000)]
    given += [(n, "2024-03-05", t) for n, t in zip(odd, texts)] + [("c1", "2024-03-05", "again"), (None, "2024-03-05", "nobody")]
    schema = "username string, report_date string, report string"
    df = spark.createDataFrame(given + [("refused", "2024-03-05", None)], schema).repartition(4)
    path = tmp_path / "r"
    sinks.write_reports(df, str(path), pooled=True)
    assert len(list(path.glob("*/*.txt"))) <= 2 * 4
    assert sorted(rows(sinks.read_reports(spark, str(path))), key=repr) == sorted(given, key=repr)
    sinks.write_reports(spark.createDataFrame([("", "2024-03-07", "later")], schema), str(path), pooled=True)
    assert sinks.read_reports(spark, str(path)).filter("report_date = '2024-03-07'").first()["username"] is None
