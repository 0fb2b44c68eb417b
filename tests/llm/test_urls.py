from datetime import date, datetime

from tallyframe.llm import urls

ENTRIES = [
    ("domain", "spam.com", "block", date(2024, 1, 10)),
    ("domain", "spam.com", "delist", date(2024, 3, 1)),
    ("domain", "spam.com", "block", date(2024, 5, 1)),
    ("prefix", "a.spam.com/good", "allow", date(2024, 1, 1)),
    ("prefix", "a.spam.com/good/bad", "block", date(2024, 2, 1)),
    ("domain", "tie.org", "allow", date(2024, 1, 1)),
    ("domain", "tie.org", "block", date(2024, 1, 1)),
    ("domain", None, "block", date(2024, 1, 1)),
    ("host", "x.net", "block", date(2024, 1, 1)),
    ("domain", "x.net", "unknown", date(2024, 1, 1)),
]
SCHEMA = "kind string, pattern string, action string, dated date"
CASES = [
    ("http://a.spam.com/", datetime(2024, 1, 9, 23), "allow", None, 0),
    ("http://a.spam.com/", datetime(2024, 1, 10), "block", "spam.com", 1),
    ("HTTPS://user@A.Spam.com.:80?q", datetime(2024, 2, 29, 23, 59), "block", "spam.com", 1),
    ("http://spam.com/x", datetime(2024, 3, 1), "allow", None, 0),
    ("http://spam.com/x", datetime(2024, 5, 1), "block", "spam.com", 1),
    ("http://spam.com/x", datetime(2031, 5, 1), "block", "spam.com", 1),
    ("http://notspam.com/x", datetime(2024, 2, 1), "allow", None, 0),
    ("http://a.spam.com//good/?x=1", datetime(2024, 1, 15), "allow", "a.spam.com/good", 2),
    ("http://a.spam.com/goods", datetime(2024, 1, 15), "block", "spam.com", 1),
    ("http://a.spam.com/good/bad/x", datetime(2024, 1, 31), "allow", "a.spam.com/good", 2),
    ("http://a.spam.com/good/bad/x", datetime(2024, 2, 1), "block", "a.spam.com/good/bad", 3),
    ("//tie.org", datetime(2024, 1, 1), "block", "tie.org", 1),
    ("http://x.net/", datetime(2024, 1, 2), "allow", None, 0),
    ("no url", datetime(2024, 2, 1), "allow", None, 0),
    ("", datetime(2024, 2, 1), "allow", None, 0),
    (None, datetime(2024, 2, 1), "allow", None, 0),
    ("http://spam.com/", None, "allow", None, 0),
    ("http://b.spam.com/" + "p/" * 3000, datetime(2024, 2, 1), "block", "spam.com", 1),
]


def captures(spark, cases):
    rows = [(n, u, t, "v", "k") for n, (u, t, *_) in enumerate(cases)]
    return spark.createDataFrame(rows, "page_id long, url string, fetched timestamp, verdict string, pattern string")


def test_the_list_of_the_time_decides(spark):
    cases = CASES + CASES[:3]
    found = urls.filter_urls(captures(spark, cases), spark.createDataFrame(ENTRIES, SCHEMA))
    assert found.columns == ["page_id", "url", "fetched", "pattern", "verdict", "decided_by", "n_active"]
    got = [(r.verdict, r.decided_by, r.n_active) for r in sorted(found.collect())]
    assert got == [tuple(c[2:]) for c in cases]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert urls.filter_urls(captures(spark, []), spark.createDataFrame(ENTRIES, SCHEMA)).collect() == []
    assert {(r.verdict, r.n_active) for r in urls.filter_urls(captures(spark, CASES), none).collect()} == {("allow", 0)}


def test_very_long_paths(spark):
    deep = "b.spam.com/" + "/".join("q" * 40)
    entries = spark.createDataFrame([*ENTRIES, ("prefix", deep, "allow", date(2024, 1, 1))], SCHEMA)
    long = "p/" * 400_000
    cases = [(f"http://b.spam.com/{long}", datetime(2024, 2, 1)), (f"http://a.spam.com/good/{long}", datetime(2024, 1, 15))]
    cases += [(f"http://{deep}/{long}", datetime(2024, 2, 1)), (f"http://{deep[:-2]}", datetime(2024, 2, 1))]
    got = sorted(urls.filter_urls(captures(spark, cases * 50), entries).select("page_id", "decided_by", "n_active").collect())
    wanted = [("spam.com", 1), ("a.spam.com/good", 2), (deep, 2), ("spam.com", 1)]
    assert [tuple(r)[1:] for r in got] == wanted * 50


def test_intervals(spark):
    held = urls.validity(spark.createDataFrame(ENTRIES[:3], SCHEMA)).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to) for r in held] == [(date(2024, 1, 10), date(2024, 3, 1)), (date(2024, 5, 1), None)]
