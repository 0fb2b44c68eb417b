import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.session import build_session  # noqa: E402

MOVIES = """1@Toy Story (1995)@Adventure|Animation|Children
2@Oldboy (2005)@Action
3@"Quoted" Film (2005)@
4@Café (2001) @Drama|Drama
5@abc@(no genres listed)
6@Toy Story (1995)@Comedy
"""
RATINGS = """1@1@5@838985046
2@2@3.5@1112486027
2@1@4@1112486027
3@99@4@1112486027
"""
TAGS = """1@1@fun@1135429236
2@2@grim@1135429236
"""


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[4,3]",  # a failed task is tried again
        4,
        settings={
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(shared),
            "spark.sql.warehouse.dir": str(shared / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(tmp_path_factory):
    """Tiny separated files with awkward titles, and their paths by name."""
    folder = tmp_path_factory.mktemp("edge")
    paths = {}
    for name, text in (("movies", MOVIES), ("ratings", RATINGS), ("tags", TAGS)):
        path = folder / f"{name}.dat"
        path.write_text(text, encoding="utf-8")
        paths[name] = str(path)
    return paths


@pytest.fixture
def movies(spark, files):
    from tallyframe.sources import read_delimited

    return read_delimited(spark, files["movies"], "movieId int, title string, genres string", sep="@")


@pytest.fixture
def ratings(spark, files):
    from tallyframe.sources import read_delimited

    schema = "userId int, movieId int, rating double, timestamp bigint"
    return read_delimited(spark, files["ratings"], schema, sep="@")


@pytest.fixture
def conf(spark):
    """Set Spark settings for one test."""
    before = {}

    def change(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_of(df) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
