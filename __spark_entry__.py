"""Registered queries, each next to the SQL that must give the same rows.

The operators are written for tables of items, ratings and tags, trips,
diamonds and images. The given tables are shaped into those by the functions
below, and the SQL shapes them in the same way.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyframe import catalog, functions, learn, operators, plans, sinks, sources  # noqa: E402
from tallyframe.session import scratch_path  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline  # noqa: F401, E402
    from tallyframe.llm import registry as llm  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tallyframe.llm", "tallyframe.llm.registry"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL to compare it with."""

    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def entry(spark: SparkSession) -> DataFrame:
    d = "/root/testdata/sf0.001"
    return plans.top_rated_items(movies(spark, d), ratings(spark, d), more_votes_than=20)


def queries() -> dict[str, Query]:
    return {**_QUERIES, **(llm.queries() if llm else {})}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **(llm.oracle_sql() if llm else {})}


# ---- the given tables in the shapes the reports expect ----------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return sources.read_parquet(spark, f"{d}/{name}.parquet")


def movies(spark: SparkSession, d: str) -> DataFrame:
    """movieId, title such as ``red widget (1988)``, genres joined by bars."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.concat("p_name", F.lit(" ("), F.col("p_size") + 1960, F.lit(")")).alias("title"),
        F.concat_ws("|", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("|"))).alias("genres"),
    )


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """userId, movieId, rating, timestamp in epoch seconds."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        F.col("l_quantity").alias("rating"),
        functions.epoch_seconds(F.col("l_shipdate")).alias("timestamp"),
    )


def tags(spark: SparkSession, d: str) -> DataFrame:
    """userId, movieId, tag, timestamp in epoch seconds."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("userId"),
        F.col("o_orderkey").alias("movieId"),
        F.col("o_orderpriority").alias("tag"),
        functions.epoch_seconds(F.col("o_orderdate")).alias("timestamp"),
    )


def clicks(spark: SparkSession, d: str) -> DataFrame:
    """Events as text columns; ``props`` has quote marks, ``who`` the separator."""
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat_ws("@", "event_type", "user_id").alias("who"),
        "event_type",
        "props",
        functions.epoch_seconds(F.col("ts")).cast("string").alias("seconds"),
    )


MOVIES = """movies AS (
  SELECT p_partkey AS movieId,
         p_name || ' (' || CAST(p_size + 1960 AS VARCHAR) || ')' AS title,
         p_brand || '|' || p_type || '|' || replace(p_name, ' ', '|') AS genres
  FROM part)"""
RATINGS = """ratings AS (
  SELECT l_suppkey AS userId, l_partkey AS movieId, l_quantity AS rating,
         epoch_us(l_shipdate) // 1000000 AS "timestamp"
  FROM lineitem)"""
TAGS = """tags AS (
  SELECT o_custkey AS userId, o_orderkey AS movieId, o_orderpriority AS tag,
         epoch_us(o_orderdate) // 1000000 AS "timestamp"
  FROM orders)"""
CLICKS = """clicks AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         event_type || '@' || CAST(user_id AS VARCHAR) AS who,
         event_type, props,
         CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS seconds
  FROM events)"""

MOVIE_SCHEMA = "movieId bigint, title string, genres string"
RATING_SCHEMA = "userId bigint, movieId bigint, rating double, timestamp bigint"


# ---- reports ----------------------------------------------------------------


@query(f"""WITH {MOVIES}, {RATINGS}
SELECT title, avg(rating) AS rate, count(*) AS votes
FROM movies JOIN ratings USING (movieId)
GROUP BY title HAVING count(*) > 100
ORDER BY rate DESC, title LIMIT 10""")
def top_rated(spark, d):
    return plans.top_rated_items(movies(spark, d), ratings(spark, d))


@query(f"""WITH {MOVIES}, {RATINGS}
SELECT title, count(rating) AS votes, avg(rating) AS rate
FROM movies LEFT JOIN ratings USING (movieId)
GROUP BY title HAVING count(rating) > 100""")
def rated_left(spark, d):
    return plans.rated_items(movies(spark, d), ratings(spark, d))


@query("""SELECT source AS title, count(*) AS votes, CAST(sum(quality) AS DOUBLE) / nullif(count(quality), 0) AS rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(*) > 20""")
def rated_left_star(spark, d):
    """Documents are counted per source whether or not one has a label."""
    documents = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"))
    return plans.rated_items(
        documents, table(spark, d, "labels"), "doc_id", "title", "quality", more_votes_than=20, count="rows"
    )


@query(f"""WITH {MOVIES}
SELECT genre, count(*) AS count
FROM (SELECT unnest(string_split(genres, '|')) AS genre FROM movies)
GROUP BY genre""")
def token_counts(spark, d):
    return plans.items_per_token(movies(spark, d))


@query(f"""WITH {MOVIES}
SELECT substring(title, -5, 4) AS year, count(*) AS count FROM movies GROUP BY 1""")
def suffix_hist(spark, d):
    return plans.items_per_suffix(movies(spark, d))


@query(f"""WITH {MOVIES},
uneven AS (SELECT CASE WHEN title LIKE 'r%' THEN title || '  '
                       WHEN title LIKE 's%' THEN replace(title, '(', '[') ELSE title END AS title FROM movies)
SELECT nullif(regexp_extract(title, '\\((\\d{{4}})\\)\\s*$', 1), '') AS year, count(*) AS count
FROM uneven GROUP BY 1""")
def title_year_robust(spark, d):
    title = F.col("title")
    uneven = (
        F.when(title.startswith("r"), F.concat(title, F.lit("  ")))
        .when(title.startswith("s"), F.replace(title, F.lit("("), F.lit("[")))
        .otherwise(title)
    )
    return plans.items_per_year(movies(spark, d).withColumn("title", uneven))


@query(f"""WITH {RATINGS}
SELECT CAST(year(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS year, count(*) AS count
FROM ratings GROUP BY 1 ORDER BY 1 LIMIT 10""")
def epoch_year_hist(spark, d):
    return plans.records_per_year(ratings(spark, d), first=10)


@query(f"""WITH {TAGS}
SELECT CAST(year(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS year, count(*) AS count
FROM tags GROUP BY 1 ORDER BY 1 LIMIT 10""")
def epoch_year_hist_tags(spark, d):
    return plans.records_per_year(tags(spark, d), first=10)


@query(f"WITH {MOVIES} SELECT * FROM movies WHERE contains(title, '2005')")
def filter_contains(spark, d):
    return operators.contains_text(movies(spark, d), "title", "2005")


@query("""SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem WHERE l_suppkey < 25 GROUP BY l_suppkey""")
def filtered_sum(spark, d):
    exact = F.col("l_extendedprice").cast("decimal(18,2)")
    report = plans.amount_per_zone(table(spark, d, "lineitem"), "l_suppkey", exact)
    return report.withColumn("amount", F.col("amount").cast("double"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def group_count(spark, d):
    return plans.trips_per_pair(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT p_brand,
       CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(p_retailprice) AS p_retailprice
FROM part GROUP BY p_brand""")
def avg_by_group(spark, d):
    return plans.mean_per_group(table(spark, d, "part"), "p_brand", "p_retailprice", exact_scale=2)


@query("""WITH lines AS (
  SELECT l_linestatus || l_returnflag AS kind,
         CASE WHEN l_returnflag = 'R' THEN 'n/a' WHEN l_linenumber = 1 THEN NULL
              ELSE CAST(l_quantity AS VARCHAR) END AS rating
  FROM lineitem)
SELECT kind, avg(TRY_CAST(rating AS DOUBLE)) AS rating FROM lines GROUP BY kind""")
def avg_of_strings(spark, d):
    rating = F.when(F.col("l_returnflag") == "R", "n/a").when(
        F.col("l_linenumber") != 1, F.col("l_quantity").cast("string")
    )
    lines = table(spark, d, "lineitem").select(
        F.concat("l_linestatus", "l_returnflag").alias("kind"), rating.alias("rating")
    )
    path = scratch_path(spark, "strings")
    sinks.write_csv(lines, path, sep="@", header=False)
    with temporary_schema(spark) as schema:
        text = sources.create_delimited_table(spark, f"{schema}.lines", path, ["kind", "rating"], sep="@", quote="")
        return operators.avg_by_group(text, "kind", "rating", "rating")


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def limit_rows(spark, d):
    return operators.limit_rows(table(spark, d, "part"), 10, "p_partkey")


@query("SELECT l_returnflag, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_returnflag")
def chart_aggregate(spark, d):
    spec = {"keys": [{"name": "l_returnflag"}], "groups": [], "values": [{"name": "l_quantity", "aggr": "sum"}]}
    return operators.chart_from_spec(table(spark, d, "lineitem"), spec)


@query("""SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS "F",
       sum(l_quantity) FILTER (l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY l_returnflag""")
def chart_pivot(spark, d):
    return operators.chart_aggregate(
        table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_linestatus", ["F", "O"]
    )


@query("""SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS "F",
       sum(l_quantity) FILTER (l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY l_returnflag""")
def chart_pivot_all(spark, d):
    """The series are found in the data."""
    return operators.chart_aggregate(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_linestatus")


@query("""SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS "F",
       sum(l_quantity) FILTER (l_linestatus <> 'F') AS other
FROM lineitem GROUP BY l_returnflag""")
def chart_pivot_rest(spark, d):
    """Series that are not listed meet in a column of their own."""
    return operators.chart_aggregate(
        table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_linestatus", ["F"], rest="other"
    )


@query("""SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_series, max(total) AS largest,
       arg_min(total, l_suppkey::VARCHAR) AS first_series, sum(n) AS n
FROM (SELECT l_returnflag, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS total, count(*) AS n
      FROM lineitem GROUP BY l_returnflag, l_suppkey) GROUP BY l_returnflag""")
def chart_series(spark, d):
    """A series for every supplier, in one map per flag."""
    rows = table(spark, d, "lineitem")
    quantities = operators.chart_series(rows, ["l_returnflag"], "l_quantity", "l_suppkey")
    lines = operators.chart_series(rows.withColumn("one", F.lit(1)), ["l_returnflag"], "one", "l_suppkey", "lines")
    values = F.map_values("series")
    return quantities.join(lines.select("l_returnflag", "lines"), "l_returnflag").select(
        "l_returnflag",
        F.size("series").cast("bigint").alias("n_series"),
        F.array_max(values).cast("bigint").alias("largest"),
        F.get(values, 0).cast("bigint").alias("first_series"),
        F.aggregate(F.map_values("lines"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"),
    )


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem GROUP BY ALL""")
def sum_of_doubles(spark, d):
    """Revenue as doubles, added up without regard to the order of the rows."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = operators.exact_sums(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], revenue, "revenue")
    return sums.withColumn("revenue", F.round("revenue", 2))


# ---- ratios and functions of rows ---------------------------------------------


@query("""SELECT count(*) FILTER (l_quantity > 30) AS hits, count(*) AS n,
       CAST(count(*) FILTER (l_quantity > 30) AS DOUBLE) / count(*) AS estimate
FROM lineitem""")
def row_ratio(spark, d):
    """Share of the line items of more than 30 pieces."""
    return operators.ratio_estimate(table(spark, d, "lineitem"), F.col("l_quantity") > 30)


@query("""SELECT CAST(sum((l_orderkey % 7) * l_linenumber) AS BIGINT) AS total FROM lineitem""")
def function_sum(spark, d):
    """A Python function of every line item, summed over Arrow batches."""
    rows = table(spark, d, "lineitem")
    return operators.map_and_sum(rows, lambda key, line: key % 7 * line, ["l_orderkey", "l_linenumber"])


@query("""SELECT sum(CASE WHEN l_linestatus = 'F' THEN l_quantity / 4 ELSE l_quantity / 2 END) AS total FROM lineitem""")
def function_sum_double(spark, d):
    rows = table(spark, d, "lineitem")
    return operators.map_and_sum(
        rows, lambda status, n: n / 2 - n / 4 * (status == "F"), ["l_linestatus", "l_quantity"], kind="double"
    )


# ---- vectors and learning ---------------------------------------------------


@query("""SELECT vec_id, CAST(pos AS INTEGER) AS pos, v::DOUBLE / 255.0::DOUBLE AS value
FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)""")
def vector_scale(spark, d):
    scaled = functions.scale_vector(F.col("embedding"), 255.0)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(scaled).alias("pos", "value"))


@query("""WITH weights AS (
  SELECT vec_id, [exp(v::DOUBLE - list_max(embedding)::DOUBLE) FOR v IN embedding] AS w FROM embeddings)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v / total, 6) AS value
FROM (SELECT vec_id, list_sum(w) AS total, unnest(range(len(w))) AS pos, unnest(w) AS v FROM weights)""")
def vector_softmax(spark, d):
    probabilities = functions.softmax(F.col("embedding"))
    unrolled = table(spark, d, "embeddings").select("vec_id", F.posexplode(probabilities).alias("pos", "value"))
    return unrolled.withColumn("value", F.round("value", 6))


@query("""SELECT label, count(*) AS n,
       round(avg(ln(list_sum([exp(v::DOUBLE) FOR v IN embedding])) - embedding[label + 1]::DOUBLE), 6) AS loss
FROM embeddings GROUP BY label""")
def cross_entropy(spark, d):
    loss = functions.cross_entropy_loss(F.col("embedding"), F.col("label"))
    return (
        table(spark, d, "embeddings")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("loss"))
    )


@query("""WITH weights AS (
  SELECT vec_id, label, embedding, [exp(v::DOUBLE - list_max(embedding)::DOUBLE) FOR v IN embedding] AS w FROM embeddings)
SELECT vec_id % 5 = 0 AS held_out, count(*) AS n,
       avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
       round(avg(-ln(greatest(w[label + 1] / list_sum(w), 1e-15))), 6) AS loss
FROM weights GROUP BY 1""")
def ml_evaluate(spark, d):
    """Accuracy and loss of the softmax of the vectors themselves, taken as scores."""
    largest = F.array_position("embedding", F.array_max("embedding")) - 1
    scored = table(spark, d, "embeddings").select(
        "label",
        (F.col("vec_id") % 5 == 0).alias("held_out"),
        largest.cast("int").alias("prediction"),
        functions.softmax(F.col("embedding")).alias("probabilities"),
    )
    return learn.evaluate(scored, "label", "held_out").withColumn("loss", F.round("loss", 6))


@query("""WITH steps AS (SELECT label, vec_id, ('0x' || substr(md5(vec_id::VARCHAR), 1, 3))::INTEGER AS step FROM embeddings),
counted AS (SELECT label, step, sum(count(*)) OVER (PARTITION BY label ORDER BY step) AS upto,
                   sum(count(*)) OVER (PARTITION BY label) AS total FROM steps GROUP BY label, step)
SELECT label, upto * 10000 <= 2000 * total AS held_out, count(*) AS n, count(*) AS n_sum_one, count(*) AS n_largest
FROM steps JOIN counted USING (label, step) GROUP BY ALL""")
def ml_predict(spark, d):
    """Every vector scored by a trained classifier: its probabilities add up, and the largest is predicted."""
    rows = table(spark, d, "embeddings")
    rows = rows.withColumn("held_out", learn.held_out_by_label(rows, "vec_id", "label"))
    model = learn.fit_classifier(rows.where(~F.col("held_out")), "embedding", "label", 64, 10, max_iter=40, key="vec_id")
    scored = learn.score(model, rows, "embedding")
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    chosen = F.get("probabilities", F.col("prediction")) == F.array_max("probabilities")
    return scored.groupBy("label", "held_out").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_one"),
        F.count_if(chosen).alias("n_largest"),
    )


@query("""WITH lines AS (
  SELECT [l_quantity::DOUBLE / 10 - 2.5, l_discount::DOUBLE * 50 - 2.5] AS f,
         CASE WHEN (l_quantity > 25) <> (l_discount > 0.05) THEN 1 ELSE 0 END AS label,
         ('0x' || substr(md5(l_orderkey || '-' || l_linenumber), 1, 8))::BIGINT < 858993459 AS held_out
  FROM lineitem),
centres AS (SELECT label, avg(f[1]) AS x, avg(f[2]) AS y FROM lines WHERE NOT held_out GROUP BY label),
judged AS (
  SELECT l.label, (SELECT arg_min(c.label, (f[1] - x) ** 2 + (f[2] - y) ** 2) FROM centres c) AS nearest
  FROM lines l WHERE held_out)
SELECT label, count(*) AS n, round(avg(CASE WHEN nearest = label THEN 1 ELSE 0 END), 2) AS by_centre, TRUE AS better
FROM judged GROUP BY label""")
def ml_fit(spark, d):
    """Classes that no straight line parts: held-out accuracy by the nearest centre, and whether the trained model beats 0.9."""
    x, y = F.col("l_quantity").cast("double") / 10 - 2.5, F.col("l_discount").cast("double") * 50 - 2.5
    label = ((F.col("l_quantity") > 25) != (F.col("l_discount") > 0.05)).cast("int")
    rows = table(spark, d, "lineitem").select(
        F.array(x, y).alias("f"), label.alias("label"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")
    )
    rows = rows.withColumn("held_out", learn.held_out("key"))
    seen = rows.where(~F.col("held_out"))
    model = learn.fit_classifier(seen, "f", "label", 2, 2, hidden=8, max_iter=100, max_rows=20_000, key="key")
    centres = seen.groupBy("label").agg(F.avg(F.get("f", 0)).alias("x"), F.avg(F.get("f", 1)).alias("y")).collect()
    away = [F.struct((F.pow(F.get("f", 0) - c.x, 2) + F.pow(F.get("f", 1) - c.y, 2)).alias("d"), F.lit(c.label).alias("c")) for c in centres]
    scored = learn.score(model, rows.where("held_out"), "f").withColumn("nearest", F.array_min(F.array(*away))["c"])
    hit = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(hit("nearest"), 2).alias("by_centre"),
        ((hit("prediction") > hit("nearest")) & (hit("prediction") > 0.9)).alias("better"),
    )


# ---- sources ----------------------------------------------------------------


def _movie_file(spark, d) -> str:
    path = scratch_path(spark, "movies")
    sinks.write_csv(movies(spark, d), path, sep="@", header=False)
    return path


def _rating_file(spark, d) -> str:
    path = scratch_path(spark, "ratings")
    sinks.write_csv(ratings(spark, d), path, sep="@", header=False)
    return path


@query(f"""WITH {RATINGS} SELECT * FROM ratings""")
def scan_delimited(spark, d):
    return sources.read_delimited(spark, _rating_file(spark, d), RATING_SCHEMA, sep="@")


@query(f"""WITH {MOVIES}
SELECT CAST(movieId AS INTEGER) AS movieId, title, genres FROM movies""")
def scan_inferred(spark, d):
    return sources.read_delimited(spark, _movie_file(spark, d), sep="@", names=["movieId", "title", "genres"])


@query("""SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer""")
def scan_csv_header(spark, d):
    path = scratch_path(spark, "customer")
    sinks.write_csv(table(spark, d, "customer"), path, sep=";")
    return sources.read_delimited(spark, path, sep=";", header=True)


@query("SELECT * FROM orders")
def scan_parquet(spark, d):
    return table(spark, d, "orders")


@query(f"""WITH {MOVIES}, {TAGS}, lines AS (
  SELECT 'movies' AS prefix, movieId || '@' || title || '@' || genres AS line FROM movies
  UNION ALL SELECT '_tags', userId || '@' || movieId || '@' || tag || '@' || "timestamp" FROM tags)
SELECT prefix, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, 1::BIGINT AS markers FROM lines GROUP BY prefix""")
def list_files(spark, d):
    """Files of a listing, summed by the prefix they are under; one folder and the markers are hidden ones."""
    path = scratch_path(spark, "listing")
    for prefix, frame in (("movies", movies(spark, d)), ("_tags", tags(spark, d))):
        frame.select(F.concat_ws("@", *frame.columns)).write.text(f"{path}/{prefix}")
    prefix = F.element_at(F.split("path", "/"), -2)
    found = sources.list_files(spark, path)
    marker = F.element_at(F.split("path", "/"), -1) == "_SUCCESS"
    return found.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count_if(marker).alias("markers"))


@query(f"""WITH {MOVIES} SELECT * FROM movies ORDER BY title, movieId LIMIT 10""")
def rows_to_frame(spark, d):
    """A fetched preview of ten rows, as a DataFrame again."""
    preview = operators.limit_rows(movies(spark, d), 10, "title", "movieId").collect()
    return sources.frame_from_rows(spark, preview, MOVIE_SCHEMA)


# ---- tables over files ------------------------------------------------------


@contextmanager
def temporary_schema(spark: SparkSession):
    """A schema of its own in the shared folder, gone afterwards.

    The tables made in it are external, so frames built on them stay valid.
    """
    name = f"tally_{uuid.uuid4().hex}"
    catalog.create_schema(spark, name, scratch_path(spark, "schema"))
    try:
        yield name
    finally:
        catalog.drop_schema(spark, name, cascade=True)


@query("""SELECT c_mktsegment, avg(c_custkey) AS mean_key FROM customer GROUP BY c_mktsegment""")
def table_csv_ddl(spark, d):
    """All columns of a CSV table are strings; the mean reads them as numbers."""
    path = scratch_path(spark, "customers")
    sinks.write_csv(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), path)
    with temporary_schema(spark) as schema:
        text = sources.create_delimited_table(spark, f"{schema}.customers", path, header=True)
        return operators.avg_by_group(text, "c_mktsegment", "c_custkey", "mean_key")


@query(f"""WITH {CLICKS} SELECT event_id, event_type, props, seconds FROM clicks""")
def table_external_delimited(spark, d):
    """Text without quoting rules: quote marks are ordinary characters."""
    path = scratch_path(spark, "plain")
    columns = ["event_id", "event_type", "props", "seconds"]
    clicks(spark, d).select(F.concat_ws("@", *columns)).write.text(path)
    with temporary_schema(spark) as schema:
        return sources.create_delimited_table(spark, f"{schema}.clicks", path, columns, sep="@", quote="")


@query(f"WITH {CLICKS} SELECT * FROM clicks")
def table_external_quoted(spark, d):
    """Quoted text: fields may hold the separator and escaped quote marks."""
    path = scratch_path(spark, "quoted")
    events = clicks(spark, d)
    sinks.write_csv(events, path, sep="@", header=False, options={"quote": '"', "escape": "\\"})
    with temporary_schema(spark) as schema:
        return sources.create_delimited_table(spark, f"{schema}.clicks", path, events.columns, sep="@")


@query(f"WITH {MOVIES} SELECT * FROM movies")
def table_at_location(spark, d):
    path = scratch_path(spark, "located")
    sinks.write_directory(movies(spark, d), path)
    with temporary_schema(spark) as schema:
        return sources.create_table_at(spark, f"{schema}.movies", path)


# ---- sinks ------------------------------------------------------------------


@query(f"""WITH {MOVIES}, {RATINGS}, {TAGS}
SELECT 'movies' AS "table", count(*) AS n, CAST(sum(movieId) AS BIGINT) AS ids FROM movies
UNION ALL SELECT 'ratings', count(*), CAST(sum(movieId) AS BIGINT) FROM ratings
UNION ALL SELECT 'tags', count(*), CAST(sum(movieId) AS BIGINT) FROM tags""")
def ctas_refresh(spark, d):
    """Managed tables, refreshed twice: the second run replaces the first."""
    frames = {"movies": movies(spark, d), "ratings": ratings(spark, d), "tags": tags(spark, d)}
    with temporary_schema(spark) as schema:
        for name, frame in [*frames.items(), ("movies", frames["movies"])]:
            sinks.refresh_table(frame, f"{schema}.{name}")
        totals = [
            spark.table(f"{schema}.{name}").agg(
                F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"), F.sum("movieId").alias("ids")
            )
            for name in frames
        ]
        # Dropping a managed table removes its files, so the totals are stored first.
        return sinks.store_once(totals[0].union(totals[1]).union(totals[2]), "totals")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def sink_single_csv(spark, d):
    path = scratch_path(spark, "single")
    sinks.write_single_csv(group_count(spark, d), path)
    return sources.read_delimited(spark, path, "l_returnflag string, l_linestatus string, count bigint")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def sink_external_table(spark, d):
    path = scratch_path(spark, "external")
    with temporary_schema(spark) as schema:
        sinks.write_external_table(group_count(spark, d), f"{schema}.pairs", path)
        return spark.table(f"{schema}.pairs")


@query("""SELECT 'csv' AS output, l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL
UNION ALL SELECT 'table', l_returnflag, l_linestatus, count(*) FROM lineitem GROUP BY ALL""")
def sink_twice(spark, d):
    """One aggregate behind two outputs, computed once."""
    counts = sinks.store_once(group_count(spark, d), "counts")
    csv, external = scratch_path(spark, "csv"), scratch_path(spark, "table")
    sinks.write_single_csv(counts, csv)
    with temporary_schema(spark) as schema:
        sinks.write_external_table(counts, f"{schema}.pairs", external)
        stored = spark.table(f"{schema}.pairs")
    file = sources.read_delimited(spark, csv, counts.schema)
    return file.select(F.lit("csv").alias("output"), "*").union(stored.select(F.lit("table").alias("output"), "*"))


@query(f"WITH {MOVIES} SELECT * FROM movies")
def sink_csv_header(spark, d):
    path = scratch_path(spark, "export")
    sinks.write_csv(movies(spark, d), path)
    return sources.read_delimited(spark, path, MOVIE_SCHEMA, header=True)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def sink_csv_text(spark, d):
    """Whole texts with line breaks, quote marks and separators, quotes doubled."""
    path = scratch_path(spark, "texts")
    documents = table(spark, d, "documents")
    sinks.write_csv(documents, path, options={"escape": '"', "maxRecordsPerFile": "10000"})
    return sources.read_delimited(spark, path, documents.schema, header=True, escape='"', multiline=True)


# ---- catalog ----------------------------------------------------------------

REMOTE = "tally_remote"


def _register_remote(spark: SparkSession) -> None:
    """A second catalog. Its endpoint is contacted only when its tables are read."""
    catalog.register_catalog(
        spark,
        REMOTE,
        "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog",
        {"url": "jdbc:hive2://catalog.invalid/default", "driver": "org.apache.hive.jdbc.HiveDriver"},
    )


def _register_given(spark: SparkSession, d: str, schema: str, *names: str) -> None:
    """Name the given files in a schema; nothing is copied."""
    for name in names:
        sources.create_table_at(spark, f"{schema}.{name}", f"{d}/{name}.parquet")


def _rows_per_table(spark: SparkSession, schema: str) -> DataFrame:
    """The listed tables with their row counts, one scan of metadata each."""
    found = [r.table for r in catalog.list_tables(spark, schema).collect()]
    counts = [
        spark.table(f"{schema}.{name}").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        for name in found
    ]
    result = spark.createDataFrame([], "table string, n bigint")
    for other in counts:
        result = result.union(other)
    return result


@query("""SELECT event_type, count(DISTINCT user_id) AS users, min(event_id) AS first_event, max(event_id) AS last_event
FROM events GROUP BY event_type""")
def view_query(spark, d):
    """SQL text over a session view."""
    name = f"events_{uuid.uuid4().hex}"
    catalog.register_view(table(spark, d, "events"), name)
    found = spark.sql(
        "SELECT event_type, count(DISTINCT user_id) AS users, min(event_id) AS first_event, max(event_id) AS last_event "
        f"FROM {name} GROUP BY event_type"
    )
    spark.catalog.dropTempView(name)
    return found


@query("SELECT 'spark_catalog' AS catalog, count(*) AS n FROM part")
def cat_catalogs(spark, d):
    """The catalog in use as the listing has it, with the parts that a three-level name finds in it."""
    with temporary_schema(spark) as schema:
        _register_given(spark, d, schema, "part")
        listed = catalog.list_catalogs(spark).where(F.col("catalog") == spark.catalog.currentCatalog()).first()["catalog"]
        parts = spark.table(f"{listed}.{schema}.part").agg(F.count(F.lit(1)).alias("n"))
        return parts.select(F.lit(listed).alias("catalog"), "n")


@query("SELECT 'spark_catalog' AS catalog, count(*) AS n FROM orders")
def cat_current(spark, d):
    """The current catalog and schema resolve a bare table name."""
    before = spark.catalog.currentDatabase()
    with temporary_schema(spark) as schema:
        _register_given(spark, d, schema, "orders")
        catalog.use_schema(spark, schema)
        try:
            return spark.sql("SELECT current_catalog() AS catalog, count(*) AS n FROM orders")
        finally:
            catalog.use_schema(spark, before)


@query(f"""SELECT '{REMOTE}' AS switched_to, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def cat_switch(spark, d):
    """A three-level name works from any current catalog."""
    _register_remote(spark)
    with temporary_schema(spark) as schema:
        _register_given(spark, d, schema, "orders")
        catalog.switch_catalog(spark, REMOTE)
        try:
            # current_catalog() in SQL would be evaluated only when the frame runs.
            current = F.lit(catalog.current_catalog(spark))
            orders = spark.table(f"spark_catalog.{schema}.orders")
            return operators.group_count(orders, current.alias("switched_to"), "o_orderstatus", out="n")
        finally:
            catalog.switch_catalog(spark, "spark_catalog")
            catalog.unregister_catalog(spark, REMOTE)


@query("""SELECT 'first' AS schema, count(*) AS n FROM lineitem
UNION ALL SELECT 'second', count(*) FROM orders""")
def cat_schemas(spark, d):
    """Two schemas, created twice without harm, and the rows found in each."""
    with temporary_schema(spark) as first, temporary_schema(spark) as second:
        labels = {first: "first", second: "second"}
        for schema in labels:
            catalog.create_schema(spark, schema)
        _register_given(spark, d, first, "lineitem")
        _register_given(spark, d, second, "orders")
        listed = [r.schema for r in catalog.list_schemas(spark).collect() if r.schema in labels]
        counts = [
            _rows_per_table(spark, schema).agg(F.lit(labels[schema]).alias("schema"), F.sum("n").alias("n"))
            for schema in sorted(listed, key=labels.get)
        ]
        return counts[0].union(counts[1])


@query("""SELECT 'part' AS "table", count(*) AS n FROM part
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events""")
def cat_tables(spark, d):
    with temporary_schema(spark) as schema:
        _register_given(spark, d, schema, "part", "lineitem", "events")
        return _rows_per_table(spark, schema)


@query("""SELECT 'o_orderkey' AS column_name, 'bigint' AS data_type, count(o_orderkey) AS present FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'double', count(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM orders""")
def cat_describe(spark, d):
    """Described columns with their number of values."""
    with temporary_schema(spark) as schema:
        _register_given(spark, d, schema, "orders")
        described = catalog.describe_table(spark, f"{schema}.orders")
        orders = spark.table(f"{schema}.orders")
        present = orders.agg(*[F.count(c).alias(c) for c in orders.columns]).unpivot(
            [], orders.columns, "column_name", "present"
        )
        types = described.select(F.col("col_name").alias("column_name"), "data_type")
        return types.join(present, "column_name")


@query("""SELECT 'part' AS "table", count(*) AS n FROM part""")
def cat_drop(spark, d):
    """Of two tables one is dropped, twice; its files and the other table stay."""
    with temporary_schema(spark) as schema:
        _register_given(spark, d, schema, "part", "events")
        for _ in range(2):
            catalog.drop_table(spark, f"{schema}.events")
        return _rows_per_table(spark, schema)


@query("SELECT true AS refused, true AS gone, count(*) AS n FROM nation")
def cat_drop_schema(spark, d):
    """A schema that holds a table is not dropped unless asked to; the table's files stay."""
    name = f"tally_{uuid.uuid4().hex}"
    catalog.create_schema(spark, name, scratch_path(spark, "schema"))
    _register_given(spark, d, name, "nation")
    rows = spark.table(f"{name}.nation")
    try:
        catalog.drop_schema(spark, name)
        refused = False
    except AnalysisException:
        refused = True
    catalog.drop_schema(spark, name, cascade=True)
    gone = catalog.list_schemas(spark).where(F.col("schema") == name).isEmpty()
    return rows.agg(F.lit(refused).alias("refused"), F.lit(gone).alias("gone"), F.count(F.lit(1)).alias("n"))
