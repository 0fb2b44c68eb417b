"""The registered queries of this subpackage, each with its SQL where SQL can express it.

Every query applies its operator with production parameters to its whole table
and derives the columns that are compared from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import (
    bytebpe,
    embeddings,
    importance,
    packing,
    periods,
    pieces,
    pii,
    quality,
    sharding,
    simhash,
    substring,
    toxicity,
    urls,
)
from tallyframe.llm.common import WORD
from tallyframe.sources import read_parquet

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{d}/{name}.parquet")


FIRST_DAY = "2024-01-01"


def url_list(pages: DataFrame) -> DataFrame:
    """Dated list entries from the hosts and paths of the pages; they grow with the table."""
    places = pages.where("url is not null").select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    places = places.where("host <> ''").select("host", F.regexp_extract("path", "^/([^/]+)", 1).alias("part")).distinct()
    number = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("int")
    hosts = places.select("host").distinct().withColumn("x", number(F.col("host")))
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)

    def dated(frame: DataFrame, every: int, kind: str, pattern, action: str, n) -> DataFrame:
        return frame.where(F.col("x") % every == 0).select(
            F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("dated")
        )

    x, host = F.col("x"), F.col("host")
    parent = F.regexp_replace(host, "^[^.]*\\.", "")
    paths = places.where("part <> ''").withColumn("pattern", F.concat_ws("/", "host", "part"))
    paths = paths.withColumn("x", number(F.col("pattern")))
    return (
        dated(hosts, 3, "domain", host, "block", x % 300)
        .union(dated(hosts, 6, "domain", host, "delist", x % 300 + 60))
        .union(dated(hosts, 12, "domain", host, "block", x % 300 + 150))
        .union(dated(hosts, 40, "domain", parent, "block", x % 500))
        .union(dated(paths, 5, "prefix", F.col("pattern"), "allow", x % 200))
    )


_SQL["op1_urls"] = f"""WITH captures AS (
  SELECT page_id, url, DATE '{FIRST_DAY}' + CAST(page_id % 500 AS INTEGER) AS day,
         rtrim(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
places AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS part FROM captures WHERE host <> ''),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS x FROM places),
paths AS (SELECT host || '/' || part AS pattern, CAST('0x' || substr(md5(host || '/' || part), 1, 4) AS INTEGER) AS x
          FROM places WHERE part <> ''),
listed AS (
  SELECT 'domain' AS kind, host AS pattern, 'block' AS action, x % 300 AS n FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT 'domain', host, 'delist', x % 300 + 60 FROM hosts WHERE x % 6 = 0
  UNION ALL SELECT 'domain', host, 'block', x % 300 + 150 FROM hosts WHERE x % 12 = 0
  UNION ALL SELECT 'domain', regexp_replace(host, '^[^.]*\\.', ''), 'block', x % 500 FROM hosts WHERE x % 40 = 0
  UNION ALL SELECT 'prefix', pattern, 'allow', x % 200 FROM paths WHERE x % 5 = 0),
daily AS (
  SELECT kind, pattern, DATE '{FIRST_DAY}' + n AS dated,
         arg_max(action, list_position(['delist', 'allow', 'block'], action)) AS action
  FROM listed GROUP BY ALL),
intervals AS (
  SELECT *, lead(dated) OVER (PARTITION BY kind, pattern ORDER BY dated) AS ended FROM daily),
active AS (
  SELECT DISTINCT url, day, kind, pattern, action FROM captures JOIN intervals
    ON action <> 'delist' AND day >= dated AND (ended IS NULL OR day < ended)
   AND CASE kind WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
       ELSE starts_with(host || path || '/', pattern || '/') END),
judged AS (
  SELECT url, day, arg_max(action, (kind = 'prefix')::INT * 100000 + length(pattern)) AS action,
         arg_max(pattern, (kind = 'prefix')::INT * 100000 + length(pattern)) AS pattern, count(*) AS n
  FROM active GROUP BY url, day)
SELECT page_id, host, coalesce(action, 'allow') AS verdict, pattern AS decided_by, coalesce(n, 0) AS n_active
FROM captures LEFT JOIN judged USING (url, day)"""


@query
def op1_urls(spark, d):
    """All pages against the list of the day they were fetched; the days come from the page ids."""
    pages = table(spark, d, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") % 500).cast("int"))
    judged = urls.filter_urls(pages.withColumn("fetched", fetched), url_list(pages))
    host = F.coalesce(urls.host_of(F.col("url")), F.lit(""))
    return judged.select("page_id", host.alias("host"), "verdict", "decided_by", "n_active")


SHARDS = 40


@query
def op2_sharding(spark, d):
    """All documents into 40 shards whose row counts are at most one apart."""
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = sharding.shard_rows(sized, ["doc_id", "size", "text_crc32"], SHARDS, seed=2)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


@query
def op3_pieces(spark, d):
    """All documents in SentencePiece pieces, with their four best segmentations."""
    encoded = pieces.encode_pieces(table(spark, d, "documents"), most=4, keep_ids=False)
    return encoded.select("doc_id", F.col("nbest.score").alias("scores"), F.col("nbest.n_ids").alias("n_ids"), F.col("nbest.ids_crc32").alias("ids_crc32"), "round_trip")


@query
def op4_simhash(spark, d):
    """All documents in components of fingerprints with at most two differing bits."""
    groups = simhash.simhash_groups(table(spark, d, "documents"), most=2)
    digits = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op5_substring(spark, d):
    """All documents without the 13-word windows that an earlier document has."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    done = substring.remove_repeats(docs, window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_quality(spark, d):
    """All documents judged by weakly supervised rules."""
    judged = quality.judge_quality(table(spark, d, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


@query
def op7_pii(spark, d):
    """Personal data of all documents, and the terms that reveal it."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = pii.sanitise(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(pii.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        pii.span_list(F.concat("base_spans", "term_spans")).alias("spans"),
    )


@query
def op8_toxicity(spark, d):
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = table(spark, d, "documents")
    sample = toxicity.labelled_sample(docs, table(spark, d, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit_toxicity(sample))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op9_embeddings(spark, d):
    """All vectors in components of cosine 0.9 or more."""
    return embeddings.near_duplicates(table(spark, d, "embeddings"), least=0.9)


@query
def op10_packing(spark, d):
    """All documents into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, d, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by a hash of its id, is periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    every = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = every.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query
def op11_periods(spark, d):
    """All documents, every tenth made periodic, with their runs of 12 words or more and without the repeats."""
    docs = with_repeats(table(spark, d, "documents"))
    found = periods.period_runs(docs, least=12).withColumn("best", periods.longest_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op12_byte_bpe(spark, d):
    """All documents in byte-level pieces of the public 50k vocabulary for many languages, and back."""
    import public_tokenizers

    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    vocabulary = bytebpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    documents = table(spark, d, "documents").select("doc_id", "text")
    encoded = bytebpe.encode_by_task(documents, vocabulary, keep=["doc_id"], form="bytes")
    return encoded.select(
        "doc_id",
        F.col("ids.n").alias("n_tokens"),
        F.sha2("ids.packed", 256).alias("ids_sha256"),
        F.sha2("ids.decoded", 256).alias("decoded_sha256"),
    )


_SQL["op13_importance"] = """WITH read AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
spread AS (SELECT side, doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
           FROM (SELECT side, doc_id, unnest(words) AS w FROM read)),
bytes AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
named AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM spread)),
hashed AS (
  SELECT w, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(length(x) // 2),
      lambda k: ('0x' || substr(x, CAST(2 * k + 1 AS INTEGER), 2))::UBIGINT),
      lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]))) % 10000 AS bucket
  FROM named, bytes),
counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
            FROM spread JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS ss, coalesce(sum(t), 0)::BIGINT AS tt FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain
          FROM counted, totals),
weighed AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
            FROM spread JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)"""


@query
def op13_importance(spark, d):
    """All documents with their rank in a draw of a tenth that resembles the benchmark."""
    drawn = importance.resample(table(spark, d, "documents"), table(spark, d, "benchmark"), seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def pipeline(spark, d):
    """Toxicity, near copies, repeated windows, personal data, packing: each on what the last kept."""
    return corpus_pipeline.run(spark, d)


if corpus_pipeline.ORACLE_SQL is not None:
    _SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
