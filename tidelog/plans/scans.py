"""Sources and sinks: tables go out through a sink and come back through a source."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import readers, versions, writers
from .registry import Tables, query

NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("SRC1_csv_scan", "SELECT c_custkey, c_acctbal FROM customer")
def csv_scan(t: Tables):
    writers.write_csv(t.customer, at := t.scratch())
    return readers.scan_csv(t.spark, at, ["c_custkey", "c_acctbal"], "c_custkey bigint, c_acctbal double")


@query("SRC2_csv_existing_columns", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_existing(t: Tables):
    writers.write_csv(t.nation, at := t.scratch())
    return readers.scan_csv_safe(t.spark, at, ["n_nationkey", "absent", "n_name"])


@query("SRC4_csv_parse_dates", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL")
def csv_dates(t: Tables):
    out = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_totalprice")
    writers.write_csv(out, at := t.scratch())
    from ..functions.times import parse_time

    return readers.scan_csv(t.spark, at, ["o_orderkey", "o_orderdate"], "o_orderkey bigint").withColumn("o_orderdate", parse_time(F.col("o_orderdate")).cast("timestamp_ntz")).dropna(subset=["o_orderdate"])


@query("SRC5_prefer_extract", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey FROM nation WHERE n_regionkey = 1")
def prefer_extract(t: Tables):
    at = t.scratch()
    writers.write_csv(t.nation, f"{at}/nation.csv")
    writers.write_csv(t.nation.where("n_regionkey = 1"), f"{at}/nation_extract.csv")
    return readers.scan_csv(t.spark, readers.prefer(t.spark, at, "nation"), ["n_nationkey"])


@query(
    "SRC6_json_documents",
    """
    SELECT user_id, event_id, event_type, false AS demo FROM events
    UNION ALL SELECT user_id, event_id, event_type, true FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY CAST(user_id AS VARCHAR) LIMIT 20)
    """,
)
def json_documents(t: Tables):
    """A document for each user: all of them, and the first twenty as a demo reads them."""
    docs = t.events.groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type")).alias("events"))
    writers.write_documents(docs, at := t.scratch())
    schema = "user_id bigint, events array<struct<event_id:bigint,event_type:string>>"
    read = lambda first: readers.scan_documents(t.spark, at, schema, recursive=True, first=first, name="user_id").select("user_id", F.inline("events"))
    return read(None).withColumn("demo", F.lit(False)).unionByName(read(20).withColumn("demo", F.lit(True)))


@query("SRC7_recursive_scan", "SELECT r_regionkey, r_name FROM region")
def recursive(t: Tables):
    t.region.write.json(f"{(at := t.scratch())}/a/b")
    return t.spark.read.schema("r_regionkey bigint, r_name string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(at)


@query("SRC8_jsonl_strict", NATION)
def jsonl_strict(t: Tables):
    t.nation.write.json(at := t.scratch())
    return readers.scan_jsonl(t.spark, at, "n_nationkey bigint, n_name string, n_regionkey bigint")


def _dirty(t: Tables) -> str:
    rows = t.region.select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value"))
    bad = t.spark.createDataFrame([("{broken",), ("[1, 2]",), ("7",)], "value string")
    rows.unionByName(bad).write.text(at := t.scratch())
    return at


@query("SRC9_jsonl_skip_bad", "SELECT r_regionkey, r_name FROM region")
def jsonl_skip(t: Tables):
    return readers.scan_jsonl(t.spark, _dirty(t), "r_regionkey bigint, r_name string", "skip")


@query("SRC10_jsonl_wrap", "SELECT r_name, NULL AS value FROM region UNION ALL SELECT NULL, v FROM (VALUES ('{broken'), ('[1, 2]'), ('7')) x(v)")
def jsonl_wrap(t: Tables):
    return readers.scan_jsonl(t.spark, _dirty(t), "r_regionkey bigint, r_name string", "mark").select("r_name", F.col("_value").alias("value"))


@query(
    "SRC10_bad_line_numbers",
    """
    SELECT c_custkey % 3 AS part, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS line, '{broken ' || c_name AS value
    FROM customer QUALIFY c_custkey % 7 = 0
    """,
)
def bad_line_numbers(t: Tables):
    """Three files of lines, one customer a line; every seventh is no JSON, every eleventh blank."""
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("{broken "), "c_name")).when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.to_json(F.struct("c_custkey", "c_name")))
    lines = t.customer.select((F.col("c_custkey") % 3).alias("part"), "c_custkey", line.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(at := t.scratch())
    found = readers.bad_lines(t.spark, at)
    return found.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part"), "line", "value")


@query("SNK1_filtered_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_type = 'error'")
def filtered_csv(t: Tables):
    writers.write_csv(t.events.where("event_type = 'error'").select("event_id", "event_type"), at := t.scratch())
    return readers.scan_csv(t.spark, at, ["event_id"])


@query("SNK3_csv_table", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def csv_table(t: Tables):
    writers.write_csv(t.region, at := t.scratch())
    return readers.scan_csv(t.spark, at, ["r_regionkey", "r_name"])


@query("SNK4_nested_documents", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey")
def nested_documents(t: Tables):
    t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders")).write.json(at := t.scratch())
    back = t.spark.read.schema("o_custkey bigint, orders array<struct<o_orderkey:bigint,o_totalprice:double>>").json(at)
    return back.select("o_custkey", F.inline("orders")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    "SNK5_versioned_update",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, v AS version
    FROM customer, (VALUES (2)) AS t(v) UNION ALL SELECT c_custkey, c_acctbal, 1 FROM customer
    """,
)
def versioned(t: Tables):
    """Both versions, read through their manifests; the same update again makes no third one."""
    own = versions.VersionedTable(t.spark, t.scratch(), "c_custkey bigint, c_acctbal double", ["c_custkey"])
    own.upsert(t.customer.select("c_custkey", "c_acctbal"))
    for _ in range(2):
        own.upsert(t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal")))
    return functools.reduce(DataFrame.unionByName, [own.read(v).withColumn("version", F.lit(v)) for v in range(1, own.version() + 1)])


@query("SNK6_append", "SELECT n_name, CAST(2 AS BIGINT) AS n FROM nation")
def append(t: Tables):
    at = t.scratch()
    for _ in range(2):
        writers.append_jsonl(t.nation.select("n_name"), at)
    return t.spark.read.schema("n_name string").json(at).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SNK7_replace_partitions", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'X', 1")
def replace_partitions(t: Tables):
    at = t.scratch()
    own = t.nation.select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
    writers.replace_partitions(own, at, ["n_regionkey"])
    writers.replace_partitions(t.spark.createDataFrame([("X", 1)], "n_name string, n_regionkey int"), at, ["n_regionkey"])
    return t.spark.read.schema("n_name string, n_regionkey int").parquet(at)


@query(
    "SNK8_upsert",
    """
    SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS status,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders
    """,
)
def upsert(t: Tables):
    """Rows by entity, in order of their ids after some are replaced: place is a row's place among its entity's as they lie in the file."""
    own = versions.VersionedTable(t.spark, t.scratch(), "o_custkey bigint, o_orderkey bigint, status string", ["o_orderkey"], by=["o_custkey"], buckets=8)
    own.upsert(t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status")))
    own.upsert(t.orders.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey", F.lit("late").alias("status")))
    lies = own.read().select("*", F.col("_metadata.row_index").alias("at"))
    return lies.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("at")).cast("long")).drop("at")


@query(
    "SNK9_vector_table",
    "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, embedding[i] AS x FROM embeddings, range(1, 65) r(i)",
)
def vector_table(t: Tables):
    """All components, read back."""
    t.embeddings.select("vec_id", "embedding").write.parquet(at := t.scratch())
    return t.spark.read.parquet(at).select("vec_id", F.posexplode("embedding").alias("i", "x"))


@query("SNK10_resume", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM customer")
def resume(t: Tables):
    """The first run begins with nothing, the second adds the rest, the third finds all done."""
    at = t.scratch()
    for run, rows in (("first", t.customer.where("c_custkey % 3 = 0")), ("second", t.customer), ("third", t.customer)):
        writers.resume(rows.select("c_custkey", F.lit(run).alias("run")), at, ["c_custkey"])
    return t.spark.read.parquet(at)
