"""Headers, previews, unreadable lines, settings, charts, completeness and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import events as ev
from ..operators import rollups as ru
from ..sources import config, readers, writers
from .registry import Tables, query

c = F.col


@query(
    "SRC3_csv_header",
    """
SELECT 'nation' AS file, CAST(i AS INTEGER) AS i, ['n_nationkey', 'n_name', 'n_regionkey'][i + 1] AS column_name FROM range(3) r(i)
UNION ALL SELECT 'region', i, ['r_regionkey', 'r_name'][i + 1] FROM range(2) r(i)
UNION ALL SELECT 'empty', i, ['c_custkey', 'c_name'][i + 1] FROM range(2) r(i)
""",
)
def csv_header(t: Tables):
    """Headers alone, of a file without rows too."""
    at, out = t.scratch(), []
    for name, df in (("nation", t.nation), ("region", t.region), ("empty", t.customer.where("false").select("c_custkey", "c_name"))):
        writers.write_csv(df, f"{at}/{name}")
        out += [(name, i, x) for i, x in enumerate(readers.csv_columns(t.spark, f"{at}/{name}"))]
    return t.spark.createDataFrame(out, "file string, i int, column_name string")


@query("SNK2_empty_header", "SELECT 'c_custkey,c_name' AS line")
def empty_header(t: Tables):
    """The file's own lines."""
    writers.write_csv(t.customer.where("false").select("c_custkey", "c_name"), at := t.scratch())
    return t.spark.read.text(at).select(c("value").alias("line"))


@query("SRC11_count_unreadable", "SELECT n_regionkey, count(*) FILTER (n_nationkey % 3 = 0) AS unreadable FROM nation GROUP BY 1")
def unreadable(t: Tables):
    """Lines that were cut off, by the folder that holds them."""
    line = F.to_json(F.struct("n_nationkey", "n_name"))
    cut = t.nation.select("n_regionkey", F.when(c("n_nationkey") % 3 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value"))
    cut.write.partitionBy("n_regionkey").text(at := t.scratch())
    counted = readers.count_unreadable(t.spark, at)
    return counted.groupBy(F.regexp_extract("file", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey")).agg(F.sum("unreadable").alias("unreadable"))


@query(
    "SRC12_glob_dir_file",
    """
SELECT 'folder' AS how, n_nationkey, n_name FROM nation
UNION ALL SELECT 'glob', n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2)
UNION ALL SELECT 'file', n_nationkey, n_name FROM nation WHERE n_regionkey = 4
UNION ALL SELECT 'top', n_nationkey, n_name FROM nation WHERE n_regionkey = 4
""",
)
def glob_dir_file(t: Tables):
    """A folder with what is below it, a pattern, one file, and a folder without what is below it."""
    at = t.scratch()
    for r in (0, 1, 2, 3):
        t.nation.where(c("n_regionkey") == r).select("n_nationkey", "n_name").coalesce(1).write.json(f"{at}/r{r}")
    t.nation.where("n_regionkey = 4").select("n_nationkey", "n_name").coalesce(1).write.mode("append").json(f"{at}")
    schema = "n_nationkey bigint, n_name string"
    top = readers.scan_any(t.spark, at, schema)
    ways = (("folder", readers.scan_any(t.spark, at, schema, recursive=True)), ("glob", readers.scan_any(t.spark, f"{at}/r[12]", schema)), ("file", readers.scan_any(t.spark, top.inputFiles()[0], schema)), ("top", top))
    out = None
    for how, df in ways:
        part = df.select(F.lit(how).alias("how"), "n_nationkey", "n_name")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "SRC14_preview",
    """
    SELECT 0 AS line, 'c_custkey' AS a, 'c_name' AS b UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), CAST(c_custkey
    AS VARCHAR), c_name FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5)
    """,
)
def preview(t: Tables):
    """The header and the first rows of a file, as text."""
    writers.write_csv(t.customer.select("c_custkey", "c_name").orderBy("c_custkey").coalesce(1), at := t.scratch())
    return t.spark.createDataFrame([(i, *row) for i, row in enumerate(readers.preview(t.spark, at, 5))], "line int, a string, b string")


SETTINGS = """
# what the caller may leave out
horizon: 24
model:
  name: "small: one"   # quoted
  rate: 0.5
  stops:
    - end
    - 'next'
demo: false
limit: null
"""


@query(
    "SRC15_config",
    """SELECT k, v FROM (VALUES ('horizon', '48'), ('stride', '2'), ('model.name', 'small: one'), ('model.rate', '0.5'), ('model.stops', '["end", "next"]'), ('model.size', '8'), ('demo', 'false'), ('limit', 'null')) x(k, v)""",
)
def settings(t: Tables):
    """Defaults, under a YAML file, under what the caller gives."""
    t.spark.createDataFrame([(SETTINGS,)], "value string").coalesce(1).write.text(at := t.scratch())
    own = config.load_config({"horizon": 12, "stride": 2, "model": {"name": "none", "size": 8}}, text=readers.read_text(t.spark, at), horizon=48)
    return t.spark.createDataFrame(list(config.flat(own).items()), "k string, v string")


@query(
    "SNK11_chart_frames",
    """
    SELECT 'bin ' || CAST(floor(value / 10) AS BIGINT) AS label, count(*) AS n, round(200.0 * count(*) / max(count(*))
    OVER (), 2) AS height FROM events WHERE value IS NOT NULL GROUP BY 1
    """,
)
def chart_frames(t: Tables):
    """A bar chart is drawn into a file; label, number and height are read from the drawing."""
    bars = t.events.where("value IS NOT NULL").groupBy(F.concat(F.lit("bin "), F.floor(c("value") / 10).cast("string")).alias("label")).agg(F.count("*").alias("n"))
    writers.write_bar_chart(bars, at := t.scratch(), "label", "n", title="Events by value")
    drawn = t.spark.read.text(at).where(c("value").startswith("<rect class=\"bar\""))
    part = lambda name: F.regexp_extract("value", f' {name}="([^"]*)"', 1)
    return drawn.select(part("data-label").alias("label"), part("data-value").cast("double").cast("long").alias("n"), part("height").cast("double").alias("height"))


@query(
    "JOI19_completeness",
    """
    SELECT doc_id, source, have, bool_and(have) OVER (PARTITION BY source) AS complete FROM (SELECT d.doc_id, d.source,
    l.doc_id IS NOT NULL AS have FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)
    """,
)
def completeness(t: Tables):
    """Which documents are done, and of which sources all are."""
    done = t.labels.select("doc_id", F.lit(True).alias("have")).distinct()
    each = t.documents.select("doc_id", "source").join(done, "doc_id", "left").withColumn("have", F.coalesce("have", F.lit(False)))
    sources = each.groupBy(c("source").alias("s")).agg(F.bool_and("have").alias("complete"))
    return each.join(sources, c("source").eqNullSafe(c("s"))).drop("s")


@query(
    "JOI20_task_grid",
    """
    SELECT task, model, n_nationkey, o_orderkey FROM (VALUES ('sort'), ('cloze')) a(task), (VALUES ('m1'), ('m2'), ('m3'))
    b(model), nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    """,
)
def task_grid(t: Tables):
    """Tasks and models are given lists: every entity's row is repeated for them, and meets its items by key."""
    grid = t.nation.select("n_nationkey", F.explode(F.array(F.lit("sort"), F.lit("cloze"))).alias("task")).withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))))
    items = t.customer.join(t.orders, c("o_custkey") == c("c_custkey")).select(c("c_nationkey").alias("n_nationkey"), "o_orderkey")
    return grid.join(items, "n_nationkey").select("task", "model", "n_nationkey", "o_orderkey")


@query(
    "AGG10_two_level_nesting",
    """
    SELECT l_orderkey, string_agg(g, ';' ORDER BY g) AS nested FROM (SELECT l_orderkey, l_returnflag || ':' || string_agg(CAST(l_partkey
    AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS g FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY
    1
    """,
)
def two_level_nesting(t: Tables):
    inner = ev.nested(t.lineitem, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"], ["l_partkey"])
    outer = ev.nested(inner, ["l_orderkey"], ["l_returnflag"], ["l_returnflag", "items"], "groups")
    told = lambda g: F.concat(g.l_returnflag, F.lit(":"), F.array_join(F.transform(g["items"], lambda x: x.l_partkey.cast("string")), ","))
    return outer.select("l_orderkey", F.array_join(F.transform("groups", told), ";").alias("nested"))


@query("AGG32_reconciliation", "SELECT user_id FROM events GROUP BY 1 HAVING user_id % 9 IN (0, 1)")
def reconciliation(t: Tables):
    """Summaries come from a file in which some means and some counts are off."""
    per_user = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    per_user.withColumns({"m": F.when(c("user_id") % 9 == 0, c("m") + 1).otherwise(c("m") + 0.001), "n": F.when(c("user_id") % 9 == 1, c("n") - 1).otherwise(c("n"))}).write.json(at := t.scratch())
    stored = t.spark.read.schema("user_id bigint, m double, n bigint").json(at)
    return ru.disagreements(per_user, stored, ["user_id"], "m", "n")


@query(
    "AUX27_required_columns",
    """
SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'kind', event_type FROM events
UNION ALL SELECT NULL, 'missing', 'absent'
""",
)
def required_columns(t: Tables):
    """Parameters written as text become rows; columns that a table must have and lacks are named."""
    told = F.concat(F.lit(" k = "), F.get_json_object("props", "$.k"), F.lit(";kind=  "), c("event_type"), F.lit("; ; note"))
    rows = t.events.select("event_id", F.explode(texts.parameters(told)).alias("name", "value"))
    missing = readers.missing_columns(t.events, ["user_id", "ts", "absent"])
    return rows.unionByName(t.spark.createDataFrame([(None, "missing", x) for x in missing], "event_id bigint, name string, value string"))


@query("AUX25_prompts", "SELECT n_nationkey, 'Nation ' || n_name || ' of {region}' AS prompt, 'Say {it}.' AS plain FROM nation")
def prompts(t: Tables):
    """A prompt's named places are filled from columns; places that aren't given, and prompts without arguments, stay as they are."""
    return t.nation.select("n_nationkey", texts.prompt("Nation {name} of {region}", name=c("n_name")).alias("prompt"), texts.prompt("Say {it}.").alias("plain"))


@query(
    "AUX26_validators",
    """
    SELECT user_id, bool_or(event_type = 'signup') AS has_terminal, count(*) FILTER (event_type = 'error') AS flagged
    FROM events GROUP BY 1
    """,
)
def validators(t: Tables):
    """Whether each entity has its terminal event, and how many of its rows a scan flags."""
    return ru.audit(t.events, "user_id", terminal=c("event_type") == "signup", flag=c("event_type").rlike("^err"))


@query("AUX30_file_iteration", "SELECT n_regionkey, count(*) * 2 AS bytes FROM nation GROUP BY 1")
def file_iteration(t: Tables):
    """Text files below a folder, with their sizes."""
    t.nation.select("n_regionkey", F.lit("x").alias("value")).repartition(1, "n_regionkey").write.partitionBy("n_regionkey").text(at := t.scratch())
    found = readers.files_below(t.spark, at, "*.txt")
    return found.groupBy(F.regexp_extract("file", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey")).agg(F.sum("bytes").alias("bytes"))


@query("AUX37_safe_length", "SELECT doc_id, coalesce(length(CASE WHEN doc_id % 2 = 0 THEN text END), 0) AS n, coalesce(len(CASE WHEN doc_id % 3 = 0 THEN string_split(text, ' ') END), 0) AS parts FROM documents")
def safe_length(t: Tables):
    """The length of a text or a list, 0 where there is none."""
    text, parts = F.when(c("doc_id") % 2 == 0, c("text")), F.when(c("doc_id") % 3 == 0, F.split("text", " "))
    return t.documents.select("doc_id", texts.safe_length(text).cast("long").alias("n"), texts.safe_length(parts, array=True).cast("long").alias("parts"))
