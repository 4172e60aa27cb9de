"""The given tables seen as a graph, in Spark and in SQL.

Regions and nations are directories, customers and suppliers files, orders code blocks, line items
raw edges from orders to suppliers, parts symbols. ``NODES``, ``RAW``, ... are the same
projections as SQL common table expressions, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import hierarchy
from loomgraph.shared import broadcast_if_few

#: Suppliers that are broadcast at most; of more, edges are shuffled to them.
FEW_SUPPLIERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.withColumn("nation_id", F.concat_ws("/", "r_name", "n_name"))


def customer_files(spark: SparkSession, d: str) -> DataFrame:
    language = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Python")
        .when(F.col("c_mktsegment") == "BUILDING", "TypeScript")
        .when(F.col("c_mktsegment") == "FURNITURE", "JavaScript")
        .when(F.col("c_mktsegment") == "MACHINERY", "Rust")
    )
    joined = table(spark, d, "customer").join(_places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "c_custkey", F.concat_ws("/", "nation_id", "c_name").alias("id"), F.col("c_name").alias("name"), language.alias("language")
    )


def supplier_files(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "supplier").join(_places(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "nation_id", F.concat_ws("/", "nation_id", "s_name").alias("id"), F.col("s_name").alias("name"))


def order_blocks(spark: SparkSession, d: str) -> DataFrame:
    files = customer_files(spark, d).select("c_custkey", F.col("id").alias("file_path"))
    kind = F.when(F.col("o_orderstatus") == "F", "Function").when(F.col("o_orderstatus") == "O", "Class").otherwise("Struct")
    orders = table(spark, d, "orders").join(files, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        "o_orderkey",
        paths.block_id(F.col("file_path"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("id"),
        F.col("o_orderpriority").alias("name"),
        kind.alias("kind"),
        "file_path",
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    text = lambda v=None: F.lit(v).cast("string")
    row = lambda id_, type_, name, language, kind, file_path, ordinal: [
        id_.alias("id"), F.lit(type_).alias("type"), name.alias("name"), language.alias("language"), kind.alias("kind"),
        file_path.alias("file_path"), ordinal.cast("long").alias("child_ordinal"),
    ]
    c = F.col
    root = spark.range(1).select(*row(F.lit(""), "Directory", F.lit(""), text(), text(), text(), F.lit(0)))
    regions = table(spark, d, "region").select(*row(c("r_name"), "Directory", c("r_name"), text(), text(), text(), c("r_regionkey")))
    nations = _places(spark, d).select(*row(c("nation_id"), "Directory", c("n_name"), text(), text(), text(), c("n_nationkey")))
    customers = customer_files(spark, d).select(*row(c("id"), "File", c("name"), c("language"), text(), c("id"), c("c_custkey")))
    suppliers = supplier_files(spark, d).select(*row(c("id"), "File", c("name"), text(), text(), c("id"), c("s_suppkey")))
    orders = order_blocks(spark, d).select(*row(c("id"), "CodeBlock", c("name"), text(), c("kind"), c("file_path"), c("o_orderkey")))
    every = root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(suppliers).unionByName(orders)
    return hierarchy.with_ancestors(every).withColumn("path", F.when(c("type") != "CodeBlock", c("id")))


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge per line item from its order to its supplier; weight 1, ``quantity`` beside it."""
    kind = F.when(F.col("l_returnflag") == "A", "FunctionCall").when(F.col("l_returnflag") == "N", "MethodCall").otherwise("TypeReference")
    source = order_blocks(spark, d).select("o_orderkey", F.col("id").alias("source"))
    target = broadcast_if_few(supplier_files(spark, d).select("s_suppkey", F.col("id").alias("target")), FEW_SUPPLIERS)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", kind.alias("kind"), F.col("l_quantity").cast("long").alias("quantity"))
    joined = lines.join(source, F.col("l_orderkey") == F.col("o_orderkey")).join(target, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        "source", "target", "kind", F.lit(1).cast("long").alias("weight"), (F.col("l_orderkey") * 10000 + F.col("l_suppkey")).alias("seq"), "quantity"
    )


def visible(all_nodes: DataFrame) -> DataFrame:
    return all_nodes.filter(VISIBLE).select("id")


def expanded(all_nodes: DataFrame) -> DataFrame:
    return all_nodes.filter(EXPANDED.replace("len(ancestors)", "size(ancestors)")).select("id")


def directories(all_nodes: DataFrame) -> DataFrame:
    return all_nodes.filter("type = 'Directory' and id <> ''").select("id")


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        paths.block_id(F.col("p_brand"), F.col("p_name"), F.col("p_partkey")).alias("id"),
        F.lit("CodeBlock").alias("type"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("file_path"),
    )


def raw_refs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    suppliers = supplier_files(spark, d).select("s_suppkey", F.col("nation_id").alias("from_node"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    turn = F.col("l_linenumber") % 3
    return joined.select(
        "from_node",
        F.when(turn == 0, "FunctionCall").when(turn == 1, "MethodCall").otherwise("TypeReference").alias("kind"),
        F.when(turn == 0, F.concat("p_brand", F.lit("::"), "p_name"))
        .when(turn == 1, F.concat(F.lit("x."), "p_name"))
        .otherwise(F.concat("p_name", F.lit("<T>")))
        .alias("name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        "p_name",
        "p_brand",
    )


def page_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), "/+$", "")
    segment = F.substring_index(path, "/", 1)
    language = F.when(segment == "en", "TypeScript").when(segment == "de", "Python").when(segment == "fr", "Rust")
    return table(spark, d, "pages").select(path.alias("id"), path.alias("path"), language.alias("language")).distinct()


def page_imports(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), "/+$", "")
    n = (F.col("page_id") * 37 % 1000).cast("string")
    modules = F.array(
        F.concat(F.lit("./"), n),
        F.concat(F.lit("../fr/"), n),
        F.concat(F.lit("en."), n),
        F.concat(F.lit("crate::en::"), n),
        F.concat(F.lit("es/"), n),
        F.regexp_extract("html", 'href="([^"]*)"', 1),
    )
    return table(spark, d, "pages").select("page_id", path.alias("file_path"), F.explode(modules).alias("module_path"))


def events(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    of = lambda name, value: F.when(t == name, value)
    return (
        table(spark, d, "events")
        .filter(t.isin("signup", "purchase", "error", "view"))
        .select(
            F.col("user_id").cast("string").alias("run_id"),
            F.col("event_id").alias("seq"),
            of("signup", "FileStart").when(t == "purchase", "FileDone").when(t == "error", "Error").otherwise("Complete").alias("type"),
            F.when(t != "view", F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("path"),
            of("purchase", F.get_json_object("props", "$.k").cast("long")).alias("blocks"),
            of("error", F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("message"),
            of("view", F.col("event_id") % 100).alias("total_files"),
            of("view", F.col("event_id") % 1000).alias("total_blocks"),
        )
    )


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    """All events with their times; a click starts a run."""
    t = F.col("event_type")
    starts = table(spark, d, "events").filter(t == "click").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.lit("Start").alias("type"))
    every = events(spark, d).unionByName(starts, allowMissingColumns=True)
    return every.join(table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts"), "seq")


VISIBLE = "not (type = 'File' and child_ordinal % 7 = 3) and not (coalesce(container_id, '-') = '' and child_ordinal = 2)"
EXPANDED = "(type = 'Directory' and not (len(ancestors) = 2 and child_ordinal % 3 = 1)) or (type = 'File' and child_ordinal % 2 = 0)"

PLACES = "places AS (SELECT n_nationkey, n_name, r_name, r_name || '/' || n_name AS nation_id FROM nation JOIN region ON n_regionkey = r_regionkey)"
FILES = """cf AS (SELECT c_custkey, nation_id, r_name, nation_id || '/' || c_name AS id, c_name AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Python' WHEN 'BUILDING' THEN 'TypeScript' WHEN 'FURNITURE' THEN 'JavaScript'
                    WHEN 'MACHINERY' THEN 'Rust' END AS language
  FROM customer JOIN places ON c_nationkey = n_nationkey),
sf AS (SELECT s_suppkey, nation_id, r_name, nation_id || '/' || s_name AS id, s_name AS name FROM supplier JOIN places ON s_nationkey = n_nationkey)"""
BLOCKS = """ob AS (SELECT o_orderkey, cf.id || '::' || o_orderpriority || '@' || o_orderkey AS id, o_orderpriority AS name,
  CASE o_orderstatus WHEN 'F' THEN 'Function' WHEN 'O' THEN 'Class' ELSE 'Struct' END AS kind, cf.id AS file_path, nation_id, r_name
  FROM orders JOIN cf ON o_custkey = c_custkey)"""
TREE = f"{PLACES}, {FILES}, {BLOCKS}"
NODES = f"""{TREE}, nodes AS (
  SELECT '' AS id, 'Directory' AS type, '' AS name, NULL::VARCHAR AS language, NULL::VARCHAR AS kind, NULL::VARCHAR AS file_path,
         0::BIGINT AS child_ordinal, NULL::VARCHAR AS container_id, []::VARCHAR[] AS ancestors
  UNION ALL SELECT r_name, 'Directory', r_name, NULL, NULL, NULL, r_regionkey, '', [''] FROM region
  UNION ALL SELECT nation_id, 'Directory', n_name, NULL, NULL, NULL, n_nationkey, r_name, ['', r_name] FROM places
  UNION ALL SELECT id, 'File', name, language, NULL, id, c_custkey, nation_id, ['', r_name, nation_id] FROM cf
  UNION ALL SELECT id, 'File', name, NULL, NULL, id, s_suppkey, nation_id, ['', r_name, nation_id] FROM sf
  UNION ALL SELECT id, 'CodeBlock', name, NULL, kind, file_path, o_orderkey, file_path, ['', r_name, nation_id, file_path] FROM ob)"""
RAW = """raw AS (SELECT ob.id AS source, sf.id AS target, 1::BIGINT AS weight, CAST(l_quantity AS BIGINT) AS quantity,
  CASE l_returnflag WHEN 'A' THEN 'FunctionCall' WHEN 'N' THEN 'MethodCall' ELSE 'TypeReference' END AS kind,
  l_orderkey * 10000 + l_suppkey AS seq
  FROM lineitem JOIN ob ON l_orderkey = o_orderkey JOIN sf ON l_suppkey = s_suppkey)"""
VIEW = f"visible AS (SELECT id FROM nodes WHERE {VISIBLE}), expanded AS (SELECT id FROM nodes WHERE {EXPANDED})"
SHOWN = """opened AS (SELECT id FROM visible INTERSECT SELECT id FROM expanded),
shown AS (SELECT * FROM nodes WHERE id <> '' AND id IN (SELECT id FROM visible)
  AND id NOT IN (SELECT i FROM (SELECT id AS i, unnest(ancestors) AS a FROM nodes) WHERE a <> '' AND a NOT IN (SELECT id FROM opened)))"""
#: Nearest container in ``lifted_to(id)``.
PLACE = """place AS (SELECT id, arg_max(c, depth) AS shown_id FROM (
    SELECT id, unnest(list_append(ancestors, id)) AS c, unnest(range(0, len(ancestors) + 1)) AS depth FROM nodes)
  WHERE c IN (SELECT id FROM lifted_to) GROUP BY id)"""
ROLLED = f"""lifted_to AS (SELECT id FROM nodes WHERE type = 'Directory' AND id <> ''), {PLACE},
up AS MATERIALIZED (SELECT place.shown_id AS s, raw.* FROM raw JOIN place ON source = place.id),
across AS MATERIALIZED (SELECT place.shown_id AS t, up.* FROM up JOIN place ON target = place.id),
lifted AS (SELECT * FROM across WHERE s <> t AND NOT (s = source AND t = target)),
firsts AS (SELECT s, t, kind FROM (SELECT s, t, kind, row_number() OVER (PARTITION BY s, t ORDER BY seq, kind) AS k FROM lifted) WHERE k = 1),
rolled AS (SELECT s AS source, t AS target, firsts.kind AS kind, CAST(count(*) AS BIGINT) AS count, CAST(sum(weight) AS BIGINT) AS weight
  FROM lifted JOIN firsts USING (s, t) GROUP BY s, t, firsts.kind)"""
PARTS = "parts AS (SELECT p_brand || '::' || p_name || '@' || p_partkey AS id, p_name, p_brand FROM part)"
SYMBOLS = f"{PARTS}, symbols AS (SELECT p_name AS symbol, id AS node_id FROM parts UNION ALL SELECT p_brand || '::' || p_name, id FROM parts)"
REFS = """refs AS (SELECT sf.nation_id AS from_node, l_orderkey * 10 + l_linenumber AS seq, p_name, p_brand,
  CASE l_linenumber % 3 WHEN 0 THEN 'FunctionCall' WHEN 1 THEN 'MethodCall' ELSE 'TypeReference' END AS kind,
  CASE l_linenumber % 3 WHEN 0 THEN p_brand || '::' || p_name WHEN 1 THEN 'x.' || p_name ELSE p_name || '<T>' END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sf ON l_suppkey = s_suppkey)"""
PAGE_PATH = "regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/+$', '')"
PAGE_FILES = f"""pf AS (SELECT DISTINCT path AS id, path, CASE split_part(path, '/', 1) WHEN 'en' THEN 'TypeScript' WHEN 'de' THEN 'Python'
    WHEN 'fr' THEN 'Rust' END AS language
  FROM (SELECT {PAGE_PATH} AS path FROM pages))"""
PATH_KEYS = r"""keyed AS (SELECT path AS key, id, path, 0 AS rank FROM pf
  UNION ALL SELECT regexp_replace(path, '([^/])\.[^./]*$', '\1'), id, path, 1 FROM pf),
keys AS (SELECT key, id AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, path) AS k FROM keyed) WHERE k = 1)"""
PAGE_IMPORTS = f"""imports AS (SELECT page_id, {PAGE_PATH} AS file_path, unnest(['./' || (page_id * 37 % 1000), '../fr/' || (page_id * 37 % 1000),
    'en.' || (page_id * 37 % 1000), 'crate::en::' || (page_id * 37 % 1000), 'es/' || (page_id * 37 % 1000),
    regexp_extract(html, 'href="([^"]*)"', 1)]) AS module_path FROM pages)"""
EVENTS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'FileStart' WHEN 'purchase' THEN 'FileDone' WHEN 'error' THEN 'Error' ELSE 'Complete' END AS type,
  CASE WHEN event_type <> 'view' THEN 'f' || event_id END AS path,
  CASE WHEN event_type = 'purchase' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS blocks,
  CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS message,
  CASE WHEN event_type = 'view' THEN event_id % 100 END AS total_files,
  CASE WHEN event_type = 'view' THEN event_id % 1000 END AS total_blocks
  FROM events WHERE event_type IN ('signup', 'purchase', 'error', 'view'))"""
