"""Scans and sinks. Files to scan are first written from the driver tables to the shared folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from standflow.session import scratch_path
from standflow.sources import sinks, tables

from .bindings import DECADES, SCENARIOS, SPECIES, query, r6, shared, table


@query("union_tables", """
    SELECT event_id AS id, user_id, value, 'simulation_events' AS source_table FROM events
    UNION ALL
    SELECT o_orderkey, o_custkey, NULL, 'simulation_orders' FROM orders""")
def _(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "value")
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")
    )
    named = {
        "simulation_events": events, "simulation_orders": orders,
        "metadata_all": table(spark, d, "customer"),
    }
    return tables.union_tables(spark, named)


@query("read_table", """
    SELECT CAST(c_custkey AS INTEGER) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
           c_acctbal FROM customer""")
def _(spark, d):
    schema = T.StructType.fromDDL("c_custkey int, c_nationkey string, c_acctbal double")
    return tables.read_table(spark, f"{d}/customer.parquet", schema)


@query("scan_by_id_list", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN
    (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ids = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("l_orderkey")
    )
    return tables.scan_by_id_list(lines, ids, "l_orderkey")


@query("read_csv_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    path = scratch_path(spark, "csv")
    df = table(spark, d, "supplier")
    df.write.csv(path, header=True)
    return tables.read_csv_table(spark, path, df.schema)


@query("read_delim_per_key", """
    SELECT point_id, edge, round(MAT_avg, 6) AS MAT_avg, ANP_avg, species FROM {b_edges}""")
def _(spark, d):
    path = scratch_path(spark, "edges")
    edges = shared(spark, d, "b_edges").withColumnRenamed("species", "range_edges_df")
    edges.write.partitionBy("range_edges_df").csv(path, sep=" ", header=True, nullValue="NA")
    schema = T.StructType.fromDDL("point_id bigint, edge string, MAT_avg double, ANP_avg double")
    return r6(tables.read_delim_per_key(
        spark, f"{path}/*/*.csv", "range_edges_df=([A-Za-z_]+)/", schema
    ), "MAT_avg")


@query("ingest_arrow_files", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem""")
def _(spark, d):
    path = scratch_path(spark, "arrow")
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    sinks.write_arrow_files(df, path).count()
    return tables.ingest_arrow_files(spark, f"{path}/*.arrow", df.schema)


@query("read_parquet_set", """
    SELECT event_id, user_id, CASE WHEN value > 20 THEN value END AS value FROM events
    WHERE value > 20""")
def _(spark, d):
    path = scratch_path(spark, "set")
    events = table(spark, d, "events").select(
        "event_id", "user_id", F.when(F.col("value") > 20, F.col("value")).alias("value"),
        "event_type",
    )
    events.write.partitionBy("event_type").parquet(path)
    return tables.read_parquet_set(spark, f"{path}/*/*.parquet")


_PARSED = r"""
    SELECT s_suppkey, path, regexp_replace(s, '^(prep|pred)_', '') AS species, decade, scenario,
           CASE WHEN starts_with(s, 'prep_') THEN 'prep' WHEN starts_with(s, 'pred_') THEN 'pred'
                ELSE 'raw' END AS kind
    FROM (SELECT *, regexp_extract(path, '/(\w*)_[0-9]{4}-[0-9]{4}_', 1) AS s,
                 regexp_extract(path, '_([0-9]{4}-[0-9]{4})_', 1) AS decade,
                 replace(regexp_extract(path, '_[0-9]{4}-[0-9]{4}_([-\w]*)[.]', 1),
                         '_all_grids_v8', '') AS scenario FROM {b_paths}) p
    WHERE s <> ''"""


@query("parse_file_dimensions", _PARSED)
def _(spark, d):
    return tables.parse_file_dimensions(shared(spark, d, "b_paths"))


@query("dimension_grid", f"""
    SELECT * FROM ({_PARSED}) q
    WHERE species IN {SPECIES[:5]} AND decade IN {DECADES[2:]} AND scenario IN {SCENARIOS[:2]}""")
def _(spark, d):
    parsed = tables.parse_file_dimensions(shared(spark, d, "b_paths"))
    dims = {"species": SPECIES[:5], "decade": DECADES[2:], "scenario": SCENARIOS[:2]}
    return tables.dimension_grid(spark, dims, parsed)


@query("write_table_overwrite", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def _(spark, d):
    path = scratch_path(spark, "table")
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                          "o_totalprice")
    sinks.write_table_overwrite(df.limit(0), path)
    return sinks.write_table_overwrite(df, path)


@query("write_csv_result", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return sinks.write_csv_result(df, scratch_path(spark, "result"))


# the second write replaces the folders of one event type only
@query("write_partitioned_dataset", """
    SELECT event_id, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value,
           event_type FROM events""")
def _(spark, d):
    path = scratch_path(spark, "parts")
    df = table(spark, d, "events").select("event_id", "value", "event_type")
    sinks.write_partitioned_dataset(df, path, ["event_type"])
    again = df.where("event_type = 'click'").withColumn("value", F.col("value") + 1)
    return sinks.write_partitioned_dataset(again, path, ["event_type"])


@query("write_predictions", """
    SELECT point_id, pred_state_1, species, timestep AS decade, rcp AS scenario,
           state AS init_state FROM {b_predictions}""")
def _(spark, d):
    df = shared(spark, d, "b_predictions").select(
        "point_id", "pred_state_1", "species", F.col("timestep").alias("decade"),
        F.col("rcp").alias("scenario"), F.col("state").alias("init_state"),
    )
    path = scratch_path(spark, "predictions")
    return sinks.write_predictions(df, path, ["species", "decade", "scenario"])
