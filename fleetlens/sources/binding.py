"""The benchmark tables as an inventory: customers are nodes, orders reports, order lines events, parts resources and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Store

#: The moment that "now" is for the bound tables.
NOW = "2001-08-01 00:00:00"
#: Bytes of Parquet for whose rows' texts one task has room.
PER_TASK = 4_000_000


def _dealt(read: DataFrame) -> int:
    """Tasks for what the rows of these files grow to as text: that is packed so well that its size after packing tells little of it."""
    return 1 + int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PER_TASK


def bind(spark: SparkSession, sf_dir: str) -> Store:

    def t(name: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})

    md5 = lambda c: F.md5(F.col(c).cast("string"))

    def place() -> DataFrame:
        """Customers with the names of their nation and region."""
        nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        return t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def producer(key: str) -> F.Column:
        return F.concat(F.lit("producer-"), (F.col(key) % 5).cast("string"))

    def certnames() -> DataFrame:
        every = lambda n, k, x: F.when(F.col("c_custkey") % n == k, x)
        return t("customer").select(
            F.col("c_name").alias("certname"), every(20, 0, F.lit("2001-07-25").cast("timestamp")).alias("deactivated"), every(20, 1, F.lit("2001-06-01").cast("timestamp")).alias("expired"),
            every(9, 0, F.lit(False)).alias("facts_expire"), every(9, 0, F.lit("2001-01-01").cast("timestamp")).alias("facts_expire_updated"),
        )

    def stamp(days: int) -> F.Column:
        return F.timestamp_seconds(F.unix_timestamp(F.lit("2001-07-01").cast("timestamp")) + (F.col("c_custkey") % days) * 86400)

    def factsets() -> DataFrame:
        doc = F.struct(
            F.col("c_mktsegment").alias("mktsegment"), F.col("c_acctbal").alias("acctbal"), (F.col("c_custkey") * 10).alias("uptime_seconds"), (F.col("c_custkey") % 2 == 0).alias("is_virtual"),
            F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region")).alias("nation"), F.array("c_mktsegment", "r_name").alias("labels"),
            F.struct(F.col("c_name").alias("certname"), F.struct(F.col("r_name").alias("region")).alias("extensions")).alias("trusted"),
        )
        return place().select(
            F.col("c_name").alias("certname"), F.col("n_name").alias("environment"), stamp(30).alias("timestamp"), stamp(30).alias("producer_timestamp"), producer("c_custkey").alias("producer"),
            md5("c_name").alias("hash"), F.from_json(F.to_json(doc), "map<string,variant>").alias("facts"),
        )

    def reports() -> DataFrame:
        o = t("orders").join(place().select("c_custkey", "c_name", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
        agent = F.col("o_orderkey") % 10 != 0
        newest = Window.partitionBy("o_custkey", agent).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
        o = o.withColumn("latest", agent & (F.row_number().over(newest) == 1))
        shifted = lambda s: F.timestamp_micros(F.unix_micros("o_orderdate") + s * 1_000_000)
        return o.select(
            F.col("o_orderkey").alias("id"), md5("o_orderkey").alias("hash"), F.col("c_name").alias("certname"), F.col("n_name").alias("environment"), F.lit("8.1.0").alias("agent_version"),
            F.lit(12).alias("report_format"), F.concat(F.lit("v"), (F.col("o_orderkey") % 7).cast("string")).alias("configuration_version"),
            shifted(-300).alias("start_time"), F.col("o_orderdate").alias("end_time"), F.col("o_orderdate").alias("producer_timestamp"), shifted(60).alias("receive_time"),
            producer("o_orderkey").alias("producer"), F.md5(F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("transaction_uuid"),
            F.md5(F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))).alias("catalog_uuid"), F.lit(None).cast("string").alias("code_id"),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("job-"), (F.col("o_orderkey") % 100).cast("string"))).alias("job_id"),
            F.when(F.col("o_orderkey") % 2 == 0, "not_used").otherwise("on_failure").alias("cached_catalog_status"),
            F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "changed").otherwise("unchanged").alias("status"),
            F.when(agent, "agent").otherwise("plan").alias("type"), (F.col("o_orderpriority") == "5-LOW").alias("noop"), (F.col("o_orderkey") % 4 == 0).alias("noop_pending"),
            (F.col("o_orderstatus") == "F").alias("corrective_change"), F.to_json(F.array(F.struct(F.lit("time").alias("category"), F.lit("total").alias("name"), F.col("o_totalprice").alias("value")))).alias("metrics"),
            F.to_json(F.array(F.struct(F.lit("notice").alias("level"), F.col("o_orderpriority").alias("message")))).alias("logs"), "latest",
        )

    def lines() -> DataFrame:
        """Order lines with their part, order and node; by order last, so that what follows by order is not shuffled again."""
        o = t("orders").select("o_orderkey", "o_custkey")
        c = t("customer").select("c_custkey", F.col("c_name").alias("certname"))
        ordered = o.join(c, F.col("o_custkey") == F.col("c_custkey")).hint("shuffle_hash")  # narrow and by key, while sorting the lines would spill
        parts = t("part").withColumn("kind", F.initcap("p_type"))
        return t("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))

    kind = F.col("kind")
    title = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))

    def resource_events() -> DataFrame:
        skipped = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 3 == 0)
        status = F.when(F.col("l_returnflag") == "R", "failure").when(F.col("l_returnflag") == "A", "noop").when(skipped, "skipped").otherwise("success")
        return lines().select(
            F.col("l_orderkey").alias("report_id"), "certname", status.alias("status"), F.col("l_shipdate").alias("timestamp"), kind.alias("resource_type"), title.alias("resource_title"),
            F.when(~skipped, F.col("p_brand")).alias("property"), F.col("l_quantity").cast("bigint").cast("string").alias("new_value"), F.lit('"absent"').alias("old_value"),
            F.concat(F.lit("changed "), "p_name").alias("message"), F.concat(F.lit("/etc/"), F.col("p_brand")).alias("file"), F.col("l_linenumber").alias("line"),
            F.array(F.lit("Stage[main]"), F.col("p_brand"), F.concat(kind, F.lit("["), title, F.lit("]"))).alias("containment_path"), F.col("p_brand").alias("containing_class"),
            (F.col("l_linestatus") == "F").alias("corrective_change"), F.when(F.col("l_linenumber") % 2 == 0, "restart").alias("name"),
        )

    def catalogs() -> DataFrame:
        n = F.lit(None).cast("string")
        return place().select(
            F.col("c_name").alias("certname"), md5("c_name").alias("hash"), F.col("c_custkey").cast("string").alias("version"), F.md5(F.concat(F.lit("t"), "c_name")).alias("transaction_uuid"),
            F.md5(F.concat(F.lit("c"), "c_name")).alias("catalog_uuid"), n.alias("code_id"), n.alias("job_id"), F.col("n_name").alias("environment"), stamp(28).alias("producer_timestamp"), producer("c_custkey").alias("producer"),
        )

    def parameters() -> F.Column:
        """A part's parameters: the map as JSON would give it, without making and parsing it where no value is missing."""
        doc = F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.struct(F.col("p_type").alias("kind")).alias("options"))
        plain = F.col("p_size").isNotNull() & F.col("p_brand").isNotNull() & F.col("p_type").isNotNull() & F.coalesce(F.abs("p_retailprice") < float("inf"), F.lit(False))
        values = {"size": F.col("p_size").cast("variant"), "brand": F.col("p_brand").cast("variant"), "price": F.parse_json(F.when(plain, F.col("p_retailprice").cast("string"))), "options": F.to_variant_object(F.struct(F.col("p_type").alias("kind")))}
        return F.when(plain, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).otherwise(F.from_json(F.to_json(doc), "map<string,variant>"))

    tags = F.array(F.lower("p_type"), F.lower("p_brand"))
    described = [kind.alias("type"), title.alias("title"), tags.alias("tags"), (F.col("p_size") % 2 == 0).alias("exported"), F.concat(F.lit("/etc/"), F.col("p_brand")).alias("file"), F.col("p_size").alias("line"), parameters().alias("parameters")]

    def catalog_resources() -> DataFrame:
        p = lines().select("certname", "p_partkey", "p_name", "p_brand", "p_type", "kind", "p_size", "p_retailprice").repartition("certname").distinct()  # rows of a node stay together
        return p.select("certname", F.md5(F.concat(kind, title)).alias("resource"), *described)

    def catalog_texts() -> DataFrame:
        """Resources and edges of each node as the joined JSON of a catalog's lists, in one pass over the lines and with a part's JSON made once.

        Tags are written with underscores.  The rows are those of ``catalog_resources`` and ``edges``.
        """
        end = F.to_json(F.struct(kind.alias("type"), title.alias("title")))
        item = F.to_json(F.struct("type", "title", "exported", "file", "line", F.transform("tags", lambda x: F.replace(x, F.lit("#"), F.lit("_"))).alias("tags"), "parameters"))
        parts = t("part").withColumn("kind", F.initcap("p_type")).select("p_partkey", end.alias("end"), *described).select("p_partkey", "end", item.alias("item")).hint("shuffle_hash")
        c = t("customer").select("c_custkey", F.col("c_name").alias("certname"))
        ordered = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "certname").hint("shuffle_hash")
        read = t("lineitem").select("l_orderkey", "l_partkey")
        rows = read.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("certname", "o_orderkey", "p_partkey", "end", "item")
        rows = rows.repartition(_dealt(t("lineitem")), "certname")
        order = Window.partitionBy("o_orderkey", "certname").orderBy("p_partkey", "end")  # by order first: names of nodes compare slowly
        after = F.lead(F.struct("p_partkey", "end")).over(order)
        rows = rows.withColumn("after", after).withColumn("again", (F.col("after.p_partkey") == F.col("p_partkey")) & (F.col("after.end") == F.col("end")))  # a part that has several lines of an order
        edge = F.when(~F.col("again"), F.concat(F.lit('{"source":'), "end", F.lit(',"target":'), "after.end", F.lit(',"relationship":"contains"}')))
        held = rows.groupBy(F.xxhash64("certname").alias("node"), "certname").agg(F.collect_list("item").alias("items"), F.collect_list(edge).alias("edges"))
        return held.select("certname", *[F.array_join(F.array_distinct(x), ",").alias(y) for x, y in (("items", "resources"), ("edges", "edges"))])

    def edges() -> DataFrame:
        p = lines().select("o_orderkey", "certname", "p_partkey", "kind", title.alias("title")).distinct()
        order = Window.partitionBy("o_orderkey").orderBy("p_partkey")
        p = p.withColumn("next", F.lead(F.struct("kind", "title")).over(order)).filter("next is not null")
        return p.select("certname", F.col("kind").alias("source_type"), F.col("title").alias("source_title"), F.col("next.kind").alias("target_type"), F.col("next.title").alias("target_title"), F.lit("contains").alias("relationship")).repartition("certname").distinct()

    package = [F.col("p_name").alias("package_name"), F.col("p_brand").alias("version"), F.col("p_type").alias("provider")]

    def inputs() -> DataFrame:
        return t("events").join(t("customer"), F.col("user_id") == F.col("c_custkey"))

    return Store(
        spark,
        {
            "driver_events": lambda: t("events"), "certnames": certnames, "factsets": factsets, "reports": reports, "resource_events": resource_events, "catalogs": catalogs, "catalog_resources": catalog_resources, "edges": edges, "catalog_texts": catalog_texts,
            "packages": lambda: t("part").select(*package).distinct(), "certname_packages": lambda: lines().select("certname", *package).distinct(),
            "catalog_inputs": lambda: inputs().select(F.col("c_name").alias("certname"), F.col("event_type").alias("type"), F.col("props").alias("name")).distinct(),
            "catalog_inputs_meta": lambda: inputs().groupBy(F.col("c_name").alias("certname")).agg(F.max("ts").alias("producer_timestamp")).withColumn("catalog_uuid", md5("certname")),
            "environments": lambda: t("nation").select(F.col("n_name").alias("name")),
            "producers": lambda: spark.range(5).select(F.concat(F.lit("producer-"), F.col("id").cast("string")).alias("name")),
        },
    )
