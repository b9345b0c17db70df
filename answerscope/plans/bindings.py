"""The driver's TPC-H-like tables read as the metric model, so that every metric runs at any scale factor.

orders are answers, lineitem rows sentences and mentions, parts pages, nations labelled domains. Each table is a plan
over column-pruned scans; the sentence order is the only window over lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .shipping import ship

CFG = Config(engines={"F": "f", "O": "o", "P": "p"})
SITES = 40  # of which nations label 25
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


#: Bytes that a task after a shuffle takes, where the session has left Spark's own bound. A task sorts and groups them in memory.
TASK = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
TASK_BYTES, SPARKS = 16 << 20, 64 << 20
#: Partitions before Spark joins small ones: one for each so many bytes of a table's files, as rows take some four times as many in a shuffle.
FIRST, FILE_BYTES = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 4 << 20
#: Bytes of files that one task reads, where the session has left Spark's own bound: with more than 200 partitions to write to, a task keeps its rows to sort them.
SPLIT, SPLIT_BYTES, SPARKS_SPLIT = "spark.sql.files.maxPartitionBytes", 32 << 20, 128 << 20
#: Partitions' number where the session joins none: Spark doesn't look at FIRST then.
FIXED, JOINS = "spark.sql.shuffle.partitions", ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    path = f"{sf_dir}/{name}.parquet"
    bound_tasks(spark, path)
    return spark.read.parquet(path)


def bound_tasks(spark: SparkSession, path: str) -> None:
    """The number of partitions grows with the table, so that what one task holds doesn't."""
    if spark.conf.get(TASK) in ("64MB", str(SPARKS), f"{SPARKS}b"):
        spark.conf.set(TASK, str(TASK_BYTES))
    if spark.conf.get(SPLIT) in ("128MB", str(SPARKS_SPLIT), f"{SPARKS_SPLIT}b"):
        spark.conf.set(SPLIT, str(SPLIT_BYTES))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    number = FIRST if all(spark.conf.get(c).lower() == "true" for c in JOINS) else FIXED
    least = int(spark.conf.get(number, None) or spark.conf.get(FIXED))
    if size > least * FILE_BYTES:
        spark.conf.set(number, str(-(-size // FILE_BYTES)))


def url_of(part):
    return F.concat(F.lit("https://www.d"), part % SITES, F.lit(".example/p"), part)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with sent_idx, its 0-based place in its order."""
    place = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return read(spark, sf_dir, "lineitem").withColumn("sent_idx", F.row_number().over(place) - 1)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("answer_id"), F.col("o_orderstatus").alias("engine"), F.col("o_custkey").alias("prompt_no"),
        F.col("o_orderpriority").alias("pillar"), F.col("c_mktsegment").alias("intent"),
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("answer_id"), "sent_idx", F.col("l_quantity").cast("int").alias("n_words"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long line names its brand twice."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    found = lines(spark, sf_dir).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("l_quantity") > 25, 2).otherwise(1)))
    return found.select(F.col("l_orderkey").alias("answer_id"), "sent_idx", F.col("p_brand").alias("brand"), F.col("p_type").alias("sub_brand"), times.alias("nth")).drop("nth")


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the return flags of the brand's lines; rows stay dealt by answer, as they are joined by it later."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    flags = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").repartition("l_orderkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    has = {label: F.max(F.col("l_returnflag") == flag) for label, flag in (("positive", "A"), ("neutral", "N"), ("negative", "R"))}
    by = flags.groupBy(F.col("l_orderkey").alias("answer_id"), F.col("p_brand").alias("brand")).agg(*[c.alias(k) for k, c in has.items()])
    several = F.size(F.filter(F.array(*has), lambda x: x)) > 1
    label = F.when(several, "mixed").when(F.col("positive"), "positive").when(F.col("negative"), "negative").otherwise("neutral")
    score = F.when(several, 0).when(F.col("positive"), 1).when(F.col("negative"), -1).otherwise(0)
    return by.select("answer_id", "brand", label.alias("label"), score.alias("score"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's parts in order of first appearance, each once."""
    seen = lines(spark, sf_dir).groupBy("l_orderkey", "l_partkey").agg(F.min("sent_idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first"))
    engines = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("engine"))
    url = url_of(F.col("l_partkey"))
    return seen.withColumn("rank", rank).join(engines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("answer_id"), "engine", "rank", url.alias("url"), F.concat(F.lit("d"), F.col("l_partkey") % SITES, F.lit(".example")).alias("domain")
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    tier = F.when(F.col("n_nationkey") % 3 == 0, "High").when(F.col("n_nationkey") % 3 == 1, "Medium").otherwise("Low")
    return read(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("d"), F.col("n_nationkey"), F.lit(".example")).alias("domain"), F.col("r_name").alias("domain_type"), tier.alias("authority_tier")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    status = F.when(size % 10 == 0, 404).when(size % 10 == 1, 403).when(size % 10 == 2, F.lit(None).cast("int")).otherwise(200)
    soft = (size % 11 == 0) & F.coalesce(status == 200, F.lit(False))
    words = size * 10
    return read(spark, sf_dir, "part").select(
        url_of(key).alias("url"), status.alias("http_status"), F.when(size % 10 == 2, "Timeout: read").alias("fetch_error"),
        F.when(size % 7 == 0, "pdf").otherwise("html").alias("content_kind"), words.alias("n_words"), soft.alias("soft_404"),
        (F.coalesce(status == 200, F.lit(False)) & (words >= 50) & ~soft).alias("is_readable"),
        F.when(key % 7 != 0, F.date_sub(F.lit(CFG.run_date).cast("date"), (key % 700).cast("int"))).alias("published_date"),
        F.element_at(F.array(F.lit("jsonld"), F.lit("meta"), F.lit("htmldate")), (key % 3 + 1).cast("int")).alias("date_source"),
        F.element_at(F.array(F.lit(""), F.lit("NewsArticle;Organization"), F.lit("FAQPage"), F.lit("WebPage"), F.lit("BankOrCreditUnion;Report")), (key % 5 + 1).cast("int")).alias("schema_types"),
    )


def page_brand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own brand, and for every third one a brand that no answer names."""
    key = F.col("p_partkey")
    own = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("count"))
    side = F.struct(F.concat(F.lit("Side#"), key % 4).alias("brand"), (F.col("p_size") % 5 + 1).alias("count"))
    both = F.explode(F.when(key % 3 == 0, F.array(own, side)).otherwise(F.array(own)))
    return read(spark, sf_dir, "part").select(url_of(key).alias("url"), both.alias("b")).select("url", "b.brand", "b.count")


TABLES = {f.__name__: f for f in (answers, sentences, mentions, sentiment, citations, domains, pages, page_brand_counts)}


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: f(spark, sf_dir) for name, f in TABLES.items()}
