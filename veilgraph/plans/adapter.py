"""The driver's star schema as a directory graph: nations are domains, customers users, suppliers computers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Keys that share a member of a nation; about a 25th of them are the nation's.
BLOCK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_name(nation: Column) -> Column:
    return F.concat(F.lit("CORP"), nation.cast("string"), F.lit(".LOCAL"))


def domain_sid(nation: Column) -> Column:
    return F.concat_ws("-", F.lit("S-1-5-21"), (nation + 1000000).cast("string"), (nation + 2000000).cast("string"), (nation + 3000000).cast("string"))


def user_name(customer: Column) -> Column:
    return F.concat(F.lit("user"), customer.cast("string"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, raw): users and computers of each nation, a member for each ``BLOCK`` keys, so that members don't grow with the tables; and one of domains."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    n, c, s = F.col("c_nationkey"), F.col("c_custkey"), F.col("s_suppkey")
    user = F.struct(
        F.concat_ws("-", domain_sid(n), (c + 1100).cast("string")).alias("ObjectIdentifier"), F.concat_ws("-", domain_sid(n), F.lit("513")).alias("PrimaryGroupSID"),
        F.struct(F.concat(F.upper(user_name(c)), F.lit("@"), domain_name(n)).alias("name"), domain_name(n).alias("domain"), user_name(c).alias("samaccountname"), F.col("c_mktsegment").alias("description"), c.alias("employeenumber"), F.lit(True).alias("enabled")).alias("Properties"),
    )
    host = F.concat(F.lit("SRV"), s.cast("string"), F.lit("."), domain_name(F.col("s_nationkey")))
    computer = F.struct(
        F.concat_ws("-", domain_sid(F.col("s_nationkey")), (s + 500000).cast("string")).alias("ObjectIdentifier"),
        F.struct(host.alias("name"), F.array(F.concat(F.lit("HOST/"), host)).alias("serviceprincipalnames"), F.lit("Windows Server 2019 Standard").alias("operatingsystem")).alias("Properties"),
    )
    domain = F.struct(domain_sid(F.col("n_nationkey")).alias("ObjectIdentifier"), F.struct(domain_name(F.col("n_nationkey")).alias("name"), F.concat(F.lit("DC=corp"), F.col("n_nationkey").cast("string"), F.lit(",DC=local")).alias("distinguishedname")).alias("Properties"))

    def pack(df: DataFrame, key: Column, number: Column, kind: str, item: Column) -> DataFrame:
        got = df.groupBy(key.alias("k"), F.floor(number / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(item)).alias("data"))
        meta = F.struct(F.lit(kind).alias("type"), F.size("data").alias("count"), F.lit(6).alias("version"))
        return got.select(F.concat(F.lit(f"{kind}-"), F.lpad(F.col("k").cast("string"), 5, "0"), F.lit("-"), F.col("b").cast("string")).alias("member"), F.to_json(F.struct(meta.alias("meta"), "data")).cast("binary").alias("raw"))

    users, computers = pack(customer, n, c, "users", user), pack(supplier, F.col("s_nationkey"), s, "computers", computer)
    return users.union(computers).union(pack(nation, F.lit(0), F.col("n_nationkey"), "domains", domain))
