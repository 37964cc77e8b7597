"""Message rows derived from star-schema tables by integer arithmetic, for queries that two engines can compare.

`routes`: one table entry per order, its path and communities from the line items. `sessions`: one
session message per event. `peers` and `refs`: peer tables from customers, referred to by orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _net(x: Column, path_id: Column | None = None) -> Column:
    return net.ipv4_prefix(F.lit(167772160) + (x * 7919) % 16777216, (F.lit(8) + x % 25).cast("int"), path_id)


def _addr(second: int, x: Column) -> Column:
    return F.lit(167772160 + second * 65536) + x % 65536


def _peer(df: DataFrame, second: int, x: Column) -> DataFrame:
    number = _addr(second, x)
    return df.withColumns({"peer_addr": net.ipv4_text(number), "peer_addr_bin": F.unhex(F.lpad(F.hex(number), 8, "0")), "peer_asn": F.lit(64400).cast("long") + x % 200})


def _time(df: DataFrame, ts: Column) -> DataFrame:
    micros = F.unix_micros(ts.cast("timestamp"))
    return df.withColumns({"ts_secs": F.floor(micros / 1_000_000).cast("long"), "ts_micros": F.pmod(micros, F.lit(1_000_000)).cast("int")})


def routes(spark: SparkSession, sf_dir: str, paths: bool = True, parts: int | None = None) -> DataFrame:
    """Entries by order; paths=False leaves line items, and so AS paths and communities, out.

    parts: orders are dealt out by key into so many partitions, which stay through the join with line items.
    """
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    df = df if parts is None else df.repartition(parts, "o_orderkey")
    if paths:
        supp, part = F.col("l_suppkey"), F.col("l_partkey")
        asn = F.when(supp % 25 == 0, 64500 + supp).when(supp % 41 == 0, 23456).otherwise(100 + supp % 9)
        item = F.struct("l_linenumber", "l_partkey", "l_suppkey", asn.cast("long").alias("asn"), ((part % 65536) * 65536 + supp).alias("comm"))
        items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
        df = df.join(items, key == F.col("l_orderkey"), "left")
        base = F.coalesce(F.col("items.asn"), F.array().cast("array<bigint>"))
        members = F.array((64400 + cust % 200).cast("long"), F.lit(777).cast("long"))
        seq = F.when(F.size(base) > 0, F.array(F.struct(F.lit(2).alias("type"), base.alias("asns")))).otherwise(F.array().cast("array<struct<type:int,asns:array<bigint>>>"))
        sets = F.when(key % 11 == 0, F.array(F.struct(F.lit(1).alias("type"), members.alias("asns")))).otherwise(F.array().cast("array<struct<type:int,asns:array<bigint>>>"))
        df = df.withColumns({"as_path_segs": F.concat(seq, sets), "communities": F.coalesce(F.col("items.comm"), F.array().cast("array<bigint>"))})
        df = df.withColumn("as_path", F.flatten(F.col("as_path_segs.asns")))
    else:
        df = df.withColumns({"as_path_segs": F.array().cast("array<struct<type:int,asns:array<bigint>>>"), "communities": F.array().cast("array<bigint>"), "as_path": F.array().cast("array<bigint>")})
    df = _time(_peer(df, 0, cust), F.col("o_orderdate"))
    codes = F.concat(F.array(*map(F.lit, (1, 2, 3))), *[F.when(test, F.array(F.lit(code))).otherwise(F.array().cast("array<int>")) for test, code in ((key % 7 == 0, 6), (key % 5 == 0, 7), (F.size("communities") > 0, 8), (key % 3 == 0, 32))])
    large = F.struct(F.col("peer_asn").alias("global"), cust.alias("local1"), F.lit(1).cast("long").alias("local2"))
    return df.select(
        F.lit("orders").alias("file"), key.alias("rec_no"), F.lit(0).alias("entry_no"), F.lit("TABLE_DUMPV2").alias("kind"), F.lit(2).alias("msg_type"), "ts_secs", "ts_micros", "peer_addr", "peer_addr_bin", "peer_asn",
        F.lit(True).alias("asn32"), F.array(_net(key)).alias("announced"), F.array().cast(f"array<{net.PREFIX}>").alias("withdrawn"), codes.alias("attr_codes"), "as_path_segs", "as_path", F.array("peer_addr").alias("next_hops"),
        (key % 3).cast("int").alias("origin"), (key % 7 == 0).alias("atomic"), F.when(key % 5 == 0, F.struct(F.col("peer_asn").alias("asn"), F.col("peer_addr").alias("addr"))).alias("aggregator"), "communities",
        F.when(key % 3 == 0, F.array(large)).otherwise(F.array().cast("array<struct<global:bigint,local1:bigint,local2:bigint>>")).alias("large_communities"), F.array().cast("array<int>").alias("capabilities"), F.lit(None).cast("string").alias("error"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by event: click announces (with path ids), purchase withdraws, view keeps alive, signup opens, others notify."""
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    df = _time(_peer(read(spark, sf_dir, "events"), 1, user), F.col("ts"))
    x = key % 65535 + 1
    six = F.struct(
        F.lit(2).alias("afi"), F.lit(1).alias("safi"), (key % 3).alias("path_id"), F.lit(48).alias("len"), F.concat(F.unhex(F.lit("20010DB8")), F.unhex(F.lpad(F.hex(x), 4, "0")), F.unhex(F.lit("00" * 10))).alias("net"),
        F.concat(F.lit("6:" + f"{0x20010DB8:032b}"), F.lpad(F.bin(x), 16, "0")).alias("key"), F.concat(F.lit("2001:db8:"), F.lower(F.hex(x)), F.lit("::/48")).alias("text"),
    )
    none = F.array().cast(f"array<{net.PREFIX}>")
    update = kind.isin("click", "purchase")
    path = F.array((100 + user % 9).cast("long"), (100 + key % 9).cast("long"))
    return df.select(
        F.lit("events").alias("file"), key.alias("rec_no"), F.lit(0).alias("entry_no"), F.lit("BGP4MP_ET").alias("kind"), F.when(update, 2).when(kind == "view", 4).when(kind == "signup", 1).otherwise(3).alias("msg_type"), "ts_secs", "ts_micros", "peer_addr", "peer_addr_bin", "peer_asn",
        (key % 2 == 0).alias("asn32"), F.when(kind == "click", F.array(_net(key, key % 3), _net(key + 1, (key + 1) % 3), six)).otherwise(none).alias("announced"), F.when(kind == "purchase", F.array(_net(key), _net(key + 2))).otherwise(none).alias("withdrawn"),
        F.when(kind == "click", F.array(*map(F.lit, (1, 2, 3, 14)))).otherwise(F.array().cast("array<int>")).alias("attr_codes"), F.when(update, F.array(F.struct(F.lit(2).alias("type"), path.alias("asns")))).alias("as_path_segs"), F.when(update, path).alias("as_path"),
        F.when(kind == "click", F.array("peer_addr")).alias("next_hops"), F.when(kind == "click", 0).alias("origin"), F.lit(False).alias("atomic"), F.lit(None).cast("struct<asn:bigint,addr:string>").alias("aggregator"), F.lit(None).cast("array<bigint>").alias("communities"),
        F.lit(None).cast("array<struct<global:bigint,local1:bigint,local2:bigint>>").alias("large_communities"), F.when(kind == "signup", F.array(F.lit(1), F.lit(65), (200 + key % 3).cast("int"))).alias("capabilities"), F.lit(None).cast("string").alias("error"),
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), (key % 4).cast("string")).alias("file"), (F.floor(key / 4) % 2).cast("int").alias("table_no"), F.floor(key / 8).cast("int").alias("peer_idx"), net.ipv4_text(_addr(2, key)).alias("bgp_id"), net.ipv4_text(_addr(0, key)).alias("addr"),
        F.unhex(F.lpad(F.hex(_addr(0, key)), 8, "0")).alias("addr_bin"), (64400 + key % 200).cast("long").alias("asn"), (key % 2 == 0).alias("asn32"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = F.col("o_custkey")
    idx = F.floor(cust / 8) + F.when(F.col("o_orderkey") % 97 == 0, 1_000_000).otherwise(0)
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (cust % 4).cast("string")).alias("file"), (F.floor(cust / 4) % 2).cast("int").alias("table_no"), idx.cast("int").alias("peer_idx"))
