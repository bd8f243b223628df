"""The domain tables as views over an orders/lineitem star schema.

The star has no payments, so payments are derived from lines. Order keys divisible
by 997 pay nothing, those divisible by 40 pay a tenth and their successors 38 %, which
gives the discount detectors something to find. Products are formed from whole cents
and whole percents, so none is rounded from an inexact double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginwatch.functions.money import amount, cents

Tables = dict[str, DataFrame]

# The columns used; a declared schema spares reading file footers to infer one.
STAR_SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, "
    "l_tax double, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_brand string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


def _rounded(product: Column, scale: int) -> Column:
    """A non-negative whole product divided by ``scale``, rounded half up."""
    return F.floor((product + scale // 2) / scale)


def star_tables(spark: SparkSession, base: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{base}/{name}.parquet")

    orders, lines, part = read("orders"), read("lineitem"), read("part")
    supplier, nation = read("supplier"), read("nation")

    price, tax, discount = cents("l_extendedprice"), cents("l_tax"), cents("l_discount")
    key = F.col("l_orderkey")
    shipped = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    pending = F.col("o_orderstatus") == "P"
    factor = (
        F.when(key % 997 == 0, 0).when(key % 40 == 0, 10).when(key % 40 == 1, 38).otherwise(100)
    )

    return {
        "orders": orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderkey").alias("customer_id"),
            F.when(pending & (F.col("o_orderpriority") == "1-URGENT"), "canceled")
            .when(pending, "shipped")
            .otherwise("delivered")
            .alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("shipped").alias("order_delivered_customer_date"),
        ),
        "order_items": lines.select(
            key.alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            amount(price).alias("price"),
            amount(_rounded(price * tax, 100)).alias("freight_value"),
        ),
        "order_payments": lines.groupBy(key.alias("order_id"), F.col("l_linestatus").alias("payment_type")).agg(
            amount(F.sum(_rounded(price * (100 - discount) * factor, 10000))).alias("payment_value")
        ),
        "products": part.select(
            F.col("p_partkey").alias("product_id"),
            F.nullif(F.col("p_brand"), F.lit("Brand#13")).alias("product_category_name"),
        ),
        "category_xlat": part.filter(~F.col("p_brand").isin("Brand#7", "Brand#13"))
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("product_category_name_english"),
        )
        .distinct(),
        "customers": orders.select(
            F.col("o_orderkey").alias("customer_id"), F.col("o_custkey").alias("customer_unique_id")
        ),
        "sellers": supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("n_name").alias("seller_state"),
            F.col("s_name").alias("seller_city"),
        ),
    }
