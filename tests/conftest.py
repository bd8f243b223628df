from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def edge_tables(spark):
    """Hand-made rows with the awkward cases: see the comments."""
    orders = [
        # two items and two payments: the row product counts four
        ("a", "ca", "delivered", day("2018-01-01 10:00:00"), day("2018-01-11 09:00:00")),
        ("b", "cb", "canceled", day("2018-01-02 00:00:00"), None),
        # delivered without a date
        ("c", "cc", "delivered", day("2018-01-09 00:00:00"), None),
        # delivered before it was purchased
        ("d", "cd", "delivered", day("2018-01-10 12:00:00"), day("2018-01-09 00:00:00")),
        # no purchase time
        ("e", "ce", "delivered", None, day("2018-02-01 00:00:00")),
        # only a zero payment
        ("f", "cf", "delivered", day("2018-01-20 00:00:00"), day("2018-03-20 00:00:00")),
        # no items and no payments
        ("g", "cg", "shipped", day("2018-12-31 00:00:00"), None),
        # the same order id twice
        ("h", "ch", "delivered", day("2018-02-05 00:00:00"), day("2018-02-10 00:00:00")),
        ("h", "ch", "delivered", day("2018-02-05 00:00:00"), day("2018-02-10 00:00:00")),
    ]
    items = [
        ("a", "p1", "s1", 10.0, 1.0),
        ("a", "p2", "s2", 20.0, 2.0),
        ("b", "p1", "s1", 10.0, 1.0),
        ("c", "p3", "s1", 5.0, 0.5),
        ("d", "p4", "s2", 7.0, 0.7),
        ("e", "p1", "s2", 10.0, 1.0),
        ("f", "p1", "s1", 0.0, 0.0),
        ("h", "p2", "s3", 100.0, 0.0),
    ]
    payments = [
        ("a", 12.35),
        ("a", 3.0),
        ("b", 11.0),
        ("c", 5.5),
        ("d", 7.7),
        ("e", 11.0),
        ("f", 0.0),
        ("h", 60.0),
    ]
    products = [("p1", "toys_own"), ("p2", "untranslated"), ("p3", None), ("p4", "toys_own")]
    xlat = [("toys_own", "toys")]
    customers = [("ca", "u1"), ("cb", "u1"), ("cc", "u2"), ("cd", "u3"), ("ce", "u3"), ("cf", "u4"), ("ch", "u5")]
    sellers = [("s1", "SP", "x"), ("s2", "RJ", "y"), ("s3", "SP", "z")]
    frame = spark.createDataFrame
    return {
        "orders": frame(
            orders,
            "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
            "order_delivered_customer_date timestamp_ntz",
        ),
        "order_items": frame(
            items, "order_id string, product_id string, seller_id string, price double, freight_value double"
        ),
        "order_payments": frame(payments, "order_id string, payment_value double"),
        "products": frame(products, "product_id string, product_category_name string"),
        "category_xlat": frame(xlat, "product_category_name string, product_category_name_english string"),
        "customers": frame(customers, "customer_id string, customer_unique_id string"),
        "sellers": frame(sellers, "seller_id string, seller_state string, seller_city string"),
    }
