"""Explicit schemas of the relational tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_STR, _INT, _LONG, _DBL, _TS = StringType(), IntegerType(), LongType(), DoubleType(), TimestampNTZType()

# Column names of the source files, in file order.
SCHEMAS: dict[str, StructType] = {
    "orders": _schema(
        order_id=_STR,
        customer_id=_STR,
        order_status=_STR,
        order_purchase_timestamp=_TS,
        order_approved_at=_TS,
        order_delivered_carrier_date=_TS,
        order_delivered_customer_date=_TS,
        order_estimated_delivery_date=_TS,
    ),
    "order_items": _schema(
        order_id=_STR,
        order_item_id=_INT,
        product_id=_STR,
        seller_id=_STR,
        shipping_limit_date=_TS,
        price=_DBL,
        freight_value=_DBL,
    ),
    "order_payments": _schema(
        order_id=_STR,
        payment_sequential=_INT,
        payment_type=_STR,
        payment_installments=_INT,
        payment_value=_DBL,
    ),
    "products": _schema(
        product_id=_STR,
        product_category_name=_STR,
        product_name_lenght=_DBL,
        product_description_lenght=_DBL,
        product_photos_qty=_DBL,
        product_weight_g=_DBL,
        product_length_cm=_DBL,
        product_height_cm=_DBL,
        product_width_cm=_DBL,
    ),
    "category_xlat": _schema(product_category_name=_STR, product_category_name_english=_STR),
    "customers": _schema(
        customer_id=_STR,
        customer_unique_id=_STR,
        customer_zip_code_prefix=_STR,
        customer_city=_STR,
        customer_state=_STR,
    ),
    "sellers": _schema(seller_id=_STR, seller_zip_code_prefix=_STR, seller_city=_STR, seller_state=_STR),
    "order_reviews": _schema(
        review_id=_STR,
        order_id=_STR,
        review_score=_INT,
        review_comment_title=_STR,
        review_comment_message=_STR,
        review_creation_date=_TS,
        review_answer_timestamp=_TS,
    ),
    "geolocation": _schema(
        geolocation_zip_code_prefix=_STR,
        geolocation_lat=_DBL,
        geolocation_lng=_DBL,
        geolocation_city=_STR,
        geolocation_state=_STR,
    ),
}

# The seven tables the analyses query; the other two are only profiled.
CORE_TABLES = (
    "orders",
    "order_payments",
    "order_items",
    "customers",
    "products",
    "sellers",
    "category_xlat",
)
