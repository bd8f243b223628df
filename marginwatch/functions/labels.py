"""Category names, bins and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names that appear in results.
UNKNOWN = "unknown"
DELIVERED = "delivered"
CANCELED = "canceled"
L1 = "L1_discount_abuse"
L2 = "L2_refund_spike"
L3 = "L3_silent_churn"
L4 = "L4_short_lifecycle"
DISPLAY_NAMES = {
    L1: "Discount Abuse",
    L2: "Refund Spike",
    L3: "Silent Churn",
    L4: "Short Lifecycle",
}


def tier(ltv: Column, q40: Column, q80: Column) -> Column:
    """Right-closed bins (0, q40], (q40, q80], (q80, inf); null outside them."""
    return (
        F.when(ltv <= 0, F.lit(None).cast("string"))
        .when(ltv <= q40, "Low")
        .when(ltv <= q80, "Mid")
        .when(ltv > q80, "High")
    )


def severity(z: Column) -> Column:
    """Right-closed bins (-inf, -3], (-3, -2.5], (-2.5, -2]; null above -2."""
    return F.when(z <= -3.0, "Critical").when(z <= -2.5, "High").when(z <= -2.0, "Medium")


def canceled() -> Column:
    return F.col("order_status") == CANCELED


def delivered() -> Column:
    return F.col("order_status") == DELIVERED
