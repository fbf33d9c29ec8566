"""Retail: typed silver tables from the bronze feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import map_values
from tidemark.operators.conform import conform
from tidemark.operators.sessions import sessionize

# Marketplace order states and the canonical status each stands for.
ORDER_STATES = {
    "completed": ["SHIPPED", "RECEIVED", "CLOSED"],
    "in_progress": ["SHIPPING", "WAITING_ACCEPTANCE"],
    "cancelled": ["CANCELED", "REFUSED"],
}
LOADED = {"ingested_at": ("ingested_at", "timestamp_ntz")}


def typed(raw: DataFrame, **casts: str) -> DataFrame:
    """Pass the columns through, casting the named ones."""
    casts = {"ingested_at": "timestamp_ntz", **casts}
    return conform(raw, {c: (c, casts[c]) if c in casts else c for c in raw.columns})


def categories(raw: DataFrame) -> DataFrame:
    return typed(raw, category_level="int")


def products(raw: DataFrame) -> DataFrame:
    return typed(raw, base_price="double")


def variants(raw: DataFrame) -> DataFrame:
    typed_rows = typed(raw, price="double", stock_level="int", is_active="boolean")
    return typed_rows.withColumn("is_in_stock", F.col("stock_level") > 0)


def customer_versions(raw: DataFrame) -> DataFrame:
    """Version history without the generator's latent columns."""
    kept = ["customer_id", "version_number", "effective_at", "change_reason", "first_name",
            "last_name", "email", "brand_line_affinity", "home_size", "prefers_petite", "region",
            "postcode_area", "signup_date", "loyalty_member", "loyalty_tier", "email_consent",
            "marketing_consent", "data_processing_consent", "ingested_at"]
    flags = dict.fromkeys(
        ["prefers_petite", "loyalty_member", "email_consent", "marketing_consent",
         "data_processing_consent"], "boolean")
    return typed(raw.select(*kept), version_number="int", effective_at="timestamp_ntz",
                 signup_date="date", **flags)


def email_events(raw: DataFrame) -> DataFrame:
    return typed(raw, event_at="timestamp_ntz")


def events(raw: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Clickstream with derived session ids. The true ids are for evaluation only."""
    rows = typed(raw, event_at="timestamp_ntz", quantity="int", unit_price="double",
                 is_marketplace="boolean")
    return sessionize(rows, "anonymous_id", "event_at", "event_id", gap)


def search_logs(raw: DataFrame) -> DataFrame:
    return typed(raw, event_at="timestamp_ntz", results_count="int", clicked_position="int",
                 converted="boolean")


def orders(raw: DataFrame) -> DataFrame:
    return typed(raw, order_at="timestamp_ntz", is_guest="boolean", num_lines="int",
                 num_units="int", gross_amount="double", discount_amount="double",
                 net_amount="double")


def order_lines(raw: DataFrame) -> DataFrame:
    return typed(raw, quantity="int", unit_price="double", line_amount="double",
                 is_returned="boolean", returned_at="timestamp_ntz")


def marketplace_orders(raw: DataFrame) -> DataFrame:
    """Marketplace headers in the shape and vocabulary of first-party orders."""
    return conform(raw, {
        "order_id": "mirakl_order_id",
        "customer_id": "customer_ref",
        "order_at": ("created_date", "timestamp_ntz"),
        "order_channel": F.lit("marketplace"),
        "is_guest": F.col("customer_ref").isNull(),
        "seller_id": "shop_id",
        "seller_name": "shop_name",
        "net_amount": ("total_price", "double"),
        "commission_rate": ("commission_rate", "double"),
        "commission_amount": ("commission_amount", "double"),
        "currency": "currency_iso_code",
        "source_order_state": "order_state",
        "order_status": map_values("order_state", ORDER_STATES, "unknown"),
        **LOADED,
    })


def marketplace_order_lines(raw: DataFrame) -> DataFrame:
    return conform(raw, {
        "line_id": "mirakl_line_id",
        "order_id": "mirakl_order_id",
        "variant_id": "offer_sku",
        "quantity": ("quantity", "int"),
        "unit_price": ("price_unit", "double"),
        "line_amount": ("line_total", "double"),
        "is_returned": ("is_refunded", "boolean"),
        "return_reason": "refund_reason",
        **LOADED,
    })
