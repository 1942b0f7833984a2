"""The four captured entities. One declaration drives decode, staging, current state and history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C

VERSION = "cdc_source_ts_ms"  # event time at the source, epoch ms
SEQ = "seq"  # position in the change log; breaks ties between equal versions of a key


@dataclass(frozen=True)
class Attribute:
    """A column of a change record and how staging turns its wire form into its stored form."""

    name: str
    wire: T.DataType
    form: str = "plain"  # plain | day | instant | flag
    default: object = None  # set for columns that are never null once staged
    source_name: str | None = None  # name at the source, where it differs

    def staged(self) -> Column:
        value = F.col(self.name)
        if self.form == "day":
            value = C.day_from_epoch(value)
        elif self.form == "instant":
            value = F.timestamp_millis(value)
        elif self.form == "flag":
            value = value.cast("int")
        if self.default is not None:
            value = F.coalesce(value, F.lit(self.default).cast(self.stored_type()))
        return value.alias(self.name)

    def stored_type(self) -> T.DataType:
        by_form = {"day": T.DateType(), "instant": T.TimestampType(), "flag": T.IntegerType()}
        return by_form.get(self.form, self.wire)


AUDIT = (
    Attribute("updated_at", T.LongType(), "instant"),
    Attribute("updated_by", T.LongType()),
    Attribute("created_at", T.LongType(), "instant"),
    Attribute("created_by", T.LongType()),
)

CAPTURE = (
    Attribute("cdc_deleted", T.BooleanType(), "flag", default=0),
    Attribute("cdc_op", T.StringType(), default=""),
    Attribute(VERSION, T.LongType(), default=0),
)


@dataclass(frozen=True)
class Entity:
    name: str
    key: str
    payload: tuple[Attribute, ...]

    @property
    def attributes(self) -> tuple[Attribute, ...]:
        return (Attribute(self.key, T.LongType()), *self.payload, *AUDIT, *CAPTURE)

    @property
    def columns(self) -> list[str]:
        return [a.name for a in self.attributes]

    @property
    def wire_schema(self) -> T.StructType:
        """A flat change record, as it lies on the topic."""
        return T.StructType([T.StructField(a.name, a.wire) for a in self.attributes])

    @property
    def row_image(self) -> T.StructType:
        """A row at the source: the record without the capture columns, under the source's names."""
        row = (Attribute(self.key, T.LongType()), *self.payload, *AUDIT)
        return T.StructType([T.StructField(a.source_name or a.name, a.wire) for a in row])

    @property
    def renames(self) -> dict[str, str]:
        return {a.source_name: a.name for a in self.payload if a.source_name}

    @property
    def staged_schema(self) -> T.StructType:
        fields = [T.StructField(a.name, a.stored_type()) for a in self.attributes]
        return T.StructType([*fields, T.StructField(SEQ, T.LongType())])

    @property
    def history_schema(self) -> T.StructType:
        return T.StructType([*self.staged_schema, T.StructField("_inserted_at", T.TimestampType())])

    def topic(self, prefix: str = "operations") -> str:
        return f"{prefix}.{self.name}"


CUSTOMERS = Entity(
    "customers",
    "customer_id",
    (
        Attribute("customer_name", T.StringType(), default=""),
        Attribute("is_active", T.BooleanType(), "flag", default=1),
        Attribute("customer_address", T.StringType()),
    ),
)

PRODUCTS = Entity(
    "products",
    "product_id",
    (
        Attribute("product_name", T.StringType(), default=""),
        Attribute("barcode", T.StringType(), default=""),
        Attribute("unity_price", T.DoubleType(), default=0.0),
        Attribute("is_active", T.BooleanType(), "flag", default=1),
    ),
)

ORDERS = Entity(
    "orders",
    "order_id",
    (
        Attribute("order_date", T.IntegerType(), "day"),
        Attribute("delivery_date", T.IntegerType(), "day"),
        Attribute("customer_id", T.LongType()),
        Attribute("status", T.StringType()),
    ),
)

ORDER_ITEMS = Entity(
    "order_items",
    "order_item_id",
    (
        Attribute("order_id", T.LongType()),
        Attribute("product_id", T.LongType()),
        Attribute("quantity", T.IntegerType(), source_name="quanity"),
    ),
)

ENTITIES = (CUSTOMERS, PRODUCTS, ORDERS, ORDER_ITEMS)
