"""The tables, and the knowledge-base model that is read from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.plans.graphplan import NodeType, RelationshipType, Schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The schema of the sales graph; a relationship type has one pair of ends.
SALES = Schema(
    "sales",
    (
        NodeType("Customer", ("custkey",), {"custkey": "long", "name": "string", "acctbal": "double", "segment": "string"}),
        NodeType("Order", ("orderkey",), {"orderkey": "long", "status": "string", "total": "double", "priority": "string"}),
        NodeType("Part", ("partkey",), {"partkey": "long", "name": "string", "brand": "string", "type": "string", "size": "integer", "price": "double"}),
        NodeType("Supplier", ("suppkey",), {"suppkey": "long", "name": "string", "acctbal": "double"}),
        NodeType("Nation", ("nationkey",), {"nationkey": "long", "name": "string"}),
        NodeType("Region", ("regionkey",), {"regionkey": "long", "name": "string"}),
    ),
    (
        RelationshipType("PLACED", "Customer", "Order"),
        RelationshipType("CONTAINS", "Order", "Part"),
        RelationshipType("SUPPLIED_BY", "Order", "Supplier"),
        RelationshipType("CUSTOMER_IN", "Customer", "Nation"),
        RelationshipType("SUPPLIER_IN", "Supplier", "Nation"),
        RelationshipType("IN_REGION", "Nation", "Region"),
    ),
)


@dataclass(frozen=True)
class SalesGraph:
    """Typed nodes (id and declared properties) and relationships (id, from_id, to_id) over the sales tables."""

    spark: SparkSession
    sf_dir: str
    schema: Schema = SALES

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def nodes(self, label: str) -> DataFrame:
        c = F.col
        if label == "Customer":
            return self._table("customer").select(c("c_custkey").cast("long").alias("id"), c("c_custkey").cast("long").alias("custkey"), c("c_name").alias("name"), c("c_acctbal").alias("acctbal"), c("c_mktsegment").alias("segment"))
        if label == "Order":
            return self._table("orders").select(c("o_orderkey").cast("long").alias("id"), c("o_orderkey").cast("long").alias("orderkey"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("total"), c("o_orderpriority").alias("priority"))
        if label == "Part":
            return self._table("part").select(
                c("p_partkey").cast("long").alias("id"), c("p_partkey").cast("long").alias("partkey"), c("p_name").alias("name"), c("p_brand").alias("brand"), c("p_type").alias("type"), c("p_size").alias("size"), c("p_retailprice").alias("price")
            )
        if label == "Supplier":
            return self._table("supplier").select(c("s_suppkey").cast("long").alias("id"), c("s_suppkey").cast("long").alias("suppkey"), c("s_name").alias("name"), c("s_acctbal").alias("acctbal"))
        if label == "Nation":
            return self._table("nation").select(c("n_nationkey").cast("long").alias("id"), c("n_nationkey").cast("long").alias("nationkey"), c("n_name").alias("name"))
        if label == "Region":
            return self._table("region").select(c("r_regionkey").cast("long").alias("id"), c("r_regionkey").cast("long").alias("regionkey"), c("r_name").alias("name"))
        raise KeyError(label)

    def relationships(self, kind: str) -> DataFrame:
        ends = {
            "PLACED": ("orders", "o_custkey", "o_orderkey"),
            "CONTAINS": ("lineitem", "l_orderkey", "l_partkey"),
            "SUPPLIED_BY": ("lineitem", "l_orderkey", "l_suppkey"),
            "CUSTOMER_IN": ("customer", "c_custkey", "c_nationkey"),
            "SUPPLIER_IN": ("supplier", "s_suppkey", "s_nationkey"),
            "IN_REGION": ("nation", "n_nationkey", "n_regionkey"),
        }
        name, a, b = ends[kind]
        pairs = self._table(name).select(F.col(a).cast("long").alias("from_id"), F.col(b).cast("long").alias("to_id"))
        pairs = pairs.distinct() if name == "lineitem" else pairs
        return pairs.select(F.concat_ws(":", F.lit(kind), "from_id", "to_id").alias("id"), "from_id", "to_id")
