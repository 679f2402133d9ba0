"""The property graph: two DataFrames, nodes and edges.

Analyses read few labels, so both tables are stored partitioned by label.  Everything a
report needs of the enclosing method is a column of the node, which saves a join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch

_TEXT = ("name", "code", "full_name", "method_full_name", "type_full_name", "signature", "filename")
NODES = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("label", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.IntegerType()) for c in ("ast_pre", "ast_post", "line", "col", "line_end", "col_end", "arg_index", "ord")]
    + [T.StructField("is_external", T.BooleanType()), T.StructField("ast_parent_full_name", T.StringType()), T.StructField("ast_parent_type", T.StringType()), T.StructField("method_id", T.LongType()), T.StructField("lang", T.StringType())]
)
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("label", T.StringType()), T.StructField("idx", T.IntegerType())])

#: Labels of nodes that have a value.
EXPRESSIONS = ("CALL", "IDENTIFIER", "LITERAL", "FIELD_IDENTIFIER", "METHOD_REF", "TYPE_REF", "BLOCK", "CONTROL_STRUCTURE", "RETURN")
OPERATOR = "<operator>."


class Graph:
    """nodes and edges, completed to the full schema.

    chain: for graphs whose flow edges form paths, a DataFrame ``id, chain, pos``; then
    reachability and dominance are comparisons of positions instead of a fixpoint.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, chain: DataFrame | None = None, root: str | None = None):
        self.spark = nodes.sparkSession
        self.nodes, self.edges, self.chain = complete(nodes, NODES), complete(edges, EDGES), chain
        self.root = root  # empty: known to be absent

    @classmethod
    def of_rows(cls, spark: SparkSession, nodes: Iterable[dict], edges: Iterable[tuple]) -> Graph:
        """From dictionaries of node columns and (src, dst, label[, idx]) tuples."""
        rows = [tuple(n.get(f.name) for f in NODES) for n in nodes]
        links = [(*e, None)[:4] for e in edges]
        return cls(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES))

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def links(self, *labels: str) -> DataFrame:
        return self.edges.where(F.col("label").isin(*labels))

    def argument(self, index: int | None = None) -> DataFrame:
        """call, arg, idx of ARGUMENT edges."""
        out = self.links("ARGUMENT").select(F.col("src").alias("call"), F.col("dst").alias("arg"), "idx")
        return out if index is None else out.where(F.col("idx") == index)

    def out(self, df: DataFrame, label: str, key: str = "id") -> DataFrame:
        """Nodes that an edge of the label reaches from those of df, once each."""
        ids = self.links(label).join(df.select(F.col(key).alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        return self.nodes.join(ids, "id", "left_semi")

    def into(self, df: DataFrame, label: str, key: str = "id") -> DataFrame:
        ids = self.links(label).join(df.select(F.col(key).alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        return self.nodes.join(ids, "id", "left_semi")

    def with_code(self, ids: DataFrame, key: str, name: str) -> DataFrame:
        return ids.join(self.nodes.select(F.col("id").alias(key), F.col("code").alias(name)), key, "left")

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges"))

    def materialize(self) -> Graph:
        """The graph as written tables by label, so that no query computes it again."""
        scratch = Scratch(self.spark, "graph")
        chain = None if self.chain is None else scratch.save(self.chain, "chain")
        return Graph(scratch.save(self.nodes, "nodes", "label"), scratch.save(self.edges, "edges", "label"), chain, self.root)

    def views(self, prefix: str = "") -> None:
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")

    def sql(self, text: str) -> DataFrame:
        """The raw escape hatch: any query over ``nodes`` and ``edges``."""
        return self.spark.sql(text, nodes=self.nodes, edges=self.edges) if "{nodes}" in text or "{edges}" in text else (self.views(), self.spark.sql(text))[1]

    def metadata_root(self) -> str | None:
        """The root that the first META_DATA node names; looked up once."""
        if self.root is not None:
            return self.root or None
        row = self.label("META_DATA").select("full_name").limit(1).collect()
        self.root = (row[0][0] if row else None) or ""
        return self.root or None


def complete(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of the schema in order; missing ones are null."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
