"""Reading, writing and cataloguing graphs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graph import WebGraph
from skein.operators.stats import link_types
from skein.schema import EDGES, NODES
from skein.shared import salted_join


def write_graph(graph: WebGraph, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """Nodes and edges below ``path``; JSON and Parquet keep maps, CSV has them as JSON texts."""
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        if fmt == "csv":
            maps = [c for c, t in df.dtypes if t.startswith(("map", "array", "struct"))]
            df = df.withColumns({c: F.to_json(c) for c in maps})
        writer = df.write.mode("overwrite")
        if partition_by and name == "nodes":
            writer = writer.partitionBy(partition_by)
        (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, fmt: str = "parquet") -> WebGraph:
    """Graph written by :func:`write_graph`."""
    if fmt != "csv":
        return WebGraph(*(spark.read.schema(s).format(fmt).load(f"{path}/{n}") for n, s in (("nodes", NODES), ("edges", EDGES))))
    out = []
    for name, schema in (("nodes", NODES), ("edges", EDGES)):
        flat = schema.replace("map<string,string>", "string")
        df = spark.read.schema(flat).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/{name}")
        out.append(df.withColumns({c: F.from_json(c, "map<string,string>") for c in ("metadata", "user_data") if c in df.columns}))
    return WebGraph(*out)


def write_jdbc(graph: WebGraph, url: str, prefix: str = "graph", properties: dict[str, str] | None = None) -> None:
    """Tables ``{prefix}_nodes`` and ``{prefix}_edges`` of a database whose driver the session has."""
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        maps = [c for c, t in df.dtypes if t.startswith("map")]
        df.withColumns({c: F.to_json(c) for c in maps}).write.jdbc(url, f"{prefix}_{name}", "overwrite", properties or {})


def read_jdbc(spark: SparkSession, url: str, prefix: str = "graph", properties: dict[str, str] | None = None, partitions: int = 1) -> WebGraph:
    """Graph written by :func:`write_jdbc`; with ``partitions`` the nodes are read by ranges of depth, the edges at once."""
    out = []
    for name, schema in (("nodes", NODES), ("edges", EDGES)):
        at = f"{prefix}_{name}"
        if name == "nodes" and partitions > 1:
            least, most = spark.read.jdbc(url, at, properties=properties or {}).agg(F.min("depth"), F.max("depth")).first()
            df = spark.read.jdbc(url, at, column="depth", lowerBound=least or 0, upperBound=(most or 0) + 1, numPartitions=partitions, properties=properties or {})
        else:
            df = spark.read.jdbc(url, at, properties=properties or {})
        maps = [f.split()[0] for f in schema.split(", ") if "map<" in f]
        out.append(df.withColumns({c: F.from_json(c, "map<string,string>") for c in maps if c in df.columns}))
    return WebGraph(*out)


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows, those of the new ids replaced."""
    return stored.join(new.select("node_id").distinct(), "node_id", "left_anti").select(*stored.columns).unionByName(new, allowMissingColumns=True)


def export_edges(graph: WebGraph) -> DataFrame:
    """Edges with what is known of both ends; unknown ends have blank urls."""
    end = lambda p: graph.nodes.select(F.col("node_id").alias(f"{p}_node_id"), F.col("url").alias(f"{p}_url"), F.col("depth").alias(f"{p}_depth"), F.col("scanned").alias(f"{p}_scanned"))
    rows = salted_join(salted_join(graph.edges, end("source"), "source_node_id", "left"), end("target"), "target_node_id", "left", counted=graph.edges)
    return rows.select("edge_id", "source_node_id", "target_node_id", F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("target_url", F.lit("")).alias("target_url"), "source_depth", "target_depth", F.to_json("metadata").alias("metadata"))


def base_colour(scanned: Column, should_scan: Column) -> Column:
    return F.when(scanned & should_scan, "#4CAF50").when(scanned, "#2196F3").when(should_scan, "#FFC107").otherwise("#9E9E9E")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(graph: WebGraph, label: str = "url") -> DataFrame:
    """Lines of a DOT file with their order: ``(part, line)``.

    Labels are cut to 50 characters; nodes are shaded by depth, external links
    red, links back orange.
    """
    text = F.coalesce(F.col(label) if label != "node_id" else F.substring("node_id", 1, 12), F.lit(""))
    cut = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    shade = F.format_number(F.lit(0.9) - F.lit(0.08) * F.least(F.coalesce("depth", F.lit(0)), F.lit(10)), 2)
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), _quoted(F.col("node_id")), F.lit(" [label="), _quoted(cut), F.lit(', style=filled, fillcolor="0.6 0.3 '), shade, F.lit('"];')).alias("line"))
    kinds = link_types(F.col("metadata"))
    colour = F.when(F.array_contains(kinds, "external"), ' [color="red"]').when(F.array_contains(kinds, "back"), ' [color="orange"]').otherwise("")
    edges = graph.edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), _quoted(F.col("source_node_id")), F.lit(" -> "), _quoted(F.col("target_node_id")), colour, F.lit(";")).alias("line"))
    spark = graph.nodes.sparkSession
    return spark.createDataFrame([(0, "digraph G {")], "part int, line string").unionByName(nodes).unionByName(edges).unionByName(spark.createDataFrame([(3, "}")], "part int, line string"))


def write_dot(graph: WebGraph, path: str, label: str = "url") -> None:
    dot_lines(graph, label).repartitionByRange("part").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)


def graph_summary(graph: WebGraph) -> DataFrame:
    """Metric and value rows, as a workbook's summary sheet has them."""
    from skein.operators.stats import graph_stats

    s = graph_stats(graph.nodes, graph.edges)
    return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in s.columns])).alias("x")).select("x.*")


class Catalog:
    """Named, versioned graphs below a folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, name: str, graph: WebGraph, version: str | None = None) -> str:
        version = version or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        write_graph(graph, f"{self.root}/{name}/version={version}")
        return version

    def versions(self, name: str) -> list[str]:
        """Versions of a graph, newest first."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        return sorted((s.getPath().getName().removeprefix("version=") for s in fs.listStatus(folder)), reverse=True)

    def names(self) -> list[str]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def load(self, name: str, version: str | None = None) -> WebGraph:
        found = self.versions(name)
        wanted = version or (found[0] if found else None)
        if wanted not in found:
            raise KeyError(f"no graph {name!r}" + (f" of version {version!r}" if version else ""))
        return read_graph(self.spark, f"{self.root}/{name}/version={wanted}")

    def delete(self, name: str, version: str | None = None) -> bool:
        jvm, fs = self._fs()
        return fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" + (f"/version={version}" if version else "")), True)
