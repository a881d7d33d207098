"""Graph documents: nodes (id, name, class, connections) and links (source, target, type) in several formats.

Every format is a DataFrame of text lines in order (part, line), written as text by `save`. Lines are
made row by row, so a graph of any size is exported without gathering it anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.lineage import cut


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """A dense number from 0 in the given order: the rows before each range partition plus the place in it.

    The ranges are written out, so that their sizes and their rows are of one and the same split.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    rows = cut(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    # One row for each range partition.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.select("_p", "_first", before.alias("_before"))
    return rows.join(F.broadcast(offset), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_before")


def graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their degree, and links whose ends both exist, each once."""
    ids = nodes.select("id")
    e = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type").distinct()
    e = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    degree = e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("connections"))
    n = nodes.join(degree, "id", "left").select("id", "name", F.col("label").alias("class"), F.coalesce("connections", F.lit(0)).alias("connections"))
    return n, e.select("source", "target", "type")


def xml(c: F.Column) -> F.Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _lines(spark, head: list[str], nodes: DataFrame, middle: list[str], links: DataFrame, tail: list[str]) -> DataFrame:
    """part, key, line: fixed lines around those of nodes and links (key, line)."""

    def fixed(part: int, rows: list[str]) -> DataFrame:
        return spark.createDataFrame([(part, f"{k:04d}", x) for k, x in enumerate(rows)], "part int, key string, line string")

    out = fixed(0, head)
    for part, df in ((1, nodes), (3, links)):
        out = out.unionByName(df.select(F.lit(part).alias("part"), "key", "line"))
    return out.unionByName(fixed(2, middle)).unionByName(fixed(4, tail))


def _link_key() -> F.Column:
    return F.concat_ws("|", "source", "target", "type")


def to_json(n: DataFrame, e: DataFrame) -> DataFrame:
    """One JSON object a line: {"node": ...} and {"link": ...}; `document` has all in one."""
    nodes = n.select(F.col("id").alias("key"), F.to_json(F.struct(F.struct("id", "name", "class", "connections").alias("node"))).alias("line"))
    links = e.select(_link_key().alias("key"), F.to_json(F.struct(F.struct("source", "target", "type").alias("link"))).alias("line"))
    return _lines(n.sparkSession, [], nodes, [], links, [])


def document(n: DataFrame, e: DataFrame) -> DataFrame:
    """A single {nodes, links} document, as its lines (part, key, line): in order they are one JSON text of any size, which `save` writes."""

    def items(df: DataFrame, key: F.Column, *fields: str) -> DataFrame:
        own = cut(df.select(key.alias("key"), F.to_json(F.struct(*fields)).alias("item")))
        first = own.agg(F.min("key").alias("first"))  # one row
        comma = F.when(F.col("key") == F.col("first"), "").otherwise(",")
        return own.crossJoin(F.broadcast(first)).select("key", F.concat(comma, "item").alias("line"))

    nodes, links = items(n, F.col("id"), "id", "name", "class", "connections"), items(e, _link_key(), "source", "target", "type")
    return _lines(n.sparkSession, ['{"nodes":['], nodes, ['],"links":['], links, ["]}"])


def to_cytoscape(n: DataFrame, e: DataFrame) -> DataFrame:
    """Elements a line, each {group, data}."""
    nodes = n.select(F.col("id").alias("key"), F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct("id", F.col("name").alias("label"), "class", "connections").alias("data"))).alias("line"))
    links = e.select(_link_key().alias("key"), F.to_json(F.struct(F.lit("edges").alias("group"), F.struct(_link_key().alias("id"), "source", "target", F.col("type").alias("label")).alias("data"))).alias("line"))
    return _lines(n.sparkSession, [], nodes, [], links, [])


def to_graphml(n: DataFrame, e: DataFrame) -> DataFrame:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="{t}"/>' for k, f, t in (("name", "node", "string"), ("class", "node", "string"), ("connections", "node", "int"), ("type", "edge", "string"))]
    head.append('<graph id="G" edgedefault="directed">')
    cell = '<node id="%s"><data key="name">%s</data><data key="class">%s</data><data key="connections">%d</data></node>'
    nodes = n.select(F.col("id").alias("key"), F.format_string(cell, xml(F.col("id")), xml(F.coalesce("name", F.lit(""))), xml(F.col("class")), F.col("connections")).alias("line"))
    links = numbered(e.withColumn("key", _link_key()), "key", "i")
    links = links.select("key", F.format_string('<edge id="e%d" source="%s" target="%s"><data key="type">%s</data></edge>', F.col("i"), xml(F.col("source")), xml(F.col("target")), xml(F.col("type"))).alias("line"))
    return _lines(n.sparkSession, head, nodes, [], links, ["</graph>", "</graphml>"])


def to_gexf(n: DataFrame, e: DataFrame) -> DataFrame:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', '<graph mode="static" defaultedgetype="directed">']
    head += ['<attributes class="node"><attribute id="0" title="class" type="string"/><attribute id="1" title="connections" type="integer"/></attributes>', "<nodes>"]
    cell = '<node id="%s" label="%s"><attvalues><attvalue for="0" value="%s"/><attvalue for="1" value="%d"/></attvalues></node>'
    nodes = n.select(F.col("id").alias("key"), F.format_string(cell, xml(F.col("id")), xml(F.coalesce("name", F.lit(""))), xml(F.col("class")), F.col("connections")).alias("line"))
    links = numbered(e.withColumn("key", _link_key()), "key", "i")
    links = links.select("key", F.format_string('<edge id="%d" source="%s" target="%s" label="%s"/>', F.col("i"), xml(F.col("source")), xml(F.col("target")), xml(F.col("type"))).alias("line"))
    return _lines(n.sparkSession, head, nodes, ["</nodes>", "<edges>"], links, ["</edges>", "</graph>", "</gexf>"])


def to_d3(n: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with an index, and links between indices."""
    indexed = numbered(n, "id", "index")
    at = indexed.select("id", "index")
    links = e.join(at.withColumnsRenamed({"id": "source", "index": "source_index"}), "source").join(at.withColumnsRenamed({"id": "target", "index": "target_index"}), "target")
    return indexed.select("index", "id", "name", "class", "connections"), links.select("source_index", "target_index", "type")


FORMATS = {"cytoscape": to_cytoscape, "gexf": to_gexf, "graphml": to_graphml, "json": to_json}


def export(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Lines of a format; JSON for anything unknown."""
    return FORMATS.get(kind or "json", to_json)(*graph(nodes, edges))


def save(lines: DataFrame, path: str) -> None:
    """Text files that read in order of their names: one file for small graphs, as many as the data need for others."""
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
