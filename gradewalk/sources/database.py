"""A graph in a spatial database, in its own schema: nodes, edges between them, samples of edges.

Rows go to the database and come from it by tasks.  Writing has two steps: tasks fill staging tables, then one transaction
moves their rows over, so that readers and failed writes see all of a graph or nothing.  Lines and places travel as EWKT
text, which a spatial database takes for a geometry as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.functions import geo
from gradewalk.schemas import EDGE_DEFAULTS, EDGES, GRADE_METRICS
from gradewalk.sources.graph import DATABASE_NAMES, TABLES, from_tables, loading
from gradewalk.storage import stored

#: The coordinate systems of a graph's two geometries, and the columns that can't be null.
PLANE, GLOBE = 26910, 4326
REQUIRED = {"length_m", "base_time_s", "slope_time_s", "dist_m", "z_raw_m", "z_smooth_m"}
KEYS = {"nodes": ["node_id"], "edges": ["edge_id"], "samples": ["edge_id", "seq"]}
SAMPLE_FIELDS = ["dist_m", "z_raw_m", "z_smooth_m", "grade", "rolling_grade_20m", "rolling_grade_50m"]
NODE_FIELDS = ["node_id", "geom", "geom_wgs", "node_type", "z_m"]
KINDS: dict[str, str] = dict(part.split(" ", 1) for part in EDGES.split(", "))
EDGE_FIELDS = [c for c in KINDS if c not in ("source", "target", "geometry", "samples")]
FIELDS = {"nodes": NODE_FIELDS, "edges": ["source_node", "target_node", "geom", "geom_wgs", *EDGE_FIELDS], "samples": ["edge_id", "seq", *SAMPLE_FIELDS]}
#: Column types of a database with geometries and JSON; plain ones are given as text types.
SPATIAL_TYPES = {"Point": "geometry(Point, {srid})", "LineString": "geometry(LineString, {srid})", "text": "TEXT", "json": "JSONB"}


def ewkt(srid: int, shape: Column) -> Column:
    return F.concat(F.lit(f"SRID={srid};"), shape)


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), F.concat_ws(" ", x.cast("string"), y.cast("string")), F.lit(")"))


def places_of(text: Column) -> Column:
    """The places of an EWKT point or line."""
    inner = F.regexp_extract(text, r"\(([^()]*)\)", 1)
    pair = lambda t: F.split(F.trim(t), r"\s+")
    return F.transform(F.split(inner, ","), lambda t: F.struct(pair(t)[0].cast("double").alias("lon"), pair(t)[1].cast("double").alias("lat")))


def rows_of(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table, in the order in which they refer to each other."""
    def flat(lon: Column, lat: Column) -> Column:
        x, y = geo.utm10(lon, lat)
        return F.struct(x.alias("lon"), y.alias("lat"))

    at = flat(F.col("lon"), F.col("lat"))
    placed = nodes.select("node_id", ewkt(PLANE, point_wkt(at["lon"], at["lat"])).alias("geom"), ewkt(GLOBE, point_wkt(F.col("lon"), F.col("lat"))).alias("geom_wgs"), "node_type", "z_m")
    line = F.when(F.size("geometry") > 0, F.col("geometry"))
    drawn = edges.withColumns({"source_node": F.col("source"), "target_node": F.col("target"), "geom": ewkt(PLANE, geo.linestring_wkt(F.transform(line, lambda p: flat(p["lon"], p["lat"])))), "geom_wgs": ewkt(GLOBE, geo.linestring_wkt(line)), "source_tags": F.to_json("source_tags")})
    samples = edges.select("edge_id", F.posexplode("samples").alias("seq", "s")).select("edge_id", "seq", *(f"s.{c}" for c in SAMPLE_FIELDS))
    return {"nodes": placed, "edges": drawn.select(*FIELDS["edges"]), "samples": samples}


def table_definitions(types: dict[str, str]) -> dict[str, str]:
    """CREATE TABLE of each table."""
    def of(name: str, kind: str) -> str:
        sql = {"long": "BIGINT", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN"}.get(kind, types["json"] if name == "source_tags" else types["text"])
        given = 0.0 if name in GRADE_METRICS else EDGE_DEFAULTS.get(name) if name not in REQUIRED and name != "edge_type" else None
        default = "" if given is None else f" DEFAULT '{given}'" if isinstance(given, str) else f" DEFAULT {str(given).upper()}"
        return f"{name} {sql}{default}{' NOT NULL' if name in REQUIRED else ''}"

    shapes = lambda kind: f"geom {types[kind].format(srid=PLANE)} NOT NULL, geom_wgs {types[kind].format(srid=GLOBE)}"
    others = ", ".join(of(c, KINDS[c]) for c in EDGE_FIELDS if c != "edge_id")
    series = ", ".join(of(c, "double") for c in SAMPLE_FIELDS)
    ends = ", ".join(f"{c} BIGINT NOT NULL REFERENCES {TABLES['nodes']}(node_id)" for c in ("source_node", "target_node"))
    return {
        "nodes": f"CREATE TABLE {TABLES['nodes']} (node_id BIGINT NOT NULL PRIMARY KEY, {shapes('Point')}, node_type {types['text']}, z_m DOUBLE PRECISION, confidence DOUBLE PRECISION DEFAULT 1.0)",
        "edges": f"CREATE TABLE {TABLES['edges']} (edge_id BIGINT NOT NULL PRIMARY KEY, {ends}, {shapes('LineString')}, {others}, {', '.join(f'cost_{p} DOUBLE PRECISION' for p in ('fastest', 'balanced', 'flattest', 'accessible'))})",
        "samples": f"CREATE TABLE {TABLES['samples']} (edge_id BIGINT NOT NULL REFERENCES {TABLES['edges']}(edge_id), seq INTEGER NOT NULL, {series}, PRIMARY KEY (edge_id, seq))",
    }


@contextmanager
def transaction(spark: SparkSession, url: str, options: dict[str, str]) -> Iterator[Any]:
    """A JDBC connection of the driver; what it ran is committed at the end, or rolled back if anything failed."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def run(connection: Any, *statements: str) -> None:
    for sql in statements:
        statement = connection.createStatement()
        try:
            statement.execute(sql)
        finally:
            statement.close()


def existing_tables(connection: Any) -> set[str]:
    found, names = connection.getMetaData().getTables(None, None, "%", None), set()
    while found.next():
        names.add(found.getString("TABLE_NAME").lower())
    return names


def create_tables(spark: SparkSession, url: str, options: dict[str, str] | None = None, types: dict[str, str] = SPATIAL_TYPES) -> None:
    """Creates the tables that aren't there."""
    with transaction(spark, url, options or {}) as connection:
        there = existing_tables(connection)
        run(connection, *(sql for name, sql in table_definitions(types).items() if TABLES[name] not in there))


def save_graph(nodes: DataFrame, edges: DataFrame, url: str, options: dict[str, str] | None = None, truncate: bool = True, types: dict[str, str] = SPATIAL_TYPES) -> None:
    """Saves a graph whole or not at all, making the tables where they lack.

    ``truncate`` replaces what the tables hold.  Without it nodes that are there take the new values, while edges and samples
    that are there stay as they are.  A failed task, a repeated id, an edge to an unknown node or one without a line fails the
    write, and the tables stay as they were.
    """
    spark, options = nodes.sparkSession, options or {}
    create_tables(spark, url, options, types)
    staged = {name: f"{TABLES[name]}_{uuid.uuid4().hex[:12]}" for name in TABLES}
    value = lambda name, c: f's."{c}"' if c != "source_tags" or types["json"] == types["text"] else f'CAST(s."{c}" AS {types["json"]})'
    try:
        for name, df in rows_of(nodes, edges).items():
            df.write.format("jdbc").options(url=url, dbtable=staged[name], **options).mode("errorifexists").save()
        moves = [f"DELETE FROM {TABLES[name]}" for name in ("samples", "edges", "nodes")] if truncate else []
        for name, fields in FIELDS.items():
            same = " AND ".join(f't.{k} = s."{k}"' for k in KEYS[name])
            values = ", ".join(value(name, c) for c in fields)
            if name == "nodes":
                new = ", ".join(f'{c} = s."{c}"' for c in fields if c not in KEYS[name])
                moves.append(f"MERGE INTO {TABLES[name]} t USING {staged[name]} s ON {same} WHEN MATCHED THEN UPDATE SET {new}")
            moves.append(f"INSERT INTO {TABLES[name]} ({', '.join(fields)}) SELECT {values} FROM {staged[name]} s WHERE NOT EXISTS (SELECT 1 FROM {TABLES[name]} t WHERE {same})")
        with transaction(spark, url, options) as connection:
            run(connection, *moves)
    finally:
        with transaction(spark, url, options) as connection:
            there = existing_tables(connection)
            run(connection, *(f"DROP TABLE {t}" for t in staged.values() if t in there))


def table_in_parts(spark: SparkSession, url: str, options: dict[str, str], table: str, key: str, columns: str, parts: int) -> DataFrame:
    """A table read by ``parts`` tasks, each a range of ids; filters and columns that are asked for reach the database."""
    load = lambda source, more: spark.read.format("jdbc").options(url=url, dbtable=source, **options, **more).load()
    ends = load(f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}) t", {}).first()
    ranges = {} if ends[0] is None else {"partitionColumn": key, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(parts)}
    df = load(f"(SELECT {columns} FROM {table}) t", ranges)
    return df.toDF(*(c.lower() for c in df.columns))


def load_graph(spark: SparkSession, url: str, options: dict[str, str] | None = None, parts: int = 8, spatial: bool = True) -> tuple[DataFrame, DataFrame]:
    """A saved graph.  ``spatial``: the database writes its geometries as EWKT; else they are such text already.

    A database or table that is missing and a graph without nodes or edges are ``GraphUnavailable``.
    """
    shape = "ST_AsEWKT({0}) AS {0}" if spatial else "{0}"
    own = {"geom": shape.format("geom"), "geom_wgs": shape.format("geom_wgs"), "source_tags": "CAST(source_tags AS text) AS source_tags" if spatial else "source_tags"}
    with loading():
        read = {name: table_in_parts(spark, url, options or {}, TABLES[name], KEYS[name][0], ", ".join(own.get(c, c) for c in fields), parts) for name, fields in FIELDS.items()}
        wgs, flat = places_of(F.col("geom_wgs"))[0], places_of(F.col("geom"))[0]
        nodes = read["nodes"].select("node_id", wgs["lon"].alias("lon"), wgs["lat"].alias("lat"), flat["lon"].alias("x"), flat["lat"].alias("y"), F.coalesce("z_m", F.lit(0.0)).alias("z_m"), "node_type")
        edges = read["edges"].withColumns({"geometry": places_of(F.col("geom_wgs")), "source_tags": F.from_json("source_tags", "map<string,string>")})
        edges = edges.withColumnsRenamed({v: k for k, v in DATABASE_NAMES.items() if k != "geometry"})
        # naming looks through the edges several times, and by filters that not every database can say
        return from_tables(nodes, stored(edges), read["samples"])
