"""Survey tables derived from the benchmark tables, for queries and checks.

`DWELLING`, `RESIDENT` and `RELATION` give each column as an expression that reads the
same in Spark and in the checking engine; how tables are joined is written separately.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions.columns import lookup
from domicilia.operators.joins import hot_keys, join_to_unique

REGION_OF_ORDER = "cast(1 + {key} % 33 as int)"

# Dwellings: orders with their customers.
DWELLING = {
    "A01nficha": "o_orderkey",
    "A01ra": REGION_OF_ORDER.format(key="o_orderkey"),
    "A01setor": (
        "cast(case when o_orderkey % 33 = 0 then 53011 + floor((o_orderkey % 132) / 33)"
        " when o_orderkey % 33 = 26 then 53271 + floor((o_orderkey % 66) / 33)"
        " else 53010 + 10 * (o_orderkey % 33) end as int)"
    ),
    "POS_ESTRATO": "c_mktsegment",
    "PESO_PRE": "cast(1 + o_orderkey % 7 as double)",
    "POP_AJUSTADA_PROJ": "cast(20000 + 1000 * length(c_mktsegment) as double)",
    "datavisita": (
        "concat(cast(month(o_orderdate) as string), '/', cast(day(o_orderdate) as string), '/',"
        " cast(year(o_orderdate) as string))"
    ),
    "B01": "case when o_orderkey % 23 = 0 then 2 else 1 end",
    "B02": "cast(1 + o_custkey % 4 as int)",
    "B03": "cast(1 + o_orderkey % 3 as int)",
    "B05": (
        "case when o_orderkey % 41 = 0 then 77777.0e0 when o_orderkey % 43 = 0 then 88888.0e0"
        " when o_orderkey % 47 = 0 then null else o_totalprice / 500.0e0 end"
    ),
    "B06": "case when o_orderkey % 5 = 0 then 88 when o_orderkey % 5 = 1 then 2 else 1 end",
    "B08": "cast(1 + o_orderkey % 6 as int)",
    "B12": "cast(o_orderkey % 4 as int)",
    "A01nfamilias": "case when o_orderkey % 13 < 3 then 2 else 1 end",
    "A01npessoas": "cast(o_custkey % 8 as int)",
    "FATOR_PROJ": "cast(1 + o_orderkey % 7 as double)",
}

# Residents: order lines; `head` marks the first line of the order in full sort order.
RESIDENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
RELATION = {
    "E02": (
        "case when head then 1 when l_partkey % 29 = 0 then 17 when l_partkey % 31 = 0 then 18"
        " when l_partkey % 37 = 0 then null else 1 + l_linenumber end"
    )
}
RESIDENT = {
    "A01nficha": "l_orderkey",
    "A01ra": "case when l_suppkey % 83 = 0 then null else " + REGION_OF_ORDER.format(key="l_orderkey") + " end",
    "idade_calculada": "cast(18 + l_partkey % 60 as int)",
    "E03": "cast(1 + l_suppkey % 2 as int)",
    "E04": "cast(1 + l_partkey % 5 as int)",
    "E21": "cast(1 + l_partkey % 3 as int)",
    "G05": "case when l_partkey % 10 = 0 then 4 when l_partkey % 10 = 1 then 99 else 1 end",
    "G08": "cast(1 + l_partkey % 16 as int)",
    "G09": "cast(1 + l_suppkey % 2 as int)",
    "G13": "case when l_partkey % 4 = 0 then 3 when l_partkey % 4 = 1 then 88 else 1 end",
    "G041": "case when l_partkey % 6 = 0 then 1 else 2 end",
    "G16": (
        "case when l_partkey % 59 = 0 then 77777.0e0 when l_partkey % 61 = 0 then 88888.0e0"
        " when l_partkey % 13 = 0 then 66666.0e0 when l_partkey % 17 = 0 then 99999.0e0"
        " when l_partkey % 3 = 0 then l_extendedprice / 10.0e0 else l_extendedprice / 100.0e0 end"
    ),
    "G19": "case when l_partkey % 11 = 0 then 66666.0e0 else l_quantity end",
    "G201": "case when l_partkey % 53 = 0 then 88888.0e0 else 0.0e0 end",
    "G202": "0.0e0",
    "G203": "case when l_suppkey % 97 = 0 then 77777.0e0 else 0.0e0 end",
    "G204": "66666.0e0",
    "FATOR_PROJ": "cast(1 + l_orderkey % 7 as double)",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(frame: DataFrame, fields: dict[str, str]) -> DataFrame:
    return frame.selectExpr(*[f"{sql} as {name}" for name, sql in fields.items()])


def dwellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return _named(orders.join(customer, orders.o_custkey == customer.c_custkey), DWELLING)


def residents(spark: SparkSession, sf_dir: str, relation: bool = True) -> DataFrame:
    """Order lines as residents; without `relation` the search for the head is spared."""
    lines = _table(spark, sf_dir, "lineitem")
    if not relation:
        return _named(lines, RESIDENT)
    first = lines.groupBy("l_orderkey").agg(F.min(F.struct(*RESIDENT_ORDER)).alias("_first"))
    joined = join_to_unique(lines, first, ["l_orderkey"], "inner", hot_keys(lines, ["l_orderkey"]))
    marked = joined.withColumn("head", F.struct(*RESIDENT_ORDER) == F.col("_first"))
    return _named(marked, {**RESIDENT, **RELATION})


# Monthly price changes in %, by class: from line taxes and from order totals.
INDEX_GENERAL = "round(10 * avg(l_tax) + 0.01 * month(l_shipdate), 2)"
INDEX_RENT = "round(avg(o_totalprice) / 1000000 + 0.02 * month(o_orderdate), 2)"


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index extract of the year: (classe, ref, ref1, valor)."""
    parts = []
    for table, date, value, classe in (
        ("lineitem", "l_shipdate", INDEX_GENERAL, codes.GENERAL_INDEX),
        ("orders", "o_orderdate", INDEX_RENT, codes.RENT_INDEX),
    ):
        rows = _table(spark, sf_dir, table).withColumn("m", F.month(date))
        value = value.replace(f"month({date})", "m")
        parts.append(rows.groupBy("m").agg(F.expr(value).cast("double").alias("valor")).withColumn("classe", F.lit(classe)))
    month = F.col("m")
    return parts[0].unionByName(parts[1]).select(
        "classe",
        F.concat(F.lit("2018"), F.lpad(month.cast("string"), 2, "0")).alias("ref"),
        F.concat(lookup(month, codes.MONTHS), F.lit(" 2018")).alias("ref1"),
        "valor",
    )


OCCUPIED = {
    "ra_cira": REGION_OF_ORDER.format(key="o_orderkey"),
    "ano": "cast(year(o_orderdate) as int)",
    "area_1": "o_totalprice",
}
OCCUPIED_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def occupied_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied-area polygons: region, year, hectares."""
    return _named(_table(spark, sf_dir, "orders"), OCCUPIED)


def region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region polygons: code, prefixed code, label as drawn on the map, number, area."""
    drawn = {label: raw for raw, label in codes.POLYGON_LABELS.items()}
    grouped = _table(spark, sf_dir, "orders").groupBy(F.expr(DWELLING["A01ra"]).alias("ra_cira")).agg(
        (1000.0 + F.count("*") % 1000).alias("area")
    )
    name = lookup(F.col("ra_cira"), codes.REGIONS)
    return grouped.select(
        F.col("ra_cira").cast("string").alias("ra_cira"),
        F.concat(F.lit("RA-"), F.col("ra_cira").cast("string")).alias("ra_codigo"),
        F.coalesce(lookup(name, drawn), name).alias("ra"),
        F.col("ra_cira").cast("string").alias("ra_num"),
        "area",
    )


# Lots as rectangles, every seventh with a rectangular hole; whole numbers.
VERTEX_RINGS = {
    0: "c_custkey % 1000 * 10, c_custkey % 777 * 10, 20 + c_custkey % 30, 20 + c_custkey % 17",
    1: "c_custkey % 1000 * 10 + 2, c_custkey % 777 * 10 + 3, 4, 5 + c_custkey % 3",
}


def lot_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex table of customers' lots: (poly_id, ring, seq, x, y)."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey")
    parts = []
    for ring, box in VERTEX_RINGS.items():
        x, y, width, height = [F.expr(e.strip()).cast("double") for e in box.split(",")]
        rows = customer if ring == 0 else customer.filter("c_custkey % 7 = 0")
        corners = F.array(
            F.struct(x.alias("x"), y.alias("y")),
            F.struct((x + width).alias("x"), y.alias("y")),
            F.struct((x + width).alias("x"), (y + height).alias("y")),
            F.struct(x.alias("x"), (y + height).alias("y")),
        )
        parts.append(
            rows.select(F.col("c_custkey").alias("poly_id"), F.lit(ring).alias("ring"), F.posexplode(corners).alias("seq", "p"))
            .select("poly_id", "ring", "seq", "p.x", "p.y")
        )
    return parts[0].unionByName(parts[1])


# Parcels: a grid of equal rectangles, some missing, in regions of whole blocks.
PARCEL = {"c": "c_custkey % 40", "r": "floor(c_custkey / 40)"}
PARCEL_SIZE = (10.0, 8.0)
PARCEL_KEPT = "c_custkey % 11 <> 5"
PARCEL_REGION = "cast(1 + (floor((c_custkey % 40) / 7) + 3 * floor(floor(c_custkey / 40) / 5)) % 33 as int)"


def parcels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertex table of parcels that share borders, and the region of each; every other runs clockwise."""
    customer = _table(spark, sf_dir, "customer").filter(PARCEL_KEPT).select("c_custkey")
    width, height = PARCEL_SIZE
    x, y = F.expr(PARCEL["c"]) * width, F.expr(PARCEL["r"]) * height
    corners = [F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (width, 0), (width, height), (0, height))]
    ring = F.when(F.col("c_custkey") % 2 == 0, F.array(*corners)).otherwise(F.array(*corners[::-1]))
    unfolded = customer.select(F.col("c_custkey").alias("poly_id"), F.lit(0).alias("ring"), F.posexplode(ring).alias("seq", "p"))
    regions = customer.select(F.col("c_custkey").alias("poly_id"), F.expr(PARCEL_REGION).alias("ra_cira"))
    return unfolded.select("poly_id", "ring", "seq", "p.x", "p.y"), regions


# Lots drawn badly: crossed outlines, holes that stick out, borders passed over twice; whole numbers.
SKETCH_WIDTH, SKETCH_HEIGHT = "(20 + 2 * (c_custkey % 15))", "(20 + 2 * (c_custkey % 8))"
SKETCHES = {
    0: {0: "0 0, w h, w 0, 0 h"},
    1: {0: "0 0, w 0, w h, 0 h", 1: "w-3 2, w+2 2, w+2 5, w-3 5"},
    2: {0: "0 0, w 0, w h, 0 h", 1: "4 4, 8 4, 8 9, 4 9"},
    3: {0: "0 0, w 0, w h, 0 h, 0 0, w 0, w h, 0 h"},
}


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex table of one drawing per customer; its kind is the remainder of the key by four."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey")
    places = {"w": f"cast({SKETCH_WIDTH} as double)", "h": f"cast({SKETCH_HEIGHT} as double)"}
    parts = []
    for kind, rings in SKETCHES.items():
        for ring, text in rings.items():
            points = [[re.sub("[wh]", lambda m: places[m[0]], part) for part in point.split()] for point in text.split(",")]
            corners = F.array(*[F.struct(F.expr(f"cast({px} as double)").alias("x"), F.expr(f"cast({py} as double)").alias("y")) for px, py in points])
            rows = customer.filter(f"c_custkey % {len(SKETCHES)} = {kind}")
            parts.append(rows.select(F.col("c_custkey").alias("poly_id"), F.lit(ring).alias("ring"), F.posexplode(corners).alias("seq", "p")))
    return reduce(DataFrame.unionByName, parts).select("poly_id", "ring", "seq", "p.x", "p.y")
