"""Building models made of the given tables: regions are buildings, nations are
zones, customers are surfaces, orders are windows, suppliers own the equipment."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings.base import query, table
from hearthline.operators import objects as ob
from hearthline.plans import building
from hearthline.session import scratch_path
from hearthline.sources.buildings import write_building_objects


def _objects(df: DataFrame, kind: str | Column, pos: Column, key: Column, /, **props) -> DataFrame:
    """Objects of one type; a property that is NULL is left out."""
    body = F.to_json(F.struct(*[v.alias(k) for k, v in props.items()]))
    return df.select(
        F.col("r_name").alias("building_id"),
        F.lit(0).alias("type_pos"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("object_type"),
        pos.cast("bigint").alias("obj_pos"),
        key.alias("object_name"),
        F.parse_json(body).alias("props"),
    )


def _tag(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def city(spark, sf, *kinds: str) -> DataFrame:
    """The object table, of all or the given types.

    Nation 7 is no defined zone, and many references dangle.
    """
    # Nations and regions are fixed lists of a few dozen rows.
    places = F.broadcast(
        table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    customers = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    n, c, s, o = F.col("n_nationkey"), F.col("c_custkey"), F.col("s_suppkey"), F.col("o_orderkey")
    nation = F.col("n_name")
    boundary = F.when(c % 3 == 0, "Outdoors").when(c % 3 == 1, "Surface").otherwise("Ground")
    schedule = F.array(
        F.struct(F.lit("Through: 12/31").alias("field")),
        F.struct(F.lit("For: AllDays").alias("field")),
        F.struct(F.lit("Until: 07:00").alias("field")),
        F.struct((s % 25).cast("string").alias("field")),
        F.struct(F.lit("x").alias("field")),
        F.struct(F.lit("y").alias("field")),
        F.struct(F.lit("Until: 24:00").alias("field")),
        F.struct(F.when(s % 2 == 0, F.lit("none")).otherwise(F.col("s_acctbal").cast("string")).alias("field")),
        F.struct(F.lit("rest").alias("field")),
    )
    units = F.array(
        F.struct(F.lit("ZoneHVAC:AirDistributionUnit").alias("zone_equipment_object_type"), _tag("ADU", s).alias("zone_equipment_name")),
        F.struct(F.lit("Fan").alias("zone_equipment_object_type"), _tag("FAN", s).alias("zone_equipment_name")),
        F.struct(F.lit("ZoneHVAC:AirDistributionUnit").alias("zone_equipment_object_type"), _tag("ADU", s - 7).alias("zone_equipment_name")),
    )
    terminal = F.when(s % 2 == 0, "AirTerminal:A").otherwise("AirTerminal:B")
    zone_field = F.when(s % 3 == 0, F.concat(nation, F.lit(" List"))).otherwise(nation)
    parts = {
        "Zone": lambda: _objects(
            places.where(n != 7), "Zone", n, nation,
            ceiling_height=n / 2.0, volume=n * 10.0, multiplier=F.lit(1),
            name=F.when(n % 2 == 0, _tag("Hall ", n)), direction_of_relative_north=n * 3,
        ),
        "BuildingSurface:Detailed": lambda: _objects(
            customers, "BuildingSurface:Detailed", c, F.col("c_name"),
            name=_tag("N", c % 300), zone_name=nation, surface_type=F.col("c_mktsegment"), outside_boundary_condition=boundary,
            outside_boundary_condition_object=F.when(c % 3 == 1, F.when(c % 2 == 0, _tag("N", (c * 7 + 1) % 300)).otherwise(
                F.concat(F.lit("Customer#"), F.lpad((c + 4).cast("string"), 9, "0")))),
            sun_exposure=F.when(c % 2 == 0, "SunExposed"), wind_exposure=F.lit("WindExposed"), construction_name=_tag("C", c % 120),
        ),
        "FenestrationSurface:Detailed": lambda: _objects(
            orders, "FenestrationSurface:Detailed", o, _tag("W", o),
            building_surface_name=F.when(o % 11 != 0, F.col("c_name")).otherwise("none"),
            construction_name=F.when(o % 5 != 0, _tag("C", o % 90)), view_factor_to_ground=o % 10,
        ),
        "Construction": lambda: _objects(suppliers, "Construction", s, _tag("C", s), outside_layer=F.col("s_name"), layers=F.array(s, s + 1)),
        "ZoneInfiltration:DesignFlowRate": lambda: _objects(
            suppliers, "ZoneInfiltration:DesignFlowRate", s, _tag("INF", s),
            zone_or_zonelist_or_space_or_spacelist_name=zone_field, design_flow_rate=F.col("s_acctbal"), schedule_name=_tag("SCH", s),
        ),
        "ZoneHVAC:EquipmentConnections": lambda: _objects(
            suppliers, "ZoneHVAC:EquipmentConnections", s, _tag("EC", s),
            zone_name=nation, zone_conditioning_equipment_list_name=_tag("EL", s),
        ),
        "ZoneHVAC:EquipmentList": lambda: _objects(suppliers.where(s % 13 != 0), "ZoneHVAC:EquipmentList", s, _tag("EL", s), equipment=units),
        "ZoneHVAC:AirDistributionUnit": lambda: _objects(
            suppliers, "ZoneHVAC:AirDistributionUnit", s, _tag("ADU", s),
            air_terminal_object_type=terminal, air_terminal_name=_tag("T", s),
        ),
        "AirTerminal": lambda: _objects(
            suppliers.where(s % 5 != 0), terminal, s, _tag("T", s),
            maximum_air_flow_rate=F.when(s % 4 == 0, "Autosize").otherwise((s * 2).cast("string")),
            reheat_coil_object_type=F.lit("Coil:Heating"), reheat_coil_name=_tag("K", s),
        ),
        "Coil:Heating": lambda: _objects(suppliers.where(s % 3 == 0), "Coil:Heating", s, _tag("K", s), efficiency=F.lit(1), nominal_capacity=s * 100),
        "AirLoopHVAC:ZoneSplitter": lambda: _objects(
            suppliers.where(s % 4 == 0), "AirLoopHVAC:ZoneSplitter", s, _tag("SP", s),
            nodes=F.array(
                F.struct(F.concat(nation, F.lit(" ATU In Node")).alias("outlet_node_name")),
                F.struct(F.concat(F.lit("X "), nation, F.lit(" ATU")).alias("outlet_node_name")),
            ),
        ),
        "AirLoopHVAC": lambda: _objects(
            places.groupBy("r_name", "r_regionkey").agg(F.max("n_nationkey").alias("n")).where("r_regionkey <> 2"),
            "AirLoopHVAC", F.lit(0), F.lit("VAV Sys 1"), design_supply_air_flow_rate=F.col("r_regionkey") * 5,
        ),
        "ZoneControl:Thermostat": lambda: _objects(
            suppliers, "ZoneControl:Thermostat", s, _tag("TH", s),
            zone_or_zonelist_name=nation, control_type_schedule_name=_tag("CT", s),
            control_1_object_type=F.lit("Setpoint:Heat"), control_1_name=_tag("SH", s),
            control_2_object_type=F.when(s % 2 == 0, "Setpoint:Dual"), control_2_name=_tag("SD", s - 7),
        ),
        "Setpoint:Heat": lambda: _objects(suppliers.where(s % 6 != 0), "Setpoint:Heat", s, _tag("SH", s), heating_setpoint_temperature_schedule_name=_tag("SCH", s)),
        "Setpoint:Dual": lambda: _objects(
            suppliers, "Setpoint:Dual", s, _tag("SD", s),
            cooling_setpoint_temperature_schedule_name=_tag("SCH", s), heating_setpoint_temperature_schedule_name=F.lit("H"),
        ),
        "Schedule:Compact": lambda: _objects(suppliers.where(s % 9 != 0), "Schedule:Compact", s, _tag("SCH", s), data=schedule),
        "People": lambda: _objects(
            customers, "People", c, _tag("P", c),
            zone_or_zonelist_or_space_or_spacelist_name=nation, number_of_people=c % 50, fraction_radiant=F.when(c % 2 == 0, 0.3),
            number_of_people_schedule_name=_tag("SCH", c % 100),
        ),
        "Lights": lambda: _objects(
            suppliers, "Lights", s, _tag("L", s),
            zone_or_zonelist_or_space_or_spacelist_name=nation, lighting_level=s * 3, schedule_name=_tag("SCH", s),
        ),
        "ElectricEquipment": lambda: _objects(
            suppliers, "ElectricEquipment", s, _tag("E", s),
            zone_or_zonelist_or_space_or_spacelist_name=zone_field, design_level=s * 4, fraction_latent=F.lit(0.5),
        ),
        "Building": lambda: _objects(places, "Building", n, nation, name=nation, terrain=F.lit("City")),
        "Site:Location": lambda: _objects(places, "Site:Location", -n, nation, name=nation, latitude=n * 1.5),
        "Output:Variable": lambda: _objects(places.where("r_regionkey < 3"), "Output:Variable", n, nation, key_value=F.lit("*")),
    }
    return reduce(DataFrame.unionByName, [parts[k]() for k in kinds or parts])


def stored_city(spark, sf) -> DataFrame:
    """The object table written by type, as operators that read it often want it."""
    path = scratch_path(spark, "objects")
    write_building_objects(city(spark, sf), path)
    return spark.read.parquet(path)


PLACES_SQL = "places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)"
CUSTOMERS_SQL = "cust AS (SELECT * FROM customer JOIN places ON c_nationkey = n_nationkey)"
SUPPLIERS_SQL = "supp AS (SELECT * FROM supplier JOIN places ON s_nationkey = n_nationkey)"
ORDERS_SQL = "ord AS (SELECT * FROM orders JOIN cust ON o_custkey = c_custkey)"
BASE_SQL = f"WITH {PLACES_SQL}, {CUSTOMERS_SQL}, {SUPPLIERS_SQL}, {ORDERS_SQL}"
SURFACES_SQL = """surf AS (SELECT r_name AS building_id, n_name AS zone, c_custkey AS obj_pos, c_name AS surface, 'N' || c_custkey % 300 AS name,
 c_mktsegment AS type, CASE c_custkey % 3 WHEN 0 THEN 'Outdoors' WHEN 1 THEN 'Surface' ELSE 'Ground' END AS boundary,
 CASE WHEN c_custkey % 3 <> 1 THEN 'Unknown' WHEN c_custkey % 2 = 0 THEN 'N' || (c_custkey * 7 + 1) % 300
  ELSE 'Customer#' || lpad(CAST(c_custkey + 4 AS VARCHAR), 9, '0') END AS boundary_object,
 'C' || c_custkey % 120 AS construction, CASE WHEN c_custkey % 2 = 0 THEN 'SunExposed' ELSE 'Unknown' END AS sun FROM cust)"""
WINDOWS_SQL = """win AS (SELECT r_name AS building_id, n_name AS zone, o_orderkey AS obj_pos, 'W' || o_orderkey AS "window", c_name AS parent_surface,
 CASE WHEN o_orderkey % 5 <> 0 THEN 'C' || o_orderkey % 90 ELSE 'Unknown' END AS construction, CAST(o_orderkey % 10 AS VARCHAR) AS vf_to_ground
 FROM ord WHERE o_orderkey % 11 <> 0)"""


COUNTS_SQL = f"""counts AS (
 SELECT r_name AS building_id, 'Zone' AS object_type, count(*) FILTER (n_nationkey <> 7) AS n_objects FROM places GROUP BY 1
 UNION ALL SELECT r_name, 'BuildingSurface:Detailed', count(*) FROM cust GROUP BY 1
 UNION ALL SELECT r_name, 'People', count(*) FROM cust GROUP BY 1
 UNION ALL SELECT r_name, 'FenestrationSurface:Detailed', count(*) FROM ord GROUP BY 1
 UNION ALL SELECT r_name, t, count(*) FROM supp, (VALUES ('Construction'), ('ZoneInfiltration:DesignFlowRate'), ('ZoneHVAC:EquipmentConnections'),
  ('ZoneHVAC:AirDistributionUnit'), ('ZoneControl:Thermostat'), ('Setpoint:Dual'), ('Lights'), ('ElectricEquipment')) v(t) GROUP BY 1, 2
 UNION ALL SELECT r_name, 'ZoneHVAC:EquipmentList', count(*) FROM supp WHERE s_suppkey % 13 <> 0 GROUP BY 1
 UNION ALL SELECT r_name, CASE WHEN s_suppkey % 2 = 0 THEN 'AirTerminal:A' ELSE 'AirTerminal:B' END, count(*) FROM supp WHERE s_suppkey % 5 <> 0 GROUP BY 1, 2
 UNION ALL SELECT r_name, 'Coil:Heating', count(*) FROM supp WHERE s_suppkey % 3 = 0 GROUP BY 1
 UNION ALL SELECT r_name, 'AirLoopHVAC:ZoneSplitter', count(*) FROM supp WHERE s_suppkey % 4 = 0 GROUP BY 1
 UNION ALL SELECT r_name, 'AirLoopHVAC', 1 FROM region WHERE r_regionkey <> 2
 UNION ALL SELECT r_name, 'Setpoint:Heat', count(*) FROM supp WHERE s_suppkey % 6 <> 0 GROUP BY 1
 UNION ALL SELECT r_name, 'Schedule:Compact', count(*) FROM supp WHERE s_suppkey % 9 <> 0 GROUP BY 1
 UNION ALL SELECT r_name, t, count(*) FROM places, (VALUES ('Building'), ('Site:Location')) v(t) GROUP BY 1, 2
 UNION ALL SELECT r_name, 'Output:Variable', count(*) FROM places WHERE r_regionkey < 3 GROUP BY 1)"""


@query("A12_object_counts", f"{BASE_SQL}, {COUNTS_SQL} SELECT * FROM counts")
def object_counts(spark, sf):
    return ob.object_counts(city(spark, sf))


CATEGORY_SQL = """cat(category, object_type) AS (VALUES ('hvac', 'AirLoopHVAC'), ('hvac', 'ZoneHVAC:EquipmentConnections'), ('schedules', 'Schedule:Compact'),
 ('constructions', 'Construction'), ('loads', 'People'), ('loads', 'Lights'), ('loads', 'ElectricEquipment'), ('loads', 'ZoneInfiltration:DesignFlowRate'),
 ('zones', 'Zone'), ('outputs', 'Output:Variable'), ('materials', 'none'), ('meters', 'none')),
sums AS (SELECT r_name AS building_id, category, CAST(coalesce(sum(n_objects), 0) AS BIGINT) AS n_objects, count(n_objects) AS n_types FROM region CROSS JOIN cat
 LEFT JOIN counts ON counts.building_id = r_name AND counts.object_type = cat.object_type GROUP BY 1, 2)"""


@query("A12_category_counts", f"{BASE_SQL}, {COUNTS_SQL}, {CATEGORY_SQL} SELECT * FROM sums")
def category_counts(spark, sf):
    return ob.category_counts(city(spark, sf))


MISSING_SQL = """SELECT r_name AS building_id, t AS missing_type FROM region, (VALUES ('Version'), ('SimulationControl'), ('RunPeriod'),
 ('SizingPeriod:DesignDay'), ('GlobalGeometryRules')) v(t)"""


@query("P17_required_objects", MISSING_SQL)
def required_objects(spark, sf):
    return ob.required_objects(city(spark, sf))


PRESENCE_SQL = f"""{BASE_SQL}, {COUNTS_SQL}, {CATEGORY_SQL} SELECT building_id, category, n_objects, CAST(CASE category WHEN 'outputs' THEN 5 ELSE 1 END AS INTEGER) AS at_least,
 CASE WHEN n_objects = 0 THEN 'missing' WHEN category = 'outputs' AND n_objects < 5 THEN 'few' ELSE 'ok' END AS status FROM sums WHERE category <> 'meters'"""


@query("P18_presence_checks", PRESENCE_SQL)
def presence_checks(spark, sf):
    return ob.presence_checks(city(spark, sf))


@query("C9_validate_buildings", PRESENCE_SQL)
def validate_buildings(spark, sf):
    return building.validate_buildings(city(spark, sf)).summary


@query(
    "L4_first_object",
    f"{BASE_SQL} SELECT r_name AS building_id, arg_min(c_name, c_custkey) AS object_name FROM cust GROUP BY 1",
)
def first_object(spark, sf):
    return ob.first_object(city(spark, sf, "BuildingSurface:Detailed"), "BuildingSurface:Detailed").select("building_id", "object_name")


@query(
    "F13_building_summary",
    f"""{BASE_SQL} SELECT r_name AS building_id, arg_min(n_name, n_nationkey) AS building_name, '0' AS north_axis, 'City' AS terrain,
 arg_max(n_name, n_nationkey) AS location_name, round(max(n_nationkey) * 1.5, 6)::DOUBLE AS latitude FROM places GROUP BY 1""",
)
def building_summary(spark, sf):
    return ob.building_summary(city(spark, sf, "Building", "Site:Location")).select(
        "building_id", "building_name", "north_axis", "terrain", "location_name", F.col("latitude").cast("double").alias("latitude")
    )


@query(
    "F9_zone_properties",
    f"""{BASE_SQL} SELECT r_name AS building_id, n_name AS zone, CASE WHEN n_nationkey % 2 = 0 THEN 'Hall ' || n_nationkey ELSE n_name END AS display_name,
 n_nationkey / 2.0 AS ceiling_height, n_nationkey * 10.0 AS volume, CAST(n_nationkey * 3 AS DOUBLE) AS direction_north, 1.0 AS multiplier, NULL::VARCHAR AS type
 FROM places WHERE n_nationkey <> 7""",
)
def zone_properties(spark, sf):
    z = ob.zones(city(spark, sf, "Zone"))
    return z.withColumns({c: F.col(c).cast("double") for c in ("ceiling_height", "volume")})


@query(
    "J5_zone_adjacency_by_name",
    f"""{BASE_SQL}, {SURFACES_SQL} SELECT DISTINCT a.building_id, a.zone, b.zone AS other_zone FROM surf a
 JOIN surf b ON a.building_id = b.building_id AND a.boundary_object = b.name AND a.zone <> b.zone WHERE a.boundary = 'Surface'""",
)
def zone_adjacency_by_name(spark, sf):
    return ob.zone_adjacency(city(spark, sf, "BuildingSurface:Detailed"), by="name")


@query(
    "J6_zone_adjacency_by_key",
    f"""{BASE_SQL}, {SURFACES_SQL} SELECT a.building_id, a.zone, a.obj_pos, a.surface, b.zone AS adjacent_zone, b.surface AS adjacent_surface FROM surf a
 JOIN surf b ON a.building_id = b.building_id AND a.boundary_object = b.surface AND a.zone <> b.zone WHERE a.boundary = 'Surface'""",
)
def zone_adjacency_by_key(spark, sf):
    return ob.zone_adjacency(city(spark, sf, "BuildingSurface:Detailed"), by="key")


@query(
    "J17_named_adjacency",
    f"""{BASE_SQL}, {SURFACES_SQL}, e AS (SELECT DISTINCT a.building_id, a.zone, b.zone AS other_zone FROM surf a
 JOIN surf b ON a.building_id = b.building_id AND a.boundary_object = b.name AND a.zone <> b.zone WHERE a.boundary = 'Surface'),
d AS (SELECT r_name AS building_id, n_name AS zone, CASE WHEN n_nationkey % 2 = 0 THEN 'Hall ' || n_nationkey ELSE n_name END AS shown FROM places WHERE n_nationkey <> 7)
SELECT e.building_id, e.zone, e.other_zone, coalesce(x.shown, e.zone) AS zone_name, coalesce(y.shown, e.other_zone) AS other_zone_name, x.shown IS NULL AS is_orphan
FROM e LEFT JOIN d x ON x.building_id = e.building_id AND x.zone = e.zone LEFT JOIN d y ON y.building_id = e.building_id AND y.zone = e.other_zone""",
)
def named_adjacency(spark, sf):
    return ob.named_adjacency(city(spark, sf, "Zone", "BuildingSurface:Detailed"))


@query(
    "J5_zone_connections",
    f"""{BASE_SQL}, {SURFACES_SQL}, e AS (SELECT a.building_id, a.zone, count(DISTINCT b.zone) AS n FROM surf a
 JOIN surf b ON a.building_id = b.building_id AND a.boundary_object = b.name AND a.zone <> b.zone WHERE a.boundary = 'Surface' GROUP BY 1, 2)
SELECT r_name AS building_id, n_name AS zone, CASE WHEN n_nationkey % 2 = 0 THEN 'Hall ' || n_nationkey ELSE n_name END AS display_name, coalesce(n, 0) AS n_connected
FROM places LEFT JOIN e ON e.building_id = r_name AND e.zone = n_name WHERE n_nationkey <> 7""",
)
def zone_connections(spark, sf):
    return ob.zone_connections(city(spark, sf, "Zone", "BuildingSurface:Detailed"))


@query(
    "J7_zone_surfaces",
    f"""{BASE_SQL}, {SURFACES_SQL} SELECT building_id, zone, obj_pos, surface, type, boundary, boundary_object, construction, boundary = 'Outdoors' AS is_exterior,
 CASE WHEN boundary = 'Outdoors' THEN sun END AS sun_exposure, CASE WHEN boundary = 'Outdoors' THEN 'WindExposed' END AS wind_exposure FROM surf""",
)
def zone_surfaces(spark, sf):
    return ob.zone_surfaces(city(spark, sf, "BuildingSurface:Detailed"))


@query("J8_zone_windows", f"{BASE_SQL}, {WINDOWS_SQL} SELECT * FROM win")
def zone_windows(spark, sf):
    return ob.zone_windows(city(spark, sf, "BuildingSurface:Detailed", "FenestrationSurface:Detailed"))


@query(
    "J9_zone_constructions",
    f"""{BASE_SQL}, {SURFACES_SQL}, {WINDOWS_SQL}, used AS (SELECT building_id, zone, construction FROM surf UNION SELECT building_id, zone, construction FROM win)
SELECT used.*, s_name AS outside_layer FROM used JOIN supp ON used.building_id = r_name AND construction = 'C' || s_suppkey""",
)
def zone_constructions(spark, sf):
    found = ob.zone_constructions(city(spark, sf, "BuildingSurface:Detailed", "FenestrationSurface:Detailed", "Construction"))
    return found.select("building_id", "zone", "construction", ob.prop(F.col("definition"), "outside_layer").alias("outside_layer"))


@query(
    "U2_used_constructions",
    f"""{BASE_SQL}, {SURFACES_SQL}, {WINDOWS_SQL} SELECT building_id, construction FROM surf UNION SELECT building_id, construction FROM win""",
)
def used_constructions(spark, sf):
    objs = city(spark, sf, "BuildingSurface:Detailed", "FenestrationSurface:Detailed")
    names = [f(objs).select("building_id", "construction") for f in (ob.zone_surfaces, ob.zone_windows)]
    return names[0].union(names[1]).distinct()


@query(
    "U3_distinct_neighbours",
    f"""{BASE_SQL}, {SURFACES_SQL} SELECT DISTINCT a.building_id, a.zone, b.zone AS adjacent_zone FROM surf a
 JOIN surf b ON a.building_id = b.building_id AND a.boundary_object = b.surface AND a.zone <> b.zone WHERE a.boundary = 'Surface'""",
)
def distinct_neighbours(spark, sf):
    return ob.zone_adjacency(city(spark, sf, "BuildingSurface:Detailed"), by="key").select("building_id", "zone", "adjacent_zone").distinct()


@query(
    "J10_resolve_ref",
    f"""{BASE_SQL} SELECT r_name AS building_id, 'ADU' || s_suppkey AS unit, CASE WHEN s_suppkey % 5 <> 0 THEN
 CASE WHEN s_suppkey % 4 = 0 THEN 'Autosize' ELSE CAST(s_suppkey * 2 AS VARCHAR) END END AS max_flow_rate FROM supp""",
)
def resolve_ref(spark, sf):
    objs = city(spark, sf, "ZoneHVAC:AirDistributionUnit", "AirTerminal", "Coil:Heating")
    units = ob.of_type(objs, "ZoneHVAC:AirDistributionUnit").select(
        "building_id",
        F.col("object_name").alias("unit"),
        ob.p("air_terminal_object_type").alias("t"),
        ob.p("air_terminal_name").alias("n"),
    )
    found = ob.resolve_ref(units, objs, "t", "n", "target")
    return found.select("building_id", "unit", ob.prop(F.col("target"), "maximum_air_flow_rate").alias("max_flow_rate"))


HVAC_SQL = """reach AS (SELECT c.r_name AS building_id, c.n_name AS zone, c.s_suppkey * 10 + i AS place, c.s_suppkey - 7 * i AS k, i FROM supp c, (VALUES (0), (1)) v(i)
 WHERE c.s_suppkey % 13 <> 0),
term AS (SELECT reach.building_id, zone, place, k FROM reach JOIN supp t ON t.r_name = reach.building_id AND t.s_suppkey = k WHERE k % 5 <> 0),
best AS (SELECT building_id, zone, arg_max(k, place) AS k, arg_max(k, place) FILTER (k % 3 = 0) AS coil FROM term GROUP BY 1, 2)"""


@query(
    "J11_zone_hvac",
    f"""{BASE_SQL}, {HVAC_SQL} SELECT building_id, zone, 'T' || k AS terminal_name, CASE WHEN k % 2 = 0 THEN 'AirTerminal:A' ELSE 'AirTerminal:B' END AS terminal_type,
 CASE WHEN k % 4 = 0 THEN 'Autosize' ELSE CAST(k * 2 AS VARCHAR) END AS max_flow_rate, 'K' || coil AS coil_name, CAST(coil * 100 AS VARCHAR) AS capacity FROM best""",
)
def zone_hvac(spark, sf):
    return ob.zone_hvac(city(spark, sf, "ZoneHVAC:EquipmentConnections", "ZoneHVAC:EquipmentList", "ZoneHVAC:AirDistributionUnit", "AirTerminal", "Coil:Heating")).select(
        "building_id",
        "zone",
        F.col("terminal_unit.name").alias("terminal_name"),
        F.col("terminal_unit.type").alias("terminal_type"),
        F.col("terminal_unit.max_flow_rate").alias("max_flow_rate"),
        F.col("reheat_coil.name").alias("coil_name"),
        F.col("reheat_coil.capacity").alias("capacity"),
    )


@query(
    "J12_zone_air_loop",
    f"""{BASE_SQL} SELECT DISTINCT r_name AS building_id, n_name AS zone, 'VAV Sys 1' AS name, CAST(r_regionkey * 5 AS VARCHAR) AS design_flow_rate
 FROM supp WHERE s_suppkey % 4 = 0 AND r_regionkey <> 2 AND (n_nationkey <> 7 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 7))""",
)
def zone_air_loop(spark, sf):
    return ob.zone_air_loop(city(spark, sf, "Zone", "BuildingSurface:Detailed", "AirLoopHVAC:ZoneSplitter", "AirLoopHVAC")).select("building_id", "zone", "air_loop.*")


INFILTRATION_SQL = """zone AS (SELECT r_name AS building_id, n_name AS zone FROM places WHERE n_nationkey <> 7 UNION SELECT r_name, n_name FROM cust),
inf AS (SELECT r_name AS building_id, s_suppkey, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' List' ELSE n_name END AS field FROM supp)"""


@query(
    "J13_zone_infiltration",
    f"""{BASE_SQL}, {INFILTRATION_SQL} SELECT building_id, zone, arg_max(s_acctbal, s_suppkey) AS design_flow_rate, 'SCH' || max(s_suppkey) AS schedule
 FROM inf JOIN zone USING (building_id) WHERE contains(field, zone) GROUP BY 1, 2""",
)
def zone_infiltration(spark, sf):
    return ob.zone_infiltration(city(spark, sf, "Zone", "BuildingSurface:Detailed", "ZoneInfiltration:DesignFlowRate")).select(
        "building_id", "zone", F.col("infiltration.design_flow_rate").cast("double").alias("design_flow_rate"), "infiltration.schedule"
    )


@query(
    "J13_zone_infiltration_equal",
    f"""{BASE_SQL}, {INFILTRATION_SQL} SELECT building_id, zone, 'SCH' || max(s_suppkey) AS schedule
 FROM inf JOIN zone USING (building_id) WHERE field = zone GROUP BY 1, 2""",
)
def zone_infiltration_equal(spark, sf):
    return ob.zone_infiltration(city(spark, sf, "Zone", "BuildingSurface:Detailed", "ZoneInfiltration:DesignFlowRate"), match="equals").select("building_id", "zone", "infiltration.schedule")


THERMOSTAT_SQL = """last AS (SELECT r_name AS building_id, n_name AS zone, max(s_suppkey) AS k FROM supp GROUP BY 1, 2),
setp AS (SELECT building_id, zone, 1 AS slot, 'Setpoint:Heat' AS type, 'SH' || k AS name, k AS s FROM last WHERE k % 6 <> 0
 UNION ALL SELECT building_id, zone, 2, 'Setpoint:Dual', 'SD' || (k - 7), k - 7 FROM last JOIN supp ON r_name = building_id AND s_suppkey = k - 7 WHERE k % 2 = 0)"""


@query(
    "J14_zone_thermostat",
    f"""{BASE_SQL}, {THERMOSTAT_SQL} SELECT last.building_id, last.zone, 'TH' || k AS control_name, 'CT' || k AS control_type_schedule,
 coalesce(string_agg(slot || '/' || type || '/' || name || '/SCH' || s, ';' ORDER BY slot), '') AS objects
 FROM last LEFT JOIN setp ON setp.building_id = last.building_id AND setp.zone = last.zone GROUP BY 1, 2, 3, 4""",
)
def zone_thermostat(spark, sf):
    parts = F.transform("control_objects", lambda c: F.concat_ws("/", c["slot"].cast("string"), c["type"], c["name"], c["schedule"]))
    return ob.zone_thermostat(city(spark, sf, "ZoneControl:Thermostat", "Setpoint:Heat", "Setpoint:Dual")).select(
        "building_id", "zone", "control_name", "control_type_schedule", F.array_join(parts, ";").alias("objects")
    )


@query(
    "J15_zone_schedules",
    f"""{BASE_SQL}, {THERMOSTAT_SQL}, d AS (SELECT DISTINCT building_id, zone, s FROM setp)
SELECT d.building_id, zone, 'SCH' || s AS schedule, CASE WHEN s_suppkey % 9 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END::INTEGER AS n_points,
 CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 25 AS DOUBLE) END AS first_value, CASE WHEN s_suppkey % 9 <> 0 THEN '07:00' END AS first_time,
 CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 2 <> 0 THEN s_acctbal END AS second_value
FROM d JOIN supp ON r_name = d.building_id AND s_suppkey = s""",
)
def zone_schedules(spark, sf):
    points = F.col("points")
    return ob.zone_schedules(city(spark, sf, "ZoneControl:Thermostat", "Setpoint:Heat", "Setpoint:Dual", "Schedule:Compact")).select(
        "building_id",
        "zone",
        "schedule",
        F.size(points).alias("n_points"),
        F.get(points, F.lit(0))["value"].alias("first_value"),
        F.get(points, F.lit(0))["time"].alias("first_time"),
        F.get(points, F.lit(1))["value"].alias("second_value"),
    )


@query(
    "J16_zone_loads",
    f"""{BASE_SQL}
SELECT r_name AS building_id, n_name AS zone, 'People' AS kind, 'P' || max(c_custkey) AS name, NULL AS design_level, max(c_custkey) % 50 AS number_of_people,
 'SCH' || max(c_custkey) % 100 AS schedule FROM cust GROUP BY 1, 2
UNION ALL SELECT r_name, n_name, 'Lights', 'L' || max(s_suppkey), max(s_suppkey) * 3, NULL, 'SCH' || max(s_suppkey) FROM supp GROUP BY 1, 2
UNION ALL SELECT r_name, n_name || CASE WHEN s_suppkey % 3 = 0 THEN ' List' ELSE '' END, 'ElectricEquipment', 'E' || max(s_suppkey), max(s_suppkey) * 4, NULL, NULL FROM supp GROUP BY 1, 2""",
)
def zone_loads(spark, sf):
    return ob.zone_loads(city(spark, sf, "People", "Lights", "ElectricEquipment")).select(
        "building_id",
        "zone",
        "kind",
        "name",
        F.col("design_level").cast("bigint").alias("design_level"),
        F.col("number_of_people").cast("bigint").alias("number_of_people"),
        "schedule",
    )


@query(
    "F11_schedule_points",
    f"""{BASE_SQL} SELECT r_name AS building_id, 'SCH' || s_suppkey AS schedule, '07:00' AS time, CAST(s_suppkey % 25 AS DOUBLE) AS value FROM supp WHERE s_suppkey % 9 <> 0
UNION ALL SELECT r_name, 'SCH' || s_suppkey, '24:00', s_acctbal FROM supp WHERE s_suppkey % 9 <> 0 AND s_suppkey % 2 <> 0""",
)
def schedule_points(spark, sf):
    s = ob.of_type(city(spark, sf, "Schedule:Compact"), "Schedule:Compact")
    return s.select(
        "building_id", F.col("object_name").alias("schedule"), F.explode(ob.schedule_points(F.col("props"))).alias("_p")
    ).select("building_id", "schedule", "_p.time", "_p.value")


@query(
    "F10_schedule_fallback",
    f"""{BASE_SQL} SELECT r_name AS building_id, 'SH' || s_suppkey AS name, 'SCH' || s_suppkey AS schedule FROM supp WHERE s_suppkey % 6 <> 0
UNION ALL SELECT r_name, 'SD' || s_suppkey, 'SCH' || s_suppkey FROM supp""",
)
def schedule_fallback(spark, sf):
    keys = [f"{k}setpoint_temperature_schedule_name" for k in ("", "cooling_", "heating_")]
    s = city(spark, sf, "Setpoint:Heat", "Setpoint:Dual").where(F.col("object_type").startswith("Setpoint:"))
    return s.select("building_id", F.col("object_name").alias("name"), ob.first_prop(F.col("props"), keys).alias("schedule"))


@query(
    "F12_surface_lists",
    f"""{BASE_SQL}, {SURFACES_SQL}, {WINDOWS_SQL}, w AS (SELECT building_id, zone, count(*) AS n FROM win GROUP BY 1, 2)
SELECT s.building_id, s.zone, md5(string_agg(surface, ';' ORDER BY obj_pos)) AS surfaces, coalesce(string_agg(surface, ';' ORDER BY obj_pos) FILTER (boundary = 'Outdoors'), '') AS exterior,
 max(coalesce(w.n, 0))::INTEGER AS n_windows FROM surf s LEFT JOIN w ON w.building_id = s.building_id AND w.zone = s.zone GROUP BY 1, 2""",
)
def surface_lists(spark, sf):
    z = ob.zone_features(stored_city(spark, sf)).where(F.size("zone_properties.surfaces") > 0)
    return z.select(
        "building_id",
        "zone",
        F.md5(F.array_join("zone_properties.surfaces.surface", ";")).alias("surfaces"),
        F.coalesce(F.array_join("zone_properties.exterior_surfaces.surface", ";"), F.lit("")).alias("exterior"),
        F.coalesce(F.size("construction.windows"), F.lit(0)).alias("n_windows"),
    )


@query(
    "C10_zone_feature_rows",
    f"""{BASE_SQL}, {SURFACES_SQL}, {WINDOWS_SQL}, {HVAC_SQL}, {INFILTRATION_SQL}, {THERMOSTAT_SQL},
used AS (SELECT building_id, zone, construction FROM surf UNION SELECT building_id, zone, construction FROM win)
SELECT 'zone_properties' AS section, count(*) AS n FROM places WHERE n_nationkey <> 7
UNION ALL SELECT 'surfaces', count(*) FROM surf
UNION ALL SELECT 'adjacencies', count(*) FROM surf a JOIN surf b ON a.building_id = b.building_id AND a.boundary_object = b.surface AND a.zone <> b.zone
UNION ALL SELECT 'exterior_surfaces', count(*) FROM surf WHERE boundary = 'Outdoors'
UNION ALL SELECT 'windows', count(*) FROM win
UNION ALL SELECT 'materials', count(*) FROM used JOIN supp ON used.building_id = r_name AND construction = 'C' || s_suppkey
UNION ALL SELECT 'infiltration', count(*) FROM (SELECT DISTINCT building_id, zone FROM inf JOIN zone USING (building_id) WHERE contains(field, zone))
UNION ALL SELECT 'hvac', count(*) FROM best
UNION ALL SELECT 'air_loop', count(DISTINCT n_name) FROM supp WHERE s_suppkey % 4 = 0 AND r_regionkey <> 2 AND (n_nationkey <> 7 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 7))
UNION ALL SELECT 'thermostat', count(*) FROM last
UNION ALL SELECT 'setpoint_schedules', count(DISTINCT (building_id, zone, s)) FROM setp
UNION ALL SELECT 'occupancy_loads', (SELECT count(DISTINCT n_name) FROM cust) + (SELECT count(DISTINCT n_name) FROM supp) + (SELECT count(DISTINCT (n_name, s_suppkey % 3 = 0)) FROM supp)""",
)
def zone_feature_rows(spark, sf):
    return ob.zone_feature_rows(stored_city(spark, sf)).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def _joined(cells: str, *fields: str) -> Column:
    """A list of structs as text, fields by | and cells by ;."""
    return F.coalesce(F.md5(F.array_join(F.transform(cells, lambda c: F.concat_ws("|", *[c[f].cast("string") for f in fields])), ";")), F.lit(""))


@query(
    "C10_zone_features",
    f"""{BASE_SQL}, {SURFACES_SQL}, {WINDOWS_SQL}, {HVAC_SQL}, {INFILTRATION_SQL}, {THERMOSTAT_SQL},
z AS (SELECT r_name AS building_id, n_name AS zone, n_nationkey FROM places WHERE n_nationkey <> 7),
su AS (SELECT building_id, zone, md5(string_agg(surface || '|' || type || '|' || boundary, ';' ORDER BY obj_pos)) AS surfaces,
 md5(string_agg(surface || '|' || type || '|' || sun || '|WindExposed', ';' ORDER BY obj_pos) FILTER (boundary = 'Outdoors')) AS exterior FROM surf GROUP BY 1, 2),
ad AS (SELECT a.building_id, a.zone, md5(string_agg(b.zone || '|' || a.surface || '|' || b.surface, ';' ORDER BY a.obj_pos)) AS adjacencies
 FROM surf a JOIN surf b ON a.building_id = b.building_id AND a.boundary_object = b.surface AND a.zone <> b.zone GROUP BY 1, 2),
wi AS (SELECT building_id, zone, md5(string_agg("window" || '|' || parent_surface || '|' || construction || '|' || vf_to_ground, ';' ORDER BY obj_pos)) AS windows FROM win GROUP BY 1, 2),
ma AS (SELECT building_id, zone, md5(string_agg(construction, ';' ORDER BY construction)) AS materials FROM (SELECT building_id, zone, construction FROM surf UNION SELECT building_id, zone, construction FROM win)
 JOIN supp ON building_id = r_name AND construction = 'C' || s_suppkey GROUP BY 1, 2),
nf AS (SELECT building_id, zone, arg_max(s_acctbal, s_suppkey) AS design_flow_rate FROM inf JOIN zone USING (building_id) WHERE contains(field, zone) GROUP BY 1, 2),
al AS (SELECT DISTINCT r_name AS building_id, n_name AS zone, true AS on_air_loop FROM supp WHERE s_suppkey % 4 = 0 AND r_regionkey <> 2 AND (n_nationkey <> 7 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 7))),
sc AS (SELECT building_id, zone, md5(string_agg(DISTINCT 'SCH' || s, ';' ORDER BY 'SCH' || s)) AS schedules FROM setp GROUP BY 1, 2),
pe AS (SELECT r_name AS building_id, n_name AS zone, 'P' || max(c_custkey) AS people FROM cust GROUP BY 1, 2),
li AS (SELECT r_name AS building_id, n_name AS zone, 'L' || max(s_suppkey) AS lights FROM supp GROUP BY 1, 2),
eq AS (SELECT r_name AS building_id, n_name || CASE WHEN s_suppkey % 3 = 0 THEN ' List' ELSE '' END AS zone, 'E' || max(s_suppkey) AS equipment FROM supp GROUP BY 1, 2),
every AS (SELECT building_id, zone FROM z UNION SELECT building_id, zone FROM su UNION SELECT building_id, zone FROM best UNION SELECT building_id, zone FROM last UNION SELECT building_id, zone FROM pe
 UNION SELECT building_id, zone FROM li UNION SELECT building_id, zone FROM eq UNION SELECT building_id, zone FROM al UNION SELECT building_id, zone FROM nf)
SELECT building_id, zone, n_nationkey * 10.0 AS volume, coalesce(surfaces, '') AS surfaces, coalesce(exterior, '') AS exterior, coalesce(adjacencies, '') AS adjacencies,
 coalesce(windows, '') AS windows, coalesce(materials, '') AS materials, design_flow_rate, 'T' || best.k AS terminal, 'K' || best.coil AS coil, coalesce(on_air_loop, false) AS on_air_loop,
 'TH' || last.k AS thermostat, coalesce(schedules, '') AS schedules, people, lights, equipment
FROM every LEFT JOIN z USING (building_id, zone) LEFT JOIN su USING (building_id, zone) LEFT JOIN ad USING (building_id, zone) LEFT JOIN wi USING (building_id, zone)
 LEFT JOIN ma USING (building_id, zone) LEFT JOIN nf USING (building_id, zone) LEFT JOIN best USING (building_id, zone) LEFT JOIN al USING (building_id, zone)
 LEFT JOIN last USING (building_id, zone) LEFT JOIN sc USING (building_id, zone) LEFT JOIN pe USING (building_id, zone) LEFT JOIN li USING (building_id, zone) LEFT JOIN eq USING (building_id, zone)""",
)
def zone_features(spark, sf):
    """Every section's content: lists as digests of their text, records by name."""
    made = building.extract_zone_features(stored_city(spark, sf))
    z, c, h, p, o = "zone_properties", "construction", "hvac_system", "control_parameters", "occupancy_loads"
    return made.select(
        "building_id",
        "zone",
        F.col(f"{z}.properties.volume").cast("double").alias("volume"),
        _joined(f"{z}.surfaces", "surface", "type", "boundary").alias("surfaces"),
        _joined(f"{z}.exterior_surfaces", "surface", "type", "sun_exposure", "wind_exposure").alias("exterior"),
        _joined(f"{z}.adjacencies", "adjacent_zone", "surface", "adjacent_surface").alias("adjacencies"),
        _joined(f"{c}.windows", "window", "parent_surface", "construction", "vf_to_ground").alias("windows"),
        _joined(f"{c}.materials", "construction").alias("materials"),
        F.col(f"{c}.infiltration.design_flow_rate").cast("double").alias("design_flow_rate"),
        F.col(f"{h}.terminal_unit.name").alias("terminal"),
        F.col(f"{h}.reheat_coil.name").alias("coil"),
        F.col(f"{h}.air_loop").isNotNull().alias("on_air_loop"),
        F.col(f"{p}.thermostat.control_name").alias("thermostat"),
        _joined(f"{p}.setpoint_schedules", "schedule").alias("schedules"),
        F.col(f"{o}.people.name").alias("people"),
        F.col(f"{o}.lights.name").alias("lights"),
        F.col(f"{o}.equipment.name").alias("equipment"),
    )
