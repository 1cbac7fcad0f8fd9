"""Building objects: counts, checks, zone adjacency and reference resolution.

Input is the object table ``(building_id, type_pos, object_type, obj_pos,
object_name, props)``. References between objects are data, so following one is
an equi-join on building, type and name; every operator covers all zones of all
buildings at once, and narrowing to one zone is a filter the optimizer pushes
into each branch.

Store large object tables with ``write_building_objects``; its partitioning by
type turns ``of_type`` into partition pruning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.variants import first_prop, items, prop, schedule_points
from hearthline.operators.align import align_series
from hearthline.presets import (
    ADJACENT_BOUNDARY,
    AIR_LOOP_NAME,
    AIR_LOOP_NODE_MARK,
    AIR_TERMINAL_UNIT,
    EXTERIOR_BOUNDARY,
    OBJECT_CATEGORIES,
    OBJECT_MINIMUM_COUNTS,
    OBJECT_PREFIX_CATEGORIES,
    REQUIRED_OBJECT_TYPES,
)

ZONE_FIELD = "zone_or_zonelist_or_space_or_spacelist_name"


def of_type(objs: DataFrame, kind: str) -> DataFrame:
    return objs.where((F.col("object_type") == kind) & F.col("object_name").isNotNull())


def p(key: str, kind: str = "string", default=None) -> Column:
    return prop(F.col("props"), key, kind, default)


def nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


# --- counts and presence ----------------------------------------------------


def object_counts(objs: DataFrame) -> DataFrame:
    typed = objs.where(F.col("object_type").isNotNull())
    return typed.groupBy("building_id", "object_type").agg(F.count("object_name").alias("n_objects"))


def category_counts(
    objs: DataFrame,
    categories: dict[str, Sequence[str]] = OBJECT_CATEGORIES,
    prefixes: dict[str, str] = OBJECT_PREFIX_CATEGORIES,
) -> DataFrame:
    """Objects and distinct types per category, zeros included."""
    member = {c: F.col("object_type").isin(*types) for c, types in categories.items()}
    member |= {c: F.col("object_type").startswith(start) for c, start in prefixes.items()}
    aggs = []
    for i, test in enumerate(member.values()):
        aggs += [F.coalesce(F.sum(F.when(test, F.col("n_objects"))), F.lit(0)).alias(f"n{i}")]
        aggs += [F.count_if(test).alias(f"t{i}")]
    cells = [
        F.struct(F.lit(c).alias("category"), F.col(f"n{i}").alias("n_objects"), F.col(f"t{i}").alias("n_types"))
        for i, c in enumerate(member)
    ]
    counted = objs.groupBy("building_id", "object_type").agg(F.count("object_name").alias("n_objects"))
    per_building = counted.groupBy("building_id").agg(*aggs)
    return per_building.select("building_id", F.explode(F.array(*cells)).alias("_c")).select("building_id", "_c.*")


def required_objects(objs: DataFrame, required: Sequence[str] = REQUIRED_OBJECT_TYPES) -> DataFrame:
    """Required types a building lacks."""
    there = [F.coalesce(F.bool_or(F.col("object_type") == t), F.lit(False)).alias(f"r{i}") for i, t in enumerate(required)]
    per_building = objs.groupBy("building_id").agg(*there)
    absent = F.array_compact(F.array(*[F.when(~F.col(f"r{i}"), F.lit(t)) for i, t in enumerate(required)]))
    return per_building.select("building_id", F.explode(absent).alias("missing_type"))


def presence_checks(
    objs: DataFrame, minimum: dict[str, int] = OBJECT_MINIMUM_COUNTS, **categories
) -> DataFrame:
    """Each category's count against the least expected number."""
    least = F.create_map(*[F.lit(x) for kv in minimum.items() for x in kv])
    counts = category_counts(objs, **categories).where(F.col("category").isin(*minimum))
    need = F.element_at(least, F.col("category"))
    return counts.select(
        "building_id",
        "category",
        "n_objects",
        need.alias("at_least"),
        F.when(F.col("n_objects") == 0, "missing").when(F.col("n_objects") < need, "few").otherwise("ok").alias("status"),
    )


def first_object(objs: DataFrame, kind: str) -> DataFrame:
    """The first object of a type in file order, per building."""
    first = F.min_by(F.struct("object_name", "props"), "obj_pos").alias("_f")
    return of_type(objs, kind).groupBy("building_id").agg(first).select("building_id", "_f.object_name", "_f.props")


SUMMARY_FIELDS = {
    "Building": {"building_name": "name", "north_axis": "north_axis", "terrain": "terrain"},
    "Site:Location": {
        "location_name": "name",
        "latitude": "latitude",
        "longitude": "longitude",
        "time_zone": "time_zone",
        "elevation": "elevation",
    },
    "SimulationControl": {
        "do_zone_sizing": "do_zone_sizing_calculation",
        "do_system_sizing": "do_system_sizing_calculation",
        "do_plant_sizing": "do_plant_sizing_calculation",
        "run_for_sizing_periods": "run_simulation_for_sizing_periods",
        "run_for_weather_file": "run_simulation_for_weather_file_run_periods",
    },
    "RunPeriod": {
        "begin_month": "begin_month",
        "begin_day": "begin_day_of_month",
        "end_month": "end_month",
        "end_day": "end_day_of_month",
    },
}


def building_summary(objs: DataFrame) -> DataFrame:
    """One row per building with the head facts of its first objects, as text."""
    firsts = [
        F.min_by(F.when(F.col("object_type") == t, F.col("props")), F.when(F.col("object_type") == t, F.col("obj_pos"))).alias(
            f"p{i}"
        )
        for i, t in enumerate(SUMMARY_FIELDS)
    ]
    kept = objs.where(F.col("object_type").isin(*SUMMARY_FIELDS) & F.col("object_name").isNotNull())
    out = [
        prop(F.col(f"p{i}"), key).alias(name)
        for i, fields in enumerate(SUMMARY_FIELDS.values())
        for name, key in fields.items()
    ]
    named = kept.groupBy("building_id").agg(*firsts).select("building_id", *out)
    # A building object without an axis faces north.
    return named.withColumn("north_axis", F.coalesce("north_axis", F.lit("0")))


# --- zones, surfaces, adjacency ---------------------------------------------


def zones(objs: DataFrame) -> DataFrame:
    """Zone, display name (its ``name`` property, else its key) and properties."""
    return of_type(objs, "Zone").select(
        "building_id",
        F.col("object_name").alias("zone"),
        F.coalesce(p("name"), F.col("object_name")).alias("display_name"),
        p("ceiling_height").alias("ceiling_height"),
        p("volume").alias("volume"),
        p("direction_of_relative_north", "double").alias("direction_north"),
        p("multiplier", "double").alias("multiplier"),
        p("type").alias("type"),
    )


def zone_surfaces(objs: DataFrame) -> DataFrame:
    """One row per surface of a zone; exposures only for exterior surfaces."""
    s = of_type(objs, "BuildingSurface:Detailed").select(
        "building_id",
        p("zone_name").alias("zone"),
        "obj_pos",
        F.col("object_name").alias("surface"),
        p("surface_type", default="Unknown").alias("type"),
        p("outside_boundary_condition", default="Unknown").alias("boundary"),
        p("outside_boundary_condition_object", default="Unknown").alias("boundary_object"),
        p("sun_exposure", default="Unknown").alias("_sun"),
        p("wind_exposure", default="Unknown").alias("_wind"),
        p("construction_name", default="").alias("construction"),
    )
    exterior = F.col("boundary") == EXTERIOR_BOUNDARY
    return s.where(F.col("zone").isNotNull()).select(
        "building_id",
        "zone",
        "obj_pos",
        "surface",
        "type",
        "boundary",
        "boundary_object",
        "construction",
        exterior.alias("is_exterior"),
        F.when(exterior, F.col("_sun")).alias("sun_exposure"),
        F.when(exterior, F.col("_wind")).alias("wind_exposure"),
    )


def zone_adjacency(objs: DataFrame, by: str = "name") -> DataFrame:
    """Neighbouring zones through surfaces that face another surface.

    ``by="name"`` matches the other surface's ``name`` property and gives each
    pair of zones once; ``by="key"`` matches its key and gives one row per
    surface, with both surfaces.
    """
    surfaces = of_type(objs, "BuildingSurface:Detailed")
    if by == "key":
        here = zone_surfaces(objs).where(F.col("boundary") == ADJACENT_BOUNDARY)
        there = surfaces.select(
            "building_id",
            F.col("object_name").alias("boundary_object"),
            p("zone_name", default="Unknown").alias("adjacent_zone"),
        )
        return (
            here.join(there, ["building_id", "boundary_object"])
            .where(nonempty(F.col("adjacent_zone")) & (F.col("adjacent_zone") != F.col("zone")))
            .select(
                "building_id",
                "zone",
                "obj_pos",
                "surface",
                "adjacent_zone",
                F.col("boundary_object").alias("adjacent_surface"),
            )
        )
    # Both sides are folded to distinct zones per surface name before they meet,
    # so a name that many surfaces share costs one row per zone, not per surface.
    here = (
        surfaces.where(p("outside_boundary_condition") == ADJACENT_BOUNDARY)
        .select("building_id", p("outside_boundary_condition_object").alias("_name"), p("zone_name").alias("zone"))
        .where(nonempty(F.col("_name")) & nonempty(F.col("zone")))
        .distinct()
    )
    there = (
        surfaces.select("building_id", p("name").alias("_name"), p("zone_name").alias("other_zone"))
        .where(nonempty(F.col("_name")) & nonempty(F.col("other_zone")))
        .distinct()
    )
    return (
        here.join(there, ["building_id", "_name"])
        .where(F.col("zone") != F.col("other_zone"))
        .select("building_id", "zone", "other_zone")
        .distinct()
    )


def named_adjacency(objs: DataFrame) -> DataFrame:
    """``zone_adjacency`` with display names, and whether a zone is undefined."""
    names = zones(objs).select("building_id", "zone", "display_name")
    other = names.select(
        "building_id", F.col("zone").alias("other_zone"), F.col("display_name").alias("other_display_name")
    )
    edges = zone_adjacency(objs, by="name")
    return (
        edges.join(names, ["building_id", "zone"], "left")
        .join(other, ["building_id", "other_zone"], "left")
        .select(
            "building_id",
            "zone",
            "other_zone",
            F.coalesce("display_name", "zone").alias("zone_name"),
            F.coalesce("other_display_name", "other_zone").alias("other_zone_name"),
            F.col("display_name").isNull().alias("is_orphan"),
        )
    )


def zone_connections(objs: DataFrame) -> DataFrame:
    """Number of neighbouring zones per defined zone, zero included."""
    counts = zone_adjacency(objs, by="name").groupBy("building_id", "zone").agg(F.count(F.lit(1)).alias("n"))
    return (
        zones(objs)
        .join(counts, ["building_id", "zone"], "left")
        .select("building_id", "zone", "display_name", F.coalesce("n", F.lit(0)).alias("n_connected"))
    )


def zone_windows(objs: DataFrame) -> DataFrame:
    """Windows whose parent surface belongs to a zone."""
    windows = of_type(objs, "FenestrationSurface:Detailed").select(
        "building_id",
        F.col("obj_pos"),
        F.col("object_name").alias("window"),
        p("building_surface_name", default="").alias("surface"),
        p("construction_name", default="Unknown").alias("construction"),
        p("view_factor_to_ground").alias("vf_to_ground"),
    )
    parents = zone_surfaces(objs).select("building_id", "surface", "zone")
    return windows.join(parents, ["building_id", "surface"]).select(
        "building_id", "zone", "obj_pos", "window", F.col("surface").alias("parent_surface"), "construction", "vf_to_ground"
    )


def zone_constructions(objs: DataFrame) -> DataFrame:
    """Constructions a zone's surfaces and windows use, with their definition."""
    used = (
        zone_surfaces(objs)
        .select("building_id", "zone", "construction")
        .union(zone_windows(objs).select("building_id", "zone", "construction"))
        .where(nonempty(F.col("construction")))
        .distinct()
    )
    defined = of_type(objs, "Construction").select(
        "building_id", F.col("object_name").alias("construction"), F.col("props").alias("definition")
    )
    return used.join(defined, ["building_id", "construction"]).select(
        "building_id", "zone", "construction", "definition"
    )


# --- references held in properties ------------------------------------------


def resolve_ref(
    df: DataFrame,
    objs: DataFrame,
    type_col: str,
    name_col: str,
    as_col: str,
    how: str = "left",
    fields: dict[str, Column] | None = None,
    types: Column | None = None,
) -> DataFrame:
    """Fetch the object that a ``(type, name)`` pair of columns points to.

    The properties arrive as the VARIANT column ``as_col``, NULL when nothing
    has that type and name in the building. With ``fields``, expressions over
    ``props``, only these arrive, as a struct: they are taken where the objects are
    read, so nothing else is exchanged. ``types`` is an array of the types that can be
    asked for; objects of other types are left out before the join.
    """
    target = objs.where(F.col("object_name").isNotNull())
    if types is not None:
        target = target.where(F.array_contains(types, F.col("object_type")))
    body = F.struct(*[c.alias(name) for name, c in fields.items()]) if fields else F.col("props")
    target = target.select(
        "building_id",
        F.col("object_type").alias(type_col),
        F.col("object_name").alias(name_col),
        body.alias(as_col),
    )
    return df.join(target, ["building_id", type_col, name_col], how)


def asked_types(objs: DataFrame, *keys: str) -> Column:
    """The distinct types that properties of ``objs`` name, as a subquery of one small array."""
    named = F.array_compact(F.array(*[p(key) for key in keys]))
    return objs.agg(F.array_distinct(F.flatten(F.collect_set(named)))).scalar()


def zone_hvac(objs: DataFrame) -> DataFrame:
    """Terminal unit and reheat coil of a zone, by way of its equipment list.

    The last resolvable terminal and the last resolvable coil in file order
    win, each for itself.
    """
    connections = (
        of_type(objs, "ZoneHVAC:EquipmentConnections")
        .select(
            "building_id",
            p("zone_name").alias("zone"),
            F.col("obj_pos").alias("_conn"),
            p("zone_conditioning_equipment_list_name").alias("_list"),
        )
        .where(F.col("zone").isNotNull() & nonempty(F.col("_list")))
    )
    lists = of_type(objs, "ZoneHVAC:EquipmentList").select(
        "building_id", F.col("object_name").alias("_list"), F.posexplode(items(F.col("props"), "equipment")).alias("_item", "_e")
    )
    units = lists.select(
        "building_id",
        "_list",
        "_item",
        prop(F.col("_e"), "zone_equipment_object_type").alias("_type"),
        prop(F.col("_e"), "zone_equipment_name").alias("_unit"),
    ).where(F.col("_type") == AIR_TERMINAL_UNIT)
    terminals = of_type(objs, AIR_TERMINAL_UNIT).select(
        "building_id",
        F.col("object_name").alias("_unit"),
        p("air_terminal_object_type").alias("terminal_type"),
        p("air_terminal_name").alias("terminal_name"),
    )
    reached = (
        connections.join(units, ["building_id", "_list"])
        .join(terminals.where(nonempty(F.col("terminal_type"))), ["building_id", "_unit"])
        .select("building_id", "zone", "_conn", "_item", "terminal_type", "terminal_name")
    )
    terminal_types = asked_types(of_type(objs, AIR_TERMINAL_UNIT), "air_terminal_object_type")
    wanted = {
        "max_flow_rate": p("maximum_air_flow_rate"),
        "min_flow_fraction": p("constant_minimum_air_flow_fraction"),
        "coil_type": p("reheat_coil_object_type"),
        "coil_name": p("reheat_coil_name"),
    }
    at_terminal = resolve_ref(reached, objs, "terminal_type", "terminal_name", "_t", "inner", wanted, terminal_types).select(
        "building_id",
        "zone",
        F.struct("_conn", "_item").alias("_order"),
        F.struct(
            F.col("terminal_type").alias("type"),
            F.col("terminal_name").alias("name"),
            F.col("_t.max_flow_rate").alias("max_flow_rate"),
            F.col("_t.min_flow_fraction").alias("min_flow_fraction"),
        ).alias("terminal_unit"),
        "_t.coil_type",
        "_t.coil_name",
    )
    coil_types = asked_types(objs.where(F.array_contains(terminal_types, F.col("object_type"))), "reheat_coil_object_type")
    wanted = {"efficiency": p("efficiency"), "capacity": p("nominal_capacity")}
    at_coil = resolve_ref(at_terminal, objs, "coil_type", "coil_name", "_c", "left", wanted, coil_types)
    coil = F.when(
        F.col("_c").isNotNull() & nonempty(F.col("coil_type")),
        F.struct(
            F.col("coil_type").alias("type"),
            F.col("coil_name").alias("name"),
            F.col("_c.efficiency").alias("efficiency"),
            F.col("_c.capacity").alias("capacity"),
        ),
    )
    return (
        at_coil.withColumn("reheat_coil", coil)
        .groupBy("building_id", "zone")
        .agg(
            F.max_by("terminal_unit", "_order").alias("terminal_unit"),
            F.max_by("reheat_coil", F.when(F.col("reheat_coil").isNotNull(), F.col("_order"))).alias("reheat_coil"),
        )
    )


def zone_air_loop(objs: DataFrame, air_loop_name: str = AIR_LOOP_NAME) -> DataFrame:
    """The air loop of each zone that a splitter feeds.

    An outlet node feeds zone Z when its name starts with ``"Z ATU"``. The
    beginnings a node could stand for are listed and joined by equality.
    """
    nodes = of_type(objs, "AirLoopHVAC:ZoneSplitter").select(
        "building_id", F.explode(items(F.col("props"), "nodes")).alias("_n")
    )
    pieces = F.split(prop(F.col("_n"), "outlet_node_name"), AIR_LOOP_NODE_MARK)
    beginnings = F.when(
        F.size(pieces) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 1),
            lambda k: F.array_join(F.slice(pieces, F.lit(1), k), AIR_LOOP_NODE_MARK),
        ),
    )
    fed = nodes.select("building_id", F.explode(beginnings).alias("zone")).distinct()
    loops = (
        of_type(objs, "AirLoopHVAC")
        .where(F.col("object_name") == air_loop_name)
        .select(
            "building_id",
            F.struct(
                F.col("object_name").alias("name"), p("design_supply_air_flow_rate").alias("design_flow_rate")
            ).alias("air_loop"),
        )
    )
    return fed.join(known_zones(objs), ["building_id", "zone"], "left_semi").join(loops, "building_id").select(
        "building_id", "zone", "air_loop"
    )


def known_zones(objs: DataFrame) -> DataFrame:
    """Zones that are defined or that a surface names."""
    named = of_type(objs, "BuildingSurface:Detailed").select("building_id", p("zone_name").alias("zone"))
    return (
        of_type(objs, "Zone")
        .select("building_id", F.col("object_name").alias("zone"))
        .union(named.where(nonempty(F.col("zone"))))
        .distinct()
    )


def zone_infiltration(objs: DataFrame, match: str = "contains") -> DataFrame:
    """Infiltration of a zone; of several matching objects the last one counts.

    ``match="contains"``: the zone's name occurs anywhere in the object's zone
    field, so ``SPACE1-10`` also matches zone ``SPACE1-1``. Instead of testing
    all pairs, the parts of the field that are as long as some zone name are
    listed and joined by equality.
    """
    found = of_type(objs, "ZoneInfiltration:DesignFlowRate").select(
        "building_id",
        "obj_pos",
        p(ZONE_FIELD, default="").alias("_field"),
        F.struct(
            p("design_flow_rate").alias("design_flow_rate"),
            p("design_flow_rate_calculation_method").alias("calculation_method"),
            p("schedule_name").alias("schedule"),
            p("velocity_term_coefficient").alias("velocity_coefficient"),
        ).alias("infiltration"),
    )
    zone_names = known_zones(objs)
    if match == "contains":
        # One number per distinct name length, so the list stays short.
        lengths = zone_names.agg(F.collect_set(F.length("zone")).alias("_lengths")).scalar()
        field = F.col("_field")

        def parts(n: Column) -> Column:
            return F.when(
                F.length(field) >= n,
                F.transform(F.sequence(F.lit(1), F.length(field) - n + 1), lambda i: F.substring(field, i, n)),
            ).otherwise(F.array().cast("array<string>"))

        listed = F.array_distinct(F.flatten(F.transform(F.col("_lengths"), parts)))
        found = found.withColumn("_lengths", lengths).withColumn("zone", F.explode(listed))
    else:
        found = found.withColumn("zone", F.col("_field"))
    # Names that are no zones, nearly all parts, go before anything is grouped.
    found = found.join(zone_names, ["building_id", "zone"], "left_semi")
    return found.groupBy("building_id", "zone").agg(F.max_by("infiltration", "obj_pos").alias("infiltration"))


def zone_setpoints(objs: DataFrame) -> DataFrame:
    """Resolved setpoint objects of each zone's last thermostat, one per row."""
    last = _last_thermostat(objs)
    slots = F.array(
        *[
            F.struct(
                F.lit(i).alias("slot"),
                prop(F.col("_t.props"), f"control_{i}_object_type").alias("type"),
                prop(F.col("_t.props"), f"control_{i}_name").alias("name"),
            )
            for i in (1, 2, 3)
        ]
    )
    asked = (
        last.select("building_id", "zone", F.explode(slots).alias("_s"))
        .select("building_id", "zone", "_s.*")
        .where(nonempty(F.col("type")) & nonempty(F.col("name")))
    )
    schedule = first_prop(
        F.col("props"),
        [
            "setpoint_temperature_schedule_name",
            "cooling_setpoint_temperature_schedule_name",
            "heating_setpoint_temperature_schedule_name",
        ],
    )
    types = asked_types(of_type(objs, "ZoneControl:Thermostat"), *[f"control_{i}_object_type" for i in (1, 2, 3)])
    return resolve_ref(asked, objs, "type", "name", "_p", "inner", {"schedule": schedule}, types).select(
        "building_id", "zone", "slot", "type", "name", "_p.schedule"
    )


def _last_thermostat(objs: DataFrame) -> DataFrame:
    return (
        of_type(objs, "ZoneControl:Thermostat")
        .select("building_id", p("zone_or_zonelist_name").alias("zone"), "obj_pos", "object_name", "props")
        .where(F.col("zone").isNotNull())
        .groupBy("building_id", "zone")
        .agg(F.max_by(F.struct("object_name", "props"), "obj_pos").alias("_t"))
    )


def zone_thermostat(objs: DataFrame) -> DataFrame:
    """Control name, type schedule and up to three setpoint objects per zone."""
    head = _last_thermostat(objs).select(
        "building_id",
        "zone",
        F.col("_t.object_name").alias("control_name"),
        prop(F.col("_t.props"), "control_type_schedule_name").alias("control_type_schedule"),
    )
    # At most three rows per zone.
    objects = (
        zone_setpoints(objs)
        .groupBy("building_id", "zone")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "type", "name", "schedule"))).alias("control_objects"))
    )
    empty = F.array().cast("array<struct<slot:int,type:string,name:string,schedule:string>>")
    return head.join(objects, ["building_id", "zone"], "left").withColumn(
        "control_objects", F.coalesce("control_objects", empty)
    )


def zone_schedules(objs: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Setpoint schedules of each zone; an undefined schedule has no points."""
    used = (
        zone_setpoints(objs)
        .where(nonempty(F.col("schedule")))
        .select("building_id", "zone", "schedule")
        .distinct()
    )
    compact = of_type(objs, "Schedule:Compact").select(
        "building_id", F.col("object_name").alias("schedule"), schedule_points(F.col("props"), keep_zero).alias("points")
    )
    none = F.array().cast("array<struct<time:string,value:double>>")
    return used.join(compact, ["building_id", "schedule"], "left").select(
        "building_id", "zone", "schedule", F.coalesce("points", none).alias("points")
    )


LOAD_FIELDS = {
    "People": {
        "number_of_people": "number_of_people",
        "schedule": "number_of_people_schedule_name",
        "activity_level_schedule": "activity_level_schedule_name",
        "fraction_radiant": "fraction_radiant",
    },
    "Lights": {
        "design_level": "lighting_level",
        "schedule": "schedule_name",
        "fraction_radiant": "fraction_radiant",
        "return_air_fraction": "return_air_fraction",
    },
    "ElectricEquipment": {
        "design_level": "design_level",
        "schedule": "schedule_name",
        "fraction_radiant": "fraction_radiant",
        "fraction_latent": "fraction_latent",
    },
}


def zone_load(objs: DataFrame, kind: str) -> DataFrame:
    """The last object of one load type per zone, as the struct ``load``."""
    fields = [p(key).alias(name) for name, key in LOAD_FIELDS[kind].items()]
    return (
        of_type(objs, kind)
        .select("building_id", p(ZONE_FIELD).alias("zone"), "obj_pos", F.struct(F.col("object_name").alias("name"), *fields).alias("_l"))
        .where(F.col("zone").isNotNull())
        .groupBy("building_id", "zone")
        .agg(F.max_by("_l", "obj_pos").alias("load"))
    )


def zone_loads(objs: DataFrame) -> DataFrame:
    """People, lights and equipment of each zone, one row per kind present."""
    names = ["name"] + sorted({n for f in LOAD_FIELDS.values() for n in f})
    out = None
    for kind in LOAD_FIELDS:
        rows = zone_load(objs, kind).select("building_id", "zone", F.lit(kind).alias("kind"), "load.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("building_id", "zone", "kind", *names)


# --- all of a zone ----------------------------------------------------------


def _bodies(rows: DataFrame, section: str, order: str | None, *fields: str) -> DataFrame:
    place = F.lit(0).cast("bigint") if order is None else F.col(order).cast("bigint")
    return rows.select(
        "building_id",
        "zone",
        F.lit(section).alias("section"),
        place.alias("pos"),
        F.to_json(F.struct(*[F.col(f) for f in fields])).alias("body"),
    )


def zone_feature_rows(objs: DataFrame, air_loop_name: str = AIR_LOOP_NAME, match: str = "contains") -> DataFrame:
    """Every feature of every zone, one row each: section, position, JSON body.

    Rows stay rows here, so a zone may have any number of surfaces.
    """
    surfaces = zone_surfaces(objs)
    parts = [
        _bodies(zones(objs), "zone_properties", None, "ceiling_height", "volume", "direction_north", "multiplier", "type"),
        _bodies(surfaces, "surfaces", "obj_pos", "surface", "type", "boundary"),
        _bodies(zone_adjacency(objs, by="key"), "adjacencies", "obj_pos", "adjacent_zone", "surface", "adjacent_surface"),
        _bodies(surfaces.where("is_exterior"), "exterior_surfaces", "obj_pos", "surface", "type", "sun_exposure", "wind_exposure"),
        _bodies(zone_windows(objs), "windows", "obj_pos", "window", "parent_surface", "construction", "vf_to_ground"),
        _bodies(zone_constructions(objs), "materials", None, "construction", "definition"),
        _bodies(zone_infiltration(objs, match), "infiltration", None, "infiltration"),
        _bodies(zone_hvac(objs), "hvac", None, "terminal_unit", "reheat_coil"),
        _bodies(zone_air_loop(objs, air_loop_name), "air_loop", None, "air_loop"),
        _bodies(zone_thermostat(objs), "thermostat", None, "control_name", "control_type_schedule", "control_objects"),
        _bodies(zone_schedules(objs), "setpoint_schedules", None, "schedule", "points"),
        _bodies(zone_loads(objs), "occupancy_loads", None, "kind", "name", *sorted({n for f in LOAD_FIELDS.values() for n in f})),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _listed(rows: DataFrame, name: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    cell = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(f) for f in fields]).alias("v"))
    sorted_cells = F.array_sort(F.collect_list(cell))
    return rows.groupBy("building_id", "zone").agg(F.transform(sorted_cells, lambda c: c["v"]).alias(name))


def zone_features(
    objs: DataFrame, zone: str | None = None, air_loop_name: str = AIR_LOOP_NAME, match: str = "contains"
) -> DataFrame:
    """One nested record per zone: properties, construction, HVAC, control, loads.

    A record holds the zone's surfaces and windows as arrays, so it suits zones
    of ordinary size; ``zone_feature_rows`` has the same facts row by row.
    """
    surfaces = zone_surfaces(objs)
    parts = [
        known_zones(objs),
        zones(objs).select(
            "building_id",
            "zone",
            F.struct("ceiling_height", "volume", "direction_north", "multiplier", "type").alias("properties"),
        ),
        _listed(surfaces, "surfaces", ["obj_pos"], ["surface", "type", "boundary"]),
        _listed(zone_adjacency(objs, by="key"), "adjacencies", ["obj_pos"], ["adjacent_zone", "surface", "adjacent_surface"]),
        _listed(
            surfaces.where("is_exterior"), "exterior_surfaces", ["obj_pos"], ["surface", "type", "sun_exposure", "wind_exposure"]
        ),
        _listed(
            zone_windows(objs), "windows", ["obj_pos"], ["window", "parent_surface", "construction", "vf_to_ground"]
        ),
        _listed(
            zone_constructions(objs).withColumn("definition", F.to_json("definition")),
            "materials",
            ["construction"],
            ["construction", "definition"],
        ),
        zone_infiltration(objs, match),
        zone_hvac(objs),
        zone_air_loop(objs, air_loop_name),
        zone_thermostat(objs).select(
            "building_id", "zone", F.struct("control_name", "control_type_schedule", "control_objects").alias("thermostat")
        ),
        _listed(zone_schedules(objs), "setpoint_schedules", ["schedule"], ["schedule", "points"]),
        zone_load(objs, "People").withColumnRenamed("load", "people"),
        zone_load(objs, "Lights").withColumnRenamed("load", "lights"),
        zone_load(objs, "ElectricEquipment").withColumnRenamed("load", "equipment"),
    ]
    # A zone known only from a thermostat or load entry gets a record as well.
    wide = align_series(parts, on=("building_id", "zone"))
    if zone is not None:
        wide = wide.where(F.col("zone") == zone)
    return wide.select(
        "building_id",
        "zone",
        F.struct("properties", "surfaces", "adjacencies", "exterior_surfaces").alias("zone_properties"),
        F.struct("windows", "materials", "infiltration").alias("construction"),
        F.struct("terminal_unit", "reheat_coil", "air_loop").alias("hvac_system"),
        F.struct("thermostat", "setpoint_schedules").alias("control_parameters"),
        F.struct("people", "lights", "equipment").alias("occupancy_loads"),
    )
