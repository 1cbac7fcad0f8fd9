"""Building models: parsing, checks, adjacency and the features of zones."""

import json

import pytest
from conftest import rows

from hearthline.operators import objects as ob
from hearthline.plans import building
from hearthline.sources.buildings import malformed_buildings, parse_building_objects, read_building_objects, write_building_objects

FIELD = "zone_or_zonelist_or_space_or_spacelist_name"


def surface(zone, boundary="Outdoors", other=None, name=None, construction="Wall"):
    made = {"zone_name": zone, "surface_type": "Wall", "outside_boundary_condition": boundary, "construction_name": construction}
    if other:
        made["outside_boundary_condition_object"] = other
    if name:
        made["name"] = name
    if boundary == "Outdoors":
        made["sun_exposure"] = "SunExposed"
    return made


MODEL = {
    "Version": {"v": {}},
    "Building": {"B2": {"name": "Second letter"}, "B1": {"name": "Later"}},
    "Site:Location": {"L": {"name": "Here", "latitude": 41.5}},
    "Zone": {
        "SPACE1-1": {"name": "Lobby", "volume": 447.68, "ceiling_height": "Autocalculate"},
        "SPACE1-10": {"multiplier": 2},
        "SPACE2-1": {},
    },
    "BuildingSurface:Detailed": {
        "W2": surface("SPACE1-1"),
        "W1": surface("SPACE1-1", "Surface", "W3"),
        "W3": surface("SPACE2-1", "Surface", "W1", name="N3"),
        "W4": surface("SPACE1-1", "Surface", "N3", construction="Thick"),
        "W5": surface("Attic", "Surface", "N3"),
        "W6": surface("SPACE2-1", "Surface", "gone"),
    },
    "FenestrationSurface:Detailed": {
        "G1": {"building_surface_name": "W2", "construction_name": "Glass"},
        "G2": {"building_surface_name": "nowhere", "construction_name": "Glass"},
    },
    "Construction": {"Wall": {"outside_layer": "Brick"}, "Glass": {"outside_layer": "Pane"}, "Unused": {}},
    "ZoneInfiltration:DesignFlowRate": {
        "I1": {FIELD: "SPACE1-1", "design_flow_rate": 1},
        "I2": {FIELD: "SPACE1-10", "design_flow_rate": 2},
    },
    "ZoneHVAC:EquipmentConnections": {
        "C1": {"zone_name": "SPACE1-1", "zone_conditioning_equipment_list_name": "E1"},
        "C2": {"zone_name": "SPACE2-1", "zone_conditioning_equipment_list_name": "E2"},
    },
    "ZoneHVAC:EquipmentList": {
        "E1": {
            "equipment": [
                {"zone_equipment_object_type": "ZoneHVAC:AirDistributionUnit", "zone_equipment_name": "A1"},
                {"zone_equipment_object_type": "Fan", "zone_equipment_name": "A2"},
                {"zone_equipment_object_type": "ZoneHVAC:AirDistributionUnit", "zone_equipment_name": "A3"},
            ]
        },
        "E2": {"equipment": [{"zone_equipment_object_type": "ZoneHVAC:AirDistributionUnit", "zone_equipment_name": "A4"}]},
    },
    "ZoneHVAC:AirDistributionUnit": {
        "A1": {"air_terminal_object_type": "VAV", "air_terminal_name": "T1"},
        "A3": {"air_terminal_object_type": "VAV", "air_terminal_name": "T3"},
        "A4": {"air_terminal_object_type": "VAV", "air_terminal_name": "dangling"},
    },
    "VAV": {
        "T1": {"maximum_air_flow_rate": "Autosize", "reheat_coil_object_type": "Coil", "reheat_coil_name": "K1"},
        "T3": {"maximum_air_flow_rate": 0.5},
    },
    "Coil": {"K1": {"efficiency": 0.8, "nominal_capacity": 1000}},
    "AirLoopHVAC:ZoneSplitter": {"S": {"nodes": [{"outlet_node_name": "SPACE1-1 ATU In Node"}, {"outlet_node_name": "SPACE9 ATU"}]}},
    "AirLoopHVAC": {"VAV Sys 1": {"design_supply_air_flow_rate": 2.5}},
    "ZoneControl:Thermostat": {
        "TH0": {"zone_or_zonelist_name": "SPACE1-1", "control_type_schedule_name": "old"},
        "TH1": {
            "zone_or_zonelist_name": "SPACE1-1",
            "control_type_schedule_name": "CT",
            "control_1_object_type": "Setpoint:Dual",
            "control_1_name": "D1",
            "control_2_object_type": "Setpoint:Dual",
            "control_2_name": "missing",
            "control_3_object_type": "Setpoint:One",
            "control_3_name": "O1",
        },
    },
    "Setpoint:Dual": {"D1": {"heating_setpoint_temperature_schedule_name": "H", "cooling_setpoint_temperature_schedule_name": "Clg"}},
    "Setpoint:One": {"O1": {"setpoint_temperature_schedule_name": "absent"}},
    "Schedule:Compact": {
        "Clg": {
            "data": [
                {"field": "Through: 12/31"}, {"field": "For: AllDays"}, {"field": "Until: 07:00"}, {"field": 0},
                {"field": "a"}, {"field": "b"}, {"field": "Until: 18:00"}, {"field": "0"},
                {"field": "a"}, {"field": "b"}, {"field": "Until:24:00"}, {"field": 26.5},
                {"field": "a"}, {"field": "b"}, {"field": 5}, {"field": 7},
                {"field": "a"}, {"field": "b"}, {"field": "Until: 25:00"}, {"field": "warm"},
                {"field": "a"}, {"field": "b"}, {"field": "Until: 26:00"},
            ]
        }
    },
    "People": {
        "P1": {FIELD: "SPACE1-1", "number_of_people": 5},
        "P2": {FIELD: "SPACE1-1", "number_of_people": 11, "fraction_radiant": 0.3},
        "P3": {FIELD: "SPACE1-10", "number_of_people": 1},
    },
    "Lights": {"L1": {FIELD: "SPACE1-1", "lighting_level": 100}},
    "ElectricEquipment": {"Q1": {FIELD: "SPACE1-1 List", "design_level": 7}},
    "Output:Variable": {"o1": {}, "o2": {}},
    "Empty:Type": {},
}

BROKEN = json.dumps(MODEL)[:-20]
TWICE = '{"Zone": {"A": {"volume": 1}, "A": {"volume": 2}}, "Zone": {"B": {"volume": 3}, "B": {"volume": 4}}}'


@pytest.fixture(scope="module")
def texts(spark):
    given = [("b1", json.dumps(MODEL)), ("bad", BROKEN), ("twice", TWICE)]
    return spark.createDataFrame(given, "building_id string, text string")


@pytest.fixture(scope="module")
def objs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("objects") / "o")
    write_building_objects(parse_building_objects(texts), path)
    return spark.read.parquet(path).where("building_id = 'b1'")


def test_malformed_and_duplicates(texts):
    assert rows(malformed_buildings(texts)) == [("b1", False), ("bad", True), ("twice", False)]
    parsed = parse_building_objects(texts)
    assert rows(parsed.where("building_id = 'bad'")) == []
    twice = parsed.where("building_id = 'twice'").selectExpr("object_name", "string(props)")
    assert rows(twice) == [("B", '{"volume":4}')]


def test_files(spark, tmp_path):
    (tmp_path / "m.epJSON").write_text(json.dumps(MODEL, indent=2))
    (tmp_path / "bad.epJSON").write_text(BROKEN)
    read, report = building.read_buildings(spark, str(tmp_path))
    assert read.where("object_type = 'Zone'").count() == 3
    assert rows(report, "n_rows", "n_bad", "status") == [(1, 0, "ok"), (1, 1, "malformed")]
    assert read_building_objects(spark, str(tmp_path)).where("object_type = 'VAV'").count() == 2


def test_counts_and_presence(objs):
    counts = dict(rows(ob.object_counts(objs), "object_type", "n_objects"))
    assert counts["BuildingSurface:Detailed"] == 6 and counts["Empty:Type"] == 0
    report = building.validate_buildings(objs)
    found = {r["category"]: (r["n_objects"], r["status"]) for r in report.summary.collect()}
    assert found == {
        "zones": (3, "ok"),
        "hvac": (3, "ok"),
        "schedules": (1, "ok"),
        "materials": (0, "missing"),
        "constructions": (3, "ok"),
        "loads": (7, "ok"),
        "outputs": (2, "few"),
    }
    assert rows(report.violations, "missing_type") == [
        ("GlobalGeometryRules",),
        ("RunPeriod",),
        ("SimulationControl",),
        ("SizingPeriod:DesignDay",),
    ]
    head = report.tables["summary"].first()
    assert (head["building_name"], head["north_axis"], head["terrain"], head["location_name"], head["latitude"]) == (
        "Second letter",
        "0",
        None,
        "Here",
        "41.5",
    )


def test_adjacency(objs):
    assert rows(ob.zone_adjacency(objs, "name"), "zone", "other_zone") == [("Attic", "SPACE2-1"), ("SPACE1-1", "SPACE2-1")]
    assert rows(ob.zone_adjacency(objs, "key"), "zone", "surface", "adjacent_zone", "adjacent_surface") == [
        ("SPACE1-1", "W1", "SPACE2-1", "W3"),
        ("SPACE2-1", "W3", "SPACE1-1", "W1"),
    ]
    assert rows(ob.named_adjacency(objs), "zone_name", "other_zone_name", "is_orphan") == [
        ("Attic", "SPACE2-1", True),
        ("Lobby", "SPACE2-1", False),
    ]
    assert rows(ob.zone_connections(objs), "display_name", "n_connected") == [
        ("Lobby", 1),
        ("SPACE1-10", 0),
        ("SPACE2-1", 0),
    ]


def test_zone_features(objs):
    got = ob.zone_features(objs, "SPACE1-1").first().asDict(recursive=True)
    assert got["zone_properties"]["properties"] == {
        "ceiling_height": "Autocalculate",
        "volume": "447.68",
        "direction_north": None,
        "multiplier": None,
        "type": None,
    }
    assert [s["surface"] for s in got["zone_properties"]["surfaces"]] == ["W2", "W1", "W4"]
    assert got["zone_properties"]["adjacencies"] == [
        {"adjacent_zone": "SPACE2-1", "surface": "W1", "adjacent_surface": "W3"}
    ]
    assert got["zone_properties"]["exterior_surfaces"] == [
        {"surface": "W2", "type": "Wall", "sun_exposure": "SunExposed", "wind_exposure": "Unknown"}
    ]
    assert [(w["window"], w["vf_to_ground"]) for w in got["construction"]["windows"]] == [("G1", None)]
    assert [(m["construction"], m["definition"]) for m in got["construction"]["materials"]] == [
        ("Glass", '{"outside_layer":"Pane"}'),
        ("Wall", '{"outside_layer":"Brick"}'),
    ]
    # The name of zone SPACE1-1 also occurs in "SPACE1-10", which comes last.
    assert got["construction"]["infiltration"]["design_flow_rate"] == "2"
    hvac = got["hvac_system"]
    assert hvac["terminal_unit"] == {"type": "VAV", "name": "T3", "max_flow_rate": "0.5", "min_flow_fraction": None}
    assert hvac["reheat_coil"] == {"type": "Coil", "name": "K1", "efficiency": "0.8", "capacity": "1000"}
    assert hvac["air_loop"] == {"name": "VAV Sys 1", "design_flow_rate": "2.5"}
    thermostat = got["control_parameters"]["thermostat"]
    assert (thermostat["control_name"], thermostat["control_type_schedule"]) == ("TH1", "CT")
    assert [(c["slot"], c["name"], c["schedule"]) for c in thermostat["control_objects"]] == [(1, "D1", "Clg"), (3, "O1", "absent")]
    assert got["control_parameters"]["setpoint_schedules"] == [
        {"schedule": "Clg", "points": [{"time": "18:00", "value": 0.0}, {"time": "24:00", "value": 26.5}]},
        {"schedule": "absent", "points": []},
    ]
    loads = got["occupancy_loads"]
    assert (loads["people"]["name"], loads["people"]["number_of_people"]) == ("P2", "11")
    assert loads["lights"]["design_level"] == "100" and loads["equipment"] is None


def test_zone_outside_zone_objects(objs):
    got = ob.zone_features(objs, "Attic").first()
    assert got["zone_properties"]["properties"] is None
    assert [s["surface"] for s in got["zone_properties"]["surfaces"]] == ["W5"]


def test_options(objs):
    equal = ob.zone_infiltration(objs, match="equals").selectExpr("zone", "infiltration.design_flow_rate")
    assert rows(equal) == [("SPACE1-1", "1"), ("SPACE1-10", "2")]
    points = ob.zone_schedules(objs, keep_zero=True).where("schedule = 'Clg'").first()["points"]
    assert [p["time"] for p in points] == ["07:00", "18:00", "24:00"]
    assert ob.zone_air_loop(objs, "other").count() == 0


def test_feature_rows_hold_the_same_facts(objs):
    sections = dict(rows(ob.zone_feature_rows(objs).groupBy("section").count()))
    assert sections == {
        "zone_properties": 3,
        "surfaces": 6,
        "adjacencies": 2,
        "exterior_surfaces": 1,
        "windows": 1,
        "materials": 4,
        "infiltration": 2,
        "hvac": 1,
        "air_loop": 1,
        "thermostat": 1,
        "setpoint_schedules": 2,
        "occupancy_loads": 4,
    }
