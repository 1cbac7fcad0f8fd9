"""Names, thresholds and term lists of the building-energy domain.

Everything in ``operators`` is parameterised by column; this module is the only
place that knows the column names of controller logs, weather files and
building models.
"""

from __future__ import annotations

# Column names, limits and terms that results depend on.

TIME_COLUMNS = ("time", "timestep", "month", "day_of_month", "hour")

ACTION_COLUMNS = ("Heating_Setpoint_RL", "Cooling_Setpoint_RL")
ACTION_RANGES = {
    "Heating_Setpoint_RL": (15.0, 25.0),
    "Cooling_Setpoint_RL": (20.0, 30.0),
}

REWARD_COLUMNS = ("reward",)
REWARD_EXTREMES = (-10.0, 10.0)
REWARD_IQR_FACTOR = 1.5
REWARD_RUN_MIN_LENGTH = 101  # "more than 100 in a row"
HISTOGRAM_BINS = 50

OBSERVATION_COLUMNS = (
    "month",
    "day_of_month",
    "hour",
    "outdoor_temperature",
    "outdoor_humidity",
    "wind_speed",
    "wind_direction",
    "diffuse_solar_radiation",
    "direct_solar_radiation",
    "htg_setpoint",
    "clg_setpoint",
    "air_temperature",
    "air_humidity",
    "people_occupant",
    "co2_emission",
    "HVAC_electricity_demand_rate",
    "total_electricity_HVAC",
)
OBSERVATION_TIME_RANGES = {
    "month": (1, 12),
    "day_of_month": (1, 31),
    "hour": (0, 23),
}
OBSERVATION_PHYSICAL_RANGES = {
    "outdoor_temperature": (-50.0, 50.0),
    "air_temperature": (-50.0, 50.0),
    "outdoor_humidity": (0.0, 100.0),
    "air_humidity": (0.0, 100.0),
    "wind_speed": (0.0, None),
    "HVAC_electricity_demand_rate": (0.0, 1e6),
}
OBSERVATION_SETPOINTS = ("htg_setpoint", "clg_setpoint")
OBSERVATION_PLOT_COLUMNS = ("outdoor_temperature", "air_temperature", "HVAC_electricity_demand_rate")

WEATHER_HEADER_LINES = 8
WEATHER_ROW_COUNTS = (8760, 8784)
WEATHER_COLUMNS = (
    "Year",
    "Month",
    "Day",
    "Hour",
    "Minute",
    "Data Source and Uncertainty Flags",
    "Dry Bulb Temperature",
    "Dew Point Temperature",
    "Relative Humidity",
    "Atmospheric Station Pressure",
    "Extraterrestrial Horizontal Radiation",
    "Extraterrestrial Direct Normal Radiation",
    "Horizontal Infrared Radiation Intensity",
    "Global Horizontal Radiation",
    "Direct Normal Radiation",
    "Diffuse Horizontal Radiation",
    "Global Horizontal Illuminance",
    "Direct Normal Illuminance",
    "Diffuse Horizontal Illuminance",
    "Zenith Luminance",
    "Wind Direction",
    "Wind Speed",
    "Total Sky Cover",
    "Opaque Sky Cover",
    "Visibility",
    "Ceiling Height",
    "Present Weather Observation",
    "Present Weather Codes",
    "Precipitable Water",
    "Aerosol Optical Depth",
    "Snow Depth",
    "Days Since Last Snowfall",
    "Albedo",
    "Liquid Precipitation Depth",
    "Liquid Precipitation Quantity",
)
# The columns read as numbers.
WEATHER_NUMERIC_COLUMNS = (
    "Year",
    "Month",
    "Day",
    "Hour",
    "Minute",
    "Dry Bulb Temperature",
    "Dew Point Temperature",
    "Relative Humidity",
    "Atmospheric Station Pressure",
    "Extraterrestrial Horizontal Radiation",
    "Extraterrestrial Direct Normal Radiation",
    "Horizontal Infrared Radiation Intensity",
    "Global Horizontal Radiation",
    "Direct Normal Radiation",
    "Diffuse Horizontal Radiation",
    "Wind Direction",
    "Wind Speed",
    "Total Sky Cover",
    "Visibility",
    "Precipitable Water",
    "Snow Depth",
    "Days Since Last Snowfall",
    "Albedo",
    "Liquid Precipitation Depth",
)
WEATHER_TIME_RANGES = {"Month": (1, 12), "Day": (1, 31), "Hour": (1, 24)}
WEATHER_PHYSICAL_RANGES = {
    "Dry Bulb Temperature": (-70.0, 70.0),
    "Relative Humidity": (0.0, 100.0),
    "Wind Speed": (0.0, 50.0),
    "Direct Normal Radiation": (0.0, 1500.0),
}
WEATHER_PLOT_COLUMNS = ("Dry Bulb Temperature", "Relative Humidity", "Wind Speed")

SIZING_ZONE = "SPACE5-1"
SIZING_TIME_COLUMNS = ("time", "timestep")
SIZING_ROW_COUNTS = (96, 97, 98)

TRAINING_YEAR = 2021
TRAINING_GENERAL_COLUMNS = (
    "timestep",
    "month",
    "day_of_month",
    "hour",
    "obs_outdoor_temperature",
    "obs_outdoor_humidity",
    "obs_wind_speed",
    "obs_wind_direction",
    "obs_diffuse_solar_radiation",
    "obs_direct_solar_radiation",
    "action_Heating_Setpoint_RL",
    "action_Cooling_Setpoint_RL",
    "reward_reward",
)
TRAINING_OTHER_ZONES = ("SPACE1", "SPACE2", "SPACE3", "SPACE4")
PREVIEW_ROWS = 1000

REQUIRED_OBJECT_TYPES = (
    "Version",
    "Building",
    "SimulationControl",
    "Site:Location",
    "RunPeriod",
    "SizingPeriod:DesignDay",
    "GlobalGeometryRules",
)
OBJECT_CATEGORIES = {
    "hvac": (
        "AirLoopHVAC",
        "ZoneHVAC:EquipmentConnections",
        "AirTerminal:SingleDuct:VAV:Reheat",
        "Boiler:HotWater",
        "Chiller:Electric",
        "Coil:Cooling:DX",
    ),
    "materials": (
        "Material",
        "Material:NoMass",
        "Material:AirGap",
        "WindowMaterial:SimpleGlazingSystem",
    ),
    "constructions": ("Construction",),
    "loads": (
        "People",
        "Lights",
        "ElectricEquipment",
        "GasEquipment",
        "OtherEquipment",
        "ZoneInfiltration:DesignFlowRate",
    ),
    "zones": ("Zone",),
    "outputs": ("Output:Variable",),
    "meters": ("Output:Meter",),
}
OBJECT_PREFIX_CATEGORIES = {"schedules": "Schedule"}
OBJECT_MINIMUM_COUNTS = {
    "zones": 1,
    "hvac": 1,
    "schedules": 1,
    "materials": 1,
    "constructions": 1,
    "loads": 1,
    "outputs": 5,
}
ADJACENT_BOUNDARY = "Surface"
EXTERIOR_BOUNDARY = "Outdoors"
AIR_TERMINAL_UNIT = "ZoneHVAC:AirDistributionUnit"
AIR_LOOP_NAME = "VAV Sys 1"
AIR_LOOP_NODE_MARK = " ATU"
SCHEDULE_STRIDE = 4
SCHEDULE_TIME_MARK = "Until:"

KEYWORD_COVERAGE_PASS = 0.6
REASONING_PASS = 0.5
BLUEPRINT_PASS = 0.5
BLUEPRINT_TERMS = ("room", "vav", "cfm", "temperature", "supply", "return", "ahu")
BLUEPRINT_MIN_TERMS = 2
MIN_NEW_CHARACTERS = 10
MIN_OCR_CHARACTERS = 10
MIN_BLUEPRINT_CHARACTERS = 20
