"""Fixed values of the data model."""

from __future__ import annotations

IMPORT, EXPORT = "1-1:1.29.0*255", "1-1:2.29.0*255"
IMPORT_PREFIX, EXPORT_PREFIX = "1-1:1.29.0", "1-1:2.29.0"
DAY_SLOTS, MAX_SLOTS, SLOT_MINUTES = 96, 100, 15

#: First and last slot (from 1) of the parts of a day.
WINDOWS = {"night": (1, 24), "morning": (25, 40), "midday": (41, 60), "afternoon": (61, 68), "evening": (69, 88), "late": (89, 96)}
#: kWh in a quarter of an hour at 3.7, 7.4 and 11 kW.
CHARGE_LEVELS = {"p37": 0.90, "p74": 1.80, "p11": 2.70}
RUN_LEVEL = 0.80

SUMMER, WINTER = (6, 7, 8), (12, 1, 2)
ASSETS = ("pv", "hp", "ev", "battery", "hp_boiler")

PV_SURE_KWH, PV_NONE_KWH = 100.0, 1.0
HEAT_PUMPS = ("airWaterPump", "geothermalHeatPump", "airAirWaterPump")
RESISTIVE = ("electricRadiator",)
OTHER_HEATING = ("oilHeating", "wood", "districtHeating", "gasWithRadiator", "solarThermalSystem")

PRIORS = {"hp": 0.20, "ev": 0.10, "battery": 0.05, "pv": 0.15}
DEFAULT_PRIOR = 0.15
EXPECTED_SHARE = {"pv": (0.05, 0.25), "hp": (0.10, 0.30), "ev": (0.03, 0.15), "battery": (0.01, 0.10)}
CONFIDENCE = {"pv": "high", "battery": "high", "hp": "moderate", "ev": "low-mod", "boiler": "low"}
#: Asset, the detector that decides, and its cut-offs from the strictest down.
VERDICTS = (
    ("PV", "pv_export_total", ((1000.0, "yes"), (150.0, "possible"))),
    ("Battery", "battery_dark_zero", ((0.75, "yes"), (0.35, "possible"))),
    ("Heat pump", "hp_winter_ratio", ((4.0, "likely"), (2.2, "possible"))),
    ("EV", "ev_sustained_blocks", ((0.50, "likely"), (0.10, "possible"))),
    ("Boiler", "boiler_night_band", ((0.09, "possible"), (0.014, "weak"))),
)
PV_YEARLY_FOR_BATTERY = 500.0
