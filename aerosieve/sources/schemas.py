"""Schemas of landed files and layouts of flattened measurements."""

REGISTRY = (
    "location_id bigint, name string, region string, latitude double, longitude double, parameters string, sensor_count int, "
    "datetime_first string, datetime_last string, pct_2025_possible double, nn_km double, nn_station double, "
    "shares_maiac_pixel_risk string, coord_verified string, status string, qc_note string"
)
_SPAN = "struct<utc: string, local: string>"
LOCATIONS_JSON = (
    "results array<struct<id: bigint, name: string, locality: string, timezone: string, isMobile: boolean, "
    "provider: struct<id: bigint, name: string>, coordinates: struct<latitude: double, longitude: double>, country: struct<code: string>, "
    f"sensors: array<struct<id: bigint, parameter: struct<name: string>>>, datetimeFirst: {_SPAN}, datetimeLast: {_SPAN}>>"
)
SENSORS_JSON = f"results array<struct<id: bigint, parameter: struct<name: string>, datetimeFirst: {_SPAN}, datetimeLast: {_SPAN}>>"
LATEST_JSON = "results array<struct<sensorsId: bigint, value: double>>"
MEASUREMENTS_JSON = (
    "location_id bigint, sensor_id bigint, results array<struct<value: double, parameter: struct<id: bigint, name: string, units: string>, "
    f"period: struct<label: string, datetimeFrom: {_SPAN}, datetimeTo: {_SPAN}>, summary: struct<min: double, max: double, avg: double, median: double, sd: double>, "
    f"coverage: struct<expectedCount: int, observedCount: int, percentComplete: double, percentCoverage: double, datetimeFrom: {_SPAN}, datetimeTo: {_SPAN}>>>"
)
#: column -> path in a measurement
LAYOUTS = {
    "narrow": {
        "parameter_name": "parameter.name", "units": "parameter.units", "value": "value",
        "datetime_from_utc": "period.datetimeFrom.utc", "datetime_from_local": "period.datetimeFrom.local", "datetime_to_local": "period.datetimeTo.local",
        "summary_min": "summary.min", "summary_max": "summary.max", "summary_sd": "summary.sd",
        "coverage_expected": "coverage.expectedCount", "coverage_observed": "coverage.observedCount", "coverage_percent": "coverage.percentComplete",
    },
    "wide": {
        "value": "value", "parameter_id": "parameter.id", "parameter_name": "parameter.name", "units": "parameter.units", "period_label": "period.label",
        "period_from_utc": "period.datetimeFrom.utc", "period_to_utc": "period.datetimeTo.utc",
        "period_from_local": "period.datetimeFrom.local", "period_to_local": "period.datetimeTo.local",
        "summary_avg": "summary.avg", "summary_min": "summary.min", "summary_max": "summary.max", "summary_median": "summary.median", "summary_sd": "summary.sd",
        "coverage_percent": "coverage.percentCoverage", "coverage_complete": "coverage.percentComplete",
        "coverage_expected_count": "coverage.expectedCount", "coverage_observed_count": "coverage.observedCount",
        "coverage_from_utc": "coverage.datetimeFrom.utc", "coverage_to_utc": "coverage.datetimeTo.utc",
        "coverage_from_local": "coverage.datetimeFrom.local", "coverage_to_local": "coverage.datetimeTo.local",
    },
}
