"""The catalogue of change events."""

from __future__ import annotations

#: Event types with category and usual severity.
EVENT_TYPES = {
    "ROUTE_ADDED": ("A", "major"), "ROUTE_DISCONTINUED": ("A", "major"), "ROUTE_RENAMED": ("A", "minor"), "ROUTE_SPLIT": ("A", "major"), "ROUTE_MERGED": ("A", "major"),
    "ROUTE_RESTRUCTURED": ("A", "major"), "THROUGH_SERVICE_INTRODUCED": ("A", "major"), "THROUGH_SERVICE_DISCONTINUED": ("A", "major"),
    "PATTERN_EXTENDED": ("B", "major"), "PATTERN_TRUNCATED": ("B", "major"), "STOP_INSERTED_IN_PATTERN": ("B", "minor"), "STOP_REMOVED_FROM_PATTERN": ("B", "minor"),
    "DETOUR_ADDED": ("B", "minor"), "DETOUR_REMOVED": ("B", "minor"), "TIME_BAND_VARIANT": ("B", "minor"), "SHAPE_CHANGED": ("B", "minor"),
    "SERVICE_DAYS_CHANGED": ("C", "minor"), "SERVICE_REDUCED": ("C", "minor"), "SERVICE_INCREASED": ("C", "minor"), "TRIPS_TRUNCATED": ("C", "major"),
    "FIRST_LAST_CHANGED": ("C", "major"), "TIMETABLE_SHIFTED": ("C", "info"), "TRAVEL_TIME_CHANGED": ("C", "minor"), "DWELL_TIME_CHANGED": ("C", "info"),
    "STOP_ADDED": ("D", "major"), "STOP_REMOVED": ("D", "major"), "STOP_RENAMED": ("D", "minor"), "STOP_RELOCATED": ("D", "minor"), "PLATFORM_CHANGED": ("D", "minor"),
    "PLATFORM_ADDED": ("D", "info"), "PLATFORM_REMOVED": ("D", "info"),
    "GENERATION_SCOPE": ("E", "info"), "DAYTYPE_RESTRUCTURED": ("E", "major"), "HOLIDAY_EXCEPTION_CHANGED": ("E", "info"), "SEASONAL_SERVICE_CHANGED": ("E", "minor"),
    "DEMAND_RESPONSIVE_CHANGE": ("F", "major"), "FARE_CHANGED": ("F", "major"), "FEED_VALIDITY_CHANGED": ("F", "info"), "AGENCY_INFO_CHANGED": ("F", "info"),
    "TRANSLATION_CHANGED": ("F", "info"), "ACCESSIBILITY_CHANGED": ("F", "minor"), "HEADSIGN_CHANGED": ("F", "info"), "TECHNICAL_ID_CHURN": ("F", "info"), "UNEXPLAINED_RESIDUAL": ("F", "info"),
}
