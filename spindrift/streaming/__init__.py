"""Telemetry and metering as streams."""
