"""Readers and writers for record tables, detections, model tables and reports."""
