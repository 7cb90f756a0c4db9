"""Readers: OSM XML, change files, PBF, polygon and settings files, and stored libraries."""
