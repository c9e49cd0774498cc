"""Lantern subpackage."""
