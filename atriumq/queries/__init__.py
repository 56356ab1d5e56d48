"""Registered queries, by area, each module with QUERIES and ORACLES."""
