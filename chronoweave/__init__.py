"""Presence-timeline engine on Spark DataFrames: as-of and interval joins, sessions, day timelines, locations and reports."""
