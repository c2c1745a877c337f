"""Spark jobs for event-listing data: sources, de-duplication, merge, calendar."""
