"""Profiling, preparation, neighbourhoods, clustering and scoring of tables as Spark jobs."""
