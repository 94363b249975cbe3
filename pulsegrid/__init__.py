"""Rhythm and periodicity of many time-ordered signals, as Spark jobs."""
