"""Readers and sinks that go through Spark's file sources only."""
