"""The nightly run, and queries on the test tables."""
