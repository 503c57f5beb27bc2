"""Readers that turn registry files into typed DataFrames."""
