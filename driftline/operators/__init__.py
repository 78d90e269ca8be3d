"""Operators over DataFrames of traces and stays."""
