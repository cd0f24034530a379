"""Complaint-text analytics on Spark DataFrames.

Every operator takes a DataFrame plus explicit parameters and returns a
DataFrame; nothing below keeps global state or needs a service.
"""

__version__ = "0.1.0"
