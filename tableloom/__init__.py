"""Batch table operations written directly on the Spark DataFrame, SQL and catalog APIs.

Everything here takes a DataFrame (or a path or a table name) and gives a
DataFrame back; nothing pulls rows to the driver and nothing picks the master.
"""
