"""Operators for preparing training text, one module for each of them.

Every operator takes DataFrames and names of columns, reads only those
columns (so further columns, whatever their names, do not matter), and
returns a DataFrame.  ``queries.py`` holds the registered thin queries.
"""
