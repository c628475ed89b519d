"""Selections, tables, timelines, symbols, flame graphs and scheduling."""
