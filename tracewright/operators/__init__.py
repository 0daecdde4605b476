"""Operators over case-centric and object-centric event logs; each takes and returns DataFrames."""
