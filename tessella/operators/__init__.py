"""Relational operators of the engine, over plain DataFrames."""
