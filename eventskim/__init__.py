"""Skim-and-slim analysis of particle-collision events on Spark DataFrames."""
