"""Corvane: retrieval and analytics over software-project history, built on Spark DataFrames."""
