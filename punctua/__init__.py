"""Delay-risk analytics on Spark DataFrames: label, split, encode, score, evaluate, select."""
