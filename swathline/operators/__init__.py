"""Operators over point clouds and trajectories: DataFrame in, DataFrame out."""
