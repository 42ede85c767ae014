"""Readers and writers."""

from cartlens.sources.arrival import ARRIVAL, numbered_lines
from cartlens.sources.tables import TABLES, read_table
from cartlens.sources.text import (
    read_baskets,
    read_cluster_assignments,
    read_purchases_frame,
    read_ratings,
)
from cartlens.sources.sinks import load_kmeans_model, save_kmeans_model, write_delimited
from cartlens.sources.jdbc import read_jdbc_features

__all__ = [
    "ARRIVAL",
    "numbered_lines",
    "TABLES",
    "read_table",
    "read_ratings",
    "read_purchases_frame",
    "read_cluster_assignments",
    "read_baskets",
    "write_delimited",
    "save_kmeans_model",
    "load_kmeans_model",
    "read_jdbc_features",
]
