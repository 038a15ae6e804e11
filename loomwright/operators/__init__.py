"""Operators over DataFrames: column and row transforms, duplicates, aggregates, browsing, inference, schemas, lineage, charts."""
