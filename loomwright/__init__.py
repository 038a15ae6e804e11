"""loomwright: a PySpark engine that consolidates messy tables and answers guarded queries over them."""
