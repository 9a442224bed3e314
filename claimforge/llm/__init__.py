"""Training-data operators: each module holds one operator, queries.py the thin registered queries."""
