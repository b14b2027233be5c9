"""Operators for training-data pipelines (documents, pages, benchmark, labels).

Each module is one operator with its own general interface; ``queries`` holds
the thin registered queries, ``oracle`` the DuckDB SQL where SQL can say it.
"""
