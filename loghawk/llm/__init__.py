"""Training-data operators: de-duplication, extraction, filtering, scoring, mixing, formatting.

Nothing else in the package imports this folder; ``queries.py`` holds the
registered queries and ``__spark_entry__.py`` adds them when it is present.
"""
