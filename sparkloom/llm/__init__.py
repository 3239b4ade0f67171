"""Training-data operators: each module holds one operator and its thin query.

Nothing outside this subpackage and ``corpus_pipeline`` imports it.
"""
