"""Training-data operators: ten text, page, vector and chat jobs, and their queries.

Nothing outside this subpackage imports it.
"""
