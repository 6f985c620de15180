"""Training-data operators: thirteen corpus operators and the queries built on them.

Nothing outside this folder imports it; ``__spark_entry__.py`` registers its
queries when the folder is present.
"""
