"""Training-data operators for large text corpora.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it
is installed.
"""
