"""Training-data operators for large text corpora.

Nothing else in the library imports this subpackage. ``queries.py`` holds the registered queries,
``oracle.py`` their SQL; each operator is a module with its own general interface.
"""
