"""Training-data operators: the only part of the library that works on text corpora.

Nothing outside this subpackage imports it; ``queries.py`` lists what the
entry point registers.
"""
