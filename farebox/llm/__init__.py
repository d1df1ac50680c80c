"""Training-data operators: the thirteen corpus operators and their queries.

Nothing else in the library imports this subpackage; general helpers
(``farebox.session``) are imported from the library.
"""
