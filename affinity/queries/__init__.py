"""The queries over the table folders, by name, and the SQL that must give the same rows."""

from affinity.queries import changes, lifecycle, search, terms

#: The modules of queries outside the optional subpackage.
CORE = (search, terms, lifecycle, changes)
