"""The verbs, the registered queries, and the SQL that gives the same rows."""
