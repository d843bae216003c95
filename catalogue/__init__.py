"""The registered queries, each next to the SQL that states its result."""
