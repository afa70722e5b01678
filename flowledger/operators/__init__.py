"""DataFrame operators of the catalogue engine. Rows are ordered by explicit columns, never by arrival."""
