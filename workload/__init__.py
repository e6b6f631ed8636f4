"""The registered queries: raw tables derived from the given test tables, the
queries over them, and the SQL that checks them."""
