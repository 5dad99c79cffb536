"""The registered queries: package operators over the given tables, each with its SQL twin."""
