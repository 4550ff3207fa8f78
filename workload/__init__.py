"""The registered queries: every operator over the TPC-H-like test tables, and SQL to check it."""
