"""Registered queries on the test tables and the SQL that gives the same rows."""
