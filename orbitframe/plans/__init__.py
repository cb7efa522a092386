"""Adapters from the test tables to domain tables, the registered queries, and the SQL that checks them."""
