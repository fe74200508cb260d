"""All registered queries and their SQL."""

from . import file_queries, read_queries, sql_queries, table_queries

QUERIES = read_queries.QUERIES | file_queries.QUERIES | sql_queries.QUERIES | table_queries.QUERIES
SQL = read_queries.SQL | file_queries.SQL | sql_queries.SQL | table_queries.SQL
