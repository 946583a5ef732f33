"""All registered queries of the library's own operators, with the SQL that checks them."""

from lodestore.plans import class_queries, graph_queries, index_queries, live_queries, more_queries, other_queries, request_queries, search_queries, session_queries, source_queries, store_queries

QUERIES = {}
ORACLES = {}
for _m in (search_queries, session_queries, request_queries, graph_queries, class_queries, store_queries, other_queries, more_queries, source_queries, index_queries, live_queries):
    QUERIES |= _m.Q
    ORACLES |= _m.SQL
