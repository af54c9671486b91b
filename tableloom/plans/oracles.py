"""The same results as ``queries``, in SQL over the given tables."""

from __future__ import annotations

# Code points that Python calls white space.
_SPACES = "||".join(f"chr({point})" for point in range(0x3001) if chr(point).isspace())

_NATIONS_OF_REGION = "SELECT n_nationkey FROM nation WHERE n_regionkey = 1"
_CUSTOMERS_OF_REGION = (
    f"SELECT c_custkey FROM customer WHERE c_nationkey IN ({_NATIONS_OF_REGION})"
)
_ORDERS_OF_REGION = f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({_CUSTOMERS_OF_REGION})"

_GIVEN_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_ORDER_COLUMNS = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}

_WORDS = r"""
    SELECT word, count(*) AS n
    FROM (SELECT unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word FROM documents)
    WHERE word <> ''
    GROUP BY word
"""

_LOCATION = "array<double>"
_FIELDS = {
    "closing_date": "string",
    "geolocation": _LOCATION,
    "id": "bigint",
    "opening_date": "string",
    "premise_address1": "string",
    "premise_address2": "string",
    "premise_city": "string",
    "premise_name": "string",
    "premise_phone": "string",
    "premise_state": "string",
    "premise_zip": "string",
    "type_description": "string",
}
_FIELD_TREE = [
    ("fields", "struct<" + ",".join(f"{name}:{kind}" for name, kind in _FIELDS.items()) + ">"),
    *((f"fields.{name}", kind) for name, kind in _FIELDS.items()),
    ("record_timestamp", "string"),
    ("recordid", "string"),
]

# Fields that are not in every record.
_PRESENT = {
    "fields.geolocation": "count(*) FILTER (event_type <> 'error')",
    "fields.premise_address2": "count(*) FILTER (event_id % 2 = 0)",
}

ORACLES: dict[str, str] = {
    "project_columns": "SELECT doc_id, lang FROM documents",
    "sql_over_view": "SELECT * FROM customer",
    "sql_column_over_view": "SELECT p_name FROM part",
    "conform_rename_derive": """
        SELECT c_custkey AS "datasetId", c_name AS name, c_mktsegment, 'Wake' AS county
        FROM customer
    """,
    "composite_id": """
        SELECT c_custkey AS "datasetId", c_name, c_nationkey, c_mktsegment, 'Wake' AS county,
               c_mktsegment || '_Wake_' || c_custkey AS id
        FROM customer
    """,
    "rename_positional": """
        SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance
        FROM supplier
    """,
    "nested_json_fields": """
        SELECT 'rec-' || event_id AS recordid, event_id AS "datasetId",
               'User ' || user_id AS name
        FROM events
    """,
    "midpoint_and_copies": """
        SELECT l_orderkey, l_linenumber, l_discount AS lcl, l_tax AS ucl,
               (l_discount + l_tax) / 2 AS avg, l_discount AS lcl2, l_tax AS ucl2
        FROM lineitem
    """,
    "derive_then_drop": """
        SELECT l_orderkey, l_linenumber, l_discount AS lcl, l_tax AS ucl FROM lineitem
    """,
    "concat_name": "SELECT c_custkey, c_mktsegment || ', ' || c_name AS name FROM customer",
    "split_take_item": """
        SELECT o_orderkey, string_split(o_orderpriority, '-')[2] AS priority FROM orders
    """,
    "split_take_missing_item": """
        SELECT p_partkey, string_split(p_name, ' ')[2] AS second_word,
               string_split(p_type, ' - ')[2] AS label
        FROM part
    """,
    "array_items": """
        SELECT vec_id, embedding[1] AS x, embedding[2] AS y, embedding[1000001] AS beyond
        FROM embeddings
    """,
    "split_words": """
        SELECT doc_id, cast(len(string_split(text, ' ')) AS int) AS n_words,
               array_to_string(string_split(text, ' '), '|') AS words
        FROM documents
    """,
    "strip_whitespace": f"""
        SELECT doc_id, trim(string_split(text, '.')[2], {_SPACES}) AS sentence,
               trim(text, {_SPACES}) AS text
        FROM documents
    """,
    "filter_equality": "SELECT * FROM orders WHERE o_orderstatus = 'O'",
    "filter_conjunction": """
        SELECT * FROM lineitem
        WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1
    """,
    "replace_value": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderstatus = 'F' THEN 'FINAL' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, o_orderdate, o_orderpriority
        FROM orders
    """,
    "in_subquery": f"SELECT * FROM customer WHERE c_nationkey IN ({_NATIONS_OF_REGION})",
    "nested_in_subquery": f"SELECT * FROM orders WHERE o_custkey IN ({_CUSTOMERS_OF_REGION})",
    "deep_in_subquery": f"SELECT * FROM lineitem WHERE l_orderkey IN ({_ORDERS_OF_REGION})",
    "in_subquery_repeated_keys": """
        SELECT * FROM part
        WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    """,
    "scalar_subquery_filter": """
        SELECT * FROM customer
        WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')
          AND c_mktsegment = 'BUILDING'
    """,
    "nested_scalar_subquery": """
        SELECT * FROM orders
        WHERE o_custkey = (
            SELECT max(c_custkey) FROM customer
            WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7'))
    """,
    "row_count": "SELECT count(*) AS n FROM lineitem",
    "word_count": _WORDS,
    "limit_rows": """
        SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10
    """,
    "preview_limit": """
        SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 20
    """,
    "union_by_name_conformed": """
        SELECT c_custkey AS "datasetId", c_name AS name, c_acctbal AS bal,
               cast(NULL AS varchar) AS "dateEnd"
        FROM customer
        UNION ALL BY NAME
        SELECT '2020-01-31' AS "dateEnd", s_acctbal AS bal, s_suppkey AS "datasetId",
               s_name AS name
        FROM supplier
    """,
    "union_self": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "replicate_rows": "SELECT supplier.* FROM supplier, range(61)",
    "enlarged_midpoints": """
        SELECT p_partkey, p_size AS lcl, p_retailprice AS ucl,
               (p_size + p_retailprice) / 2 AS avg, p_size AS lcl2, p_retailprice AS ucl2
        FROM part, range(61)
    """,
    "repartition_rows": "SELECT * FROM orders",
    "partition_sizes": """
        SELECT l_linenumber, count(*) AS n, true AS held FROM lineitem GROUP BY l_linenumber
    """,
    "in_subquery_sql": f"SELECT * FROM orders WHERE o_custkey IN ({_CUSTOMERS_OF_REGION})",
    "scalar_subquery_sql": """
        SELECT c_custkey, c_name FROM customer
        WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')
    """,
    "list_databases": """
        SELECT r_regionkey AS n_regionkey, nullif(count(n_nationkey), 0) AS "count"
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
    """,
    "rows_to_frame": """
        SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    """,
    "csv_scan_raw": """
        SELECT cast(c_custkey AS varchar) AS _c0, c_name AS _c1,
               cast(c_nationkey AS varchar) AS _c2, cast(c_acctbal AS varchar) AS _c3,
               c_mktsegment AS _c4
        FROM customer
    """,
    "csv_scan_header": """
        SELECT cast(o_orderkey AS varchar) AS o_orderkey, cast(o_custkey AS varchar) AS o_custkey,
               o_orderstatus, cast(o_totalprice AS varchar) AS o_totalprice,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS o_orderdate, o_orderpriority
        FROM orders
    """,
    "csv_scan_infer": "SELECT * FROM orders",
    "csv_scan_declared": "SELECT * FROM lineitem",
    "csv_sink_noheader": "SELECT * FROM part",
    "csv_lossless_texts": "SELECT * FROM documents",
    "csv_lossless_timestamps": "SELECT * FROM events",
    "json_scan": "SELECT * FROM documents",
    "json_scan_timestamps": "SELECT * FROM events",
    "json_scan_infer": "SELECT doc_id, lang FROM documents",
    "json_project_csv": "SELECT doc_id, lang FROM documents",
    "word_count_files": _WORDS,
    "county_union": """
        SELECT o_orderstatus || '_Wake_H' || o_orderkey AS id,
               'H' || o_orderkey AS "datasetId", 'Customer ' || o_custkey AS name,
               o_custkey || ' Main St, Side A' AS address1,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Unit ' || o_orderkey % 10 END AS address2,
               'City ' || o_custkey % 7 AS city, o_orderstatus AS state,
               cast(27000 + o_custkey % 1000 AS varchar) AS zip, '919-' || o_custkey AS tel,
               strftime(o_orderdate, '%Y-%m-%d') AS "dateStart", cast(NULL AS varchar) AS "dateEnd",
               o_orderpriority AS type, o_totalprice AS "geoX", -o_totalprice AS "geoY",
               'Wake' AS county
        FROM orders
        UNION ALL
        SELECT 'NC_Durham_' || event_id, cast(event_id AS varchar), 'User ' || user_id,
               user_id || ' Oak Ave', CASE WHEN event_id % 2 = 0 THEN 'Rear' END,
               'Town ' || user_id % 5, 'NC', '0' || (user_id % 90 + 1000), '(919) ' || user_id,
               strftime(ts, '%Y-%m-%d'),
               strftime(cast(ts AS date) + cast(event_id % 29 + 1 AS int), '%Y-%m-%d'),
               CASE WHEN event_type <> 'click' THEN event_type END,
               CASE WHEN event_type <> 'error' THEN value END,
               CASE WHEN event_type <> 'error' THEN cast(user_id AS double) END,
               'Durham'
        FROM events
    """,
    "typed_union": """
        SELECT cast(c_custkey AS varchar) AS key, cast(c_nationkey AS varchar) AS nation,
               c_mktsegment AS segment, cast(NULL AS varchar) AS label,
               cast(c_nationkey AS double) AS rank, cast(c_nationkey AS varchar) AS codes
        FROM customer
        UNION ALL
        SELECT 'S-' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN cast(s_nationkey AS varchar) END,
               NULL, CASE WHEN s_suppkey % 2 = 0 THEN s_name END, s_acctbal, NULL
        FROM supplier
        UNION ALL
        SELECT cast(p_partkey AS varchar), NULL, NULL, NULL, NULL, p_partkey || ',none' FROM part
    """,
    "malformed_rows": """
        WITH judged AS (
            SELECT *, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS bad,
                   CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END || o_orderkey
                       || ',' || o_orderstatus AS start
            FROM orders)
        SELECT 'good' AS kind, cast(o_orderkey AS varchar) AS row, o_totalprice,
               (SELECT count(*) FROM judged WHERE NOT bad) AS n
        FROM judged WHERE NOT bad
        UNION ALL
        SELECT 'bad',
               start || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ',' || o_totalprice END
                   || CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 THEN ',more' ELSE '' END,
               NULL, (SELECT count(*) FROM judged WHERE bad)
        FROM judged WHERE bad
    """,
    "record_texts": "SELECT * FROM documents",
    "record_timestamps": "SELECT * FROM events",
    "json_schema_aggregate": " UNION ALL ".join(
        f"SELECT '{name}' AS field, '{kind}' AS type, {_PRESENT.get(name, 'count(*)')} AS n FROM events"
        for name, kind in _FIELD_TREE
    ),
    "counts_while_writing": """
        WITH counted AS (
            SELECT count(*) AS a, count(*) FILTER (o_orderstatus = 'O') AS b,
                   count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS c
            FROM orders)
        SELECT 0 AS step, 'load' AS phase, a AS rows_in, a AS rows_out, 0::bigint AS dropped FROM counted
        UNION ALL SELECT 1, 'open', a, b, a - b FROM counted
        UNION ALL SELECT 2, 'urgent', b, c, b - c FROM counted
        UNION ALL SELECT 3, 'write', c, c, 0 FROM counted
    """,
    "files_of_equal_bytes": """
        SELECT 5::bigint AS files, count(*) AS rows, true AS within_a_row FROM documents
    """,
    "schema_as_json": " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{kind}' AS type, true AS nullable, count({name}) AS n FROM orders"
        for name, kind in zip(
            _ORDER_COLUMNS, ["long", "long", "string", "double", "timestamp_ntz", "string"]
        )
    ),
    "partitions_two_levels": """
        SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS state,
               o_orderpriority || '/=+% é' AS kind, count(*) AS n
        FROM orders GROUP BY ALL
    """,
    "partitions_pruned_by_subquery": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
        WHERE o_orderstatus = 'O' AND o_orderpriority IN (
            SELECT o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%')
    """,
    "bucketed_in_filter": f"SELECT * FROM orders WHERE o_custkey IN ({_CUSTOMERS_OF_REGION})",
    "bucket_details": """
        SELECT 'parquet' AS provider, 'MANAGED' AS kind, 4 AS buckets,
               'l_orderkey,l_linenumber' AS bucket_columns, 'l_orderkey' AS sort_columns,
               count(*) AS n, 4::bigint AS files
        FROM lineitem
    """,
    "metastore_sql": " UNION ALL ".join(
        f"SELECT {i} AS integer_idx, '{name}' AS column_name, '{kind}' AS type_name,"
        f" count({name}) AS n, {dict(o_custkey=1, o_orderkey=0).get(name, -1)} AS bucket_idx"
        " FROM orders"
        for i, (name, kind) in enumerate(_ORDER_COLUMNS.items())
    ),
    "external_text_table": "SELECT * FROM orders",
    "external_text_table_char": """
        SELECT cast(c_custkey AS int) AS num, rpad(c_name, 100, ' ') AS name,
               rpad(c_mktsegment, 100, ' ') AS segment
        FROM customer
    """,
    "managed_table_insert": """
        SELECT cast(s_suppkey AS int) AS emp_id, s_name AS name, 'Supplier' AS position,
               cast(s_acctbal AS float) AS salary
        FROM supplier
        UNION ALL
        SELECT * FROM (VALUES
            (-1, 'Ada Vale', 'Analyst', cast(75000 AS float)),
            (-2, 'Bo, Tern', 'Engineer', cast(95000 AS float)),
            (-3, 'Cy Wren', 'Editor', cast(85000 AS float)))
    """,
    "catalog_databases": "SELECT o_orderkey, o_orderstatus FROM orders",
    "catalog_tables": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in _GIVEN_TABLES
    ),
    "catalog_columns": " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS type, count({name}) AS n"
        " FROM orders"
        for i, (name, kind) in enumerate(_ORDER_COLUMNS.items())
    ),
    "catalog_storage": """
        SELECT 'o_orderstatus=' || o_orderstatus AS partition_spec, count(*) AS n
        FROM orders GROUP BY o_orderstatus
    """,
    "schema_as_rows": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{name}', '{kind}', true)" for i, (name, kind) in enumerate(_FIELD_TREE))
    + ") AS tree(position, field, type, nullable)",
}
