"""Word lists that decide whether a name followed by a parenthesis is a routine call."""

# These lists must stay exactly as they are for the classes to be right.
KEYWORDS_BEFORE_PAREN = frozenset("""
    as in exists all any some values over filter within from where and or not on using
    when then case by having group order select union intersect except join into
    distinct between like ilike similar is null returning do else end limit offset
    fetch with recursive left right full inner outer cross lateral natural asc desc
    nulls first last for of only tablesample window partition range rows groups
    unbounded preceding following current row grouping cube rollup sets array set to if
    numeric decimal dec char character varchar varbit bit time timestamp timestamptz
    interval float double real int integer bigint smallint money bool boolean text
    bytea uuid json jsonb xml
""".split())

# Routines of the database itself, which have no side effects to replay.
BUILTIN_ROUTINES = frozenset("""
    count sum avg min max array_agg string_agg bool_and bool_or every json_agg
    jsonb_agg json_object_agg jsonb_object_agg xmlagg
    row_number rank dense_rank percent_rank cume_dist ntile lead lag first_value
    last_value nth_value
    now current_timestamp current_date current_time clock_timestamp
    statement_timestamp transaction_timestamp age date_part date_trunc extract
    make_date make_interval make_time make_timestamp
    coalesce nullif greatest least
    cast to_char to_date to_number to_timestamp
    generate_series unnest array_length array_upper array_lower array_cat
    array_append array_remove
    length upper lower trim ltrim rtrim substring replace concat concat_ws format left
    right repeat reverse split_part
    abs ceil floor round trunc mod power sqrt random sign
    json_build_object jsonb_build_object json_build_array jsonb_build_array
    row_to_json to_json to_jsonb
    pg_typeof version current_database current_schema current_user session_user
    txid_current
""".split())

# Weight of each class when one text holds several statements.
CLASS_PRIORITY = {
    "unknown": 0, "plain_select": 1, "utility": 2, "proc_select": 3, "copy_from": 4,
    "dml": 5, "call": 5, "ddl": 6, "begin": 7, "commit_rollback": 8,
}
