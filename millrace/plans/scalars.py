"""Queries over scalar functions: strings, times, numbers, arrays, maps and documents within columns.

Irrational results are compared as decimals of nine places.
"""

from __future__ import annotations

from .registry import sql

sql(
    "string_parts",
    """SELECT c_custkey, split_part(c_name, '#', 2) AS part, substring_index(c_name, '#', 1) AS head, substring_index(c_name, '0', -1) AS tail,
      array_join(regexp_extract_all(c_name, '[0-9][0-9][0-9]', 0), ',') AS threes, CAST(regexp_count(c_name, '0') AS BIGINT) AS zeros,
      CAST(regexp_instr(c_name, '[1-9]') AS BIGINT) AS first_digit, overlay(c_name PLACING 'XX' FROM 3 FOR 2) AS laid,
      contains(c_name, '7') AS seven, endswith(c_name, '1') AS one, ltrim(lpad(c_mktsegment, 12)) AS lt, rtrim(rpad(c_mktsegment, 12)) AS rt,
      CAST(locate('0', c_name, 12) AS BIGINT) AS at, CAST(char_length(c_mktsegment) AS BIGINT) AS n, CAST(octet_length(c_mktsegment) AS BIGINT) AS bytes,
      CAST(find_in_set(c_mktsegment, 'BUILDING,FURNITURE') AS BIGINT) AS place
    FROM {customer}""",
    """SELECT c_custkey, split_part(c_name, '#', 2) AS part, split_part(c_name, '#', 1) AS head, list_last(string_split(c_name, '0')) AS tail,
      array_to_string(regexp_extract_all(c_name, '[0-9]{3}'), ',') AS threes, len(regexp_extract_all(c_name, '0')) AS zeros,
      length(regexp_extract(c_name, '^[^1-9]*')) % length(c_name) + CASE WHEN c_name SIMILAR TO '[^1-9]*' THEN 0 ELSE 1 END AS first_digit,
      substr(c_name, 1, 2) || 'XX' || substr(c_name, 5) AS laid,
      contains(c_name, '7') AS seven, ends_with(c_name, '1') AS one, c_mktsegment AS lt, c_mktsegment AS rt,
      CASE WHEN strpos(substr(c_name, 12), '0') > 0 THEN strpos(substr(c_name, 12), '0') + 11 ELSE 0 END AS at, length(c_mktsegment) AS n, strlen(c_mktsegment) AS bytes,
      CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 0 END AS BIGINT) AS place
    FROM customer""",
)
sql(
    "string_forms",
    """SELECT c_custkey, sha2(c_name, 256) AS sha, base64(CAST(c_name AS BINARY)) AS b64, CAST(unbase64(base64(CAST(c_name AS BINARY))) AS STRING) AS back,
      url_encode(c_name) AS enc, url_decode(url_encode(c_name)) AS dec, parse_url(concat('https://x.org/p/', c_custkey, '?q=', c_nationkey), 'QUERY', 'q') AS q,
      parse_url(concat('https://x.org/p/', c_custkey), 'PATH') AS path, format_string('%05d-%s', c_custkey, c_mktsegment) AS fmt, mask(c_name) AS masked,
      initcap(lower(c_mktsegment)) AS cap, c_name ILIKE 'CUSTOMER%1' AS il, soundex(c_mktsegment) AS sound,
      (lower(c_mktsegment) COLLATE UTF8_LCASE) = c_mktsegment AS same, chr(65 + c_nationkey % 26) AS letter, hex(c_custkey) AS hx,
      elt(1 + c_nationkey % 3, 'a', 'b', 'c') AS el, space(2) || c_mktsegment AS sp, format_number(c_custkey, 0) AS grouped
    FROM {customer}""",
    r"""SELECT c_custkey, sha256(c_name) AS sha, to_base64(encode(c_name)) AS b64, c_name AS back,
      url_encode(c_name) AS enc, c_name AS dec, CAST(c_nationkey AS VARCHAR) AS q,
      '/p/' || c_custkey AS path, printf('%05d-%s', c_custkey, c_mktsegment) AS fmt,
      regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS masked,
      c_mktsegment[1] || lower(c_mktsegment[2:]) AS cap, c_name ILIKE 'CUSTOMER%1' AS il,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'MACHINERY' THEN 'M256' END AS sound,
      true AS same, chr(65 + c_nationkey % 26) AS letter, to_hex(c_custkey) AS hx,
      (['a', 'b', 'c'])[1 + c_nationkey % 3] AS el, '  ' || c_mktsegment AS sp, format('{:,}', c_custkey) AS grouped
    FROM customer""",
)
sql(
    "time_parts",
    """SELECT o_orderkey, CAST(months_between(o_orderdate, DATE'2000-01-15') AS DECIMAL(18,4)) AS months, next_day(CAST(o_orderdate AS DATE), 'MO') AS monday,
      CAST(weekday(o_orderdate) AS BIGINT) AS wd, trunc(CAST(o_orderdate AS DATE), 'YEAR') AS year_start, date_sub(CAST(o_orderdate AS DATE), 10) AS before,
      CAST(extract(WEEK FROM o_orderdate) AS BIGINT) AS wk, o_orderdate + make_interval(0, 1, 0, 2) AS later,
      make_timestamp_ntz(year(o_orderdate), 3, 4, 5, 6, 7.5) AS made, date_from_unix_date(CAST(o_orderkey AS INT)) AS from_days, CAST(unix_date(CAST(o_orderdate AS DATE)) AS BIGINT) AS days
    FROM {orders}""",
    """SELECT o_orderkey, CAST(12 * (year(o_orderdate) - 2000) + month(o_orderdate) - 1 +
        CASE WHEN day(o_orderdate) = 15 THEN 0 ELSE (day(o_orderdate) - 15 + (epoch(o_orderdate) % 86400) / 86400.0) / 31 END AS DECIMAL(18,4)) AS months,
      CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INT) AS monday, isodow(o_orderdate) - 1 AS wd,
      CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start, CAST(o_orderdate AS DATE) - 10 AS before, weekofyear(o_orderdate) AS wk,
      o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS later, make_timestamp(year(o_orderdate), 3, 4, 5, 6, 7.5) AS made,
      DATE '1970-01-01' + CAST(o_orderkey AS INT) AS from_days, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days
    FROM orders""",
)
sql(
    "time_conversions",
    """SELECT event_id, CAST(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ) AS parsed,
      try_to_timestamp(event_type, 'yyyy') IS NULL AS bad, from_unixtime(event_id * 1000, 'yyyy-MM-dd HH:mm:ss') AS unix,
      convert_timezone('UTC', 'Asia/Tokyo', ts) AS tokyo, timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) AS hours,
      timestampadd(MINUTE, 90, ts) AS later, unix_timestamp(CAST(ts AS TIMESTAMP)) AS epoch, to_date(date_format(ts, 'yyyy/MM/dd'), 'yyyy/MM/dd') AS day,
      CAST(date_trunc('WEEK', ts) AS TIMESTAMP_NTZ) AS week, date_part('MINUTE', ts) AS mi, CAST(try_to_date('x') IS NULL AS BOOLEAN) AS none
    FROM {events}""",
    """SELECT event_id, date_trunc('second', ts) AS parsed, true AS bad, strftime(make_timestamp(event_id * 1000 * 1000000), '%Y-%m-%d %H:%M:%S') AS unix,
      ts + INTERVAL 9 HOUR AS tokyo, datesub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS hours, ts + INTERVAL 90 MINUTE AS later,
      CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, CAST(minute(ts) AS INT) AS mi, true AS none
    FROM events""",
)
sql(
    "logarithms_and_angles",
    """SELECT c_custkey, CAST(exp(x) AS DECIMAL(20,9)) AS e, CAST(ln(x + 1) AS DECIMAL(20,9)) AS l, CAST(log10(x + 1) AS DECIMAL(20,9)) AS l10, CAST(log2(x + 1) AS DECIMAL(20,9)) AS l2,
      CAST(power(x, 1.5) AS DECIMAL(20,9)) AS p, CAST(sin(x) AS DECIMAL(20,9)) AS s, CAST(cos(x) AS DECIMAL(20,9)) AS c, CAST(tan(x / 4) AS DECIMAL(20,9)) AS t,
      CAST(atan2(x, 2) AS DECIMAL(20,9)) AS at, CAST(degrees(x) AS DECIMAL(20,9)) AS d, CAST(radians(x) AS DECIMAL(20,9)) AS r, CAST(cbrt(x) AS DECIMAL(20,9)) AS cb,
      CAST(hypot(x, 1) AS DECIMAL(20,9)) AS h, CAST(asin(x / 6) AS DECIMAL(20,9)) AS asn, CAST(sinh(x) AS DECIMAL(20,9)) AS sh, CAST(pi() AS DECIMAL(20,9)) AS pi
    FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) / 5 AS x FROM {customer})""",
    """SELECT c_custkey, CAST(exp(x) AS DECIMAL(20,9)) AS e, CAST(ln(x + 1) AS DECIMAL(20,9)) AS l, CAST(log10(x + 1) AS DECIMAL(20,9)) AS l10, CAST(log2(x + 1) AS DECIMAL(20,9)) AS l2,
      CAST(power(x, 1.5) AS DECIMAL(20,9)) AS p, CAST(sin(x) AS DECIMAL(20,9)) AS s, CAST(cos(x) AS DECIMAL(20,9)) AS c, CAST(tan(x / 4) AS DECIMAL(20,9)) AS t,
      CAST(atan2(x, 2) AS DECIMAL(20,9)) AS at, CAST(degrees(x) AS DECIMAL(20,9)) AS d, CAST(radians(x) AS DECIMAL(20,9)) AS r, CAST(cbrt(x) AS DECIMAL(20,9)) AS cb,
      CAST(sqrt(x * x + 1) AS DECIMAL(20,9)) AS h, CAST(asin(x / 6) AS DECIMAL(20,9)) AS asn, CAST(sinh(x) AS DECIMAL(20,9)) AS sh, CAST(pi() AS DECIMAL(20,9)) AS pi
    FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) / 5 AS x FROM customer)""",
)
sql(
    "whole_numbers",
    """SELECT c_custkey, CAST(width_bucket(c_acctbal, 0, 10000, 5) AS BIGINT) AS bucket, CAST(bit_count(c_custkey) AS BIGINT) AS bits, conv(CAST(c_custkey AS STRING), 10, 16) AS hx,
      conv(CAST(c_custkey AS STRING), 10, 2) AS bin, factorial(c_nationkey % 13) AS f, CAST(bround(CAST(c_custkey AS DECIMAL(18,1)) / 2, 0) AS BIGINT) AS even,
      nanvl(CAST('NaN' AS DOUBLE), c_acctbal) AS nv, pmod(-c_custkey, 7) AS pm, shiftleft(CAST(1 AS BIGINT), c_nationkey % 8) AS sl, shiftright(c_custkey, 2) AS sr,
      CAST(c_custkey & 12 AS BIGINT) AS andd, CAST(c_custkey | 3 AS BIGINT) AS orr, CAST(c_custkey ^ 5 AS BIGINT) AS xorr, c_custkey DIV 7 AS dv,
      isnan(c_acctbal) AS nan, CAST(rint(c_acctbal) AS BIGINT) AS ri, try_multiply(c_custkey, 9223372036854775807) IS NULL AS over, CAST(bit_get(c_custkey, 1) AS INT) AS second_bit
    FROM {customer}""",
    """SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 6 ELSE floor(c_acctbal / 2000) + 1 END AS BIGINT) AS bucket,
      CAST(bit_count(c_custkey) AS BIGINT) AS bits, to_hex(c_custkey) AS hx, to_binary(c_custkey) AS bin, CAST(factorial(c_nationkey % 13) AS BIGINT) AS f,
      CAST(round_even(CAST(c_custkey AS DECIMAL(18,1)) / 2, 0) AS BIGINT) AS even, c_acctbal AS nv, ((-c_custkey % 7) + 7) % 7 AS pm,
      CAST(1 AS BIGINT) << (c_nationkey % 8) AS sl, c_custkey >> 2 AS sr, c_custkey & 12 AS andd, c_custkey | 3 AS orr, xor(c_custkey, 5) AS xorr, c_custkey // 7 AS dv,
      isnan(c_acctbal) AS nan, CAST(round_even(c_acctbal, 0) AS BIGINT) AS ri, c_custkey > 1 AS over, CAST((c_custkey >> 1) & 1 AS INT) AS second_bit
    FROM customer""",
)
sql(
    "array_forms",
    """SELECT n_nationkey, array_join(array_distinct(array(k, 2, k, 3)), ',') AS d, array_join(array_repeat(k, 3), ',') AS rp, try_element_at(a, 4) IS NULL AS none, try_element_at(a, -1) AS last,
      get(a, 0) AS first, array_join(sequence(k, k + 4, 2), ',') AS sq, array_join(array_remove(array(1, k, 1), 1), ',') AS rm, CAST(size(array_compact(array(k, NULL, 2))) AS BIGINT) AS cp,
      array_join(sort_array(a, false), ',') AS down, array_join(array_append(a, 9), ',') AS ap, array_join(array_prepend(a, 0), ',') AS pp, array_join(array_insert(a, 2, 7), ',') AS ins,
      array_join(transform(arrays_zip(a, sequence(1, 3)), x -> x['a'] * x['1']), ',') AS zp, array_join(reverse(a), ',') AS rv,
      array_join(zip_with(a, array(1, 1, 1), (x, y) -> x + y), ',') AS zw, CAST(cardinality(a) AS BIGINT) AS n
    FROM (SELECT n_nationkey, CAST(n_nationkey % 7 + 4 AS INT) AS k, array(CAST(n_nationkey % 7 + 4 AS INT), 2, 3) AS a FROM {nation})""",
    """SELECT n_nationkey, k || ',2,3' AS d, concat_ws(',', k, k, k) AS rp, true AS none, 3 AS last, k AS first, array_to_string(range(k, k + 5, 2), ',') AS sq, CAST(k AS VARCHAR) AS rm,
      CAST(2 AS BIGINT) AS cp, array_to_string(list_reverse_sort([k, 2, 3]), ',') AS down, k || ',2,3,9' AS ap, '0,' || k || ',2,3' AS pp, k || ',7,2,3' AS ins,
      k || ',4,9' AS zp, '3,2,' || k AS rv, (k + 1) || ',3,4' AS zw, CAST(3 AS BIGINT) AS n
    FROM (SELECT n_nationkey, CAST(n_nationkey % 7 + 4 AS INT) AS k FROM nation)""",
)
sql(
    "generators",
    """SELECT 'inline' AS how, n_nationkey AS k, CAST(x AS BIGINT) AS a, y AS b FROM {nation} LATERAL VIEW inline(array(struct(1 AS x, n_name AS y), struct(2 AS x, 'z' AS y))) t
      UNION ALL SELECT 'outer', n_nationkey, CAST(v AS BIGINT), NULL FROM {nation} LATERAL VIEW OUTER explode(filter(array(1, 2), z -> n_nationkey % 2 = 0)) t AS v
      UNION ALL SELECT 'pos', n_nationkey, CAST(p AS BIGINT), w FROM {nation} LATERAL VIEW posexplode(split(n_name, '_')) t AS p, w
      UNION ALL SELECT 'stack', n_nationkey, CAST(p AS BIGINT), w FROM {nation} LATERAL VIEW stack(2, 1, 'one', 2, 'two') t AS p, w""",
    """SELECT 'inline' AS how, n_nationkey AS k, CAST(x AS BIGINT) AS a, CASE x WHEN 1 THEN n_name ELSE 'z' END AS b FROM nation, (SELECT unnest([1, 2]) AS x)
      UNION ALL SELECT 'outer', n_nationkey, CAST(x AS BIGINT), NULL FROM nation, (SELECT unnest([1, 2]) AS x) WHERE n_nationkey % 2 = 0
      UNION ALL SELECT 'outer', n_nationkey, NULL, NULL FROM nation WHERE n_nationkey % 2 = 1
      UNION ALL SELECT 'pos', n_nationkey, CAST(x AS BIGINT), split_part(n_name, '_', CAST(x AS INT) + 1) FROM nation, (SELECT unnest([0, 1]) AS x)
      UNION ALL SELECT 'stack', n_nationkey, CAST(x AS BIGINT), CASE x WHEN 1 THEN 'one' ELSE 'two' END FROM nation, (SELECT unnest([1, 2]) AS x)""",
)
sql(
    "map_forms",
    """SELECT c_custkey, map_from_arrays(array('n', 's'), array(CAST(c_nationkey AS STRING), c_mktsegment))['s'] AS s,
      map_from_entries(array(struct(c_mktsegment, c_custkey)))[c_mktsegment] AS k,
      array_join(transform(array_sort(map_entries(m)), e -> concat(e.key, '=', e.value)), ';') AS entries,
      array_join(transform(array_sort(map_entries(map_zip_with(m, map('a', c_nationkey), (k, x, y) -> coalesce(x, 0) + coalesce(y, 0)))), e -> concat(e.key, '=', e.value)), ';') AS zipped,
      array_join(array_sort(map_keys(transform_keys(m, (k, v) -> concat(k, v)))), ';') AS renamed,
      array_join(array_sort(map_values(transform_values(m, (k, v) -> v * 2))), ';') AS doubled,
      array_join(array_sort(map_keys(map_filter(m, (k, v) -> v > 5))), ';') AS large, map_contains_key(m, 'b') AS has, CAST(size(map_concat(m, map('z', 1))) AS BIGINT) AS n
    FROM (SELECT *, map('a', CAST(c_nationkey % 10 AS INT), 'b', 5) AS m FROM {customer})""",
    """SELECT c_custkey, c_mktsegment AS s, c_custkey AS k, 'a=' || v || ';b=5' AS entries, 'a=' || (v + c_nationkey) || ';b=5' AS zipped, 'a' || v || ';b5' AS renamed,
      CASE WHEN v * 2 < 10 THEN (v * 2) || ';10' ELSE '10;' || (v * 2) END AS doubled, CASE WHEN v > 5 THEN 'a' ELSE '' END AS large, true AS has, CAST(3 AS BIGINT) AS n
    FROM (SELECT *, CAST(c_nationkey % 10 AS INT) AS v FROM customer)""",
)
sql(
    "documents_in_columns",
    """SELECT e.event_id, j.k AS k, j.missing AS missing, schema_of_json('{{"k": 1, "s": "x"}}') AS shape, array_join(json_object_keys(props), ',') AS keys,
      to_csv(named_struct('a', user_id, 'b', event_type)) AS csv, from_xml(concat('<r><a>', user_id, '</a></r>'), 'a BIGINT').a AS xml,
      xpath_string(concat('<r><t>', event_type, '</t></r>'), 'r/t') AS xp, CAST(xpath_int(concat('<r><t>', user_id, '</t></r>'), 'r/t') AS BIGINT) AS xi,
      try_variant_get(parse_json(props), '$.none', 'bigint') IS NULL AS nb, is_variant_null(parse_json('null')) AS vn, schema_of_variant(parse_json(props)) AS vs,
      to_json(map(event_type, user_id)) AS mj, get_json_object(to_json(array(user_id, 2)), '$[1]') AS second
    FROM {events} e LATERAL VIEW json_tuple(props, 'k', 'none') j AS k, missing""",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing, 'STRUCT<k: BIGINT, s: STRING>' AS shape, array_to_string(json_keys(props), ',') AS keys,
      user_id || ',' || event_type AS csv, user_id AS xml, event_type AS xp, user_id AS xi, true AS nb, true AS vn, 'OBJECT<k: BIGINT>' AS vs,
      '{"' || event_type || '":' || user_id || '}' AS mj, '2' AS second
    FROM events""",
)
sql(
    "moments_apart",
    """SELECT o_orderkey, timestampadd(HOUR, 30, o_orderdate) AS later, timestampadd(MONTH, -1, o_orderdate) AS before,
      timestampdiff(DAY, o_orderdate, l_shipdate) AS days, timestampdiff(WEEK, l_shipdate, o_orderdate) AS weeks,
      timestampdiff(HOUR, o_orderdate, timestampadd(MINUTE, 45, l_shipdate)) AS hours
    FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_linenumber = 1""",
    """SELECT o_orderkey, o_orderdate + INTERVAL 30 HOUR AS later, o_orderdate - INTERVAL 1 MONTH AS before, date_sub('day', o_orderdate, l_shipdate) AS days,
      CAST(trunc(date_sub('day', l_shipdate, o_orderdate) / 7) AS BIGINT) AS weeks, date_sub('hour', o_orderdate, l_shipdate + INTERVAL 45 MINUTE) AS hours
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1""",
)
sql(
    "window_times",
    """SELECT CAST(window_time(w) AS TIMESTAMP_NTZ) AS closes, n FROM (
      SELECT window(CAST(ts AS TIMESTAMP), '6 hours') AS w, count(*) AS n FROM {events} GROUP BY 1)""",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND AS closes, count(*) AS n FROM events GROUP BY 1",
)
sql(
    "xml_paths",
    """SELECT c_custkey, xpath_string(x, 'c/s') AS segment, xpath_long(x, 'c/n/@k') AS nation, xpath_boolean(x, 'c/n[@k > 10]') AS high,
      array_join(xpath(x, 'c/*/text()'), '|') AS texts, xpath_double(x, 'sum(c/n/@k)') AS total
    FROM (SELECT c_custkey, concat('<c><s>', c_mktsegment, '</s><n k="', c_nationkey, '">', c_name, '</n></c>') AS x FROM {customer})""",
    """SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, c_nationkey > 10 AS high, c_mktsegment || '|' || c_name AS texts,
      CAST(c_nationkey AS DOUBLE) AS total FROM customer""",
)
