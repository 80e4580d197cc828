"""Registered queries over the driver's tables: programs, their tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docql import io_queries
from docql.engine import compile_program, structures
from docql.language_queries import DOCUMENT, LANGUAGE, OVER_DOCUMENTS
from docql.sources.tables import read_table


@dataclass(frozen=True)
class Query:
    table: str
    program: str
    sql: str | None
    datasets: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    variables: dict = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: read_table(spark, sf_dir, t) for t in self.datasets}
        return compile_program(self.program).dataset(read_table(spark, sf_dir, self.table), datasets=tables, variables=self.variables, order=self.order)


QUERIES: dict[str, Query | Callable] = {
    "select_project_arith": Query(
        "lineitem",
        ".[] | select(.l_quantity > 45 and .l_discount < 0.03) | {l_orderkey, l_linenumber, net: ((.l_extendedprice * 100 * (1 - .l_discount) | round) / 100), odd: (.l_orderkey % 2)}",
        "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 100 * (1 - l_discount) + 0.5) / 100 AS net, l_orderkey % 2 AS odd FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03",
    ),
    "group_aggregate": Query(
        "lineitem",
        "[.[] | select(.l_quantity > 45)] | group_by(.l_returnflag) | map({flag: .[0].l_returnflag, n: length, total: ((map(.l_extendedprice) | add) * 100 | round / 100), least: (map(.l_discount) | min), most: (map(.l_discount) | max)})",
        "SELECT l_returnflag AS flag, count(*) AS n, floor(sum(l_extendedprice) * 100 + 0.5) / 100 AS total, min(l_discount) AS least, max(l_discount) AS most FROM lineitem WHERE l_quantity > 45 GROUP BY 1",
    ),
    "group_by_two_keys": Query(
        "orders",
        "group_by([.o_orderstatus, .o_orderpriority]) | map({status: .[0].o_orderstatus, priority: .[0].o_orderpriority, orders: length, customers: (map(.o_custkey) | unique | length), mean: (((map(.o_totalprice) | add) / length) * 100 | round / 100)})",
        "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS orders, count(DISTINCT o_custkey) AS customers, floor(sum(o_totalprice) / count(*) * 100 + 0.5) / 100 AS mean FROM orders GROUP BY 1, 2",
    ),
    "group_having": Query(
        "orders",
        "group_by(.o_custkey) | map({custkey: .[0].o_custkey, n: length} | select(.n > 12))",
        "SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12",
    ),
    "group_conditional_sum": Query(
        "lineitem",
        "group_by(.l_linestatus) | map({status: .[0].l_linestatus, big: (map(select(.l_quantity >= 40)) | length), small: (map(select(.l_quantity < 10) | .l_linenumber) | add)})",
        "SELECT l_linestatus AS status, count(*) FILTER (l_quantity >= 40) AS big, CAST(sum(l_linenumber) FILTER (l_quantity < 10) AS BIGINT) AS small FROM lineitem GROUP BY 1",
    ),
    "whole_table_aggregate": Query(
        "customer",
        "{n: length, best: (map(.c_acctbal) | max), worst: (map(.c_acctbal) | min), owing: (map(select(.c_acctbal < 0)) | length), every: (map(.c_custkey > 0) | all), some: (map(.c_acctbal > 9990) | any)}",
        "SELECT count(*) AS n, max(c_acctbal) AS best, min(c_acctbal) AS worst, count(*) FILTER (c_acctbal < 0) AS owing, bool_and(c_custkey > 0) AS every, bool_or(c_acctbal > 9990) AS some FROM customer",
    ),
    "sort_top": Query(
        "orders",
        "sort_by(-.o_totalprice, .o_orderkey) | .[:10] | map({o_orderkey, o_totalprice})",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "sort_offset": Query(
        "part",
        "sort_by(.p_retailprice, .p_partkey) | .[20:35] | map(.p_name)",
        "SELECT p_name AS value FROM part ORDER BY p_retailprice, p_partkey LIMIT 15 OFFSET 20",
    ),
    "sort_last": Query(
        "part",
        "sort_by(.p_partkey) | .[-5:] | map({p_partkey})",
        "SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 5",
    ),
    "limit_skip": Query(
        "orders",
        "[limit(7; skip(3; sort_by(.o_orderkey)[])) | {o_orderkey}]",
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3",
    ),
    "group_max_by": Query(
        "orders",
        "group_by(.o_orderpriority) | map({p: .[0].o_orderpriority, dearest: (max_by(.o_totalprice) | .o_orderkey), cheapest: min_by(.o_totalprice).o_orderkey})",
        "SELECT o_orderpriority AS p, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY 1",
    ),
    "max_by_row": Query(
        "supplier",
        "max_by(.s_acctbal) | {s_suppkey, s_acctbal}",
        "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1",
    ),
    "unique_values": Query("customer", "map(.c_mktsegment) | unique", "SELECT DISTINCT c_mktsegment AS value FROM customer"),
    "unique_by_first": Query(
        "customer",
        "unique_by(.c_nationkey) | map({c_nationkey, c_custkey})",
        "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1",
        order=("c_custkey",),
    ),
    "union_all": Query(
        "customer",
        "map({key: .c_nationkey}) + ($supplier | map({key: .s_nationkey}))",
        "SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier",
        ("supplier",),
    ),
    "union_distinct": Query(
        "customer",
        "map({key: .c_nationkey}) + ($supplier | map({key: .s_nationkey})) | unique",
        "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier",
        ("supplier",),
    ),
    "difference": Query(
        "customer",
        "map({key: .c_custkey}) - ($orders | map({key: .o_custkey}))",
        "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
        ("orders",),
    ),
    "index_join": Query(
        "nation",
        "INDEX($region[]; .r_regionkey) as $r | .[] | {n_name, region: $r[.n_regionkey | tostring].r_name}",
        "SELECT n_name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
        ("region",),
    ),
    "join_pairs": Query(
        "customer",
        "INDEX($nation[]; .n_nationkey) as $i | JOIN($i; .c_nationkey | tostring) | map({c: .[0].c_name, n: .[1].n_name})",
        "SELECT c_name AS c, n_name AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
        ("nation",),
    ),
    "semi_join": Query(
        "customer",
        "map(select(.c_custkey | IN($orders[] | select(.o_totalprice > 300000) | .o_custkey)) | {c_custkey, c_name})",
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
        ("orders",),
    ),
    "anti_join": Query(
        "customer",
        "map(select(.c_custkey | IN($orders[] | .o_custkey) | not) | {c_custkey})",
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
        ("orders",),
    ),
    "generator_join": Query(
        "customer",
        "$orders[] as $o | .[] as $c | $nation[] as $n | select($o.o_custkey == $c.c_custkey and $c.c_nationkey == $n.n_nationkey and $o.o_totalprice > 250000) | {order: $o.o_orderkey, customer: $c.c_name, nation: $n.n_name}",
        "SELECT o_orderkey AS order, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 250000".replace("AS order", 'AS "order"'),
        ("orders", "nation"),
    ),
    "join_then_group": Query(
        "lineitem",
        "[.[] as $l | $orders[] as $o | select($l.l_orderkey == $o.o_orderkey) | {status: $o.o_orderstatus, q: $l.l_quantity}] | group_by(.status) | map({status: .[0].status, quantity: (map(.q) | add), lines: length})",
        "SELECT o_orderstatus AS status, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        ("orders",),
    ),
    "theta_join": Query(
        "nation",
        ".[] as $a | $nation[] as $b | select($a.n_regionkey == $b.n_regionkey and $a.n_nationkey < $b.n_nationkey) | {a: $a.n_name, b: $b.n_name}",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        ("nation",),
    ),
    "cross_join": Query(
        "region",
        ".[] as $r | $nation[] as $n | {r: $r.r_name, n: $n.n_name}",
        "SELECT r_name AS r, n_name AS n FROM region, nation",
        ("nation",),
    ),
    "running_sum": Query(
        "events",
        "[foreach .[] as $e (0; . + $e.user_id; {event_id: $e.event_id, total: .})]",
        "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS total FROM events",
        order=("event_id",),
    ),
    "running_max": Query(
        "events",
        "[foreach .[] as $e (null; [., $e.user_id] | max; {event_id: $e.event_id, most: .})]",
        "SELECT event_id, max(user_id) OVER (ORDER BY event_id) AS most FROM events",
        order=("event_id",),
    ),
    "intersection": Query(
        "customer",
        "map({key: .c_nationkey}) | unique | . - (. - ($supplier | map({key: .s_nationkey})))",
        "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier",
        ("supplier",),
    ),
    "row_number_lag_lead": Query(
        "events",
        "[range(length) as $i | {i: $i, event_id: .[$i].event_id, before: .[$i - 1].user_id, after: .[$i + 1].user_id}]",
        "SELECT row_number() OVER w - 1 AS i, event_id, coalesce(lag(user_id) OVER w, last_value(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before, lead(user_id) OVER w AS after FROM events WINDOW w AS (ORDER BY event_id)",
        order=("event_id",),
    ),
    "regex_captures": Query(
        "part",
        ".[] | {p_partkey, m: (.p_type | match(\"[AEIOU]\") | .offset), c: (.p_brand | capture(\"Brand#(.)\"))}",
        """SELECT '{"p_partkey":' || p_partkey || ',"m":' || (length(regexp_extract(p_type, '^[^AEIOU]*')))::VARCHAR || ',"c":{"1":"' || substr(p_brand, 7, 1) || '"}}' AS value FROM part""",
    ),
    "walk_and_stream": Query(
        "nation",
        ".[] | [tostream | select(length == 2 and (.[1] | type) == \"number\") | .[1]] | add",
        "SELECT CAST(n_nationkey + n_regionkey AS VARCHAR) AS value FROM nation",
    ),
    "histogram": Query(
        "events",
        "reduce .[] as $e ({}; .[$e.event_type] += 1)".replace("({};", "(null;"),
        "SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1",
    ),
    "reduce_sum": Query("lineitem", "reduce .[] as $l (0; . + $l.l_linenumber)", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem"),
    "strings": Query(
        "part",
        """.[] | {p_partkey, up: (.p_name | ascii_upcase), words: (.p_name | split(" ") | length), joined: (.p_name | split(" ") | join("-")), green: (.p_name | test("gr[ae]y|green")), head: .p_name[:3], size: (.p_name | length), starts: (.p_brand | startswith("Brand#1")), cut: (.p_brand | ltrimstr("Brand#")), swapped: (.p_type | gsub("[AEIOU]"; "*")), at: (.p_type | index("E")), said: "\\(.p_partkey): \\(.p_brand)"}""",
        """SELECT p_partkey, upper(p_name) AS up, len(string_split(p_name, ' ')) AS words, replace(p_name, ' ', '-') AS joined, regexp_matches(p_name, 'gr[ae]y|green') AS green, left(p_name, 3) AS head, length(p_name) AS size, starts_with(p_brand, 'Brand#1') AS starts,
           CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS cut, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS swapped, CASE WHEN instr(p_type, 'E') > 0 THEN instr(p_type, 'E') - 1 END AS at, p_partkey || ': ' || p_brand AS said FROM part""",
    ),
    "formats": Query(
        "customer",
        ".[] | {c_custkey, csv: ([.c_name, .c_mktsegment] | @csv), tsv: ([.c_name, .c_mktsegment] | @tsv), b: (.c_name | @base64), h: (\"<\" + .c_mktsegment + \"&\" | @html), j: (.c_name | @json), s: (.c_nationkey | tostring)}",
        """SELECT c_custkey, '"' || c_name || '","' || c_mktsegment || '"' AS csv, c_name || chr(9) || c_mktsegment AS tsv, base64(encode(c_name)) AS b, '&lt;' || c_mktsegment || '&amp;' AS h, '"' || c_name || '"' AS j, CAST(c_nationkey AS VARCHAR) AS s FROM customer""",
    ),
    "dates": Query(
        "orders",
        """.[] | {o_orderkey, iso: (.o_orderdate | todate), month: (.o_orderdate | strftime("%Y-%m")), year: (.o_orderdate | gmtime | .[0] | floor), later: (.o_orderdate | dateadd("months"; 1)), back: (.o_orderdate | todate | fromdate), weekday: (.o_orderdate | gmtime | .[6] | floor)}""",
        """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) AS year, CAST(epoch(o_orderdate + INTERVAL 1 MONTH) AS BIGINT) AS later, CAST(epoch(o_orderdate) AS BIGINT) AS back, dayofweek(o_orderdate) AS weekday FROM orders""",
    ),
    "math": Query(
        "part",
        ".[] | {p_partkey, f: (.p_retailprice | floor), c: (.p_retailprice | ceil), r: (.p_retailprice | round), root: (.p_size | sqrt * 1000 | floor), p: (pow(.p_size; 2) | floor), l: (.p_retailprice | log10 * 1000 | floor), m: (-7 % 3), neg: -.p_size, big: ([.p_size, 25] | max)}",
        "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS r, CAST(floor(sqrt(p_size) * 1000) AS BIGINT) AS root, CAST(pow(p_size, 2) AS BIGINT) AS p, CAST(floor(log10(p_retailprice) * 1000) AS BIGINT) AS l, -1 AS m, -p_size AS neg, greatest(p_size, 25) AS big FROM part",
    ),
    "control": Query(
        "customer",
        """.[] | {c_custkey, band: (if .c_acctbal < 0 then "owes" elif .c_acctbal < 5000 then "some" else "rich" end), or_else: (.missing // .c_mktsegment), num: ((.c_name | tonumber?) // -1), both: (.c_acctbal > 0 and .c_nationkey < 10), opposite: (.c_acctbal > 0 | not)}""".replace('((.c_name | tonumber?) // -1)', '(try (.c_name | tonumber) catch -1)'),
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS band, c_mktsegment AS or_else, CAST(-1 AS DOUBLE) AS num, c_acctbal > 0 AND c_nationkey < 10 AS both, NOT c_acctbal > 0 AS opposite FROM customer",
    ),
    "updates": Query(
        "orders",
        """.[] | .o_totalprice |= floor | .o_custkey += 1 | .o_orderstatus = "X" | .extra = .o_orderkey * 2 | del(.o_orderdate, .o_orderpriority)""",
        "SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'X' AS o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice, o_orderkey * 2 AS extra FROM orders",
    ),
    "arrays": Query(
        "embeddings",
        ".[] | {vec_id, n: (.embedding | length), positive: ([.embedding[] | select(. > 0)] | length), first: (.embedding[0] * 1000 | floor), last: (.embedding[-1] * 1000 | floor), most: (.embedding | max * 1000 | floor), scaled: (.embedding | map(. * 100 | floor) | add), any: (.embedding | any(. > 0.4)), part: (.embedding[2:5] | map(. * 10 | floor)), order: (.embedding | map(. * 10 | floor) | unique)}",
        """SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS positive, CAST(floor(embedding[1]::DOUBLE * 1000) AS BIGINT) AS first, CAST(floor(embedding[-1]::DOUBLE * 1000) AS BIGINT) AS last, CAST(floor(list_max(embedding)::DOUBLE * 1000) AS BIGINT) AS most,
           CAST(list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 100))) AS BIGINT) AS scaled, len(list_filter(embedding, lambda x: x::DOUBLE > 0.4)) > 0 AS any, list_transform(embedding[3:5], lambda x: CAST(floor(x::DOUBLE * 10) AS BIGINT)) AS part, list_sort(list_distinct(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 10) AS BIGINT)))) AS "order" FROM embeddings""",
    ),
    "explode_elements": Query(
        "embeddings",
        ".[] | .vec_id as $v | .embedding[] | {vec: $v, x: (. * 1000 | floor)}",
        "SELECT vec_id AS vec, CAST(floor(x::DOUBLE * 1000) AS BIGINT) AS x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)",
    ),
    "array_fold": Query(
        "embeddings",
        ".[] | {vec_id, s: (reduce (.embedding[] | . * 100 | floor) as $x (0; . + $x)), steps: [foreach (.embedding[:4][] | . * 100 | floor) as $x (0; . + $x)], range: [range(3)], flat: ([[1, 2], [3]] | flatten), t: ([[1, 2], [3, 4]] | transpose)}",
        """SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 100))) AS BIGINT) AS s,
           list_transform([1, 2, 3, 4], lambda i: CAST(list_sum(list_transform(embedding[1:i], lambda x: floor(x::DOUBLE * 100))) AS BIGINT)) AS steps, [0, 1, 2]::BIGINT[] AS range, [1, 2, 3]::BIGINT[] AS flat, [[1, 3], [2, 4]]::BIGINT[][] AS t FROM embeddings""",
    ),
    "variables": Query(
        "customer",
        "map(select(.c_mktsegment == $segment and .c_acctbal > $least) | {c_custkey})",
        "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 500",
        variables={"segment": "BUILDING", "least": 500},
    ),
    "definitions": Query(
        "orders",
        "def band(f; $w): f / $w | floor; [.[] | band(.o_totalprice; 50000)] | group_by(.) | map({band: .[0], n: length})",
        "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, count(*) AS n FROM orders GROUP BY 1",
    ),
}


#: Forms of programs over datasets, with ties, places and unlike rows.
QUERIES |= {
    "groups_as_stream": Query(
        "orders",
        "[group_by(.o_orderpriority)[] | {p: .[0].o_orderpriority, n: length}]",
        "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1",
    ),
    "groups_selected": Query(
        "orders",
        "group_by(.o_custkey)[] | select(length > 12) | {custkey: .[0].o_custkey, n: length} | select(.n % 2 == 0) | .custkey",
        "SELECT o_custkey AS value FROM orders GROUP BY 1 HAVING count(*) > 12 AND count(*) % 2 = 0",
    ),
    "group_lists": Query(
        "nation",
        'group_by(.n_regionkey) | map({r: .[0].n_regionkey, keys: map(.n_nationkey), names: (map(.n_name) | sort | join(",")), first: .[0].n_name, last: .[-1].n_name, twice: map(.n_nationkey * 2)})',
        """SELECT n_regionkey AS r, list(n_nationkey ORDER BY n_nationkey) AS keys, string_agg(n_name, ',' ORDER BY n_name) AS names, arg_min(n_name, n_nationkey) AS first, arg_max(n_name, n_nationkey) AS last,
           list(n_nationkey * 2 ORDER BY n_nationkey)::BIGINT[] AS twice FROM nation GROUP BY 1""",
        order=("n_nationkey",),
    ),
    "group_any_all": Query(
        "orders",
        "group_by(.o_orderstatus) | map({s: .[0].o_orderstatus, some: any(.o_totalprice > 400000), every: all(.o_totalprice > 900), mean: (add(.[].o_custkey) / length | floor)})",
        "SELECT o_orderstatus AS s, bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 900) AS every, CAST(floor(sum(o_custkey) / count(*)) AS BIGINT) AS mean FROM orders GROUP BY 1",
    ),
    "place_from_end": Query("part", ".[-3] | {p_partkey}", "SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 1 OFFSET 2", order=("p_partkey",)),
    "last_row": Query("orders", "sort_by(.o_totalprice, .o_orderkey) | last | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1"),
    "nth_row": Query("orders", "sort_by(.o_orderkey) | nth(7) | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 7"),
    "reversed_rows": Query("part", "sort_by(.p_partkey) | reverse | first | {p_partkey}", "SELECT max(p_partkey) AS p_partkey FROM part"),
    "max_by_ties": Query("customer", "max_by(.c_nationkey) | {c_custkey}", "SELECT c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey DESC LIMIT 1", order=("c_custkey",)),
    "group_max_by_ties": Query(
        "customer",
        "group_by(.c_mktsegment) | map({s: .[0].c_mktsegment, most: (max_by(.c_nationkey) | .c_custkey), least: min_by(.c_nationkey).c_custkey})",
        "SELECT c_mktsegment AS s, arg_max(c_custkey, (c_nationkey, c_custkey)) AS most, arg_min(c_custkey, (c_nationkey, c_custkey)) AS least FROM customer GROUP BY 1",
        order=("c_custkey",),
    ),
    "unique_with_nulls": Query(
        "orders",
        "group_by(.o_orderstatus) | map({s: .[0].o_orderstatus, v: (map(if .o_custkey % 3 == 0 then null else .o_custkey % 3 end) | unique)})",
        "SELECT o_orderstatus AS s, [NULL, 1, 2]::BIGINT[] AS v FROM orders GROUP BY 1",
    ),
    "fold_with_start": Query(
        "events",
        'reduce .[] as $e ({"click": 5, "none": 1}; .[$e.event_type] += 1)',
        "SELECT key, CAST(sum(n) AS BIGINT) AS value FROM (SELECT event_type AS key, 1 AS n FROM events UNION ALL VALUES ('click', 5), ('none', 1)) GROUP BY 1",
    ),
    "fold_last": Query(
        "events",
        "reduce .[] as $e ({}; .[$e.event_type] = $e.user_id)",
        "SELECT event_type AS key, arg_max(user_id, event_id) AS value FROM events GROUP BY 1",
        order=("event_id",),
    ),
    "fold_max": Query("events", "reduce .[] as $e (null; [., $e.user_id] | max)", "SELECT max(user_id) AS value FROM events"),
    "running_min": Query(
        "events",
        "[foreach .[] as $e (1000; [., $e.user_id] | min; {event_id: $e.event_id, least: .})]",
        "SELECT event_id, least(1000, min(user_id) OVER (ORDER BY event_id)) AS least FROM events",
        order=("event_id",),
    ),
    "running_count": Query(
        "events",
        "[foreach .[] as $e (0; . + 1; {event_id: $e.event_id, n: .})]",
        "SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events",
        order=("event_id",),
    ),
    "lag_three": Query(
        "events",
        "[range(length) as $i | {i: $i, a: .[$i - 3].user_id, b: .[$i + 2].event_type}]",
        """WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, user_id, event_type, count(*) OVER () AS n FROM events)
           SELECT x.i, y.user_id AS a, z.event_type AS b FROM p x LEFT JOIN p y ON y.i = (x.i - 3 + x.n) % x.n LEFT JOIN p z ON z.i = x.i + 2""",
        order=("event_id",),
    ),
    "sliding_sum": Query(
        "events",
        "[range(length) as $i | {i: $i, s: (.[$i:$i + 3] | map(.user_id) | add)}]",
        "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, CAST(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS BIGINT) AS s FROM events",
        order=("event_id",),
    ),
    "union_of_unlike": Query(
        "nation",
        "map({key: .n_nationkey}) + ($region | map({name: .r_name}))",
        """SELECT '{"key":' || n_nationkey || '}' AS value FROM nation UNION ALL SELECT '{"name":"' || r_name || '"}' FROM region""",
        ("region",),
    ),
    "difference_of_unlike": Query("nation", "map({key: .n_nationkey}) - ($region | map({key: .r_regionkey, x: 1}))", "SELECT n_nationkey AS key FROM nation", ("region",)),
    "semi_join_any": Query(
        "customer",
        "map(select(.c_custkey as $k | any($orders[] | .o_custkey; . == $k)) | {c_custkey})",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        ("orders",),
    ),
    "destructured": Query(
        "nation",
        ".[] | . as {n_nationkey: $k, n_name: $s} | {k: $k, s: $s, or_else: (null // $s), joined: (\"\\($k)\")}",
        "SELECT n_nationkey AS k, n_name AS s, n_name AS or_else, CAST(n_nationkey AS VARCHAR) AS joined FROM nation",
    ),
}
QUERIES |= {name: Query(table, program, sql) for name, (table, program, sql) in LANGUAGE.items()}


def props_query(program: str, language: str = "jq") -> Callable[[SparkSession, str], DataFrame]:
    """A program over the JSON texts of events.props, by the interpreter."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, "events").select("event_id", "props")
        return compile_program(program, language).rows(df, "props", keep=("event_id",)).select("event_id", "value")

    return run


PROPS = {
    "json_field": (".k", "jq", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events"),
    "json_entries": ("to_entries[] | \"\\(.key)=\\(.value)\" | ascii_upcase", "jq", "SELECT event_id, '\"K=' || CAST(json_extract(props, '$.k') AS VARCHAR) || '\"' AS value FROM events"),
    "json_update": (".k += 1 | .new = {a: [.k]} | del(.k)", "jq", "SELECT event_id, '{\"new\":{\"a\":[' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) || ']}}' AS value FROM events"),
    "json_recursion": ("[.. | numbers] | add", "jq", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events"),
    "json_try": ("try (.k | if . > 50 then error(\"big\") else . end) catch \"was \\(.)\"", "jq", "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN '\"was big\"' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS value FROM events"),
    "json_walk": ("walk(if type == \"number\" then . + 1 else . end)", "jq", "SELECT event_id, '{\"k\":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) || '}' AS value FROM events"),
    "json_set_get": ("setpath([\"a\", 1]; .k) | getpath([\"a\", 1]), getpath([\"a\", 0])", "jq", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'null' FROM events"),
    "json_with_entries": ("with_entries(.value |= tostring)", "jq", "SELECT event_id, '{\"k\":\"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '\"}' AS value FROM events"),
    "json_label_break": ("[label $f | range(10) | if . > 3 then break $f else . end] | add", "jq", "SELECT event_id, '6' AS value FROM events"),
    "json_stream": ("fromstream(tostream)", "jq", "SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS value FROM events"),
    "jsonata_object": ("{'k': $string(k)}", "jsonata", "SELECT event_id, '{\"k\":\"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '\"}' AS value FROM events"),
    "sql_json_method": ("$.k.type()", "jsonpath", "SELECT event_id, '\"number\"' AS value FROM events"),
    "json_paths": ("[paths]", "jq", "SELECT event_id, '[[\"k\"]]' AS value FROM events"),
    "jsonata_expression": ("k * 2 + $length('abc')", "jsonata", "SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) * 2 + 3 AS VARCHAR) AS value FROM events"),
    "sql_json_path": ("$ ? (@.k > 50).k", "jsonpath", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50"),
}


def type_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures(read_table(spark, sf_dir, "events"), "props")


def document_query(program: str, language: str) -> Callable[[SparkSession, str], DataFrame]:
    """A program over a JSON text made of each nation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, "nation").select("n_nationkey", F.expr(DOCUMENT).alias("value"))
        return compile_program(program, language).rows(df, keep=("n_nationkey",)).select("n_nationkey", "value")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {k: props_query(p, lang) for k, (p, lang, _) in PROPS.items()} | {k: document_query(p, lang) for k, (p, lang, _) in OVER_DOCUMENTS.items()}
    return {**QUERIES, "type_structure": type_structure, **more, **io_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"type_structure": """SELECT '{"k":"integer"}' AS structure""", **{k: q.sql for k, q in QUERIES.items() if q.sql}, **{k: sql for k, (_, _, sql) in (PROPS | OVER_DOCUMENTS).items()}, **io_queries.SQL}
