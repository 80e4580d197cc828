"""Registered queries for the language's builtins and operators, by family, and the same in SQL.

Each takes every row of a table and puts values of its columns through the builtins, so that most results
differ from row to row. What typed columns can't express comes back as JSON text in the column value.
"""

from __future__ import annotations

import json


def objects(table: str, fields: dict[str, tuple[str, str]], key: str = "", let: str = "") -> tuple[str, str, str]:
    """(table, program, SQL) of one object a row; fields: name to (expression, SQL). key: a column to keep."""
    kept = f"{key}, " if key else ""
    program = f".[] | {let}{{{kept}{', '.join(f'{name}: ({e})' for name, (e, _) in fields.items())}}}"
    sql = ", ".join(f'{q} AS "{name}"' for name, (_, q) in fields.items())
    return table, program, f"SELECT {kept}{sql} FROM {table}"


def arrays(table: str, items: list[tuple[str, str]], let: str = "") -> tuple[str, str, str]:
    """(table, program, SQL) of one JSON array a row; items: (expression, SQL)."""
    program = f".[] | {let}[{', '.join(f'({e})' for e, _ in items)}]"
    return table, program, f"SELECT CAST(json_array({', '.join(q for _, q in items)}) AS VARCHAR) AS value FROM {table}"


def fixed(value) -> str:
    """A JSON value in SQL."""
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False).replace("'", "''")
    return f"CAST('{text}' AS JSON)"


K, S = "n_nationkey", "n_name"
NATION = ".n_nationkey as $k | .n_name as $s | "
ENDS_0 = f"CASE WHEN ends_with({S}, '0') THEN left({S}, length({S}) - 1) ELSE {S} END"
PLACES_OF_N = f"list_filter(range(0, length({S})), lambda i: substr({S}, i + 1, 1) = 'N')"

TEXT = objects(
    "nation",
    {
        "down": (".n_name | ascii_downcase", f"lower({S})"),
        "ends": ('.n_name | endswith("0")', f"ends_with({S}, '0')"),
        "without": ('.n_name | rtrimstr("0")', ENDS_0),
        "parts": ('[.n_name | splits("A")]', f"string_split({S}, 'A')"),
        "parts_i": ('[.n_name | splits("a"; "i")]', f"string_split({S}, 'A')"),
        "vowels": ('[.n_name | scan("[AEIOU]")]', f"regexp_extract_all({S}, '[AEIOU]')"),
        "codes": (".n_name | explode", f"list_transform(string_split({S}, ''), lambda c: CAST(unicode(c) AS BIGINT))"),
        "bytes": (".n_name | utf8bytelength", f"CAST(strlen({S}) AS BIGINT)"),
        "begins": ('.n_name | test("_1.?$"; "x")', f"regexp_matches({S}, '_1.?$')"),
        "trimmed": ('"  " + .n_name + " " | trim', S),
        "left_trimmed": ('"  " + .n_name + " " | ltrim', f"{S} || ' '"),
        "right_trimmed": ('"  " + .n_name + " " | rtrim', f"'  ' || {S}"),
        "letter": (".n_nationkey + 65 | ascii", f"chr({K} + 65)"),
        "text": (".n_name | @text", S),
        "said": ('@uri "?q=\\(.n_name) b"', f"'?q=' || replace({S}, ' ', '%20') || ' b'"),
    },
    K,
)
TEXT_PLACES = arrays(
    "nation",
    [
        ('$s | sub("[AEIOU]"; "*")', f"regexp_replace({S}, '[AEIOU]', '*')"),
        ('$s | trimstr("0")', ENDS_0),
        ("$s | explode | implode", S),
        ('[$s | match("[AEIOU]"; "g") | .offset]', f"list_filter(range(0, length({S})), lambda i: regexp_matches(substr({S}, i + 1, 1), '[AEIOU]'))"),
        ('$s | match("[aeiou]"; "i") | [.offset, .length, .string]', f"json_array(length(regexp_extract({S}, '^[^AEIOU]*')), 1, regexp_extract({S}, '[AEIOU]'))"),
        ('$s | match("[AEIOU]") | .captures', fixed([])),
        ('$s | capture("(.)(.*)")', f"json_object('1', left({S}, 1), '2', substr({S}, 2))"),
        ("$s | tojson | fromjson", S),
        ('$s | contains("A")', f"contains({S}, 'A')"),
        ('"A" | inside($s)', f"contains({S}, 'A')"),
        ('$s | indices("N")', PLACES_OF_N),
        ('$s | rindex("N")', f"list_max({PLACES_OF_N})"),
    ],
    NATION,
)
COLLECTIONS = objects(
    "nation",
    {
        "sorted": ("[$k, 3, 1] | sort", f"list_sort([{K}, 3, 1]::BIGINT[])"),
        "reversed": ("[$k, 3, 1] | reverse", f"[1, 3, {K}]::BIGINT[]"),
        "second": ("[$k, 3] | has(1)", "true"),
        "fifth": ("[$k, 3] | has(4)", "false"),
        "within": ("$k | in([1, 2, 3])", f"{K} < 3"),
        "holds": ("[$k, 3] | contains([3])", "true"),
        "inside": ("[3] | inside([$k, 4])", f"{K} = 3"),
        "places": ("[$k, 3, $k] | indices($k)", f"CASE WHEN {K} = 3 THEN [0, 1, 2] ELSE [0, 2] END::BIGINT[]"),
        "found": ("[1, 5, 9, 30] | bsearch($k)", f"CAST(CASE WHEN {K} IN (1, 5, 9) THEN len(list_filter([1, 5, 9], lambda x: x < {K})) ELSE -1 - len(list_filter([1, 5, 9], lambda x: x < {K})) END AS BIGINT)"),
        "among": ("$k | IN(1, 2)", f"{K} IN (1, 2)"),
        "among2": ("IN($k, 7; 1, 2)", f"{K} IN (1, 2)"),
        "any2": ("any($k, 1; . == 4)", f"{K} = 4"),
        "all2": ("all($k, 9; . >= 5)", f"{K} >= 5"),
        "all1": ("[$k, 1] | all(. >= 1)", f"{K} >= 1"),
        "sum": ("add($k, 1, 2)", f"CAST({K} + 3 AS BIGINT)"),
        "first_of": ("[[$k, 3] | first]", f"[{K}]::BIGINT[]"),
        "last_of": ("[[3, $k] | last]", f"[{K}]::BIGINT[]"),
        "first_out": ("[first($k, 2)]", f"[{K}]::BIGINT[]"),
        "last_out": ("[last(2, $k)]", f"[{K}]::BIGINT[]"),
        "nth_out": ("[nth(1; 6, $k, 7)]", f"[{K}]::BIGINT[]"),
        "none": ("isempty(empty)", "true"),
        "some": ("[limit(2; $k, 5, 6)]", f"[{K}, 5]::BIGINT[]"),
        "others": ("[skip(1; 4, 5, $k)]", f"[5, {K}]::BIGINT[]"),
        "counted": ("[range(2; $k)]", f"range(2, {K})"),
        "flat": ("[[$k], [2, 3]] | flatten(1)", f"[{K}, 2, 3]::BIGINT[]"),
        "numbers": ("[$k, null | numbers]", f"[{K}]::BIGINT[]"),
        "nulls": ("[$k, null | nulls] | length", "1"),
        "values": ("[$k, null | values]", f"[{K}]::BIGINT[]"),
        "or_three": ("$k as $x | ($x % 2 == 0 or false) and true", f"{K} % 2 = 0"),
        "sentence": ("[$k, 1] | tojson", f"'[' || {K} || ',1]'"),
        "kind": ("$k | type", "'number'"),
    },
    K,
    ".n_nationkey as $k | ",
)
COLLECTIONS_OF_JSON = arrays(
    "nation",
    [
        ("[[0, $k] | combinations(2)]", f"[[0, 0], [0, {K}], [{K}, 0], [{K}, {K}]]"),
        ("[[$k, 1], [2]] | [combinations]", f"[[{K}, 2], [1, 2]]"),
        ("[3, $k, 4] | nth(1)", K),
        ("[range(0; $k; 5)]", f"range(0, {K}, 5)"),
        ("[$k | recurse(if . < 30 then . + 10 else empty end)]", f"list_transform(range(0, CAST(ceil((30 - {K}) / 10.0) AS BIGINT) + 1), lambda i: {K} + 10 * i)"),
        ("[$k | recurse(. * 2 + 1; . < 60)]", f"list_filter(list_transform(range(0, 7), lambda i: ({K} + 1) * (1 << i) - 1), lambda x: x < 60)"),
        ("[$k | while(. < 40; . + 10)]", f"list_filter(list_transform(range(0, 5), lambda i: {K} + 10 * i), lambda x: x < 40)"),
        ("$k | until(. > 40; . + 10)", f"{K} + 10 * ((40 - {K}) // 10 + 1)"),
        ("[limit(3; $k | repeat(. + 1))]", f"[{K}, {K} + 1, {K} + 2]"),
        ("[{a: $k, b: [1]} | recurse | numbers]", f"[{K}, 1]"),
        ("[{a: $k} | ..] | length", "2"),
        ("INDEX([$k, $s] | .[]; tostring) | keys", f"list_sort([CAST({K} AS VARCHAR), {S}])"),
        ("{a: 1} + {b: $k}", f"json_object('a', 1, 'b', {K})"),
        ("{a: {b: 1}} * {a: {c: $k}}", f"json_object('a', json_object('b', 1, 'c', {K}))"),
        ("[.[]?] | length", "3"),
        ("[$k, [$s]] | flatten", f"json_array({K}, {S})"),
        ('try [inputs] catch "none"', "'none'"),
        ('try input catch "none"', "'none'"),
    ],
    NATION,
)
PATHS = arrays(
    "nation",
    [
        ("$d | [path(..)]", fixed([[], ["a"], ["a", "b"], ["c"]])),
        ("$d | [paths]", fixed([["a"], ["a", "b"], ["c"]])),
        ('$d | [paths(type == "number")]', fixed([["a", "b"]])),
        ("$d | [leaf_paths]", fixed([["a", "b"], ["c"]])),
        ("$d | path(.a.b)", fixed(["a", "b"])),
        ("$d | pick(.a.b)", f"json_object('a', json_object('b', {K}))"),
        ('$d | delpaths([["a", "b"]])', f"json_object('a', {fixed({})}, 'c', {S})"),
        ('$d | getpath(["a", "b"])', K),
        ('$d | setpath(["a", "b"]; 1)', f"json_object('a', {fixed({'b': 1})}, 'c', {S})"),
        ("$d | del(.a)", f"json_object('c', {S})"),
        ("$d | [tostream]", f"json_array(json_array({fixed(['a', 'b'])}, {K}), {fixed([['a'], False])}, json_array({fixed(['c'])}, {S}), {fixed([[], True])})"),
        ("fromstream($d | tostream)", f"json_object('a', json_object('b', {K}), 'c', {S})"),
        ("[1 | truncate_stream([[0], 1], [[1, 0], $k], [[1, 0]], [[1]])]", f"json_array(json_array([0], {K}), {fixed([[0]])})"),
        ("$d | to_entries | map(.key)", fixed(["a", "c"])),
        ('[{name: "x", value: $k}, {key: "y", value: 1}] | from_entries', f"json_object('x', {K}, 'y', 1)"),
        ("{b: 1, a: $k} | keys", fixed(["a", "b"])),
        ("{b: 1, a: $k} | keys_unsorted", fixed(["b", "a"])),
        ("{b: 1, a: $k} | map_values(. + 1)", f"json_object('b', 2, 'a', {K} + 1)"),
        ("{a: $k} | with_entries(.value += 1)", f"json_object('a', {K} + 1)"),
        ('$d | has("a"), has("x")', "true, false"),
        ('"a" | in($d)', "true"),
        ("[3, $k] | walk(if type == \"number\" then . + 1 else . end)", f"[4, {K} + 1]"),
    ],
    NATION + "{a: {b: $k}, c: $s} as $d | ",
)
KINDS = arrays(
    "nation",
    [
        ("$v | map(type)", fixed(["number", "null", "string", "boolean", "array", "object"])),
        ("[$v[] | scalars]", f"json_array({K}, NULL, {S}, true)"),
        ("[$v[] | iterables]", fixed([[1], {}])),
        ("[$v[] | nulls]", fixed([None])),
        ("[$v[] | booleans]", fixed([True])),
        ("[$v[] | strings]", f"[{S}]"),
        ("[$v[] | arrays]", fixed([[1]])),
        ("[$v[] | objects]", fixed([{}])),
        ("[$v[] | numbers]", f"[{K}]"),
        ("[$v[] | values] | length", "5"),
        ("null, true, false", "NULL, true, false"),
        ("$k | tojson", f"CAST({K} AS VARCHAR)"),
        ('"[\\($k)]" | fromjson', f"[{K}]"),
        ('"true" | toboolean', "true"),
        ('"\\($k)" | tonumber', K),
        ("$k | tostring", f"CAST({K} AS VARCHAR)"),
        ("-$k | abs", K),
        ("builtins | length > 150", "true"),
        ("have_decnum | type", "'boolean'"),
        ("$v | length", "6"),
        ('try ($s | error) catch "was \\(.)"', f"'was ' || {S}"),
        ("try error({n: $k}) catch .n", K),
        ("try ($k | type_error) catch .", "'number is not valid'"),
        ("[$k | .a?]", "[]"),
        ("$k as [$a] ?// $a | [$a]", f"[{K}]"),
        ("{n: $k, xs: [1, [$s]]} as {n: $n, xs: [$x, [$t]]} | [$n, $x, $t]", f"json_array({K}, 1, {S})"),
        ("{} | .missing //= $k | .missing", K),
        ("{n: $k} | .n -= 1 | .n *= 6 | .n /= 2 | .n %= 7 | .n", f"CASE WHEN {K} = 0 THEN -3 ELSE ({K} - 1) * 3 % 7 END"),
        ("[label $f | range(9) | if . > 2 then break $f else . end]", fixed([0, 1, 2])),
        ("$ENV | type", "'object'"),
        ("env | type", "'object'"),
        ("$__loc__ | .line", "1"),
        ("input_line_number", "NULL"),
        ("$k | debug | stderr | . # seen, not changed\n", K),
        ('$k | debug("m")', K),
        ("not", "false"),
    ],
    NATION + "[$k, null, $s, true, [1], {}] as $v | ",
)
P = "p_size"


def thousands(sql: str) -> str:
    return f"CAST(floor(({sql}) * 1000) AS BIGINT)"


MATH = objects(
    "part",
    {
        name: (f"{program} | . * 1000 | floor", thousands(sql))
        for name, program, sql in [
            ("a", ".p_size | log", f"ln({P})"),
            ("b", ".p_size | log2", f"log2({P})"),
            ("c", ".p_size / 10 | exp", f"exp({P} / 10)"),
            ("d", ".p_size / 3 | exp2", f"pow(2, {P} / 3)"),
            ("e", ".p_size / 30 | exp10", f"pow(10, {P} / 30)"),
            ("f", "-.p_size | fabs", f"{P}"),
            ("g", ".p_size | sin", f"sin({P})"),
            ("h", ".p_size | cos", f"cos({P})"),
            ("i", ".p_size | tan", f"tan({P})"),
            ("j", ".p_size / 51 | asin", f"asin({P} / 51)"),
            ("k", ".p_size / 51 | acos", f"acos({P} / 51)"),
            ("l", ".p_size | atan", f"atan({P})"),
            ("m", "atan2(.p_size; 7)", f"atan2({P}, 7)"),
            ("n", ".p_size / 9 | sinh", f"(exp({P} / 9) - exp(-{P} / 9)) / 2"),
            ("o", ".p_size / 9 | cosh", f"(exp({P} / 9) + exp(-{P} / 9)) / 2"),
            ("p", ".p_size / 9 | tanh", f"(exp({P} / 9) - exp(-{P} / 9)) / (exp({P} / 9) + exp(-{P} / 9))"),
            ("q", ".p_size | asinh", f"ln({P} + sqrt({P} * {P} + 1))"),
            ("r", ".p_size + 1 | acosh", f"ln({P} + 1 + sqrt(({P} + 1) * ({P} + 1) - 1))"),
            ("s", ".p_size / 51 | atanh", f"ln((1 + {P} / 51) / (1 - {P} / 51)) / 2"),
            ("t", "hypot(.p_size; 4.3)", f"sqrt({P} * {P} + 4.3 * 4.3)"),
            ("u", "fma(.p_size; 3; 0.5)", f"{P} * 3 + 0.5"),
            ("v", "pow(.p_size + 0.5; 1.5)", f"pow({P} + 0.5, 1.5)"),
            ("w", ".p_size + 0.3 | sqrt", f"sqrt({P} + 0.3)"),
            ("x", ".p_size + 0.3 | cbrt", f"cbrt({P} + 0.3)"),
        ]
    },
    "p_partkey",
)
ROUNDING = objects(
    "part",
    {
        name: (f"{program} | floor", f"CAST(floor({sql}) AS BIGINT)")
        for name, program, sql in [
            ("a", ".p_size / 4 | rint", f"round_even({P} / 4, 0)"),
            ("b", ".p_size / 4 | nearbyint", f"round_even({P} / 4, 0)"),
            ("c", ".p_size / -4 | trunc", f"trunc({P} / -4)"),
            ("d", ".p_size | exponent", f"floor(log2({P}) + 1e-12)"),
            ("e", ".p_size | logb", f"floor(log2({P}) + 1e-12)"),
            ("f", "drem(.p_size; 4.25) * 100", f"({P} - 4.25 * round_even({P} / 4.25, 0)) * 100"),
            ("g", "remainder(.p_size; 3.5) * 100", f"({P} - 3.5 * round_even({P} / 3.5, 0)) * 100"),
            ("h", "(.p_size | significand) * 64", f"{P} / pow(2, floor(log2({P}) + 1e-12)) * 64"),
            ("i", ".p_size / 7 | ceil", f"ceil({P} / 7)"),
            ("j", ".p_size - 20 | abs", f"abs({P} - 20)"),
        ]
    }
    | {
        "none": ("nan | isnan", "true"),
        "endless": ("infinite | isinfinite", "true"),
        "normal": (".p_size - 1 | isnormal", f"{P} <> 1"),
        "finite": (".p_size | isfinite", "true"),
    },
    "p_partkey",
)
#: The functions at 0 to 4, in thousandths.
BESSEL = {"j0": [1000, 765, 223, -261, -398], "j1": [0, 440, 576, 339, -67]}
SPECIAL = arrays(
    "region",
    [
        ("$r + 3 | tgamma", "[2, 6, 24, 120, 720][r_regionkey + 1]"),
        ("$r + 3 | lgamma * 1000 | floor", "[693, 1791, 3178, 4787, 6579][r_regionkey + 1]"),
        *((f"$r | {f} * 1000 | floor", f"{values}[r_regionkey + 1]") for f, values in BESSEL.items()),
    ],
    ".r_regionkey as $r | ",
)
D = "o_orderdate"
DATES = objects(
    "orders",
    {
        "back": (".o_orderdate | datesub(\"days\"; 3)", f"CAST(epoch({D} - INTERVAL 3 DAY) AS BIGINT)"),
        "on": (".o_orderdate | dateadd(\"hours\"; 5)", f"CAST(epoch({D} + INTERVAL 5 HOUR) AS BIGINT)"),
        "read": ('.o_orderdate | todate | strptime("%Y-%m-%dT%H:%M:%SZ") | mktime', f"CAST(epoch({D}) AS BIGINT)"),
        "again": (".o_orderdate | gmtime | mktime", f"CAST(epoch({D}) AS BIGINT)"),
        "local": ('1425599507 | strflocaltime("%Y")', "'2015'"),
        "day": ('.o_orderdate | strftime("%d.%m.%Y")', f"strftime({D}, '%d.%m.%Y')"),
        "late": ("now > 1700000000", "true"),
    },
    "o_orderkey",
)
FORMATS = arrays(
    "nation",
    [
        ("$s | @uri", f"replace({S}, ' ', '%20')"),
        ("$s + \" b&c\" | @uri | @urid", f"{S} || ' b&c'"),
        ("$s | @base64 | @base64d", S),
        ("$s | @base32 | @base32d", S),
        ('"x" | @base32', "'PA======'"),
        ("$s + \" it's\" | @sh", f"'''' || {S} || ' it''\\''''s'''"),
        ('@json "j\\($s)"', f"'j\"' || {S} || '\"'"),
        ('@html "<\\($s + "<")"', f"'<' || {S} || '&lt;'"),
        ('@base64 "\\($k)"', f"base64(encode(CAST({K} AS VARCHAR)))"),
        ('@csv "\\([$k, $s])"', f"'{{}},\"' || {S} || '\"'".replace("'{},", f"{K} || ',")),
        ('@tsv "\\([$k, $s])"', f"{K} || chr(9) || {S}"),
        ('@sh "echo \\($k)"', f"'echo ' || {K}"),
        ('try @nonsense catch "unknown"', "'unknown'"),
        ('"\\($k)-\\($s)"', f"{K} || '-' || {S}"),
    ],
    NATION,
)
LANGUAGE = {
    "text_functions": TEXT,
    "text_places": TEXT_PLACES,
    "collections": COLLECTIONS,
    "collections_of_json": COLLECTIONS_OF_JSON,
    "paths_and_entries": PATHS,
    "kinds_and_control": KINDS,
    "math_functions": MATH,
    "rounding": ROUNDING,
    "special_functions": SPECIAL,
    "date_functions": DATES,
    "more_formats": FORMATS,
}

#: A JSON text for each nation, which the next programs are run over.
DOCUMENT = f"""'{{"k":' || {K} || ',"s":"' || {S} || '","a":[1,' || {K} || ',3],"o":[{{"n":"x","v":' || {K} || '}},{{"n":"y","v":2}}],"d":{{"e":{{"f":' || {K} || '}}}}}}'"""


def jsonata(fields: dict[str, tuple[str, str]]) -> tuple[str, str, str]:
    """(program, language, SQL) of one object a document; fields: name to (expression, SQL)."""
    program = "{" + ", ".join(f'"{name}": {e}' for name, (e, _) in fields.items()) + "}"
    made = ", ".join(f"'{name}', {q}" for name, (_, q) in fields.items())
    return program, "jsonata", f"SELECT {K}, CAST(json_object({made}) AS VARCHAR) AS value FROM nation"


def path(program: str, *outputs: str) -> tuple[str, str, str]:
    """(program, language, SQL) of a path; outputs: SQL of each value as text, null for none."""
    every = " UNION ALL ".join(f"SELECT {K}, CAST({q} AS VARCHAR) AS value FROM nation" for q in outputs)
    return program, "jsonpath", f"SELECT * FROM ({every}) WHERE value IS NOT NULL"


QUOTED = f"""'"' || {S} || '"'"""
OVER_DOCUMENTS = {
    "jsonata_paths": jsonata(
        {
            "field": ("k", K),
            "two": ("d.e", f"json_object('f', {K})"),
            "three": ("d.e.f", K),
            "named": ('o[n="x"].v', K),
            "index": ("a[1]", K),
            "from_end": ("a[-1]", "3"),
            "some": ("a[$ > 2]", f"CASE WHEN {K} > 2 THEN to_json([{K}, 3]) ELSE to_json(3) END"),
            "mapped": ("o.v", f"[{K}, 2]"),
            "any_name": ("d.*.f", K),
            "any_depth": ("**.f", K),
            "range": ("[1..3]", "[1, 2, 3]"),
            "doubled": ("o.(v * 2)", f"[{K} * 2, 4]"),
            "built": ("o.{\"n\": n}", fixed([{"n": "x"}, {"n": "y"}])),
            "grouped": ("o{n: v}", f"json_object('x', {K}, 'y', 2)"),
        }
    ),
    "jsonata_operators": jsonata(
        {
            "plus": ("k + 1", f"{K} + 1"),
            "minus": ("k - 1", f"{K} - 1"),
            "times": ("k * 2", f"{K} * 2"),
            "half": ("(k * 2 + 1) / 2", f"{K} + 0.5::DOUBLE"),
            "rest": ("k % 3", f"{K} % 3"),
            "less": ("1 - -k", f"1 + {K}"),
            "joined": ('s & "!"', f"{S} || '!'"),
            "eq": ("k = 3", f"{K} = 3"),
            "ne": ("k != 3", f"{K} <> 3"),
            "lt": ("k < 3", f"{K} < 3"),
            "le": ("k <= 3", f"{K} <= 3"),
            "gt": ("k > 3", f"{K} > 3"),
            "ge": ("k >= 3", f"{K} >= 3"),
            "both": ("k > 3 and k < 9", f"{K} > 3 AND {K} < 9"),
            "either": ("k < 3 or k > 9", f"{K} < 3 OR {K} > 9"),
            "among": ("k in [1, 2]", f"{K} IN (1, 2)"),
            "chosen": ('k > 3 ? "big" : "small"', f"CASE WHEN {K} > 3 THEN 'big' ELSE 'small' END"),
        }
    ),
    "jsonata_constructs": jsonata(
        {
            "array": ("[k, 1]", f"[{K}, 1]"),
            "object": ('{"x": k}', f"json_object('x', {K})"),
            "block": ("($x := k + 1; $x * 2)", f"({K} + 1) * 2"),
            "lambda": ("($f := function($x) {$x * $x}; $f(k))", f"{K} * {K}"),
            "chained": ("k ~> $string()", f"CAST({K} AS VARCHAR)"),
            "recursive": ("($g := function($n) {$n < 1 ? 0 : $n + $g($n - 1)}; $g(k))", f"{K} * ({K} + 1) // 2"),
            "context": ("$.k", K),
            "root": ("$$.s", S),
            "sorted": ("a^(>$)", f"list_reverse(list_sort([1, {K}, 3]))"),
        }
    ),
    "jsonata_aggregates": jsonata(
        {
            "sum": ("$sum(a)", f"{K} + 4"),
            "max": ("$max(a)", f"greatest({K}, 3)"),
            "min": ("$min(a)", f"least({K}, 1)"),
            "average": ("$average([k, k + 2])", f"{K} + 1"),
            "count": ("$count(a)", "3"),
            "append": ("$append(a, 9)", f"[1, {K}, 3, 9]"),
            "merge": ('$merge([{"x": k}, {"y": 1}])', f"json_object('x', {K}, 'y', 1)"),
            "spread": ('$spread({"x": k, "y": 1})', f"json_array(json_object('x', {K}), {fixed({'y': 1})})"),
            "lookup": ('$lookup($, "k")', K),
            "keys": ("$keys(d)", "'e'"),
            "exists": ("$exists(k)", "true"),
            "reverse": ("$reverse(a)", f"[3, {K}, 1]"),
            "sort": ("$sort([3, k, 1])", f"list_sort([1, {K}, 3])"),
            "zip": ("$zip([1, 2], [k, 3])", f"[[1, {K}], [2, 3]]"),
            "distinct": ("$distinct([k, k, 99])", f"[{K}, 99]"),
            "shuffle": ("$sort($shuffle(a))", f"list_sort([1, {K}, 3])"),
        }
    ),
    "jsonata_strings": jsonata(
        {
            "up": ("$uppercase(s)", S),
            "low": ("$lowercase(s)", f"lower({S})"),
            "length": ("$length(s)", f"length({S})"),
            "trim": ('$trim("  x  " & s & " ")', f"'x ' || {S}"),
            "contains": ('$contains(s, "_1")', f"contains({S}, '_1')"),
            "split": ('$split(s, "_")', f"string_split({S}, '_')"),
            "join": ('$join(["a", s], "-")', f"'a-' || {S}"),
            "substring": ("$substring(s, 1, 3)", f"substr({S}, 2, 3)"),
            "before": ('$substringBefore(s, "_")', f"split_part({S}, '_', 1)"),
            "after": ('$substringAfter(s, "_")', f"split_part({S}, '_', 2)"),
            "pad": ('$pad(s, 12, "#")', f"rpad({S}, 12, '#')"),
            "pad_left": ('$pad(s, -12, "#")', f"lpad({S}, 12, '#')"),
            "replace": ('$replace(s, "N", "M")', f"replace({S}, 'N', 'M')"),
            "replace_pattern": ('$replace(s, /[AI]/, "*")', f"regexp_replace({S}, '[AI]', '*', 'g')"),
            "match": ("$match(s, /[0-9]+/).match", f"regexp_extract({S}, '[0-9]+')"),
        }
    ),
    "jsonata_conversions": jsonata(
        {
            "string": ("$string(k)", f"CAST({K} AS VARCHAR)"),
            "number": ("$number($string(k))", K),
            "base": ("$formatBase(k, 2)", f"bin({K})"),
            "format": ('$formatNumber(k, "0")', f"CAST({K} AS VARCHAR)"),
            "boolean": ("$boolean(k)", f"{K} <> 0"),
            "not": ("$not(k > 3)", f"{K} <= 3"),
            "type": ("$type(s)", "'string'"),
            "abs": ("$abs(-k)", K),
            "floor": ("$floor(k + 0.5)", K),
            "ceil": ("$ceil(k + 0.5)", f"{K} + 1"),
            "round": ("$round(k + 0.5)", f"{K} + {K} % 2"),
            "sqrt": ("$sqrt(k * k)", K),
            "power": ("$power(k, 2)", f"{K} * {K}"),
            "base64": ("$base64encode(s)", f"base64(encode({S}))"),
            "base64_back": ("$base64decode($base64encode(s))", S),
            "url": ('$encodeUrlComponent(s & " b")', f"{S} || '%20b'"),
            "millis": ("$fromMillis(k * 1000)", f"'1970-01-01T00:00:' || lpad(CAST({K} AS VARCHAR), 2, '0') || '.000Z'"),
            "millis_back": ("$toMillis($fromMillis(k * 1000))", f"{K} * 1000"),
        }
    ),
    "jsonata_higher_order": jsonata(
        {
            "map": ("$map(a, function($x) {$x + 1})", f"[2, {K} + 1, 4]"),
            "filter": ("$filter(a, function($x) {$x < 3})", f"CASE WHEN {K} < 3 THEN to_json([1, {K}]) ELSE to_json(1) END"),
            "reduce": ("$reduce(a, function($x, $y) {$x + $y})", f"{K} + 4"),
            "each": ('$each({"x": k}, function($v, $n) {$n & $v})', f"'x' || {K}"),
            "sort": ("$sort(a, function($l, $r) {$l < $r})", f"list_reverse(list_sort([1, {K}, 3]))"),
            "sift": ('$sift({"x": k, "y": -1}, function($v) {$v >= 0})', f"json_object('x', {K})"),
            "single": ("$single([k], function($v) {true})", K),
        }
    ),
    "path_members": path("$.o[*].v", K, "2"),
    "path_any_member": path("$.d.*", f"""'{{"f":' || {K} || '}}'"""),
    "path_levels": path("$.d.**{1 to 2}.f", K),
    "path_every_level": path("$.d.**", f"""'{{"e":{{"f":' || {K} || '}}}}'""", f"""'{{"f":' || {K} || '}}'""", K),
    "path_last": path("$.a[last]", "3"),
    "path_before_last": path("$.a[last - 1]", K),
    "path_range": path("$.a[1 to 2]", K, "3"),
    "path_places": path("$.a[0, 1]", "1", K),
    "path_arithmetic": path("($.k + 1) * 2 - -$.k", f"({K} + 1) * 2 + {K}"),
    "path_remainder": path("$.k % 3", f"{K} % 3"),
    "path_size": path("$.a.size()", "3"),
    "path_double": path("$.k.double()", K),
    "path_ceiling": path("($.k + 0.5).ceiling()", f"{K} + 1"),
    "path_floor": path("($.k + 0.5).floor()", K),
    "path_abs": path("(-$.k).abs()", K),
    "path_keyvalue": path("$.d.e.keyvalue().value", K),
    "path_and": path("$.a[*] ? (@ > 2 && @ < 10)", f"CASE WHEN {K} > 2 AND {K} < 10 THEN {K} END", "3"),
    "path_or_not": path("$.a[*] ? (@ < 2 || !(@ < 4))", "1", f"CASE WHEN {K} < 2 OR {K} >= 4 THEN {K} END"),
    "path_equal": path('$.o[*] ? (@.n == "x").v', K),
    "path_exists": path("$.o[*] ? (exists(@.v)).v", K, "2"),
    "path_starts": path('$.s ? (@ starts with "NATION_1")', f"CASE WHEN starts_with({S}, 'NATION_1') THEN {QUOTED} END"),
    "path_like": path('$.s ? (@ like_regex "_[2-4]$")', f"CASE WHEN regexp_matches({S}, '_[2-4]$') THEN {QUOTED} END"),
    "path_unknown": path('$.a[*] ? ((@ == "x") is unknown)', "1", K, "3"),
    "path_strict": path("strict $.a[*]", "1", K, "3"),
    "path_lax_unwraps": path("lax $.o.v", K, "2"),
    "path_lax_wraps": path("lax $.k[0]", K),
    "path_lax_missing": path("lax $.missing", "NULL"),
    "path_predicate": path("$.k == 5", f"CASE WHEN {K} = 5 THEN 'true' ELSE 'false' END"),
}
