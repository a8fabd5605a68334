"""Formula constructs, one query per group: each formula is a test on every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import RuleFile, SingleTest, validate
from ruleloom.functions import formulas as fx

from .registry import flat, query, table, test, union


def group(name: str, source: str, key: str, field: str, cases: list[tuple[str, str, str]], given: dict[str, tuple[str, str]] | None = None):
    """Register one group; a case is (rule, Spark formula, SQL condition).

    ``given`` adds columns the formulas use: name -> (Spark SQL, SQL).
    """
    given = given or {}
    relation = source
    if given:
        extra = ", ".join(f"{sql} AS {column}" for column, (_, sql) in given.items())
        relation = f"(SELECT *, {extra} FROM {source})"
    rules = RuleFile.of(name, *[SingleTest(field, rule, formula, "WARN") for rule, formula, _ in cases])

    @query(name, union(*[test(relation, key, rule, condition, field, "WARN") for rule, _, condition in cases]))
    def run(spark, folder):
        df = table(spark, folder, source)
        df = df.select("*", *[F.expr(formula).alias(column) for column, (formula, _) in given.items()])
        return flat(validate(df, rules), key)


_MAYBE = {"p": ("nullif(o_orderpriority, '5-LOW')", "nullif(o_orderpriority, '5-LOW')")}

group("scalar_null_checks", "orders", "o_orderkey", "p", [
    ("given", "p IS NOT NULL", "p IS NOT NULL"),
    ("missing", "p IS NULL", "p IS NULL"),
], _MAYBE)

group("scalar_equality", "orders", "o_orderkey", "p", [
    ("is urgent", fx.same("p", "'1-URGENT'"), "p IS NOT DISTINCT FROM '1-URGENT'"),
    ("not urgent", fx.differs("p", "'1-URGENT'"), "p IS DISTINCT FROM '1-URGENT'"),
    ("both missing", fx.same("p", "nullif('x', 'x')"), "p IS NULL"),
], _MAYBE)

group("scalar_comparison", "orders", "o_orderkey", "o_totalprice", [
    ("less", "o_totalprice < 150000", "o_totalprice < 150000"),
    ("at most", "o_totalprice <= 150000.5", "o_totalprice <= 150000.5"),
    ("more", "o_totalprice > 250000", "o_totalprice > 250000"),
    ("at least", "o_orderkey >= 7500", "o_orderkey >= 7500"),
    ("text order", "o_orderstatus < 'O'", "o_orderstatus < 'O'"),
    ("date order", "o_orderdate < timestamp '1996-01-01'", "o_orderdate < timestamp '1996-01-01'"),
])

group("scalar_logic", "orders", "o_orderkey", "o_orderstatus", [
    ("and", "o_totalprice > 100000 AND o_orderstatus = 'F'", "o_totalprice > 100000 AND o_orderstatus = 'F'"),
    ("or", "o_totalprice > 300000 OR o_orderstatus = 'O'", "o_totalprice > 300000 OR o_orderstatus = 'O'"),
    ("not", "NOT (o_orderstatus = 'P')", "NOT (o_orderstatus = 'P')"),
    ("guarded null", "p IS NOT NULL AND p LIKE '1-%'", "p IS NOT NULL AND p LIKE '1-%'"),
], _MAYBE)

group("scalar_conditional", "orders", "o_orderkey", "p", [
    ("if else", fx.conditional("o_orderstatus = 'F'", "o_totalprice > 100000", "o_totalprice > 200000"),
     "CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 100000 ELSE o_totalprice > 200000 END"),
    ("default", fx.first_given("p", "'none'") + " <> 'none'", "coalesce(p, 'none') <> 'none'"),
    ("parentheses", "(o_orderkey + 1) * 2 > 15000", "(o_orderkey + 1) * 2 > 15000"),
], _MAYBE)

group("scalar_arithmetic", "orders", "o_orderkey", "o_orderkey", [
    ("sum", "o_orderkey + o_custkey > 8000", "o_orderkey + o_custkey > 8000"),
    ("difference", "o_orderkey - o_custkey > 0", "o_orderkey - o_custkey > 0"),
    ("product", "o_orderkey * 3 < 20000", "o_orderkey * 3 < 20000"),
    ("integer quotient", "o_orderkey div 7 = 100", "o_orderkey // 7 = 100"),
    ("remainder", "o_orderkey % 5 = 0", "o_orderkey % 5 = 0"),
    ("quotient", "o_totalprice / 2 > 100000", "o_totalprice / 2 > 100000"),
    ("text sum", "concat(o_orderstatus, o_orderpriority) = 'F1-URGENT'", "o_orderstatus || o_orderpriority = 'F1-URGENT'"),
])

group("scalar_bitwise", "orders", "o_orderkey", "o_orderkey", [
    ("and", "o_orderkey & 3 = 1", "(o_orderkey & 3) = 1"),
    ("or", "o_orderkey | 1 = o_orderkey", "(o_orderkey | 1) = o_orderkey"),
    ("xor", "o_orderkey ^ 5 > 1000", "xor(o_orderkey, 5) > 1000"),
    ("complement", "~o_orderkey < -500", "(~o_orderkey) < -500"),
    ("left", "shiftleft(o_orderkey, 2) > 4000", "(o_orderkey << 2) > 4000"),
    ("right", "shiftright(o_orderkey, 3) = 100", "(o_orderkey >> 3) = 100"),
])

group("scalar_regex_match", "part", "p_partkey", "p_type", [
    ("whole", fx.matches("p_brand", "Brand#[1-3]\\d"), "regexp_full_match(p_brand, 'Brand#[1-3]\\d')"),
    ("not whole", "NOT " + fx.matches("p_brand", "Brand"), "NOT regexp_full_match(p_brand, 'Brand')"),
    ("in list", "p_size IN (1, 5, 10)", "p_size IN (1, 5, 10)"),
    ("in array", fx.member("p_size", "array(1, 5, 10)"), "list_contains([1, 5, 10], p_size)"),
    ("not in array", "NOT " + fx.member("p_size", "array(2, 4)"), "NOT list_contains([2, 4], p_size)"),
])

group("scalar_starts_ends", "part", "p_partkey", "p_name", [
    ("starts", "startswith(p_type, 'S')", "starts_with(p_type, 'S')"),
    ("ends", "endswith(p_brand, '3')", "ends_with(p_brand, '3')"),
    ("not starts", "NOT startswith(p_name, 'Part')", "NOT starts_with(p_name, 'Part')"),
    ("not ends", "NOT endswith(p_name, '1')", "NOT ends_with(p_name, '1')"),
])

group("scalar_empty_size", "documents", "doc_id", "text", [
    ("empty text", fx.empty("t"), "t IS NULL OR length(t) = 0"),
    ("long text", "length(text) > 1000", "length(text) > 1000"),
    ("many lines", "size(split(text, '\\n')) > 5", "len(string_split(text, chr(10))) > 5"),
    ("no list", fx.empty_collection("filter(array(doc_id % 3, doc_id % 5), x -> x = 0)"), "NOT (doc_id % 3 = 0 OR doc_id % 5 = 0)"),
    ("no list at all", fx.empty_collection("CASE WHEN doc_id % 2 = 0 THEN array(1) END"), "doc_id % 2 <> 0"),
], {"t": ("nullif(source, 'src7')", "nullif(source, 'src7')")})

# Texts with white space of all kinds, as SQL of both sides, and what the methods have to give, spelled out for each.
_ODD = [
    ("'abc'", "'abc'"), ("'abc\\n'", "'abc' || chr(10)"), ("' \\tabc \\r\\n'", "' ' || chr(9) || 'abc ' || chr(13) || chr(10)"),
    ("' \\t\\n'", "' ' || chr(9) || chr(10)"), ("'\u2003\u3000'", "chr(8195) || chr(12288)"), ("'\u00a0'", "chr(160)"), ("''", "''"),
    ("'a,b,,'", "'a,b,,'"), ("',,a'", "',,a'"), ("',,'", "',,'"), ("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
]


def _odd(side: int) -> str:
    cases = " ".join(f"WHEN {n} THEN {pair[side]}" for n, pair in enumerate(_ODD))
    return f"CASE o_orderkey % {len(_ODD)} {cases} END"


def _where(*numbers: int) -> str:
    return f"o_orderkey % {len(_ODD)} IN ({', '.join(map(str, numbers))})"


group("scalar_white_space", "orders", "o_orderkey", "t", [
    ("whole match", f"coalesce({fx.matches('t', '[a-z]+')}, false)", _where(0)),
    ("dot does not end the line", f"coalesce({fx.matches('t', '.*')}, false)", f"NOT {_where(1, 2, 3, 10)}"),
    ("is blank", f"coalesce({fx.blank('t')}, false)", _where(3, 4, 6)),
    ("null is not blank", f"{fx.blank('t')} IS NULL", _where(10)),
    ("trimmed", f"{fx.trim('t')} <=> 'abc'", _where(0, 1, 2)),
    ("trimmed to nothing", f"{fx.trim('t')} <=> ''", _where(3, 6)),
    ("wide spaces stay", f"length({fx.trim('t')}) <=> 2", _where(4, 9)),
    ("null stays null", f"{fx.trim('t')} IS NULL", _where(10)),
    ("two parts", f"coalesce(size({fx.split('t', ',')}), 0) = 2", _where(7)),
    ("empty parts in front stay", f"{fx.split('t', ',')} <=> array('', '', 'a')", _where(8)),
    ("only separators", f"coalesce(size({fx.split('t', ',')}), -1) = 0", _where(9)),
    ("no separator", f"coalesce(size({fx.split('t', ',')}), 0) = 1", _where(0, 1, 2, 3, 4, 5, 6)),
], {"t": (_odd(0), _odd(1))})

group("scalar_string_methods", "documents", "doc_id", "text", [
    ("length", "length(text) = n_chars", "length(text) = n_chars"),
    ("upper", "upper(lang) = 'EN'", "upper(lang) = 'EN'"),
    ("lower", "lower(source) = source", "lower(source) = source"),
    ("trim", fx.trim("text") + " = text", "ascii(text[1]) > 32 AND ascii(text[-1]) > 32"),
    ("substring", fx.substring("text", "2", "5") + " = 'the'", "substring(text, 3, 3) = 'the'"),
    ("tail", "length(" + fx.substring("text", "10") + ") > 50", "length(substring(text, 11)) > 50"),
    ("index of", fx.index_of("text", "'the'") + " > 20", "instr(text, 'the') - 1 > 20"),
    ("contains", "contains(text, 'tion')", "contains(text, 'tion')"),
    ("replace", "length(replace(text, 'e', '')) < length(text) * 0.9", "length(replace(text, 'e', '')) < length(text) * 0.9"),
    ("replace all", "length(regexp_replace(text, '[0-9]', '')) = length(text)",
     "length(regexp_replace(text, '[0-9]', '', 'g')) = length(text)"),
    ("split", f"size({fx.split('text', ' ')}) > 100", "len(string_split(rtrim(text, ' '), ' ')) > 100"),
    ("is empty", "text = ''", "text = ''"),
    ("is blank", fx.blank("text"), "NOT regexp_matches(text, '[^ \\t\\n\\r]')"),
    ("equals ignore case", fx.equals_ignore_case("lang", "'EN'"), "lower(lang) = 'en'"),
    ("char at", fx.char_at("text", "1") + " = 'e'", "substring(text, 2, 1) = 'e'"),
])

group("scalar_math", "customer", "c_custkey", "c_acctbal", [
    ("abs", "abs(c_acctbal) > 500", "abs(c_acctbal) > 500"),
    ("round", "round(c_acctbal) % 2 = 0", "round(c_acctbal) % 2 = 0"),
    ("floor", "floor(c_acctbal) % 2 = 0", "CAST(floor(c_acctbal) AS BIGINT) % 2 = 0"),
    ("ceil", "ceil(c_acctbal) % 3 = 0", "CAST(ceil(c_acctbal) AS BIGINT) % 3 = 0"),
    ("pow", "pow(c_acctbal, 2) > 1000000", "pow(c_acctbal, 2) > 1000000"),
    ("sqrt", "sqrt(abs(c_acctbal)) > 50", "sqrt(abs(c_acctbal)) > 50"),
    ("decimal", "CAST(c_acctbal AS DECIMAL(12, 2)) * 3 > 9000", "CAST(c_acctbal AS DECIMAL(12, 2)) * 3 > 9000"),
    ("min max", "greatest(c_acctbal, 0) = least(c_acctbal, 5000)", "greatest(c_acctbal, 0) = least(c_acctbal, 5000)"),
])

group("scalar_format_parse", "orders", "o_orderkey", "o_orderdate", [
    ("month", "date_format(o_orderdate, 'yyyy-MM') = '1996-03'", "strftime(o_orderdate, '%Y-%m') = '1996-03'"),
    ("parse time", "to_timestamp('01.02.1997', 'dd.MM.yyyy') < o_orderdate", "strptime('01.02.1997', '%d.%m.%Y') < o_orderdate"),
    ("parse number", "to_number('12,345.50', '99,999.99') < o_totalprice", "12345.50 < o_totalprice"),
    ("format number", "format_number(o_orderkey, 0) LIKE '%,0%'", "format('{:,}', o_orderkey) LIKE '%,0%'"),
    ("text to number", "CAST(substring(o_orderpriority, 1, 1) AS INT) < 3", "CAST(substring(o_orderpriority, 1, 1) AS INT) < 3"),
])

group("scalar_collections", "orders", "o_orderkey", "o_orderstatus", [
    ("array holds", "array_contains(array('F', 'P'), o_orderstatus)", "list_contains(['F', 'P'], o_orderstatus)"),
    ("map value", "element_at(map('F', 1, 'O', 2, 'P', 3), o_orderstatus) > 1",
     "map_extract(MAP {'F': 1, 'O': 2, 'P': 3}, o_orderstatus)[1] > 1"),
    ("map keys", "array_contains(map_keys(map('F', 1, 'O', 2)), o_orderstatus)", "o_orderstatus IN ('F', 'O')"),
    ("sorted", "sort_array(array(o_orderstatus, 'N'))[0] = 'N'", "list_sort([o_orderstatus, 'N'])[1] = 'N'"),
    ("size", "size(array_distinct(array(o_orderstatus, 'F'))) = 2", "len(list_distinct([o_orderstatus, 'F'])) = 2"),
])

group("scalar_dates", "orders", "o_orderkey", "o_orderdate", [
    ("past", "o_orderdate < current_date()", "o_orderdate < current_date"),
    ("added days", "date_add(o_orderdate, 90) > date '1997-01-01'", "CAST(o_orderdate AS DATE) + 90 > date '1997-01-01'"),
    ("days between", "datediff(date '1998-01-01', o_orderdate) > 365",
     "date_diff('day', CAST(o_orderdate AS DATE), date '1998-01-01') > 365"),
    ("within three months", "o_orderdate BETWEEN add_months(date '1996-06-15', -3) AND date '1996-06-15'",
     "o_orderdate BETWEEN timestamp '1996-03-15' AND timestamp '1996-06-15'"),
    ("whole months", "months_between(timestamp '1998-08-01', o_orderdate) >= 12", "o_orderdate <= timestamp '1997-08-01'"),
    ("hours", "timestampdiff(HOUR, o_orderdate, timestamp '1996-01-01') > 1000",
     "date_diff('hour', o_orderdate, timestamp '1996-01-01') > 1000"),
    ("year", "year(o_orderdate) = 1995", "year(o_orderdate) = 1995"),
])

group("scalar_nested_access", "orders", "o_orderkey", "r", [
    ("field", "r.inner.status = 'F'", "o_orderstatus = 'F'"),
    ("index", "r.list[0] > 100", "o_orderkey > 100"),
    ("index in record", "r.list[1] % 2 = 0", "o_custkey % 2 = 0"),
    ("safe index", "get(r.list, CAST(o_orderkey % 3 AS INT)) IS NULL", "o_orderkey % 3 = 2"),
], {"r": ("named_struct('inner', named_struct('status', o_orderstatus), 'list', array(o_orderkey, o_custkey))", "o_orderkey")})

group("scalar_case_folding", "customer", "c_custkey", "c_mktsegment", [
    ("is upper", "c_mktsegment <=> upper(c_mktsegment)", "c_mktsegment = upper(c_mktsegment)"),
    ("is lower", "c_mktsegment <=> lower(c_mktsegment)", "c_mktsegment = lower(c_mktsegment)"),
    ("building", "upper(c_mktsegment) = 'BUILDING'", "upper(c_mktsegment) = 'BUILDING'"),
])

group("scalar_json_access", "events", "event_id", "props", [
    ("number", fx.json_value("props", "$.k", "INT") + " > 50", "CAST(json_extract_string(props, '$.k') AS INTEGER) > 50"),
    ("missing", fx.json_value("props", "$.none") + " IS NULL", "json_extract_string(props, '$.none') IS NULL"),
    ("typed", "from_json(props, 'k INT').k % 2 = 0", "CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0"),
    ("variant", "try_variant_get(parse_json(props), '$.k', 'int') < 10", "CAST(json_extract_string(props, '$.k') AS INTEGER) < 10"),
])
