"""Scans, validation and cleaning: S, V, P."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edaspark.common import shared_folder, small_frame
from edaspark.functions.text import NA_TOKENS
from edaspark.operators import convert, duplicates, nulls, outliers, validate
from edaspark.sources import roles, scan

from .registry import DIRTY, dirty, query, r, rounded, table

TOKENS = ", ".join(f"'{t}'" for t in NA_TOKENS)
TOKEN_COLUMNS = (
    "o_orderkey",
    "case when o_orderkey % 7 = 0 then 'NA' when o_orderkey % 7 = 1 then 'null' when o_orderkey % 11 = 0 then '#N/A' "
    "else o_orderstatus end as status",
    "case when o_orderkey % 5 = 0 then 'NaN' when o_orderkey % 5 = 1 then '' when o_orderkey % 13 = 0 then '-' "
    "else o_orderpriority end as priority",
    "case when o_orderkey % 6 = 0 then cast('NaN' as double) else o_totalprice end as price",
)


@query(
    "na_normalise",
    f"""with t as (select {', '.join(TOKEN_COLUMNS)} from orders)
    select o_orderkey, case when status in ({TOKENS}) then null else status end as status,
      case when priority in ({TOKENS}) then null else priority end as priority,
      case when isnan(price) then null else price end as price from t""",
)
def na_normalise(spark, folder):
    return scan.normalise_na(table(spark, folder, "orders").selectExpr(*TOKEN_COLUMNS))


TEXT_COLUMNS = (
    "cast(o_orderkey as string) as id",
    "concat(' 00', cast(o_custkey as string)) as padded",
    "case when o_orderkey % 9 = 0 then 'NA' else cast(o_custkey as string) end as gaps",
    "cast(o_totalprice as string) as price",
    "case when o_orderkey % 3 = 0 then 'true' when o_orderkey % 3 = 1 then 'FALSE' else 'False' end as flag",
    "case when o_orderkey % 3 = 0 then '' else 'True' end as flag_gaps",
    "case when o_orderkey % 3 = 0 then 'yes' else '1' end as mixed",
    "case when o_orderkey % 3 = 0 then '1d' else '2' end as suffixed",
    "cast(null as string) as nothing",
)


@query(
    "infer_types",
    """select o_orderkey as id, o_custkey as padded, case when o_orderkey % 9 = 0 then null else o_custkey end as gaps,
      o_totalprice as price, o_orderkey % 3 = 0 as flag, case when o_orderkey % 3 = 0 then null else 'True' end as flag_gaps,
      case when o_orderkey % 3 = 0 then 'yes' else '1' end as mixed,
      case when o_orderkey % 3 = 0 then '1d' else '2' end as suffixed, cast(null as double) as nothing from orders""",
)
def infer_types(spark, folder):
    return scan.infer_types(scan.normalise_na(table(spark, folder, "orders", *TEXT_COLUMNS)))


@query(
    "csv_scan",
    """select o_orderkey as id, o_orderstatus as status, case when o_orderkey % 4 = 0 then null else o_totalprice end as price,
      o_orderpriority as "status.1", strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey as "Unnamed: 5" from orders""",
)
def csv_scan(spark, folder):
    """S1 on a file of the whole table, with a repeated and a blank header."""
    cells = (
        "o_orderkey",
        "o_orderstatus",
        "if(o_orderkey % 4 = 0, 'n/a', string(o_totalprice))",
        "concat('\"', o_orderpriority, '\"')",
        "date_format(o_orderdate, 'yyyy-MM-dd')",
        "o_orderkey",
    )
    header = "'id,status,price,status,day,'"
    lines = table(spark, folder, "orders").selectExpr(f"concat_ws(',', {', '.join(cells)}) as line", "monotonically_increasing_id() as at")
    # The first row of each task, hence of each file, brings the header along.
    lines = lines.selectExpr(f"explode(if(at % {1 << 33} = 0, array({header}, line), array(line))) as value")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    lines.write.text(path)
    return scan.load(spark, path)


@query(
    "csv_line_breaks",
    """select o_orderkey as id, o_orderstatus || chr(10) || case when o_orderkey % 3 = 0 then o_orderpriority || ', "' || chr(10) || '"' else '' end as note,
      o_totalprice as price from orders""",
)
def csv_line_breaks(spark, folder):
    """S1 on lines whose quoted cells hold line breaks, commas and quotes, read in splits."""
    note = """concat('"', o_orderstatus, '\n', if(o_orderkey % 3 = 0, concat(o_orderpriority, ', ""\n""'), ''), '"')"""
    lines = table(spark, folder, "orders").selectExpr(f"concat_ws(',', o_orderkey, {note}, o_totalprice) as line", "monotonically_increasing_id() as at")
    lines = lines.selectExpr(f"explode(if(at % {1 << 33} = 0, array('id,note,price', line), array(line))) as value")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    lines.write.text(path)
    return scan.load(spark, path)


@query(
    "csv_folder_by_name",
    "select o_orderkey as id, o_orderstatus as status, o_totalprice as price from orders",
)
def csv_folder_by_name(spark, folder):
    """Files of one folder whose headers have the same names in another order."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    orders = table(spark, folder, "orders", "o_orderkey as id", "o_orderstatus as status", "o_totalprice as price")
    orders.filter("id % 2 = 0").write.option("header", True).csv(path)
    orders.filter("id % 2 = 1").select("price", "id", "status").write.mode("append").option("header", True).csv(path)
    return scan.load(spark, path)


@query("roles_select", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def roles_select(spark, folder):
    return roles.select_role(table(spark, folder, "lineitem"), roles.NUM)


@query(
    "column_listing",
    """select ordinal, "column", type, (select count(*) from customer) as rows, 5 as cols from (values
      (0, 'c_custkey', 'num'), (1, 'c_name', 'cat'), (2, 'c_nationkey', 'num'), (3, 'c_acctbal', 'num'),
      (4, 'c_mktsegment', 'cat')) as t(ordinal, "column", type)""",
)
def column_listing(spark, folder):
    return roles.listing(table(spark, folder, "customer"))


INFERRED_ROLES = (
    ("id", "num"), ("padded", "num"), ("gaps", "num"), ("price", "num"), ("flag", "num"), ("flag_gaps", "cat"),
    ("mixed", "cat"), ("suffixed", "cat"), ("nothing", "num"),
)


@query(
    "chart_candidates",
    " union all ".join(
        f"select '{chart}' as chart, '{slot}' as slot, '{c}' as \"column\""
        for chart, slot, kind in roles.CHART_SLOTS
        for c, role in INFERRED_ROLES
        if kind in ("all", role)
    ),
)
def chart_candidates(spark, folder):
    """Roles follow from the types that all values of a table of texts support."""
    texts = scan.normalise_na(table(spark, folder, "orders", *TEXT_COLUMNS))
    return roles.chart_candidates(scan.infer_types(texts))


@query("preview", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer order by c_custkey limit 5")
def preview(spark, folder):
    return scan.preview(spark.read.parquet(f"{folder}/customer.parquet"), order=["c_custkey"])


CHECKED = ("l_orderkey", "l_linenumber", "q", "tax", "price", "flag", "l_discount")
MISSING = " union all ".join(
    f"select {i} as ordinal, '{c}' as \"column\", count(*) - count({c}) as missing, count(*) as n from dirty"
    for i, c in enumerate(CHECKED)
)
COPIES = "(select count(*) from dirty) - (select count(*) from (select distinct * from dirty))"


@query("null_counts", f'{DIRTY} select ordinal, "column", missing as nulls from ({MISSING}) where missing > 0')
def null_counts(spark, folder):
    return validate.null_counts(dirty(spark, folder))


@query(
    "column_types",
    """select ordinal, "column", type from (values (0, 'o_orderkey', 'bigint'), (1, 'iso', 'timestamp_ntz'),
      (2, 'month_first', 'timestamp_ntz'), (3, 'day_first', 'timestamp_ntz'), (4, 'stamped', 'timestamp_ntz'),
      (5, 'mixed', 'string'), (6, 'year', 'timestamp_ntz'), (7, 'fraction', 'timestamp_ntz'), (8, 'offset', 'timestamp_ntz'),
      (9, 'zulu', 'timestamp_ntz'), (10, 'half_day', 'timestamp_ntz'), (11, 'short_year', 'timestamp_ntz'),
      (12, 'digit', 'string')) as t(ordinal, "column", type)""",
)
def column_types(spark, folder):
    """Types after dates have been looked for in every text."""
    return validate.column_types(convert.detect_dates(table(spark, folder, "orders", *DAY_COLUMNS)))


@query("duplicate_count", f"{DIRTY} select {COPIES} as duplicates")
def duplicate_count(spark, folder):
    return small_frame(spark, [(duplicates.duplicate_count(dirty(spark, folder)),)], "duplicates bigint")


@query(
    "issue_report",
    f"""{DIRTY} select 'missing_values' as "check", "column", cast(missing as varchar) as value from ({MISSING}) where missing > 0
    union all select 'data_types', c, t from (values ('l_orderkey', 'bigint'), ('l_linenumber', 'int'), ('q', 'double'),
      ('tax', 'double'), ('price', 'double'), ('flag', 'string'), ('l_discount', 'double')) as t(c, t)
    union all select 'duplicates', null, cast({COPIES} as varchar)""",
)
def issue_report(spark, folder):
    return validate.issues(dirty(spark, folder))


MODE = "(select flag from alive where flag is not null group by flag order by count(*) desc, flag limit 1)"
POLICY = f"""{DIRTY},
counted as (select count(*) as n, count(*) - count(q) as q, count(*) - count(tax) as tax from dirty),
alive as (select * from dirty where tax is not null),
later as (select count(*) as n, count(*) - count(price) as price, count(*) - count(flag) as flag from alive),
walked as (select 2 as ordinal, 'q' as "column", q as null_count, n as rows_before from counted
  union all select 3, 'tax', tax, n from counted union all select 4, 'price', price, n from later
  union all select 5, 'flag', flag, n from later)"""


@query(
    "null_plan",
    f"""{POLICY} select ordinal, "column", null_count, rows_before, {r('null_count / rows_before')} as ratio,
      case when null_count / rows_before > 0.4 then 'drop_column' when null_count / rows_before < 0.05 then 'drop_rows'
        when "column" = 'flag' then 'fill_mode' else 'fill_median' end as action,
      case when "column" = 'price' then {r('(select quantile_cont(price, 0.5) from alive)')} end as fill_number,
      case when "column" = 'flag' then {MODE} end as fill_text from walked""",
)
def null_plan(spark, folder):
    df = dirty(spark, folder)
    return rounded(nulls.NullPlan.fit(df).table(df))


HANDLED = f"""{POLICY}, handled as (select l_orderkey, l_linenumber, tax,
  coalesce(price, (select quantile_cont(price, 0.5) from alive)) as price, coalesce(flag, {MODE}) as flag, l_discount from alive)"""


@query("nulls_handled", f"{HANDLED} select l_orderkey, l_linenumber, tax, {r('price')} as price, flag, l_discount from handled")
def nulls_handled(spark, folder):
    return rounded(nulls.handle_nulls(dirty(spark, folder)))


@query("nulls_handled_by_jobs", f"{HANDLED} select l_orderkey, l_linenumber, tax, {r('price')} as price, flag, l_discount from handled")
def nulls_handled_by_jobs(spark, folder):
    """The policy's other way, for tables with too many combinations of gaps."""
    df = dirty(spark, folder)
    return rounded(nulls.NullPlan.fit(df, max_patterns=1).apply(df))


SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "strings_trimmed",
    f"""select doc_id, regexp_replace(text, '^{SPACE}|{SPACE}$', '', 'g') as text, lang, source as padded, n_chars from documents""",
)
def strings_trimmed(spark, folder):
    df = table(spark, folder, "documents")
    padded = F.concat(F.lit("\t \u001c "), F.col("source"), F.lit("　 \u0085\n"))
    return convert.trim_strings(df.select("doc_id", "text", "lang", padded.alias("padded"), "n_chars"))


@query(
    "types_cast",
    """select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as double) as o_custkey,
      cast(o_totalprice as double) as price, cast(o_custkey % 2 as boolean) as odd from orders""",
)
def types_cast(spark, folder):
    df = table(spark, folder, "orders", "o_orderkey", "o_custkey", "cast(o_totalprice as string) as price", "o_custkey % 2 as odd")
    return convert.cast_columns(df, {"o_orderkey": "str", "o_custkey": "float64", "price": "float", "odd": "bool", "absent": "int"})


DAY_COLUMNS = (
    "o_orderkey",
    "date_format(o_orderdate, 'yyyy-MM-dd') as iso",
    "date_format(o_orderdate, 'MM/dd/yyyy') as month_first",
    "date_format(o_orderdate, 'dd/MM/yyyy') as day_first",
    "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as stamped",
    "date_format(o_orderdate, if(o_orderkey % 2 = 0, 'yyyy-MM-dd', 'dd/MM/yyyy')) as mixed",
    "date_format(o_orderdate, 'yyyy') as year",
    "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") as fraction",
    "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\") as offset",
    "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as zulu",
    "date_format(o_orderdate, 'MM/dd/yyyy hh:mm:ss a') as half_day",
    "date_format(o_orderdate, 'MM/dd/yy') as short_year",
    "cast(o_orderkey % 7 as string) as digit",
)


@query(
    "dates_detected",
    """with t as (select o_orderkey, o_orderdate as d, strftime(o_orderdate, '%Y-%m-%d 00:00:00') as s from orders)
    select o_orderkey, s as iso, s as month_first, s as day_first, s as stamped,
      case when o_orderkey % 2 = 0 then strftime(d, '%Y-%m-%d') else strftime(d, '%d/%m/%Y') end as mixed,
      strftime(d, '%Y-01-01 00:00:00') as year, s as fraction, strftime(d - interval 2 hour, '%Y-%m-%d %H:%M:%S') as "offset",
      s as zulu, s as half_day, s as short_year, cast(o_orderkey % 7 as varchar) as digit from t""",
)
def dates_detected(spark, folder):
    found = convert.detect_dates(table(spark, folder, "orders", *DAY_COLUMNS))
    times = [c for c, t in found.dtypes if t == "timestamp_ntz"]
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})


NARROWABLE = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


@query(
    "narrow_types",
    " union all ".join(
        f"""select '{c}' as "column", case when min({c}) >= -128 and max({c}) < 128 then 'tinyint'
          when min({c}) >= -32768 and max({c}) < 32768 then 'smallint' else 'int' end as type from lineitem"""
        for c in NARROWABLE[:3]
    )
    + "".join(
        f""" union all select '{c}', 'float' from lineitem having max(abs({c} - cast({c} as float)::double)) <= 5e-4"""
        for c in NARROWABLE[3:]
    ),
)
def narrow_types(spark, folder):
    found = convert.NarrowPlan.fit(table(spark, folder, "lineitem", *NARROWABLE)).types
    return small_frame(spark, found, "column string, type string")


@query(
    "narrowed",
    """select l_orderkey, l_partkey, l_suppkey, cast(cast(l_quantity as float) as double) as l_quantity, l_extendedprice,
      cast(cast(l_discount as float) as double) as l_discount from lineitem""",
)
def narrowed(spark, folder):
    found = convert.narrow(table(spark, folder, "lineitem", *NARROWABLE))
    wide = {c: ("bigint" if i < 3 else "double") for i, c in enumerate(NARROWABLE)}
    return found.select(*[F.col(c).cast(t) for c, t in wide.items()])


@query("deduplicated", f"{DIRTY} select distinct * from dirty")
def deduplicated(spark, folder):
    return duplicates.remove_duplicates(dirty(spark, folder))


def _filled(fill):
    parts = [f"{r(f'coalesce({c}, {fill.format(c)})')} as {c}" for c in ("q", "tax", "price")]
    return f"{DIRTY} select cast(l_orderkey as double) as l_orderkey, cast(l_linenumber as double) as l_linenumber, {', '.join(parts)}, flag, l_discount from dirty"


@query(
    "types_of_fills",
    f"""{DIRTY}, t as (select case when l_orderkey % 8 = 0 then null else l_linenumber end as whole from dirty)
    select 'whole' as "column", 'fill_median' as action, quantile_cont(whole, 0.5)::double as fill_number from t""",
)
def types_of_fills(spark, folder):
    """A whole-number column with gaps takes the median, whatever its width."""
    df = dirty(spark, folder).selectExpr("if(l_orderkey % 8 = 0, null, l_linenumber) as whole")
    return nulls.NullPlan.fit(df).table(df).select("column", "action", "fill_number")


FILLED_BY_MEANS = ", ".join(f"{r(f'coalesce({c}, mean_{c})')} as {c}" for c in ("q", "tax", "price"))


@query(
    "fill_mean",
    f"""{DIRTY}, means as (select avg(q) as mean_q, avg(tax) as mean_tax, avg(price) as mean_price from dirty)
    select cast(l_orderkey as double) as l_orderkey, cast(l_linenumber as double) as l_linenumber, {FILLED_BY_MEANS}, flag, l_discount from dirty, means""",
)
def fill_mean(spark, folder):
    return rounded(nulls.fill_nulls(dirty(spark, folder), "mean"))


@query("fill_median", _filled("(select quantile_cont({0}, 0.5) from dirty)"))
def fill_median(spark, folder):
    return rounded(nulls.fill_nulls(dirty(spark, folder), "median"))


@query(
    "fill_mode",
    f"{DIRTY} select l_orderkey, l_linenumber, "
    + ", ".join(
        f"coalesce({c}, (select {c} from dirty where {c} is not null group by {c} order by count(*) desc, {c} limit 1)) as {c}"
        for c in ("q", "tax", "price", "flag")
    )
    + ", l_discount from dirty",
)
def fill_mode(spark, folder):
    return nulls.fill_nulls(dirty(spark, folder), "mode")


@query("drop_any_null", f"{DIRTY} select * from dirty where q is not null and tax is not null and price is not null and flag is not null")
def drop_any_null(spark, folder):
    return nulls.fill_nulls(dirty(spark, folder), "drop")


def _fences(c, source):
    return f"""(select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from {source})""", (
        f"""(select quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from {source})"""
    )


def _not_outside(c, source):
    low, high = _fences(c, source)
    return f"not coalesce({c} < {low} or {c} > {high}, false)"


@query("outliers_removed_all_at_once", f"select event_id, user_id, value from events where {_not_outside('event_id', 'events')} and {_not_outside('user_id', 'events')} and {_not_outside('value', 'events')}")
def outliers_removed_all_at_once(spark, folder):
    return outliers.remove_outliers(table(spark, folder, "events", "event_id", "user_id", "value"), at_once=True)


@query(
    "zscore_removed_all_at_once",
    "select event_id, user_id, value from events where "
    + " and ".join(
        f"abs(({c} - (select avg({c}) from events)) / (select stddev_pop({c}) from events)) < 3"
        for c in ("event_id", "user_id", "value")
    ),
)
def zscore_removed_all_at_once(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    return outliers.remove_outliers(events, "zscore", at_once=True)


def _bounds(source, columns, method):
    parts = []
    for c in columns:
        low, high = _fences(c, source)
        spread = f"stddev_samp({c})"
        if method == "iqr":
            outside = f"count(*) filter ({c} < {low} or {c} > {high})"
            quarters = f"{r(f'quantile_cont({c}, 0.25)', 4)} as q1, {r(f'quantile_cont({c}, 0.75)', 4)} as q3"
        else:
            low, high = f"avg({c}) - 3 * {spread}", f"avg({c}) + 3 * {spread}"
            mean = f"(select avg({c}) from {source})"
            outside = f"count(*) filter (abs(({c} - {mean}) / (select {spread} from {source})) > 3)"
            quarters = "cast(null as double) as q1, cast(null as double) as q3"
        parts.append(
            f"""select '{c}' as "column", '{method}' as method, {quarters}, {r(f'avg({c})', 4)} as mean, {r(spread, 4)} as std,
            {r(low, 4)} as lower, {r(high, 4)} as upper, {outside} as n_outliers from {source}"""
        )
    return " union all ".join(parts)


EVENT_NUMBERS = ("event_id", "user_id", "value")
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _bounds_table(df, method):
    return rounded(outliers.Bounds.fit(df, method).table(df), 4)


@query("bounds", _bounds("lineitem", LINE_NUMBERS, "iqr"))
def bounds(spark, folder):
    return _bounds_table(table(spark, folder, "lineitem"), "iqr")


@query("bounds_zscore", _bounds("lineitem", LINE_NUMBERS, "zscore"))
def bounds_zscore(spark, folder):
    return _bounds_table(table(spark, folder, "lineitem"), "zscore")


INFINITE = "case when event_id % 5 = 0 then {low} when event_id % 3 = 0 then {high} else value end"
INFINITE_SQL = INFINITE.format(low="'-infinity'::double", high="'infinity'::double")


def _ranked(p):
    """Interpolated quantile by its definition; next to an infinity it is that infinity."""
    low, high, share = (f"l[cast({f}((n - 1) * {p}) as bigint) + 1]" for f in ("floor", "ceil")), None, f"((n - 1) * {p} - floor((n - 1) * {p}))"
    a, b = low
    return f"case when {a} = {b} or {share} = 0 then {a} when isinf({a}) or isinf({b}) then {a} * (1 - {share}) + {b} * {share} else {a} + ({b} - {a}) * {share} end"


@query(
    "quantiles_infinite",
    f"with s as (select list_sort(list({INFINITE_SQL})) as l, count(*) as n from events) "
    + " union all ".join(f"select {p}::double as p, cast({_ranked(p)} as varchar) as low_rows, cast({_ranked(p)} as varchar) as many_rows from s" for p in (0.1, 0.25, 0.9))
    + "",
)
def quantiles_infinite(spark, folder):
    """The way for few rows and the way for many, over a column with infinite values."""
    from edaspark.operators import quantiles

    x = INFINITE.format(low="double('-infinity')", high="double('infinity')")
    df, probs = table(spark, folder, "events", f"{x} as x"), [0.1, 0.25, 0.9]
    few = quantiles.column_quantiles(df, {"x": F.col("x")}, probs)["x"]
    wide = df.select(F.col("x").alias("v0"))
    counts, sketches = quantiles._sketch_columns(wide, [0], probs, quantiles.MARGIN)
    many = quantiles._exact_columns(wide, counts, sketches, probs, quantiles.MARGIN, 1000)[0]
    said = {float("inf"): "inf", float("-inf"): "-inf"}
    return small_frame(spark, [(p, said.get(a, repr(a)), said.get(b, repr(b))) for p, a, b in zip(probs, few, many)], "p double, low_rows string, many_rows string")


@query("iqr_counts", f"select \"column\", n_outliers as outliers from ({_bounds('events', EVENT_NUMBERS, 'iqr')})")
def iqr_counts(spark, folder):
    return outliers.outlier_counts(table(spark, folder, "events"), "iqr")


@query("zscore_counts", f"select \"column\", n_outliers as outliers from ({_bounds('events', EVENT_NUMBERS, 'zscore')})")
def zscore_counts(spark, folder):
    return outliers.outlier_counts(table(spark, folder, "events"), "zscore")


SEQUENCE = ("value", "square", "user_id")
SEQUENCE_INPUT = "select event_id::varchar as id, value, value * value as square, user_id from events"


def _sequence(condition):
    steps, source = [f"s0 as ({SEQUENCE_INPUT})"], "s0"
    for i, c in enumerate(SEQUENCE, 1):
        steps.append(f"s{i} as (select * from {source} where {condition(c, source)})")
        source = f"s{i}"
    return f"with {', '.join(steps)} select id, value, {r('square')} as square, user_id from {source}"


@query("iqr_removed", _sequence(lambda c, s: f"{c} between {_fences(c, s)[0]} and {_fences(c, s)[1]}"))
def iqr_removed(spark, folder):
    events = table(spark, folder, "events", "string(event_id) as id", "value", "value * value as square", "user_id")
    return rounded(outliers.remove_outliers(events))


@query("zscore_removed", _sequence(lambda c, s: f"abs(({c} - (select avg({c}) from {s})) / (select stddev_samp({c}) from {s})) <= 3"))
def zscore_removed(spark, folder):
    events = table(spark, folder, "events", "string(event_id) as id", "value", "value * value as square", "user_id")
    return rounded(outliers.remove_outliers(events, "zscore"))


def _capped(c, low, high):
    return f"{r(f'case when {c} < {low} then {low} when {c} > {high} then {high} else {c}::double end')} as {c}"


@query("iqr_capped", "select event_type, " + ", ".join(_capped(c, *_fences(c, "events")) for c in EVENT_NUMBERS) + " from events")
def iqr_capped(spark, folder):
    return rounded(outliers.cap_outliers(table(spark, folder, "events", "event_type", *EVENT_NUMBERS)))


@query(
    "zscore_capped",
    "select event_type, "
    + ", ".join(
        _capped(c, f"(select avg({c}) - 3 * stddev_samp({c}) from events)", f"(select avg({c}) + 3 * stddev_samp({c}) from events)")
        for c in EVENT_NUMBERS
    )
    + " from events",
)
def zscore_capped(spark, folder):
    return rounded(outliers.cap_outliers(table(spark, folder, "events", "event_type", *EVENT_NUMBERS), "zscore"))
