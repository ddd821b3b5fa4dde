"""Reports and detailed profiles: R, D."""

from __future__ import annotations

from pyspark.sql import functions as F

from edaspark.operators import detail, ranks, summary
from edaspark.operators.duplicates import top_duplicates

from .cleaning import CHECKED, COPIES, EVENT_NUMBERS, LINE_NUMBERS, MISSING
from .registry import DIRTY, dirty, query, r, rounded, table


def _describe(source, columns):
    return " union all ".join(
        f"""select {i} as ordinal, '{c}' as "column", count({c}) as count, {r(f'avg({c})', 4)} as mean,
        {r(f'stddev_samp({c})', 4)} as std, {r(f'min({c})::double', 4)} as min, {r(f'quantile_cont({c}, 0.25)::double', 4)} as q25,
        {r(f'quantile_cont({c}, 0.5)::double', 4)} as q50, {r(f'quantile_cont({c}, 0.75)::double', 4)} as q75,
        {r(f'max({c})::double', 4)} as max from {source}"""
        for i, c in enumerate(columns)
    )


@query("describe_numeric", _describe("lineitem", LINE_NUMBERS))
def describe_numeric(spark, folder):
    return rounded(summary.describe_numeric(table(spark, folder, "lineitem")), 4)


DIRTY_NUMBERS = [c for c in CHECKED if c != "flag"]


@query("describe_gaps", f"{DIRTY} {_describe('dirty', DIRTY_NUMBERS)}")
def describe_gaps(spark, folder):
    return rounded(summary.describe(dirty(spark, folder)), 4)


def _time(x):
    return f"strftime(make_timestamp(cast({x} as bigint)), '%Y-%m-%d %H:%M:%S.%f')"


@query(
    "describe_time",
    f"""with m as (select epoch_us(ts) as t from events), s as (select list_sort(list(t)) as l, count(*) as n from m),
    a as (select n, l, cast(sum(t) as hugeint) as total, min(t) as lo, max(t) as hi from s, m group by n, l)
    select 0 as ordinal, 'ts' as "column", n as count, {_time('total // n')} as mean, {_time('lo')} as min,
      {', '.join(
        f"{_time(f'floor(l[cast(floor((n-1)*{p}) as int)+1] + (l[cast(ceil((n-1)*{p}) as int)+1] - l[cast(floor((n-1)*{p}) as int)+1]) * ((n-1)*{p} - floor((n-1)*{p})))')} as {c}"
        for p, c in ((0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75'))
      )}, {_time('hi')} as max from a""",
)
def describe_time(spark, folder):
    found = summary.describe_time(table(spark, folder, "events"))
    times = ("mean", "min", "q25", "q50", "q75", "max")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in times})


MIXED = ("event_id", "user_id", "ts", "value")


@query(
    "describe_mixed",
    f"""with m as (select epoch_us(ts) as t from events), s as (select list_sort(list(t)) as l, count(*) as n from m),
    a as (select n, l, cast(sum(t) as hugeint) as total, min(t) as lo, max(t) as hi from s, m group by n, l)
    select * replace (cast(case "column" when 'event_id' then 0 when 'user_id' then 1 else 3 end as int) as ordinal),
      null as time_mean, null as time_min, null as time_q25, null as time_q50, null as time_q75, null as time_max
    from ({_describe('events', [c for c in MIXED if c != 'ts'])})
    union all select 2, 'ts', n, null, null, null, null, null, null, null, {_time('total // n')}, {_time('lo')},
      {', '.join(
        _time(f'floor(l[cast(floor((n-1)*{p}) as int)+1] + (l[cast(ceil((n-1)*{p}) as int)+1] - l[cast(floor((n-1)*{p}) as int)+1]) * ((n-1)*{p} - floor((n-1)*{p})))')
        for p in (0.25, 0.5, 0.75)
      )}, {_time('hi')} from a""",
)
def describe_mixed(spark, folder):
    """Numbers and times of one table, in column order."""
    found = rounded(summary.describe(table(spark, folder, "events", *MIXED)), 4)
    times = [f"time_{s}" for s in summary.TIME_STATS]
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in times})


def _categories(source, columns):
    return " union all ".join(
        f"""select {i} as ordinal, '{c}' as "column", count({c}) as count, count(distinct {c}) as "unique",
        (select {c} from {source} where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as top,
        (select count(*) from {source} where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as freq from {source}"""
        for i, c in enumerate(columns)
    )


@query("describe_category", _categories("part", ("p_name", "p_brand", "p_type")))
def describe_category(spark, folder):
    return summary.describe(table(spark, folder, "part", "p_name", "p_brand", "p_type"))


def corr_sql(source, columns, digits=6):
    cell = "case when isnan({0}) then null else {0} end"
    return " union all ".join(
        f"select '{a}' as x, '{b}' as y, {r(cell.format(f'corr({a}, {b})'), digits)} as r from {source}"
        for a in columns
        for b in columns
    )


@query("correlation", corr_sql("lineitem", LINE_NUMBERS))
def correlation(spark, folder):
    return rounded(summary.correlation_table(table(spark, folder, "lineitem")))


WITH_FLAG = """, flagged as (select q, tax, price, l_discount, l_linenumber, l_discount > 0.05 as high, 0.1::double as same from dirty)"""


@query("correlation_gaps", f"{DIRTY}{WITH_FLAG} {corr_sql('(select * replace (high::int::double as high) from flagged)', ('q', 'tax', 'price', 'l_discount', 'l_linenumber', 'high', 'same'))}")
def correlation_gaps(spark, folder):
    """Pairwise-complete pairs, a boolean, and a constant column."""
    df = dirty(spark, folder).selectExpr("q", "tax", "price", "l_discount", "l_linenumber", "l_discount > 0.05 as high", "0.1D as same")
    return rounded(summary.correlation_table(df))


GAPS = tuple(f"x{k}" for k in range(32))
GAPS_SQL = ", ".join(f"case when (l_orderkey + {k}) % {3 + k} = 0 then null else l_quantity * {k % 5} + l_partkey % {7 + k} end as x{k}" for k in range(32))


@query("correlation_wide_gaps", f"with w as (select {GAPS_SQL} from lineitem) {corr_sql('w', GAPS)}")
def correlation_wide_gaps(spark, folder):
    """32 columns that each have gaps of their own: 528 pairs."""
    return rounded(summary.correlation_table(table(spark, folder, "lineitem", *GAPS_SQL.split(", "))))


@query("missing", f'{DIRTY} select ordinal, "column", missing, {r("100.0 * missing / n")} as percent from ({MISSING})')
def missing(spark, folder):
    return rounded(summary.Report(dirty(spark, folder)).missing())


@query(
    "insights",
    f"""{DIRTY}, d as (select *, l_orderkey * 2.0 + l_linenumber as doubled from dirty), c as ({MISSING}),
    t as (select 0 as kind_order, ordinal as sub, 'missing' as kind, printf('Column ''%s'' has %.2f%% missing values', "column", 100.0 * missing / n) as message
      from c where missing > 0
    union all select 1, 0, 'correlation', 'Strong correlation between ''doubled'' and ''l_orderkey''' from d having abs(corr(doubled, l_orderkey)) > 0.8
    union all select 2, 0, 'duplicates', 'Dataset contains ' || n || ' duplicate rows' from (select {COPIES} as n) where n > 0)
    select cast(row_number() over (order by kind_order, sub) - 1 as int) as ordinal, kind, message from t""",
)
def insights(spark, folder):
    df = dirty(spark, folder).withColumn("doubled", F.col("l_orderkey") * 2.0 + F.col("l_linenumber"))
    return summary.Report(df).insights()


@query(
    "report_scalars",
    f"""{DIRTY}, m as ({MISSING}) select max(n) as rows, cast(count(*) as int) as cols, cast(sum(missing) as bigint) as total_missing,
      {COPIES} as duplicates, (select "column" from m order by missing desc, ordinal limit 1) as top_missing,
      {r('max(100.0 * missing / n)')} as top_missing_val from m""",
)
def report_scalars(spark, folder):
    return rounded(summary.Report(dirty(spark, folder)).scalars())


@query(
    "overview",
    """select ordinal, "column", type, (select count(*) from part) as rows, 6 as cols from (values (0, 'p_partkey', 'bigint'),
      (1, 'p_name', 'string'), (2, 'p_brand', 'string'), (3, 'p_type', 'string'), (4, 'p_size', 'int'),
      (5, 'p_retailprice', 'double')) as t(ordinal, "column", type)""",
)
def overview(spark, folder):
    return summary.Report(table(spark, folder, "part")).overview()


@query(
    "variables",
    f"{DIRTY} "
    + " union all ".join(
        f"""select {i} as ordinal, '{c}' as "column", '{'text' if c == 'flag' else 'numeric'}' as kind, count({c}) as n,
        count(*) - count({c}) as missing, {r(f'100.0 * (count(*) - count({c})) / count(*)')} as missing_pct,
        count(distinct {c}) as "distinct", {r(f'100.0 * count(distinct {c}) / count({c})')} as distinct_pct,
        (select count(*) from (select {c} from dirty where {c} is not null group by {c} having count(*) = 1)) as "unique",
        count(distinct {c}) = 1 as constant from dirty"""
        for i, c in enumerate(CHECKED)
    ),
)
def variables(spark, folder):
    return rounded(detail.Detail(dirty(spark, folder)).variables())


def _numeric_detail(source, c):
    skew = f"skewness({c}) * (count({c}) - 2) / sqrt(count({c})::double * (count({c}) - 1))"
    quantiles = ", ".join(f"{r(f'quantile_cont({c}, {p})::double', 4)} as {n}" for p, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95")))
    return f"""select '{c}' as "column", count({c}) as n, {r(f'avg({c})', 4)} as mean, {r(f'stddev_samp({c})', 4)} as std,
      {r(f'var_samp({c})', 4)} as variance, {r(f'stddev_samp({c}) / avg({c})', 4)} as cv, {r(f'sum({c})::double', 4)} as sum,
      {r(f'min({c})::double', 4)} as min, {quantiles}, {r(f'max({c})::double', 4)} as max, {r(f'(max({c}) - min({c}))::double', 4)} as range,
      {r(f'(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))::double', 4)} as iqr,
      {r(f'(select quantile_cont(abs({c} - m), 0.5) from {source}, (select quantile_cont({c}, 0.5) as m from {source}))::double', 4)} as mad,
      {r(skew, 4)} as skewness, {r(f'kurtosis_pop({c})', 4)} as kurtosis,
      count(*) filter ({c} = 0) as zeros, count(*) filter ({c} < 0) as negatives from {source}"""


@query("numeric_detail", " union all ".join(_numeric_detail("events", c) for c in EVENT_NUMBERS))
def numeric_detail(spark, folder):
    return rounded(detail.numeric_detail(table(spark, folder, "events")), 4)


def top_sql(source, columns, k, percent=True):
    share = f", {r(f'100.0 * n / total')} as percent" if percent else ""
    return " union all ".join(
        f"""select '{c}' as "column", cast(rank as int) as rank, value, n{share} from (
        select cast({c} as varchar) as value, count(*) as n, row_number() over (order by count(*) desc, cast({c} as varchar)) as rank,
        sum(count(*)) over () as total from {source} where {c} is not null group by {c}) where rank <= {k}"""
        for c in columns
    )


@query("top_values", top_sql("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 10))
def top_values(spark, folder):
    return rounded(detail.common_values(table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))


@query(
    "extremes",
    " union all ".join(
        f"""(select '{c}' as "column", '{side}' as side, cast(row_number() over (order by {c} {way}) as int) as rank, {c}::double as value, count(*) as n, cast({c} as varchar) as exact
        from events group by {c} order by {c} {way} limit 5)"""
        for c in EVENT_NUMBERS
        for side, way in (("smallest", "asc"), ("largest", "desc"))
    ),
)
def extremes(spark, folder):
    return detail.extreme_values(table(spark, folder, "events"))


@query(
    "text_lengths",
    " union all ".join(
        f"""select '{c}' as "column", count({c}) as n, cast(min(length({c})) as int) as min_length, {r(f'avg(length({c}))')} as mean_length,
        {r(f'quantile_cont(length({c}), 0.5)::double')} as median_length, cast(max(length({c})) as int) as max_length,
        count(*) filter (length({c}) = 0) as empty from documents"""
        for c in ("text", "lang", "source")
    ),
)
def text_lengths(spark, folder):
    return rounded(detail.text_detail(table(spark, folder, "documents")))


@query(
    "word_counts",
    r"""select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as word from documents)
    where word <> '' group by word""",
)
def word_counts(spark, folder):
    return detail.word_counts(table(spark, folder, "documents"), "text")


@query(
    "time_detail",
    """select 'ts' as "column", count(ts) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as min, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as max,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double as range_seconds from events""",
)
def time_detail(spark, folder):
    found = detail.time_detail(table(spark, folder, "events"))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("min", "max")})


RANKED = ("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
RANKS = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in RANKED)


@query("spearman", f"with ranked as (select {RANKS} from lineitem) {corr_sql('ranked', RANKED)}")
def spearman(spark, folder):
    return rounded(ranks.spearman(table(spark, folder, "lineitem"), RANKED))


SPARSE = ("l_quantity", "l_discount", "l_tax")
SPARSE_SQL = "l_quantity, case when l_orderkey % 3 = 0 then null else l_discount end as l_discount, case when l_partkey % 4 = 0 then null else l_tax end as l_tax"


def _rank_pair(a, b):
    rank = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0::double"
    return f"""select '{a}' as x, '{b}' as y, {r('corr(p, q)')} as r from (select {rank.format(a)} as p, {rank.format(b)} as q
      from sparse where {a} is not null and {b} is not null)"""


@query("spearman_gaps", f"with sparse as (select {SPARSE_SQL} from lineitem) " + " union all ".join(_rank_pair(a, b) for a in SPARSE for b in SPARSE))
def spearman_gaps(spark, folder):
    """Ranks of a pair are over the rows where both are present."""
    df = table(spark, folder, "lineitem", "l_quantity", "if(l_orderkey % 3 = 0, null, l_discount) as l_discount", "if(l_partkey % 4 = 0, null, l_tax) as l_tax")
    return rounded(ranks.spearman(df, SPARSE))


# Twelve columns of orders, each with gaps of its own.
MANY = {f"g{k}": (f"o_orderkey % {k + 2} = 0", ("o_custkey % 97", "o_totalprice", "o_orderkey % 1000", "o_totalprice - o_custkey")[k % 4]) for k in range(12)}
MANY_SQL = ", ".join(f"case when {gap} then null else {value} end as {c}" for c, (gap, value) in MANY.items())
MANY_PAIRS = " union all ".join(
    _rank_pair(a, b).replace("from sparse", "from many") for a in MANY for b in MANY
)


@query("spearman_many_gaps", f"with many as (select {MANY_SQL} from orders) {MANY_PAIRS}")
def spearman_many_gaps(spark, folder):
    """All pairs of twelve columns with gaps, ranked together."""
    df = table(spark, folder, "orders", *[f"if({gap}, null, {value}) as {c}" for c, (gap, value) in MANY.items()])
    return rounded(ranks.spearman(df, list(MANY)))


@query(
    "average_ranks",
    "select l_extendedprice as value, count(*) as n, rank() over (order by l_extendedprice) * 0 + sum(count(*)) over (order by l_extendedprice) - (count(*) - 1) / 2.0::double as rank from lineitem group by l_extendedprice",
)
def average_ranks(spark, folder):
    """Ranks by slices small enough that a table of this size needs several."""
    return ranks.average_ranks(table(spark, folder, "lineitem"), "l_extendedprice", slice_rows=5_000)


def _cramers(source, a, b):
    return f"""select '{a}' as x, '{b}' as y, {r('sqrt((sum(n * n::double / na / nb) - 1) / (least(max(ka), max(kb)) - 1))')} as v from (
      select n, sum(n) over (partition by {a}) as na, sum(n) over (partition by {b}) as nb,
      (select count(distinct {a}) from {source}) as ka, (select count(distinct {b}) from {source}) as kb
      from (select {a}, {b}, count(*) as n from {source} group by {a}, {b}))"""


@query("cramers_v", " union all ".join(_cramers("part", a, b) for a, b in (("p_brand", "p_name"), ("p_type", "p_name"), ("p_type", "p_brand"))))
def cramers_v(spark, folder):
    return rounded(ranks.cramers_v(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"]))


GAPPY = ("q", "tax", "price", "flag")
FLAGS = ", ".join(f"({c} is null)::int::double as {c}" for c in GAPPY)


@query("nullity_corr", f"{DIRTY}, flags as (select {FLAGS} from dirty) {corr_sql('flags', GAPPY)}")
def nullity_corr(spark, folder):
    return rounded(detail.nullity_correlation(dirty(spark, folder)))


GROUPS = f"{DIRTY} select *, count(*) as copies from dirty group by all having count(*) > 1"


@query("duplicate_groups", GROUPS)
def duplicate_groups(spark, folder):
    from edaspark.operators.duplicates import duplicate_groups

    return duplicate_groups(dirty(spark, folder))


@query("top_duplicates", f"{GROUPS} order by copies desc, " + ", ".join(f"{c} nulls first" for c in CHECKED) + " limit 10")
def top_duplicate_rows(spark, folder):
    return top_duplicates(dirty(spark, folder))


@query("sample_last", "select * replace (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts) from events order by event_id desc limit 5")
def sample_last(spark, folder):
    found = detail.sample(table(spark, folder, "events"), ["event_id"], last=True)
    return found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "alerts",
    f"""{DIRTY}, a as (select *, 1 as one from dirty), m as ({MISSING}),
    z as ({' union all '.join(f"select '{c}' as c, 100.0 * count(*) filter ({c} = 0) / count({c}) as zeros, skewness({c}) * (count({c}) - 2) / sqrt(count({c})::double * (count({c}) - 1)) as skew from a" for c in DIRTY_NUMBERS)})
    select 'one' as "column", 'constant' as alert, 1.0::double as value
    union all select "column", 'missing', {r('100.0 * missing / n')} from m where missing > 0
    union all select c, 'zeros', {r('zeros')} from z where zeros > 10
    union all select c, 'skewed', {r('skew')} from z where abs(skew) > 2
    union all select null, 'duplicates', n::double from (select {COPIES} as n) where n > 0""",
)
def alerts(spark, folder):
    return rounded(detail.Detail(dirty(spark, folder).withColumn("one", F.lit(1))).alerts())


@query(
    "alerts_keys",
    f"""with a as (select o_orderkey, 2 * o_orderkey as twice, 'c' || o_custkey as customer from orders)
    select c as "column", 'unique' as alert, count(*)::double as value from orders, (values ('o_orderkey'), ('twice')) as t(c) group by c
    union all select 'customer', 'high_cardinality', count(distinct customer)::double from a
    union all select c, 'high_correlation', {r('corr(o_orderkey, twice)')} from a, (values ('o_orderkey'), ('twice')) as t(c) group by c""",
)
def alerts_keys(spark, folder):
    """The alerts that keys and copies of columns raise."""
    orders = table(spark, folder, "orders", "o_orderkey", "2 * o_orderkey as twice", "concat('c', o_custkey) as customer")
    return rounded(detail.Detail(orders).alerts())
