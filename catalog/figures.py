"""Chart tables and the pipeline: C, E."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edaspark.charts import categories, dashboard, density, histogram, missing, pairs
from edaspark.common import shared_folder, small_frame
from edaspark.plans import pipeline, report, reuse, sinks

from .cleaning import HANDLED, _fences
from .profiles import _describe, corr_sql, top_sql
from .registry import DIRTY, ORACLES, dirty, query, r, rounded, table


def _facts(source, value, keys):
    by = f"group by {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""select {head}count({value}) as n, min({value})::double as lo, max({value})::double as hi, stddev_samp({value}) as std,
      quantile_cont({value}, 0.25)::double as q1, quantile_cont({value}, 0.75)::double as q3 from {source} where {value} is not null {by}"""


def _sized(facts, whole="false"):
    return f"""select *, case when bins = 1 and hi = lo then 1.0 else (hi - lo) / bins end as width, case when hi = lo then lo - 0.5 else lo end as start from (
      select *, case when hi = lo or rule <= 0 then 1 else ceil((hi - lo) / rule) end::bigint as bins from (
      select * replace (case when {whole} and rule < 1 and rule > 0 then 1.0 else rule end as rule) from (
      select *, least(greatest(2 * (q3 - q1) * pow(n::double, -1/3::double), (hi - lo) / sqrt(n::double) / 2), (hi - lo) / (log2(n::double) + 1)) as rule
      from {facts})))"""


def _hist(long, sized, keys):
    """Histogram of a long table ``(keys, v)`` with one row of ``sized`` per key."""
    k = ", ".join(keys)
    on = " and ".join(f"a.{x} = b.{x}" for x in keys)
    return f"""select {', '.join(f'b.{x}' for x in keys)}, b.bin, {r('b.start + b.bin * b.width')} as "left", {r('b.start + b.bin * b.width + b.width')} as "right",
      coalesce(c, 0)::bigint as count from (select *, unnest(range(bins)) as bin from {sized}) b left join (
        select {k}, bin, count(*) as c from (select {', '.join(f'a.{x}' for x in keys)}, least(floor((v - start) / width), bins - 1)::bigint as bin
        from {long} a join {sized} b on {on}) group by {k}, bin) a on {on} and a.bin = b.bin"""


def _curve(long, sized, keys, points, extend, digits=9):
    on = " and ".join(f"a.{x} = b.{x}" for x in keys)
    k = ", ".join(f"b.{x}" for x in keys)
    return f"""select {k}, b.point, any_value(b.x) as x, sum(exp(-0.5 * pow((b.x - a.v) / b.h, 2))) / (any_value(b.n) * any_value(b.h) * sqrt(2 * pi())) as density,
      any_value(b.n * b.width) as area from (
      select *, lo - {extend} * h + point * ((hi - lo + 2 * {extend} * h) / {points - 1}) as x from (
      select *, std * pow(n::double, -0.2) as h, unnest(range({points}))::int as point from {sized}) where hi > lo) b
      join {long} a on {on} group by {k}, b.point"""


EVENT_LONG = "ev as (select 'value' as col, value::double as v from events), sized as ({})"
EVENT_SIZED = _sized(f"({_facts('ev', 'v', 'col')})")
HIST_COLUMNS = ("l_quantity", "l_extendedprice", "l_linenumber", "l_partkey")
LINE_LONG = "ln as (" + " union all ".join(f"select '{c}' as col, {c}::double as v from lineitem" for c in HIST_COLUMNS) + ")"
INTEGERS = "col in ('l_linenumber', 'l_partkey')"


@query(
    "histogram",
    f"""with {LINE_LONG}, sized as ({_sized(f"({_facts('ln', 'v', 'col')})", INTEGERS)})
    select col as "column", * exclude (col) from ({_hist('ln', 'sized', ['col'])})""",
)
def histogram_auto(spark, folder):
    return rounded(histogram.histogram(table(spark, folder, "lineitem"), HIST_COLUMNS))


@query(
    "histogram_fixed",
    f"""with {EVENT_LONG.format("select *, 50::bigint as bins, (hi - lo) / 50 as width, lo as start from (" + _facts('ev', 'v', 'col') + ")")}
    select col as "column", * exclude (col) from ({_hist('ev', 'sized', ['col'])})""",
)
def histogram_fixed(spark, folder):
    return rounded(histogram.histogram(table(spark, folder, "events"), ["value"], 50))


@query(
    "kde",
    f"""with {EVENT_LONG.format(EVENT_SIZED)} select col as "column", point, {r('x')} as x, {r('density', 9)} as density, {r('density * area')} as y
    from ({_curve('ev', 'sized', ['col'], 200, 0)})""",
)
def kde(spark, folder):
    found = density.kde(table(spark, folder, "events"), ["value"])
    return found.select("column", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"), F.round("y", 6).alias("y"))


@query("value_counts", top_sql("orders", ("o_orderstatus", "o_orderpriority"), 10, percent=False))
def value_counts(spark, folder):
    return categories.bars(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


PANELS = (("event_id", "num"), ("user_id", "num"), ("value", "num"), ("ts", "cat"), ("event_type", "cat"), ("props", "cat"))
DASH_LONG = "ev as (" + " union all ".join(f"select '{c}' as col, {c}::double as v from events" for c, k in PANELS if k == "num") + ")"


@query(
    "dashboard",
    f"""with {DASH_LONG}, sized as ({_sized(f"({_facts('ev', 'v', 'col')})", "col in ('event_id', 'user_id')")}),
    series as (select col, 'histogram' as series, bin::bigint as position, null as label, "left" as x, count::double as y from ({_hist('ev', 'sized', ['col'])})
      union all select col, 'kde', point::bigint, null, x, density * area from ({_curve('ev', 'sized', ['col'], 200, 0)})
      union all select "column", 'bar', rank::bigint, value, null, n::double from ({top_sql('events', ('ts', 'event_type', 'props'), 10, percent=False)})),
    panels as (select * from (values {', '.join(f"({i}, {i // 3}, {i % 3}, '{c}', '{k}')" for i, (c, k) in enumerate(PANELS))}) as t(panel, grid_row, grid_col, col, role))
    select panel, grid_row, grid_col, col as "column", role, series, position, label, {r('x', 4)} as x, {r('y', 4)} as y from panels join series using (col)""",
)
def dashboard_tables(spark, folder):
    return rounded(dashboard.dashboard(table(spark, folder, "events")), 4)


@query(
    "missing_matrix",
    f"{DIRTY} select l_orderkey, l_linenumber, (q is null)::int as q, (tax is null)::int as tax, (price is null)::int as price, (flag is null)::int as flag from dirty",
)
def missing_matrix(spark, folder):
    return missing.missing_matrix(dirty(spark, folder), ["l_orderkey", "l_linenumber"])


@query(
    "missing_blocks",
    f"""{DIRTY}, e as (select min(l_orderkey)::double as lo, (max(l_orderkey) - min(l_orderkey))::double / 100 as w from dirty),
    placed as (select least(floor((l_orderkey - lo) / w), 99)::int as block, q, tax, price, flag from dirty, e)
    select *, {r('missing / rows')} as share from ("""
    + " union all ".join(
        f"""select block, '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing from placed group by block"""
        for c in ("q", "tax", "price", "flag")
    )
    + ")",
)
def missing_blocks(spark, folder):
    return rounded(missing.missing_blocks(dirty(spark, folder), "l_orderkey"))


@query("corr_cells", corr_sql("events", ("event_id", "user_id", "value")))
def corr_cells(spark, folder):
    return rounded(pairs.heatmap(table(spark, folder, "events")))


@query("scatter2d", "select p_size, p_retailprice, p_type, p_partkey, p_name, p_brand from part")
def scatter2d(spark, folder):
    return pairs.scatter(table(spark, folder, "part"), ["p_size", "p_retailprice"], "p_type")


@query("scatter3d", "select l_quantity, l_extendedprice, l_discount, l_returnflag from lineitem")
def scatter3d(spark, folder):
    return pairs.scatter(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag", hover=False)


@query("scatter_traces", "select l_returnflag as name, count(*) as points from lineitem group by l_returnflag")
def scatter_traces(spark, folder):
    return pairs.traces(table(spark, folder, "lineitem"), "l_returnflag")


@query("joint_points", f"{DIRTY} select price, tax from dirty where price is not null and tax is not null")
def joint_points(spark, folder):
    return pairs.joint_points(dirty(spark, folder), "price", "tax")


JOINT_LONG = """both_set as (select price, tax from dirty where price is not null and tax is not null),
ln as (select 'price' as col, price as v from both_set union all select 'tax', tax from both_set)"""


@query(
    "joint_marginals",
    f"""{DIRTY}, {JOINT_LONG}, sized as ({_sized(f"({_facts('ln', 'v', 'col')})")})
    select col as "column", * exclude (col) from ({_hist('ln', 'sized', ['col'])})""",
)
def joint_marginals(spark, folder):
    return rounded(pairs.joint(dirty(spark, folder), "price", "tax")["marginals"])


def _side(c):
    return f"""least(50, case when quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) then floor(sqrt(count(*)))
      else ceil((max({c}) - min({c})) / (2 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / pow(count(*), 1/3::double))) end)"""


@query(
    "hexbin",
    f"""with g as (select floor(({_side('l_quantity')} + {_side('l_extendedprice')}) / 2) as nx, min(l_quantity) as xa, max(l_quantity) as xb,
      min(l_extendedprice) as ya, max(l_extendedprice) as yb from lineitem),
    p as (select xa - 1e-9 * (xb - xa) as x0, (xb - xa + 2e-9 * (xb - xa)) / nx as sx, ya - 1e-9 * (yb - ya) as y0,
      (yb - ya + 2e-9 * (yb - ya)) / floor(nx / sqrt(3)) as sy from g),
    u as (select (l_quantity - x0) / sx as u, (l_extendedprice - y0) / sy as v, x0, sx, y0, sy from lineitem, p),
    c as (select *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) as one from u),
    d as (select case when one then round_even(u, 0) else floor(u) + 0.5 end as a, case when one then round_even(v, 0) else floor(v) + 0.5 end as b, x0, sx, y0, sy from c)
    select {r('x0 + a * sx')} as cx, {r('y0 + b * sy')} as cy, count(*) as count from d group by a, b, x0, sx, y0, sy""",
)
def hexbin(spark, folder):
    return rounded(pairs.hexbin(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "kde2d",
    """with s as (select count(*) as n, var_samp(p_size) * pow(count(*), -1/3::double) as a, var_samp(p_retailprice) * pow(count(*), -1/3::double) as c,
      covar_samp(p_size, p_retailprice) * pow(count(*), -1/3::double) as b, min(p_size)::double as x0, max(p_size)::double as x1,
      min(p_retailprice) as y0, max(p_retailprice) as y1 from part),
    g as (select *, a * c - b * b as det, ix::int as i, iy::int as j, x0 + ix * (x1 - x0) / 49 as gx, y0 + iy * (y1 - y0) / 49 as gy
      from s, range(50) t(ix), range(50) u(iy))
    select i as ix, j as iy, round(gx, 6) as x, round(gy, 6) as y, round(sum(exp(-0.5 * (c / det * pow(gx - p_size, 2) - 2 * b / det * (gx - p_size) * (gy - p_retailprice)
      + a / det * pow(gy - p_retailprice, 2)))) / any_value(n * 2 * pi() * sqrt(det)), 9) + 0.0 as density from g, part group by i, j, gx, gy""",
)
def kde2d(spark, folder):
    found = density.kde2d(table(spark, folder, "part"), "p_size", "p_retailprice")
    return found.select("ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("density", 9).alias("density"))


@query(
    "regression",
    f"""with s as (select count(*) as n, regr_slope(l_extendedprice, l_quantity) as k, regr_intercept(l_extendedprice, l_quantity) as c,
      regr_r2(l_extendedprice, l_quantity) as r2, regr_sxx(l_extendedprice, l_quantity) as sxx, regr_syy(l_extendedprice, l_quantity) as syy,
      avg(l_quantity) as mx, min(l_quantity) as x0, max(l_quantity) as x1 from lineitem),
    p as (select *, point::int as i, x0 + (x1 - x0) * point / 99 as x, sqrt((syy - k * k * sxx) / (n - 2)) as e from s, range(100) t(point)),
    h as (select *, c + k * x as fit, 1.959963984540054 * e * sqrt(1.0::double / n + pow(x - mx, 2) / sxx) as half from p)
    select i as point, {r('x')} as x, {r('fit', 4)} as fit, {r('fit - half', 4)} as lower, {r('fit + half', 4)} as upper,
      {r('k', 5)} as slope, {r('c', 4)} as intercept, {r('r2')} as r2 from h""",
)
def regression(spark, folder):
    found = pairs.regression(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    digits = {"x": 6, "fit": 4, "lower": 4, "upper": 4, "slope": 5, "intercept": 4, "r2": 6}
    return found.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


@query("stacked", "select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by all")
def stacked(spark, folder):
    return categories.stacked(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "stacked_share",
    f"""{DIRTY} select flag as a, l_linenumber as b, count(*) as n, {r('count(*) / sum(count(*)) over (partition by flag)')} as share
    from dirty where flag is not null group by flag, l_linenumber""",
)
def stacked_share(spark, folder):
    return rounded(categories.stacked(dirty(spark, folder), "flag", "l_linenumber", normalize=True))


@query(
    "crosstab",
    """select quality as a, count(*) filter (toxic = 0) as "0", count(*) filter (toxic = 1) as "1" from labels
    where quality is not null and toxic is not null group by quality""",
)
def crosstab(spark, folder):
    return categories.crosstab_wide(table(spark, folder, "labels"), "quality", "toxic")


@query("crosstab_same", "select o_orderstatus as a, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') as \"{s}\"" for s in "FOP") + " from orders group by o_orderstatus")
def crosstab_same(spark, folder):
    return categories.crosstab_wide(table(spark, folder, "orders"), "o_orderstatus", "o_orderstatus")


@query(
    "violin_box",
    f"""with f as (select l_returnflag as category, count(*) as n, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as median,
      quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by l_returnflag)
    select category, n, {r('q1')} as q1, {r('median')} as median, {r('q3')} as q3, min(l_extendedprice) filter (l_extendedprice >= q1 - 1.5 * (q3 - q1)) as whisker_low,
      max(l_extendedprice) filter (l_extendedprice <= q3 + 1.5 * (q3 - q1)) as whisker_high from f join lineitem on l_returnflag = category group by category, n, q1, median, q3""",
)
def violin_box(spark, folder):
    return rounded(categories.violin_box(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag"))


EVENT_TYPES = f"""with ev as (select event_type as category, value as v from events), sized as ({_sized(f"({_facts('ev', 'v', 'category')})")})"""


@query("violin_density", f"{EVENT_TYPES} select category, point, {r('x')} as x, {r('density', 9)} as density from ({_curve('ev', 'sized', ['category'], 100, 2)})")
def violin_density(spark, folder):
    found = categories.violin_density(table(spark, folder, "events"), "value", "event_type")
    return found.select("category", "point", (F.round("x", 6) + F.lit(0.0)).alias("x"), F.round("density", 9).alias("density"))


# Seven categories and seven columns: one of each is over the limit of six.
FACET_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey")
FACET_TOP = "select l_linenumber from lineitem group by l_linenumber order by count(*) desc, l_linenumber limit 6"
FACET_LONG = f"""with kept as (select * from lineitem where l_linenumber in ({FACET_TOP})),
ln as ({' union all '.join(f"select l_linenumber as category, '{c}' as variable, {c}::double as v from kept" for c in FACET_COLUMNS[:6])})"""


@query("facet_categories", FACET_TOP)
def facet_categories(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.filter(F.col("l_linenumber").isin(*categories.facet_categories(lines, "l_linenumber"))).select("l_linenumber").distinct()


@query("facet_melt", f'{FACET_LONG} select category as l_linenumber, variable as "Variable", v as "Value" from ln')
def facet_melt(spark, folder):
    return categories.facet_melt(table(spark, folder, "lineitem"), FACET_COLUMNS, "l_linenumber")


FACET_SIZED = _sized(f"({_facts('ln', 'v', 'category, variable')})")


@query("facet_hist", f'{FACET_LONG}, sized as ({FACET_SIZED}) select category, variable as "Variable", * exclude (category, variable) from ({_hist("ln", "sized", ["category", "variable"])})')
def facet_hist(spark, folder):
    return rounded(categories.facet_grid(table(spark, folder, "lineitem"), FACET_COLUMNS, "l_linenumber")["histogram"])


@query(
    "facet_density",
    f"""{FACET_LONG}, sized as ({FACET_SIZED}) select category, variable as "Variable", point, {r('x')} as x, {r('density', 9)} as density, {r('density * area', 4)} as y
    from ({_curve('ln', 'sized', ['category', 'variable'], 200, 0)})""",
)
def facet_density(spark, folder):
    found = categories.facet_grid(table(spark, folder, "lineitem"), FACET_COLUMNS, "l_linenumber")["density"]
    return found.select("category", "Variable", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"), F.round("y", 4).alias("y"))


def _drawn(key):
    return f"md5(concat_ws('|', '7', cast({key} as varchar)))"


@query(
    "scatter_limited",
    f"""select l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice from lineitem qualify
      row_number() over (partition by l_returnflag order by md5(concat_ws('|', '7', cast(l_orderkey as varchar), cast(l_linenumber as varchar)))) <= 200""",
)
def scatter_limited(spark, folder):
    """C6 with a limit: of each colour, the points with the smallest keyed hashes."""
    df = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return pairs.scatter(df, ["l_quantity", "l_extendedprice"], "l_returnflag", max_points=200, key=["l_orderkey", "l_linenumber"], seed=7)


@query(
    "scatter3d_limited",
    f"select o_orderkey, o_custkey, o_totalprice from orders order by {_drawn('o_orderkey')} limit 300",
)
def scatter3d_limited(spark, folder):
    df = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return pairs.scatter(df, ["o_orderkey", "o_custkey", "o_totalprice"], hover=False, max_points=300, key=["o_orderkey"], seed=7)


@query(
    "bubble_limited",
    f"""with s as (select least(min(c_acctbal), 0) as shift, (max(c_acctbal) - least(min(c_acctbal), 0)) / 3600 as sizeref from customer),
    few as (select * from customer qualify row_number() over (partition by c_mktsegment order by {_drawn('c_custkey')}) <= 50)
    select c_custkey, c_nationkey, c_mktsegment, c_name, c_acctbal as size_raw, {r('c_acctbal - shift')} as size, {r('sizeref')} as sizeref from few, s""",
)
def bubble_limited(spark, folder):
    df = table(spark, folder, "customer")
    return rounded(pairs.bubble(df, "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", max_points=50, key=["c_custkey"], seed=7))


@query(
    "bubble",
    f"""with s as (select least(min(c_acctbal), 0) as shift, (max(c_acctbal) - least(min(c_acctbal), 0)) / 3600 as sizeref from customer)
    select c_custkey, c_nationkey, c_mktsegment, c_name, c_acctbal as size_raw, {r('c_acctbal - shift')} as size, {r('sizeref')} as sizeref from customer, s""",
)
def bubble(spark, folder):
    return rounded(pairs.bubble(table(spark, folder, "customer"), "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))


CLEAN_COLUMNS = ("l_orderkey", "l_linenumber", "tax", "price", "l_discount")
CLEAN = f"{HANDLED}, tidy as (select distinct * from handled)"


def _cap(c):
    low = f"(select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from tidy)"
    high = f"(select quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from tidy)"
    return f"{r(f'case when {c} < {low} then {low} when {c} > {high} then {high} else {c}::double end')} as {c}"


@query("pipeline_clean", f"{CLEAN} select {', '.join(_cap(c) for c in CLEAN_COLUMNS)}, flag from tidy")
def pipeline_clean(spark, folder):
    return rounded(pipeline.clean(dirty(spark, folder), narrowing=False))


@query(
    "pipeline_narrowed",
    f"""{CLEAN}, capped as (select {', '.join(_cap(c) for c in CLEAN_COLUMNS)}, flag from tidy) """
    + " union all ".join(
        f"""select '{c}' as "column", case when max(abs({c} - {c}::float::double)) <= 5e-4 then 'float' else 'double' end as type from capped"""
        for c in CLEAN_COLUMNS
    )
    + " union all select 'flag', 'string'",
)
def pipeline_narrowed(spark, folder):
    """Types in which the clean table is stored."""
    return small_frame(spark, pipeline.clean(dirty(spark, folder)).dtypes, "column string, type string")


@query(
    "stage_counts",
    f"""{CLEAN} select 'loaded' as stage, (select count(*) from dirty) as rows, 7 as cols
    union all select 'cleaned', (select count(*) from tidy), 6""",
)
def stage_counts(spark, folder):
    return pipeline.run(dirty(spark, folder)).stages


CAPPED = f"{CLEAN}, capped as (select {', '.join(_cap(c) for c in CLEAN_COLUMNS)}, flag from tidy)"
FULL_COLUMNS = ("l_orderkey", "l_linenumber", "tax", "price", "flag", "l_discount")
CAPPED_GAPS = " union all ".join(f"select {i} as ordinal, '{c}' as \"column\", count(*) - count({c}) as missing, count(*) as n from capped" for i, c in enumerate(FULL_COLUMNS))
CAPPED_COPIES = "(select count(*) from capped) - (select count(*) from (select distinct * from capped))"


@query("pipeline_report", f"{CAPPED} {corr_sql('capped', CLEAN_COLUMNS)}")
def pipeline_report(spark, folder):
    """E1's correlations on the clean table."""
    return rounded(pipeline.run(dirty(spark, folder)).report["correlation"])


@query("pipeline_issues", ORACLES["issue_report"])
def pipeline_issues(spark, folder):
    return pipeline.run(dirty(spark, folder)).issues


@query("pipeline_null_plan", ORACLES["null_plan"])
def pipeline_null_plan(spark, folder):
    return rounded(pipeline.run(dirty(spark, folder)).null_plan)


@query("pipeline_iqr_outliers", f"{CLEAN} " + " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} < {_fences(c, 'tidy')[0]} or {c} > {_fences(c, 'tidy')[1]}) as outliers from tidy" for c in CLEAN_COLUMNS))
def pipeline_iqr_outliers(spark, folder):
    return pipeline.run(dirty(spark, folder)).iqr_outliers


@query("pipeline_zscore_outliers", f"{CLEAN} " + " union all ".join(f"select '{c}' as \"column\", count(*) filter (abs(({c} - (select avg({c}) from tidy)) / (select stddev_samp({c}) from tidy)) > 3) as outliers from tidy" for c in CLEAN_COLUMNS))
def pipeline_zscore_outliers(spark, folder):
    return pipeline.run(dirty(spark, folder)).zscore_outliers


@query("pipeline_summary", f"{CAPPED} {_describe('capped', CLEAN_COLUMNS)}")
def pipeline_summary(spark, folder):
    return rounded(pipeline.run(dirty(spark, folder)).report["summary"], 4)


@query("pipeline_missing", f'{CAPPED} select ordinal, "column", missing, {r("100.0 * missing / n")} as percent from ({CAPPED_GAPS})')
def pipeline_missing(spark, folder):
    return rounded(pipeline.run(dirty(spark, folder)).report["missing"])


@query(
    "pipeline_scalars",
    f"""{CAPPED}, m as ({CAPPED_GAPS}) select max(n) as rows, cast(count(*) as int) as cols, cast(sum(missing) as bigint) as total_missing,
      {CAPPED_COPIES} as duplicates, (select "column" from m order by missing desc, ordinal limit 1) as top_missing,
      {r('max(100.0 * missing / n)')} as top_missing_val from m""",
)
def pipeline_scalars(spark, folder):
    return rounded(pipeline.run(dirty(spark, folder)).report["scalars"])


@query(
    "pipeline_insights",
    f"""{CLEAN} select 0 as ordinal, 'correlation' as kind, 'Strong correlation between ''doubled'' and ''l_orderkey''' as message
    from tidy having abs(corr(l_orderkey * 2.0 + l_linenumber, l_orderkey)) > 0.8""",
)
def pipeline_insights(spark, folder):
    """A table without gaps or copies is left with what correlates."""
    df = dirty(spark, folder).withColumn("doubled", F.col("l_orderkey") * 2.0 + F.col("l_linenumber"))
    return pipeline.run(df).report["insights"]


@query(
    "stage_tables",
    """select 'raw' as stage, true as found, (select count(*) from orders) as rows, false as found_after_drop
    union all select 'clean', true, (select count(*) from orders where o_orderkey % 2 = 0), false""",
)
def stage_tables(spark, folder):
    """Save, load and drop the tables of two stages."""
    orders, rows = table(spark, folder, "orders"), []
    for stage, df in (("raw", orders), ("clean", orders.filter("o_orderkey % 2 = 0"))):
        name = f"stage_{stage}_{uuid.uuid4().hex}"
        sinks.save_stage(df, name)
        kept = sinks.load_stage(spark, name)
        n = kept.count()
        sinks.drop_stage(spark, name)
        rows.append((stage, kept is not None, n, sinks.load_stage(spark, name) is not None))
    return small_frame(spark, rows, "stage string, found boolean, rows bigint, found_after_drop boolean")


EVENT_COLUMNS = {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}
EVENT_NUMBERS = [c for c, kind in EVENT_COLUMNS.items() if kind == "number"]
EVENT_ALERTS = " union all ".join(
    [f"select '{c}' as c, 'unique' as alert from events having count(*) > 1 and count(distinct {c}) = count(*)" for c in EVENT_COLUMNS]
    + [f"select '{c}', 'constant' from events having count(distinct {c}) = 1" for c in EVENT_COLUMNS]
    + [f"select '{c}', 'missing' from events having count({c}) < count(*)" for c in EVENT_COLUMNS]
    + [f"select '{c}', 'high_cardinality' from events having count(distinct {c}) > 50" for c, kind in EVENT_COLUMNS.items() if kind == "text"]
    + [f"select '{c}', 'zeros' from events having count(*) filter ({c} = 0) > 0.1 * count({c})" for c in EVENT_NUMBERS]
    + [f"select '{c}', 'skewed' from events having abs(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::double * (count({c}) - 1))) > 2" for c in EVENT_NUMBERS]
    + [
        f"select '{c}', 'high_correlation' from events having greatest({', '.join(f'abs(corr({c}, {d}))' for d in EVENT_NUMBERS if d != c)}) > 0.8"
        for c in EVENT_NUMBERS
    ]
    + ["select null, 'duplicates' from (select distinct * from events) having count(*) < (select count(*) from events)"]
)


@query(
    "report_written",
    f"""with sized as (select name, rows from (values ('scalars', 1), ('summary', 4), ('missing', 6), ('correlation', 9), ('variables', 6), ('nullity', 0),
      ('duplicate_groups', 0), ('numeric_detail', 3), ('spearman', 9), ('time_detail', 1), ('text_detail', 2), ('cramers_v', 1), ('sample', 5),
      ('histogram', 150)) as t(name, rows)
    union all select 'insights', count(*) from (values ('event_id', 'user_id'), ('event_id', 'value'), ('user_id', 'value')) as p(a, b)
      where abs(case when a = 'event_id' and b = 'user_id' then (select corr(event_id, user_id) from events)
        when a = 'event_id' then (select corr(event_id, value) from events) else (select corr(user_id, value) from events) end) > 0.8
    union all select 'common_values', sum(k) from ({' union all '.join(f"select least(10, count(distinct {c})) as k from events" for c in ('event_id', 'ts', 'user_id', 'event_type', 'value', 'props'))})
    union all select 'extremes', sum(k) from ({' union all '.join(f"select 2 * least(5, count(distinct {c})) as k from events" for c in ('event_id', 'user_id', 'value'))})
    union all select 'words_event_type', count(distinct w) from (select unnest(regexp_split_to_array(lower(event_type), '[^\\p{{L}}\\p{{N}}]+')) as w from events) where w <> ''
    union all select 'words_props', count(distinct w) from (select unnest(regexp_split_to_array(lower(props), '[^\\p{{L}}\\p{{N}}]+')) as w from events) where w <> ''
    union all select 'alerts', (select count(*) from ({EVENT_ALERTS})))
    select name, cast(rows as bigint) as rows from sized""",
)
def report_written(spark, folder):
    """Write the whole detailed report, and list what was written."""
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    tables = report.profile(table(spark, folder, "events"), "detailed")
    paths = sinks.write_report(tables, target)
    sizes = [(p.rsplit("/", 1)[1], spark.read.parquet(p).count()) for p in paths]
    return spark.createDataFrame(sizes, "name string, rows bigint")


@query(
    "stage_reused",
    """with t as (select count(*) as n, sum(o_custkey) as total from orders where o_orderkey % 2 = 0)
    select call, made, n, cast(total as bigint) as total from t, (values ('first', true), ('again', false), ('other', true)) as c(call, made)
    union all select 'appended', true, 2 * n, cast(2 * total as bigint) from t""",
)
def stage_reused(spark, folder):
    """A stage is made once for the same plan over the same files, and anew when the plan or a file changes."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    orders.write.parquet(f"{at}/raw")
    store, made, rows = reuse.StageStore(spark, f"{at}/stages"), [], []

    def even(df):
        made.append(1)
        return df.filter("o_orderkey % 2 = 0")

    def call(name, *parts):
        before = len(made)
        frame = store.get(spark.read.parquet(f"{at}/raw"), "even", even, *parts)
        rows.append((name, len(made) > before, *frame.selectExpr("count(*)", "sum(o_custkey)").first()))

    call("first")
    call("again")
    call("other", "another parameter")
    orders.write.mode("append").parquet(f"{at}/raw")
    call("appended")
    return small_frame(spark, rows, "call string, made boolean, n bigint, total bigint")


@query("chart_written", top_sql("events", ("event_type",), 10, percent=False))
def chart_written(spark, folder):
    """E5: write a chart's table under its name and read it."""
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    bars = categories.bars(table(spark, folder, "events"), ["event_type"])
    return spark.read.parquet(sinks.write_chart(bars, target, "value_counts", columns="event_type"))
