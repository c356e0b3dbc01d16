"""SQL fragments for the independent check on the same tables."""

from __future__ import annotations


def h(seed: str, key: str = "unit_id") -> str:
    return f"('0x' || substr(md5(concat('{seed}|', {key})), 1, 12))::BIGINT"


UNITS = """
raw_units as (
  select cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
         c_mktsegment as carrier, n_name as airport,
         cast(count(*) as double) as arr_flights,
         cast(sum(case when l_quantity > 42 - 3 * (c_nationkey % 5)
                - (case when month(l_shipdate) in (1, 6, 7, 12) then 4 else 0 end)
                then 1 else 0 end) as double) as arr_del15
  from lineitem join orders on l_orderkey = o_orderkey
       join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by year(l_shipdate), month(l_shipdate), c_mktsegment, n_name),
units as (select *, row_number() over (order by year, month, carrier, airport) - 1 as unit_id
          from raw_units)"""

LINE_UNITS = """
line_rows as (
  select l_orderkey, l_linenumber, min(l_shipdate) as day, min(l_returnflag) as carrier,
         min(l_suppkey % 50) as place, sum(l_quantity) as arr_flights
  from lineitem group by l_orderkey, l_linenumber),
units as (select cast(year(day) as int) as year, cast(month(day) as int) as month, carrier,
    's' || place as airport, arr_flights,
    cast(floor(arr_flights * ((l_orderkey * 7 + l_linenumber * 13 + place) % 40) / 100) as double)
      as arr_del15,
    row_number() over (order by l_orderkey, l_linenumber) - 1 as unit_id from line_rows)"""

PREPARED = UNITS + """,
prepared as (select *, arr_del15 / arr_flights as delay_rate,
    cast(arr_del15 / arr_flights > cast(0.2 as double) as int) as target from units)"""


def quota(source: str, size: str, name: str = "quota") -> str:
    """Per-class shares of ``size`` by largest remainder."""
    return f"""
{name}_n as (select count(*) as n, {size} as m from {source}),
{name}_c as (select target, count(*) as c from {source} group by target),
{name}_s as (select target, c * m // n as share, c * m % n as rem, m from {name}_c, {name}_n),
{name} as (select target, share + case when row_number() over (order by rem desc, target)
             <= m - (select sum(share) from {name}_s) then 1 else 0 end as k from {name}_s)"""


CEIL20 = "cast(ceil(count(*) * cast(0.2 as double)) as bigint)"

SPLIT = PREPARED + "," + quota("prepared", CEIL20) + f""",
split as (select p.*, case when row_number() over (partition by p.target
            order by {h('split42')}, unit_id) <= k then 'test' else 'train' end as part
          from prepared p join quota using (target)),
smallest as (select min(c) as c from
             (select count(*) as c from split where part = 'train' group by target)),
parts as (select s.*, part = 'test' or row_number() over (partition by part, target
            order by {h('under42')}, unit_id) <= (select c from smallest) as kept
          from split s),
train as (select * from parts where part = 'train' and kept),
test as (select * from parts where part = 'test')"""

SCORED = SPLIT + f""",
rate as (select carrier, airport, (sum(target) + 1.0::double) / (count(*) + 2.0::double) as r
         from train group by carrier, airport),
scored as (select t.*, coalesce(r, 0.5::double) as probability,
             cast(1000 + {h('value42')} % 4001 as double) as value
           from test t left join rate using (carrier, airport))"""

DAMAGED = UNITS + """,
damaged as (select unit_id, cast(year as varchar) as year, cast(month as varchar) as month,
    case when unit_id % 107 <> 0 then carrier end as carrier, airport,
    case when unit_id % 101 = 0 then 'x' when unit_id % 103 = 0 then '0'
         else cast(arr_flights as varchar) end as arr_flights,
    case when unit_id % 97 <> 0 then cast(arr_del15 as varchar) end as arr_del15,
    case when unit_id % 9700 = 0 then '15' else '0' end as arr_delay from units),
coerced as (select unit_id, try_cast(year as double) as year, try_cast(month as double) as month,
    carrier, airport, try_cast(arr_flights as double) as arr_flights,
    try_cast(arr_del15 as double) as arr_del15, arr_delay from damaged),
complete as (select * from coerced where year is not null and month is not null
    and carrier is not null and airport is not null and arr_flights is not null),
cleaned as (select unit_id, cast(year as int) as year, cast(month as int) as month, carrier,
    airport, arr_flights, coalesce(arr_del15, 0::double) as arr_del15,
    coalesce(arr_del15, 0::double) / arr_flights as delay_rate,
    cast(coalesce(arr_del15, 0::double) / arr_flights > 0.2::double as int) as target
    from complete where arr_flights > 0
    and year * 12 + month between 1992 * 12 + 1 and 2025 * 12 + 1)"""


def w(ctes: str, final: str) -> str:
    return f"with {ctes}\n{final}"


def metrics(source: str, by: str = "model", t: str = "0.5", digits: int | None = 6) -> str:
    """CTE ``metrics``: the seven metrics of (by, probability, target) rows.

    ``digits`` None leaves them unrounded, for sums and means that are rounded themselves.
    """
    columns = {
        "roc_auc": "area / (pp * nn)", "pr_auc": "ap / pp",
        "f1": "coalesce(2 * tp / nullif(2 * tp + fp + pp - tp, 0), 0)",
        "brier": "se / (pp + nn)", "accuracy": "(tp + nn - fp) / (pp + nn)",
        "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
        "recall": "coalesce(tp / nullif(pp, 0), 0)",
    }
    shown = ", ".join(f"{x} as {name}" if digits is None else f"round({x}, {digits}) as {name}"
                      for name, x in columns.items())
    return f"""
cells as (select {by}, probability as p, sum(target) as pos, sum(1 - target) as neg
          from {source} group by {by}, probability),
runs as (select *, sum(pos) over win as cp, sum(neg) over win as cn from cells
         window win as (partition by {by} order by p desc)),
sums as (select {by}, cast(sum(pos) as double) as pp, cast(sum(neg) as double) as nn,
    sum(cast(neg as double) * (cp - pos + pos / 2.0::double)) as area,
    sum(cast(pos as double) * cp / (cp + cn)) as ap,
    cast(sum(case when p >= {t}::double then pos else 0 end) as double) as tp,
    cast(sum(case when p >= {t}::double then neg else 0 end) as double) as fp,
    sum(pos * (p - 1) * (p - 1) + neg * p * p) as se from runs group by {by}),
metrics as (select {by}, {shown} from sums)"""


def decision(source: str, by: str = "strategy", penalty: str = "2000") -> str:
    """Select the decision metrics of (by, selected, value, probability) rows."""
    return f"""select {by}, round(loss + {penalty} * risk, 4) as total_cost,
    round(loss, 4) as commercial_loss, round({penalty} * risk, 4) as expected_penalty,
    round(risk, 6) as risk_sum, round(risk / nullif(n, 0), 6) as average_probability,
    cast(n as bigint) as operated
  from (select {by}, sum(case when selected then 0 else value end) as loss,
               sum(case when selected then probability else 0 end) as risk,
               sum(case when selected then 1 else 0 end) as n from {source} group by {by})"""
