"""Named subqueries of the oracle statements: the same derived tables as ``sources.tables``, written in SQL."""

from quantloom.plans.registry import r, view

view(
    "bars",
    """select p_brand as ticker, cast(l_shipdate as date) as date, min_by(px,k) as open, max(px) as high, min(px) as low,
       max_by(px,k) as close, cast(sum(l_quantity) as bigint) as volume
from (select *, l_extendedprice/l_quantity as px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k
      from lineitem join part on l_partkey=p_partkey) t group by 1,2""",
)
view(
    "event_bars",
    """select concat('U', cast(user_id%10 as varchar(10))) as ticker, cast(ts as date) as date, min_by(value,k) as open,
       max(value) as high, min(value) as low, max_by(value,k) as close, count(*) as volume
from (select *, row(ts, event_id) as k from events where value>0) t group by 1,2""",
)
view(
    "macro",
    """select case o_orderpriority when '1-URGENT' then 'SPY' when '2-HIGH' then 'QQQ' when '3-MEDIUM' then 'TLT'
            when '4-NOT SPECIFIED' then 'GLD' else 'VIX' end as symbol,
       cast(o_orderdate as date) as date, round(avg(o_totalprice),6) as close from orders group by 1,2""",
)
view(
    "news",
    """select concat('U', cast(doc_id%10 as varchar(10))) as ticker, doc_id, substring(text,1,80) as title, text as content, source,
       concat('https://n/', cast(doc_id as varchar(20))) as url,
       concat('2024-01-', lpad(cast(1+doc_id%30 as varchar(4)),2,'0'), 'T', lpad(cast(doc_id%24 as varchar(4)),2,'0'), ':00:00Z') as published_at
from documents""",
)
view(
    "fundamentals",
    """select p_brand as ticker,
       case when substring(p_brand,7,1)='1' then '-' else concat(cast(round(avg(p_retailprice)/50,2) as varchar(20))) end as "PERatio",
       concat(cast(round(avg(p_size),2) as varchar(20)),'%') as "EPS",
       cast(round(count(*)/1000.0e0,3) as varchar(20)) as "QuarterlyRevenueGrowthYOY",
       case when substring(p_brand,8,1)='3' then 'None' else cast(round(max(p_size)/100.0e0,3) as varchar(20)) end as "ReturnOnEquityTTM",
       concat('$',cast(round(min(p_retailprice),2) as varchar(20))) as "DebtToEquityRatio"
from part group by p_brand""",
)
view(
    "sector_map",
    """select distinct p_brand as ticker, case substring(p_brand,7,1) when '1' then 'QQQ' when '2' then 'TLT' when '3' then 'GLD'
       when '4' then 'XLU' else null end as sector_symbol from part""",
)
view(
    "training_runs",
    """select cast(o_orderkey as varchar(20)) as run_id, concat('model_', substring('abcdef', cast(1+o_custkey%6 as int), 1)) as model_id,
       case o_orderstatus when 'P' then 'completed' when 'F' then 'failed' else 'running' end as status,
       cast(o_orderdate as date) as created_at, round(0.5+(o_orderkey%400)/1000.0e0,6) as roc_auc,
       round(0.3+(o_orderkey%300)/1000.0e0,6) as f1, round(0.2+(o_orderkey%90)/1000.0e0,6) as brier from orders""",
)
view(
    "job_runs",
    """select cast(event_id as varchar(20)) as run_id,
       case event_type when 'click' then 'queued' when 'view' then 'running' when 'purchase' then 'completed' else 'failed' end as status,
       cast(event_id%4 as int) as attempt_count, 3 as max_attempts,
       case when event_type='error' then 'failed: max delivery attempts reached' when event_type='signup' then 'boom' end as error,
       ts as updated_at from events""",
)
# indicators without the recursive ones
view(
    "steps",
    """select *, close/nullif(lag(close) over w,0)-1 as returns, close-lag(close) over w as delta
from bars window w as (partition by ticker order by date)""",
)
view(
    "tech",
    """select *, 100-100/(1+g/nullif(l,0)) as rsi, sma_20+2*sd as bb_upper, sma_20-2*sd as bb_lower,
       (4*sd)/nullif(sma_20,0) as bb_width
from (select *, stddev_samp(returns) over w20 as volatility,
        avg(case when delta is null then null when delta>0 then delta else 0 end) over w14 as g,
        avg(case when delta is null then null when delta<0 then -delta else 0 end) over w14 as l,
        avg(close) over w20 as sma_20, avg(close) over w50 as sma_50, avg(close) over w200 as sma_200,
        stddev_samp(close) over w20 as sd, close-lag(close,10) over w as momentum
      from steps window w as (partition by ticker order by date),
        w14 as (partition by ticker order by date rows between 13 preceding and current row),
        w20 as (partition by ticker order by date rows between 19 preceding and current row),
        w50 as (partition by ticker order by date rows between 49 preceding and current row),
        w200 as (partition by ticker order by date rows between 199 preceding and current row)) t""",
)
# scored panel: RSI as probability, rounded so that order and ties agree in both engines; next return as outcome
view(
    "scored",
    f"""select * from (select ticker, date, close, {r("rsi/100")} as score, returns as ret_1d,
        lead(returns) over (partition by ticker order by date) as forward_return,
        cast(lead(returns) over (partition by ticker order by date) > 0 as int) as target from tech) t
    where score is not null and forward_return is not null""",
)
view(
    "scores",
    f"""select ticker, date, close, returns, model_id, probability,
       case when probability>=0.7 then 'Strong Buy' when probability>=0.55 then 'Buy' when probability>=0.45 then 'Hold' else 'Sell' end as signal
from (select ticker, date, close, returns, 'momentum' as model_id, {r("rsi/100")} as probability from tech
      union all
      select ticker, date, close, returns, 'reversal' as model_id, {r("1-round(rsi/100,6)")} as probability from tech) t
where probability is not null""",
)
