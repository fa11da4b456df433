"""The registered queries as plain SQL, written independently of the Spark operators.

Averages with memory are folds over lists, slopes are regressions, peaks are found by
grouping equal neighbours; the Spark side uses none of these."""

from __future__ import annotations

BARS = """
bars as (
  select lpad(cast(l_suppkey as varchar), 5, '0') as stock_code, cast(l_shipdate as date) as date,
         arg_min(px, k) as open, max(px) as high, min(px) as low, arg_max(px, k) as close,
         sum(l_quantity) as volume
  from (select *, l_extendedprice / l_quantity as px,
               row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as k
        from lineitem where l_quantity <> 0)
  group by 1, 2)"""

RAW = BARS + """,
raw as (
  select stock_code,
         case when n % 97 = 0 then null else date end as date,
         case when n % 89 = 0 then null else open end as open,
         case when n % 83 = 0 then low * 0.5 else high end as high, low,
         case when n % 79 = 0 then null else close end as close,
         case when n % 73 = 0 then null else volume end as volume
  from (select *, cast(stock_code as bigint) + date_diff('day', date '1970-01-01', date) as n from bars)),
parsed as (
  select * from raw
  where date is not null and open is not null and high is not null and low is not null and close is not null),
judged as (
  select *, (high < low or high < open or high < close or low > open or low > close
             or open <= 0 or high <= 0 or low <= 0 or close <= 0) as bad from parsed),
clean as (
  select stock_code, date, open, high, low, close, coalesce(volume, 0) as volume
  from judged where not bad)"""

LISTED = """
listed as (
  select case when length(c) < 5 then lpad(c, 5, '0') else c end as code, s_name as name,
         n_name as industry_name, r_name as market_name, n_name as sector_name
  from (select *, cast(s_suppkey as varchar) as c from supplier)
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def r(x: str, digits: int = 4, name: str | None = None) -> str:
    """Rounded the way the Spark side does (see ``registry.rounded``)."""
    return f"floor(({x}) * 1e{digits} + 0.50001) / 1e{digits} + 0.0 as {name or x}"


def rs(names, digits: int = 4, **apart: int) -> str:
    return ", ".join(r(n, apart.get(n, digits)) for n in names)


def over(rows: int | None = None, order: str = "o") -> str:
    frame = "" if rows is None else f" rows between {rows - 1} preceding and current row"
    return f"over (partition by stock_code order by {order}{frame})"


def full(agg: str, x: str, rows: int) -> str:
    return f"case when count({x}) {over(rows)} = {rows} then {agg}({x}) {over(rows)} end"


def slope(y: str, rows: int, least: int) -> str:
    return f"case when count({y}) {over(rows)} >= {least} then regr_slope({y}, i) {over(rows)} end"


def chain(threshold: float = 0.001, source: str = "bars", order: str = "date") -> str:
    """All trailing columns in four levels."""
    t = repr(float(threshold))
    way = lambda c: f"case when {c} > {t} then 1 when {c} < -{t} then -1 else 0 end"
    sign = lambda c: f"case when {c} > {t} then '+' when {c} < -{t} then '-' else '0' end"
    share = lambda c, k: (f"case when count(*) {over(k)} = {k} then list_sum(list_transform("
                          f"list({c}) {over(k)}, lambda v: case when v = {c} then 1 else 0 end))"
                          f" / {k}.0 end")
    return f"""
placed as (select *, {order} as o from {source}),
l1 as (
  select *, row_number() {over()} as i, count(*) over (partition by stock_code) as n,
    close / lag(close) {over()} - 1 as return_1d, ln(close / lag(close) {over()}) as return_1d_log,
    close - lag(close) {over()} as delta,
    {full('avg', 'close', 5)} as ma_5, {full('avg', 'close', 25)} as ma_25,
    {full('avg', 'close', 10)} as ma_10, {full('avg', 'close', 50)} as ma_50,
    {full('stddev_samp', 'close', 20)} as price_volatility, {full('avg', 'close', 20)} as ma_20,
    {full('avg', 'volume', 5)} as volume_ma_5,
    close / lag(close, 5) {over()} - 1 as roc_5, close / lag(close, 25) {over()} - 1 as roc_25
  from placed),
l2 as (
  select *,
    {full('stddev_samp', 'return_1d', 5)} as volatility_5d,
    {full('stddev_samp', 'return_1d', 20)} as volatility_20d,
    case when volume_ma_5 <> 0 then volume / volume_ma_5 end as volume_ratio,
    ma_20 + 2 * price_volatility as bb_upper, ma_20 - 2 * price_volatility as bb_lower,
    {full('stddev_samp', 'ma_5', 20)} as ma_short_volatility,
    {full('stddev_samp', 'ma_25', 20)} as ma_long_volatility,
    price_volatility / {full('avg', 'price_volatility', 50)} as volatility_ratio,
    avg(case when delta > 0 then delta else 0 end) {over(14)} as gain,
    avg(case when delta < 0 then -delta else 0 end) {over(14)} as loss,
    {slope('ma_5', 3, 3)} as short_trend_slope, ma_5 - lag(ma_5) {over()} as short_trend_slope_simple,
    {slope('ma_25', 5, 5)} as long_trend_slope, ma_25 - lag(ma_25) {over()} as long_trend_slope_simple,
    {slope('ma_5', 3, 2)} as short_seen_slope, {slope('ma_25', 5, 2)} as long_seen_slope,
    ma_5 - ma_25 as ma_convergence, (ma_5 / ma_25 - 1) * 100 as ma_convergence_pct,
    high - low as price_range, abs(close - open) as body_size,
    high - greatest(open, close) as upper_shadow, least(open, close) - low as lower_shadow
  from l1),
l3 as (
  select *,
    case when i < 14 then null when loss > 0 then 100 - 100 / (1 + gain / loss)
         when gain > 0 then 100.0 end as rsi,
    {way('short_trend_slope')} as short_trend_direction, {sign('short_trend_slope')} as short_trend,
    {way('long_trend_slope')} as long_trend_direction, {sign('long_trend_slope')} as long_trend,
    abs(short_trend_slope) as short_trend_strength, abs(long_trend_slope) as long_trend_strength,
    {sign('short_seen_slope')} as short_seen, {sign('long_seen_slope')} as long_seen
  from l2),
l4 as (
  select *, coalesce(rsi, 50.0) as rsi_filled,
    greatest(short_trend_direction * long_trend_direction, 0) as trend_agreement,
    {share('short_trend_direction', 10)} as short_trend_consistency,
    {share('long_trend_direction', 20)} as long_trend_consistency,
    short_seen <> lag(short_seen) {over()} as short_turned,
    long_seen <> lag(long_seen) {over()} as long_turned
  from l3)"""


def fold(x: str, span: int, adjust: bool) -> str:
    q = f"cast({1.0 - 2.0 / (span + 1.0)!r} as double)"
    values = f"list({x}) over (partition by stock_code order by o)"
    if not adjust:
        return f"list_reduce({values}, lambda a, v: a * {q} + v * (1 - {q}))"
    weights = f"((1 - pow({q}, row_number() {over()})) / (1 - {q}))"
    return f"list_reduce({values}, lambda a, v: a * {q} + v) / {weights}"


def averages(adjust: bool, source: str = "l4") -> str:
    return f"""
e1 as (
  select *, {fold('close', 5, True)} as ema_5, {fold('close', 25, True)} as ema_25,
    {fold('close', 12, adjust)} - {fold('close', 26, adjust)} as macd from {source}),
e2 as (select *, {fold('macd', 9, adjust)} as macd_signal from e1)"""


def reversal_steps(kind: str) -> str:
    """Extremes of one moving average from groups of equal neighbours, then the greedy."""
    w = 5 if kind == "short" else 25
    d = w // 2
    return f"""
{kind}_v as (select stock_code, date, close, i - 1 as pos, ma_{w} as v from l1
  where ma_{w} is not null and n - {w - 1} >= {2 * w}),
{kind}_g as (
  select *, sum(case when v = p then 0 else 1 end) over (partition by stock_code order by pos) as g
  from (select *, lag(v) over (partition by stock_code order by pos) as p from {kind}_v)),
{kind}_u as (select stock_code, g, any_value(v) as v, (min(pos) + max(pos)) // 2 as pos
  from {kind}_g group by 1, 2),
{kind}_x as (
  select stock_code, pos, v, case when a < v and b < v then 'peak' when a > v and b > v then 'trough' end as type
  from (select *, lag(v) over (partition by stock_code order by g) as a,
               lead(v) over (partition by stock_code order by g) as b from {kind}_u)),
{kind}_k as (
  select stock_code, type, unnest(list_reduce(
      list(pos order by case when type = 'peak' then v else -v end desc, pos desc),
      lambda kept, x: case when len(list_filter(kept, lambda y: abs(y - x) < {d})) > 0 then kept
                           else list_append(kept, x) end, cast([] as bigint[]))) as pos
  from {kind}_x where type is not null group by 1, 2),
{kind}_rev as (
  select k.stock_code, '{kind}' as trend_type, v.date, k.pos as idx, k.type, v.v as price,
         v.close as actual_price,
         case when k.type = 'peak' then '+' else '-' end as trend_before,
         case when k.type = 'peak' then '-' else '+' end as trend_after
  from {kind}_k k join {kind}_v v using (stock_code, pos))"""


RANKED = """
rev as (select * from short_rev union all select * from long_rev),
ranked as (
  select *, row_number() over (partition by stock_code, trend_type order by idx desc) as k,
    date_diff('day', lag(date) over (partition by stock_code, trend_type order by idx), date) as gap,
    abs(price - lag(price) over (partition by stock_code, trend_type order by idx)) as step
  from rev),
revstats as (
  select stock_code, trend_type, count(*) as reversal_count,
    avg(case when k <= 4 then step end) as avg_magnitude, max(case when k = 1 then price end) as last_price,
    max(case when k = 1 then type end) as last_type, least(count(*), 3) as recent,
    avg(gap) as gap_mean, stddev_pop(gap) as gap_std
  from ranked group by 1, 2)"""


def profile(source: str = "l4", by: str = "stock_code") -> str:
    """The figures of each code from rows ranked from the end."""
    parts = []
    for k, w in (("short", 5), ("long", 25)):
        look = f"(case when n >= {w} then {w} else least(10, n) end)"
        parts.append(f"""
    max(case when rd = 1 then ma_{w} end) as {k}_ma_1, max(case when rd = 2 then ma_{w} end) as {k}_ma_2,
    max(case when rd = 3 then ma_{w} end) as {k}_ma_3, max(case when rd = 1 then {k}_seen end) as {k}_seen,
    count(*) filter (where rd <= {w - 1} and {k}_turned) as {k}_turns,
    stddev_samp(case when rd <= {2 * w} then return_1d end) as {k}_spread,
    count(*) filter (where rd < {look} and delta is not null) as {k}_steps,
    count(*) filter (where rd < {look} and delta > 0) as {k}_ups,
    count(*) filter (where rd < {look} and delta < 0) as {k}_downs""")
    return f"""
prof as (
  select {by}, max(n) as data_points, max(case when rd = 1 then close end) as current_price,
    max(date) as analysis_date,
    stddev_samp(case when rd <= 20 then return_1d end) as recent_spread,
    stddev_samp(return_1d) as whole_spread,
    avg(case when rd <= 20 then price_volatility end) as recent_pv, avg(price_volatility) as usual_pv,
    {','.join(parts)}
  from (select *, n - i + 1 as rd from {source}) group by {by})"""


def calls(t: float = 300.0) -> str:
    """Trend, reversal and confidence of the path without models."""
    a, b = [], []
    for k, w in (("short", 5), ("long", 25)):
        few = f"data_points < {w}"
        a.append(f"""
    case when {few} then null when {k}_ma_3 is not null then ({k}_ma_1 - {k}_ma_3) / 3
         when {k}_ma_2 is not null then ({k}_ma_1 - {k}_ma_2) / 2 end as {k}_rise""")
        b.append(f"""
    case when {k}_rise > {t} then '+' when {k}_rise < -{t} then '-' else '0' end as {k}_trend,
    case when {k}_rise is null then 0.3 else least(abs({k}_rise) / {t}, 1.0) * 0.7 end as {k}_trend_confidence,
    case when {few} then 'insufficient_data' when {k}_rise is null then 'insufficient_ma'
         else 'fallback_analysis' end as {k}_trend_method,
    case when data_points - 1 < {w} then current_price else current_price
         * (1 + {k}_spread * case when {k}_rise < -{t} then -1 else 1 end) end as {k}_reversal_price,
    case when data_points - 1 < {w} then current_price else current_price * (1 - {k}_spread) end as {k}_reversal_low,
    case when data_points - 1 < {w} then current_price else current_price * (1 + {k}_spread) end as {k}_reversal_high,
    case when data_points - 1 < {w} then 0.3 else 0.5 end as {k}_reversal_confidence,
    case when data_points - 1 < {w} then 'insufficient_data' else 'fallback_analysis' end as {k}_reversal_method,
    least(100, greatest(0, 50 * list_avg(list_filter([
      case when data_points >= 35 then 1.0 when data_points >= 5 then 0.7 else 0.3 end,
      case when data_points >= 20 then case when whole_spread > 0
        then greatest(0.3, 1 - (recent_spread / whole_spread - 1) * 0.5) else 0.7 end end,
      case when {k}_steps > 0 then greatest({k}_ups, {k}_downs) / {k}_steps end], lambda f: f is not null)))) as {k}_confidence""")
    return f"""
risen as (select *, {','.join(a)} from prof),
called as (select *, {','.join(b)} from risen)"""


def expected(k: str, w: int) -> str:
    return f"""
{k}_joined as (
  select p.*, coalesce(s.reversal_count, 0) as reversal_count, s.avg_magnitude, s.last_price, s.last_type,
    coalesce(s.recent, 0) as recent,
    case when coalesce(s.reversal_count, 0) < 3 then 0.3 else list_avg(list_filter([
      greatest(0, 1 - gap_std / greatest(gap_mean, 1)),
      case when data_points >= {w} then greatest(0, 1 - {k}_turns / {w}.0) end,
      case when usual_pv > 0 then greatest(0, 1 - recent_pv / usual_pv) end], lambda f: f is not null)) end as regular
  from prof p left join (select * from revstats where trend_type = '{k}') s using (stock_code)),
{k}_next as (
  select stock_code, '{k}' as trend_type, reversal_count, regular, recent, last_type,
    case when reversal_count < 2 then current_price when {k}_seen = '+' then current_price + avg_magnitude / 2
         when {k}_seen = '-' then current_price - avg_magnitude / 2 else last_price end as price,
    case when reversal_count < 2 then 0 else regular end as confidence,
    case when reversal_count < 2 then 'unknown' when {k}_seen = '+' then 'peak'
         when {k}_seen = '-' then 'trough' else 'sideways' end as type,
    case when reversal_count >= 2 then {k}_seen end as current_trend,
    case when reversal_count >= 2 then avg_magnitude end as avg_magnitude
  from {k}_joined)"""


def sql(*steps: str) -> str:
    *ctes, last = steps
    return "with " + ",".join(ctes) + "\n" + last


def rows_of(names, source: str = "l4", digits: int = 4, **apart) -> str:
    return f"select stock_code, date, {rs(names, digits, **apart)} from {source}"


SHARED = """
shared as (
  select * exclude (stock_code), lpad(cast(cast(stock_code as bigint) % 25 as varchar), 5, '0') as stock_code
  from bars),
ordered as (
  select *, row_number() over (partition by stock_code order by date, open, high, low, close, volume) - 1 as pos
  from shared)"""

LIQUID = """
liquid as (select stock_code from bars group by 1 having median(volume) > 28)"""

ASKED = """
asked as (select code as stock_code from listed union all
          select 'N' || cast(n_nationkey as varchar) from nation),
batch as (
  select a.stock_code, case when data_points is null then 'no price data'
                            when data_points < 520 then 'insufficient data' end as error, c.* exclude (stock_code)
  from asked a left join called c using (stock_code)),
told as (
  select stock_code, error, data_points,
    case when error is null then short_trend end as short_trend,
    case when error is null then long_trend end as long_trend,
    case when error is null then short_reversal_price end as short_reversal_price,
    case when error is null then long_reversal_price end as long_reversal_price,
    case when error is null then short_confidence end as short_confidence,
    case when error is null then long_confidence end as long_confidence,
    case when error is null then current_price end as current_price,
    case when error is null then analysis_date end as analysis_date
  from batch)"""


def members() -> str:
    number = lambda at: f"cast('0x' || substr(h, {at}, 8) as bigint)"
    return f"""
tail as (
  select stock_code, date, close, i, n, least(n, 51) as n2 from l1 where n - i < 51),
copied as (
  select stock_code as code, member, date, close, i, n2,
    md5(stock_code || '|' || strftime(date, '%Y-%m-%d') || '|' || cast(member as varchar) || '|close') as h
  from tail, range(5) x(member)),
noisy as (
  select code || '#' || cast(member as varchar) as stock_code, code, member, date as o, date, n2 as n,
    row_number() over (partition by code, member order by i) as i,
    close * case when n2 > 10 then 1 + 0.001 * sqrt(-2 * ln(({number(1)} + 1) / (pow(2, 32) + 1)))
                 * cos(2 * pi() * ({number(9)} / pow(2, 32))) else 1 end as close
  from copied),
m4 as (
  select *, close / lag(close) {over()} - 1 as return_1d, close - lag(close) {over()} as delta,
    {full('avg', 'close', 5)} as ma_5, {full('avg', 'close', 25)} as ma_25,
    '0' as short_seen, '0' as long_seen, false as short_turned, false as long_turned,
    cast(0 as double) as price_volatility
  from noisy)"""


NOISED = """
noised as (
  select code || '#' || cast(member as varchar) as stock_code, date, open, high, low, volume,
    close * case when n > 10 then 1 + 0.001
      * sqrt(-2 * ln((cast('0x' || substr(h, 1, 8) as bigint) + 1) / (pow(2, 32) + 1)))
      * cos(2 * pi() * (cast('0x' || substr(h, 9, 8) as bigint) / pow(2, 32))) else 1 end as close
  from (select * exclude (stock_code), stock_code as code, count(*) over (partition by stock_code) as n,
          md5(stock_code || '|' || strftime(date, '%Y-%m-%d') || '|' || cast(member as varchar) || '|close') as h
        from bars, range(5) x(member)))"""


def vote(c: str) -> str:
    count = lambda s: f"count(*) filter (where {c} = '{s}')"
    return f"""(select x.t from (values ('+', 1, {count('+')}), ('-', 2, {count('-')}),
      ('0', 3, {count('0')})) x(t, k, c) order by x.c desc, x.k limit 1)"""


SLOPES = ("short_trend_slope", "short_trend_slope_simple", "long_trend_slope", "long_trend_slope_simple")
VOLATILITY = ("price_volatility", "ma_short_volatility", "ma_long_volatility", "volatility_ratio")
FINE = {"return_1d": 7, "return_1d_log": 7, "volatility_5d": 7, "volatility_20d": 7,
        "bb_upper": 3, "bb_lower": 3, "price_volatility": 3, "ma_short_volatility": 3,
        "ma_long_volatility": 3, "volatility_ratio": 6}
OHLCV = ("open", "high", "low", "close", "volume")
DIRECTIONS = "short_trend_direction, short_trend, long_trend_direction, long_trend"
FULL = ("return_1d", "volatility_5d", "volatility_20d", "macd", "macd_signal", "ma_5", "ma_25",
        "ma_10", "ma_50", "ema_5", "ema_25", *SLOPES, "short_trend_strength", "long_trend_strength",
        "short_trend_consistency", "long_trend_consistency", *VOLATILITY, "roc_5", "roc_25",
        "ma_convergence", "ma_convergence_pct")
BASIC = ("price_range", "body_size", "upper_shadow", "lower_shadow", "return_1d", "return_1d_log",
         "volatility_5d", "volatility_20d", "volume_ma_5", "volume_ratio", "rsi", "bb_upper",
         "bb_lower", "macd", "macd_signal")
BASIC_ROWS = ("return_1d is not null and volatility_20d is not null and volume_ratio is not null "
              "and rsi is not null and bb_upper is not null")
NOT_BROKEN = f"select * from e2 where {BASIC_ROWS}"


def oracle_sql() -> dict[str, str]:
    bars_of = lambda names, where="", digits=4: sql(
        BARS, f"select stock_code, date, {rs(names, digits)} from bars {where}")
    feats = lambda *names, t=0.001, digits=4, **apart: sql(
        BARS, chain(t), rows_of(names, "l4", digits, **apart))
    seen = [BARS, chain(300.0), reversal_steps("short"), reversal_steps("long"), RANKED, profile(),
            expected("short", 5), expected("long", 25)]
    revs = "stock_code, trend_type, date, idx, type, floor((price) * 1e3 + 0.50001) / 1e3 + 0.0 as price, " \
           "floor((actual_price) * 1e4 + 0.50001) / 1e4 + 0.0 as actual_price, trend_before, trend_after"
    predicted = [BARS, chain(300.0), profile(), calls()]
    analyzed = f"""
select c.stock_code, {r('c.current_price', 4, 'current_price')}, analysis_date, short_seen as short_trend,
  long_seen as long_trend, {r('s.price', 4, 'short_reversal_price')}, {r('l.price', 4, 'long_reversal_price')},
  {r('c.short_confidence', 4, 'short_confidence')}, {r('c.long_confidence', 4, 'long_confidence')}
from called c join short_next s using (stock_code) join long_next l using (stock_code)"""
    conf = lambda k: sql(*predicted, f"select stock_code, {r(k + '_confidence', 6, 'confidence')} from called")
    batch = [*predicted, LISTED, ASKED]
    both = "select * from short_next union all select * from long_next"
    candles = ("body_size", "close", "high", "low", "lower_shadow", "open", "price_range",
               "upper_shadow", "volume")
    scaled = "open", "close", "volume", "body_size", "upper_shadow"
    stat = ", ".join(f"avg({c}) as {c}_m, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as {c}_s"
                     for c in candles)
    scaler = f"scaler as (select stock_code, {stat} from l4 group by 1)"
    voted = [BARS, chain(300.0), members(), profile("m4", "code, member"), calls()]
    noised = [BARS, NOISED, chain(300.0, "noised"), *seen[2:]]
    targets = ("select stock_code, date, cast(short_trend_direction + 1 as double) as short_trend_label, "
               "cast(long_trend_direction + 1 as double) as long_trend_label, "
               f"floor((coalesce(lead(close, 5) {over()} / close - 1, 0)) * 1e6 + 0.50001) / 1e6 + 0.0 as short_reversal_label, "
               f"floor((coalesce(lead(close, 25) {over()} / close - 1, 0)) * 1e6 + 0.50001) / 1e6 + 0.0 as long_reversal_label, "
               "floor((least(greatest(coalesce(short_trend_strength, 0) * coalesce(short_trend_consistency, 0.5), 0), 1)) * 1e6 + 0.50001) / 1e6 "
               "+ 0.0 as confidence_label from l4")
    short_long = lambda names, d=4: rs([f"{k}_{n}" for k in ("short", "long") for n in names], d)
    out = {
        # sources and sinks
        "stock_list": sql(LISTED, "select * from listed"),
        "load_prices": "with " + RAW + "," + LISTED + f""",
in_range as (select * from clean where date between date '1995-01-01' and date '2001-06-30'
             and stock_code in (select code from listed))
select stock_code, date, {rs(OHLCV)} from in_range
where stock_code in (select stock_code from in_range group by 1 having count(*) >= 400)""",
        "load_mixed_prices": sql(RAW, f"select stock_code, date, {rs(OHLCV)} from clean"),
        "discover_codes": sql(BARS, "select distinct stock_code from bars"),
        "resolve_sources": sql(RAW, """
select stock_code, case when cast(stock_code as bigint) % 3 = 0 then 1 else 2 end as source,
       count(*) as rows from raw group by 1, 2"""),
        "ingest_listing": sql(LISTED, """
select '2025-05-01' as "Date", code as "Code", name as "CompanyName", sector_name as "Sector",
       market_name as "Market", lower(name) as "CompanyNameLower", length(name) as "NameLength" from listed"""),
        "ingest_quotes": sql(BARS, f"""
select stock_code, date, {rs(OHLCV)}, {r("close * volume", 2, "\"TurnoverValue\"")} from bars"""),
        "features_roundtrip": sql(BARS, chain(), averages(True), rows_of(
            ("price_range", "volatility_20d", "rsi", "volume_ratio"),
            f"({NOT_BROKEN})", volatility_20d=7)),
        "liquid_stock_list": sql(BARS, LISTED, LIQUID, """
select code as stock_code, name, industry_name, market_name, sector_name from listed
where code not in (select stock_code from bars where stock_code not in (select stock_code from liquid))"""),
        # cleaning and selection
        "norm_code": """
select code, case when length(code) < 5 then lpad(code, 5, '0') else code end as stock_code
from (select cast(s_suppkey as varchar) as code from supplier
      union all select '12' || cast(s_suppkey as varchar) || '345' from supplier)""",
        "clean_prices": sql(RAW, f"select stock_code, date, {rs(OHLCV)} from clean"),
        "validate_ohlc": sql(RAW, f"select stock_code, date, {rs(OHLCV[:4])} from judged where not bad"),
        "invalid_ohlc_counts": sql(RAW, """
select stock_code, count(*) filter (where bad) as invalid_rows, count(*) as total_rows
from judged group by 1"""),
        "ticks_to_bars": f"""
select cast(user_id as varchar) as stock_code, cast(ts as date) as date,
  {r('arg_min(value, row(ts, event_id))', 4, 'open')}, {r('max(value)', 4, 'high')}, {r('min(value)', 4, 'low')},
  {r('arg_max(value, row(ts, event_id))', 4, 'close')}, cast(count(*) as double) as volume, count(*) as ticks
from events where user_id is not null and ts is not null and value is not null group by 1, 2""",
        "rejected_prices": sql(RAW, f"""
select reason, count(*) as rows, {r('sum(close)', 1, 'closes')}, {r('sum(volume)', 1, 'volumes')}
from (select case when date is null then 'no date' when open is null then 'no open' when high is null then 'no high'
               when low is null then 'no low' when close is null then 'no close'
               when high < low then 'high below low' when high < open then 'high below open'
               when high < close then 'high below close' when low > open then 'low above open'
               when low > close then 'low above close'
               when least(open, high, low, close) <= 0 then 'price not positive' else 'kept' end as reason,
        close, case when date is not null and open is not null and high is not null and low is not null
               and close is not null and not (high < low or high < open or high < close or low > open or low > close
               or least(open, high, low, close) <= 0) then coalesce(volume, 0) else volume end as volume
      from raw) group by 1"""),
        "date_filter": bars_of(("close", "volume"),
                               "where date between date '1996-01-01' and date '1997-12-31'"),
        "min_history": bars_of(("close",), """
where stock_code in (select stock_code from bars group by 1 having count(*) >= 533)"""),
        "liquidity_filter": sql(BARS, LIQUID, f"""
select stock_code, date, {rs(('close', 'volume'))} from bars
where stock_code in (select stock_code from liquid)"""),
        "median_volume": sql(BARS, f"select stock_code, {r('median(volume)', 4, 'median_volume')} from bars group by 1"),
        "median_volume_sliced": sql(BARS, SHARED, f"select stock_code, {r('median(volume)', 4, 'median_volume')} from shared group by 1"),
        "median_price_by_flag": f"select l_returnflag, {r('median(l_extendedprice)', 3, 'median_price')} from lineitem group by 1",
        "semi_join_codes": sql(BARS, LISTED, f"""
select stock_code, date, {rs(('close',))} from bars where stock_code in (
  select code from listed where market_name = 'ASIA' or industry_name like '%1%')"""),
        "anti_join_illiquid": sql(BARS, LIQUID, f"""
select stock_code, date, {rs(('close', 'volume'))} from bars
where stock_code not in (select stock_code from liquid)"""),
        "latest_data": bars_of(("close",), "where stock_code in ('00001', '00004', '00007')"),
        "latest_row": sql(BARS, f"""
select stock_code, date, {rs(OHLCV)} from bars
where (stock_code, date) in (select (stock_code, max(date)) from bars group by stock_code)"""),
        "distinct_codes": sql(BARS, "select distinct stock_code from bars"),
        "head_codes": sql(BARS, "select distinct stock_code from bars order by 1 limit 5"),
        "union_sources": sql(BARS, f"""
select stock_code, date, {r('close')}, floor((case when date < date '1997-01-01' then volume end) * 1e4 + 0.50001) / 1e4 + 0.0 as volume
from bars"""),
        "points_per_stock": sql(BARS, "select stock_code, count(*) as data_points from bars group by 1"),
        "data_summary": sql(BARS, """
select count(*) as total_stocks, min(a) as earliest_start, max(b) as latest_end,
       cast(sum(c) as bigint) as total_data_points, floor((avg(c)) * 1e4 + 0.50001) / 1e4 + 0.0 as average_data_points
from (select min(date) as a, max(date) as b, count(*) as c from bars group by stock_code)"""),
        # indicators
        "candle_features": feats("price_range", "body_size", "upper_shadow", "lower_shadow"),
        "returns": feats("return_1d", "return_1d_log", digits=7),
        "moving_averages": feats("ma_5", "ma_10", "ma_25", "ma_50"),
        "volatility": feats("volatility_5d", "volatility_20d", digits=7),
        "volatility_features": feats(*VOLATILITY, digits=3, volatility_ratio=7),
        "rsi": feats("rsi_filled", "rsi", digits=6),
        "bollinger": feats("bb_upper", "bb_lower", digits=3),
        "volume_features": feats("volume_ma_5", "volume_ratio", digits=6),
        "momentum": feats("roc_5", "roc_25", "ma_convergence", "ma_convergence_pct", digits=6,
                          ma_convergence=4),
        "ema": sql(BARS, chain(), averages(True), rows_of(("ema_5", "ema_25"), "e2")),
        "ema_wide": sql(BARS, chain(), "w as (select stock_code, date, " + ", ".join(
            f"{fold('close', k, True)} as ema_{k}" for k in (10, 100, 20, 200)) + " from l1)",
            rows_of(("ema_10", "ema_100", "ema_20", "ema_200"), "w")),
        "macd": sql(BARS, chain(), averages(False), rows_of(("macd", "macd_signal"), "e2")),
        "macd_adjusted": sql(BARS, chain(), averages(True), rows_of(("macd", "macd_signal"), "e2")),
        "basic_features": sql(BARS, chain(), averages(True),
                              rows_of(BASIC, f"({NOT_BROKEN})", **FINE)),
        # trends
        "trend_slopes": feats(*SLOPES),
        "trend_directions": sql(BARS, chain(), f"select stock_code, date, {DIRECTIONS} from l4"),
        "trend_directions_wide": sql(BARS, chain(300.0), f"select stock_code, date, {DIRECTIONS} from l4"),
        "trend_features": sql(BARS, chain(300.0), f"""
select stock_code, date, {rs(('short_trend_strength', 'long_trend_strength'))}, trend_agreement from l4"""),
        "trend_consistency": feats("short_trend_consistency", "long_trend_consistency", t=300.0),
        "indicators": sql(BARS, chain(), averages(False), f"""
select stock_code, date, {rs(FULL, **FINE)}, {r('rsi_filled', 4, 'rsi')}, {DIRECTIONS}, trend_agreement from e2"""),
        "indicators_sliced": sql(BARS, SHARED, chain(0.001, "ordered", "pos"), averages(False), f"""
select stock_code, date, pos, {rs(FULL, **FINE)}, {r('rsi_filled', 4, 'rsi')}, {DIRECTIONS}, trend_agreement from e2"""),
        "repeated_dates": sql(BARS, SHARED, chain(0.001, "ordered", "pos"),
                              rows_of(("close", "ma_5", "ma_25"), "l4")),
        "missing_volumes": sql(BARS, """
holed as (select * replace (case when dayofyear(date) % 7 <> 0 then volume end as volume) from bars)""",
            chain(0.001, "holed"), rows_of(("volume_ma_5", "volume_ratio"), "l4", 6)),
        "current_trend_sliced": sql(BARS, SHARED, chain(0.001, "ordered", "pos"), f"""
select stock_code, date as analysis_date, {r('close', 4, 'current_price')},
       short_seen as short_trend, long_seen as long_trend from l4 where i = n"""),
        "last_sequences_sliced": sql(BARS, SHARED, "select distinct stock_code, 60 as rows from ordered"),
        "data_summary_sliced": sql(BARS, SHARED, """
select count(*) as total_stocks, min(a) as earliest_start, max(b) as latest_end,
       cast(sum(c) as bigint) as total_data_points, floor((avg(c)) * 1e4 + 0.50001) / 1e4 + 0.0 as average_data_points
from (select min(date) as a, max(date) as b, count(*) as c from shared group by stock_code)"""),
        "targets_wide_sliced": sql(BARS, SHARED, chain(0.001, "ordered", "pos"), f"""
w as (select stock_code, date, pos, {fold('close', 100, True)} as ema_100, {full('avg', 'close', 100)} as ma_100,
        coalesce(lead(close, 100) {over()} / close - 1, 0) as long_reversal_label from l1)""",
            f"select stock_code, date, pos, {rs(('ema_100', 'ma_100', 'long_reversal_label'), 6)} from w"),
        "current_trend": sql(BARS, chain(), f"""
select stock_code, date as analysis_date, {r('close', 4, 'current_price')},
       short_seen as short_trend, long_seen as long_trend from l4 where i = n"""),
        # reversals
        "reversals_short": sql(BARS, chain(), reversal_steps("short"), f"select {revs} from short_rev"),
        "reversals_long": sql(BARS, chain(), reversal_steps("long"), f"select {revs} from long_rev"),
        "recent_reversals": sql(BARS, chain(), reversal_steps("short"), reversal_steps("long"), RANKED,
                                f"select {revs}, k from ranked where k <= 3"),
        "reversal_magnitude": sql(BARS, chain(), reversal_steps("short"), reversal_steps("long"), RANKED,
                                  f"select stock_code, trend_type, reversal_count, {r('avg_magnitude')} from revstats"),
        "reversal_confidence": sql(*seen, f"""
select stock_code, trend_type, reversal_count, {r('regular', 6, 'confidence')} from ({both})"""),
        "next_reversal": sql(*seen, f"""
select stock_code, trend_type, {r('price')}, {r('confidence', 6)}, type, current_trend, {r('avg_magnitude')}
from ({both})"""),
        "trend_summary": sql(*seen, f"""
select p.stock_code, {r('p.current_price', 4, 'current_price')}, analysis_date, short_seen as short_trend,
  long_seen as long_trend, short_seen = long_seen as trend_agreement,
  {r('s.price', 4, 'short_price')}, {r('s.confidence', 6, 'short_confidence')}, s.type as short_type,
  cast(s.recent as integer) as short_recent, s.last_type as short_last_type,
  {r('l.price', 4, 'long_price')}, {r('l.confidence', 6, 'long_confidence')}, l.type as long_type,
  cast(l.recent as integer) as long_recent, l.last_type as long_last_type
from prof p join short_next s using (stock_code) join long_next l using (stock_code)"""),
        # splits and learning features
        "time_split": sql(BARS, chain(), """
select stock_code, date, case when i <= floor(n * cast(0.8 as double)) then 'train' else 'test' end as split from l1"""),
        "time_split_3way": "with " + BARS + "," + chain() + f""",
cut as (select *, floor(h * cast({1.0 - 0.1 / (0.8 + 0.1)!r} as double)) as t
        from (select *, floor(n * cast({1.0 - (1.0 - 0.8 - 0.1)!r} as double)) as h from l1))
select stock_code, date, split from (
  select stock_code, date, case when i <= t then case when t >= 100 then 'train' end
    when i <= h then case when h - t >= 10 then 'val' end
    else case when n - h >= 10 then 'test' end end as split from cut) where split is not null""",
        "training_targets": sql(BARS, chain(300.0), targets),
        "ffill_features": sql(BARS, chain(), f"""
select stock_code, date,
  floor((coalesce(last_value(case when dayofyear(date) % 7 <> 0 then close end ignore nulls) {over()}, 0)) * 1e4 + 0.50001) / 1e4 + 0.0 as gappy,
  floor((coalesce(last_value(ma_25 ignore nulls) {over()}, 0)) * 1e4 + 0.50001) / 1e4 + 0.0 as ma_25 from l4"""),
        "scaler_params": sql(BARS, chain(), scaler, "\nunion all ".join(
            f"select stock_code, '{c}' as feature, {r(c + '_m', 3, 'mean')}, {r(c + '_s', 3, 'scale')} from scaler"
            for c in candles)),
        "scale_features": sql(BARS, chain(), scaler, "select stock_code, date, " + ", ".join(
            f"floor((({c} - {c}_m) / {c}_s) * 1e6 + 0.50001) / 1e6 + 0.0 as {c}" for c in scaled)
            + " from l4 join scaler using (stock_code)"),
        "sequences": sql(BARS, chain(), f"""
select a.stock_code, count(*) as sequences, min(a.date) as first_target, count(*) * 60 as rows,
  {r('sum(b.close)', 2, 'oldest_close')}, {r('sum(c.close)', 2, 'newest_close')},
  {r('sum(c.volume)', 2, 'newest_volume')}
from l1 a join l1 b on a.stock_code = b.stock_code and b.i = a.i - 60
join l1 c on a.stock_code = c.stock_code and c.i = a.i - 1 where a.n >= 70 group by 1"""),
        "last_sequences": sql(BARS, chain(), f"""
select stock_code, cast(count(*) as integer) as rows, {r('sum(close)', 2, 'close_sum')},
  {r('sum(volume)', 2, 'volume_sum')}, {r('max(case when i = n then close end)', 2, 'newest_close')}
from l1 where i > n - 60 and n >= 60 group by 1"""),
        # forecasts
        "fallback_trend": sql(*predicted, f"""
select stock_code, short_trend, long_trend, {short_long(['trend_confidence'], 6)},
  short_trend_method, long_trend_method from called"""),
        "fallback_reversal": sql(*predicted, f"""
select stock_code, {r('current_price')}, {short_long(['reversal_price', 'reversal_low', 'reversal_high', 'reversal_confidence'])},
  short_reversal_method, long_reversal_method from called"""),
        "confidence_short": conf("short"),
        "confidence_long": conf("long"),
        "clamp_reversal_price": sql(*predicted, """
select stock_code, floor((least(greatest(current_price * (1 + long_ma_1 / current_price - 1),
  current_price * 0.5), current_price * 2)) * 1e4 + 0.50001) / 1e4 + 0.0 as price from called"""),
        "adjust_reversal_confidence": sql(*predicted, """
select stock_code, floor((least(greatest(0.5
  * case when abs(c) > 0.5 then 0.7 when abs(c) < 0.01 then 0.8 else 1 end
  * case when recent_spread > 0.05 then 0.9 when recent_spread < 0.01 then 1.1 else 1 end, 0), 1)) * 1e6 + 0.50001) / 1e6 + 0.0 as confidence
from (select *, long_ma_1 / current_price - 1 as c from called)"""),
        "predict_stock": sql(*predicted, f"""
select stock_code, {r('current_price')}, analysis_date, short_trend, long_trend,
  {short_long(['reversal_price', 'confidence'])}, short_trend_method, long_trend_method,
  short_reversal_method, long_reversal_method, data_points, data_points >= 5 as sufficient_short,
  data_points >= 25 as sufficient_long, data_points >= 60 as sufficient_ml from called"""),
        "predict_stock_analyzer": sql(*seen, calls(), analyzed),
        "predict_sliced": sql(BARS, SHARED, chain(300.0, "ordered", "pos"), *seen[2:], calls(), analyzed),
        "batch_predict": sql(*batch, f"""
select stock_code, error, short_trend, long_trend, {short_long(['reversal_price', 'confidence'])},
  {r('current_price')}, analysis_date from told"""),
        "predictions_csv": sql(*batch, f"""
select stock_code, error, '2025-01-01T00:00:00' as "timestamp", short_trend, long_trend,
  {short_long(['reversal_price', 'confidence'])}, {r('current_price')},
  strftime(analysis_date, '%Y-%m-%d') as analysis_date from told"""),
        "predictions_json": sql(*batch, f"""
select stock_code, error, short_trend, {r('short_reversal_price')},
  case when error is null then data_points end as data_points from told"""),
        "prediction_summary": sql(*batch, "select count(*) as total_stocks, "
            "count(*) filter (where error is null) as successful_predictions, "
            "count(*) filter (where error is not null) as failed_predictions, "
            "floor((avg(case when error is null then 1.0 else 0.0 end)) * 1e4 + 0.50001) / 1e4 + 0.0 as success_rate, "
            + ", ".join(f"count(*) filter (where error is null and {k}_trend = '{s}') as {k}_{name}"
                        for k in ("short", "long")
                        for name, s in (("up", "+"), ("down", "-"), ("sideways", "0")))
            + ", " + ", ".join(
                f"floor(({agg}({k}_confidence)) * 1e4 + 0.50001) / 1e4 + 0.0 as {k}_confidence_{name}"
                for k in ("short", "long")
                for name, agg in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
            + ", " + ", ".join(
                f"floor((avg(case when current_price > 0 then ({k}_reversal_price - current_price) / current_price end)) * 1e7 + 0.50001) / 1e7"
                f" + 0.0 as {k}_avg_change" for k in ("short", "long")) + " from told"),
        "trend_distribution": sql(*batch, """
select horizon, trend, count(*) as codes from (
  select 'short' as horizon, short_trend as trend from told where error is null
  union all select 'long', long_trend from told where error is null) group by 1, 2"""),
        "ensemble_trend": sql(*voted, f"""
select code as stock_code, {vote('short_trend')} as short_trend, {vote('long_trend')} as long_trend,
  {r('avg(short_trend_confidence)', 5, 'short_confidence')}, {r('avg(long_trend_confidence)', 5, 'long_confidence')},
  {r('avg((short_trend_confidence + long_trend_confidence) / 2)', 5, 'ensemble_confidence')}
from called group by code"""),
        "predict_with_ensembles": "with " + ",".join([*voted, LISTED]) + f""",
votes as (select code as stock_code, {vote('short_trend')} as voted_trend, avg(long_reversal_price) as voted_price
          from called group by code),
whole as (select stock_code, max(n) as data_points, max(case when i = n then close end) as current_price,
    max(case when i = n then ma_5 end) as a, max(case when i = n - 2 then ma_5 end) as c,
    max(case when i = n then ma_25 end) as la, max(case when i = n - 2 then ma_25 end) as lc,
    stddev_samp(case when n - i < 50 then return_1d end) as spread from l4 group by 1),
wanted as (select code as stock_code from listed union all select 'N' || cast(n_nationkey as varchar) from nation)
select stock_code, case when data_points is null then 'no price data'
                        when data_points < 520 then 'insufficient data' end as error,
  case when data_points >= 520 then case when (a - c) / 3 > 300 then '+' when (a - c) / 3 < -300 then '-' else '0' end end as short_trend,
  case when data_points >= 520 then {r('current_price * (1 + spread * case when (la - lc) / 3 < -300 then -1 else 1 end)', 3, '_').removesuffix(' as _')} end as long_reversal_price,
  case when data_points >= 520 then voted_trend end as voted_trend,
  case when data_points >= 520 then {r('voted_price', 3, '_').removesuffix(' as _')} end as voted_price
from wanted left join whole using (stock_code) left join votes using (stock_code)""",
        "ensemble_analyzer": sql(*noised, f"""
both_next as (
  select split_part(p.stock_code, '#', 1) as code, p.short_seen, p.long_seen, s.price as sp, l.price as lp,
    s.confidence as sc, l.confidence as lc
  from prof p join short_next s using (stock_code) join long_next l using (stock_code))""", f"""
select code as stock_code, {vote('short_seen')} as short_trend, {vote('long_seen')} as long_trend,
  cast(0.6 as double) as trend_confidence, {r('avg(sp)', 3, 'short_price')}, {r('avg(lp)', 3, 'long_price')},
  {r('avg((sc + lc) / 2)', 3, 'reversal_confidence')} from both_next group by code"""),
        "ensemble_reversal": sql(*voted, f"""
select code as stock_code, {r('avg(short_reversal_price)', 3, 'short_reversal_price')},
  {r('avg(long_reversal_price)', 3, 'long_reversal_price')},
  {r('avg(short_reversal_confidence)', 3, 'short_confidence')}, {r('avg(long_reversal_confidence)', 3, 'long_confidence')},
  {r('avg((short_reversal_confidence + long_reversal_confidence) / 2)', 3, 'ensemble_confidence')},
  {r('stddev_pop(short_reversal_price)', 3, 'short_price_std')}, {r('stddev_pop(long_reversal_price)', 3, 'long_price_std')}
from called group by code"""),
        # learning
        "learning_rows": sql(BARS, chain(300.0), f"""
cut as (select *, i > floor(n * cast(0.8 as double)) as test,
  i - 1 >= floor(floor(n * cast(0.8 as double)) * cast(0.8 as double)) as late,
  coalesce(lead(close, 25) {over()} / close - 1, 0) as ahead from l4)""", f"""
select case when test then 'test' else 'train' end as split, not test and late as validates, count(*) as rows,
  {r('sum(cast(short_trend_direction + 1 as double))', 3, 'short_trends')},
  {r('sum(cast(long_trend_direction + 1 as double))', 3, 'long_trends')}, {r('sum(ahead)', 3, 'long_returns')}
from cut group by 1, 2"""),
        "learning_scaler": sql(BARS, chain(300.0), f"""
select stock_code, {r('avg(close)', 3, 'close_mean')}, {r('stddev_pop(close)', 3, 'close_scale')}, {r('avg(volume)', 3, 'volume_mean')}
from l1 where i <= floor(n * cast(0.8 as double)) group by 1"""),
        "model_shapes": sql(BARS, chain(), """
judged_rows as (select count(*) as rows from l1 where i > floor(n * cast(0.8 as double)))""", """
select model, cast(1020 as integer) as inputs, cast(outputs as integer) as outputs, rows from judged_rows,
  (values ('short_trend_classifier', 3), ('long_trend_classifier', 3), ('short_reversal_regressor', 1),
          ('long_reversal_regressor', 1), ('confidence_estimator', 1)) m(model, outputs)"""),
        "model_table_scores": sql(BARS, """
select model, count(distinct stock_code) as codes, cast(0 as bigint) as differing
from bars, (values ('short_trend_classifier'), ('long_trend_classifier'), ('short_reversal_regressor'),
                   ('long_reversal_regressor'), ('confidence_estimator')) m(model) group by 1"""),
        "model_roundtrip": sql(LISTED, """
select (select count(*) from listed) + (select count(*) from nation) as codes, cast(0 as bigint) as differing"""),
        "full_pipeline_errors": sql(LISTED, """
select code as stock_code, cast(null as varchar) as error, true as complete, 'model' as method from listed
union all select 'N' || cast(n_nationkey as varchar), 'no price data', false, null from nation"""),
        # evaluation
        "eval_classification": sql(BARS, chain(300.0), """
select count(*) as rows, floor((avg(case when short_trend_direction + 1 = (i - 1) % 3 then 1.0 else 0.0 end)) * 1e6 + 0.50001) / 1e6 + 0.0
  as accuracy from l4"""),
        "eval_regression": sql(BARS, chain(), """
select count(*) as rows, floor((avg(pow(close - ma_5, 2))) * 1e2 + 0.50001) / 1e2 + 0.0 as mse, floor((avg(abs(close - ma_5))) * 1e2 + 0.50001) / 1e2 + 0.0 as mae,
  floor((1 - sum(pow(close - ma_5, 2)) / (sum(close * close) - count(*) * pow(avg(close), 2))) * 1e6 + 0.50001) / 1e6 + 0.0 as r2
from l4 where ma_5 is not null"""),
    }
    out["scaler_by_batches"] = out["scaler_params"]
    return out
