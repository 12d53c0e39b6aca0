"""SQL for the registered queries, written for DuckDB on the same tables.

``WITH`` parts are named once and pulled in by dependency.
"""

from __future__ import annotations

import re


def R(expr: str, name: str | None = None, places: int = 6) -> str:
    """Rounded output column; adding zero removes a negative zero.

    Engines round exact halves differently, so both are moved up by far less than what is compared.
    """
    return f"round({expr} + 3e-{places + 3}::DOUBLE, {places}) + 0.0 AS {name or expr}"


def _bars(price: str, raw: str = "1.0::DOUBLE") -> str:
    return f"""
    SELECT symbol, bar_date, {raw}*arg_min(p, o) AS open, {raw}*max(p + l_quantity/50) AS high, {raw}*min(p - 20*l_tax) AS low,
           {raw}*arg_max(p, o) AS close, arg_max(p, o) * (1 - 0.5::DOUBLE*min(l_discount)) AS adj_close,
           CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM (SELECT concat('S', lpad(CAST(l_suppkey AS VARCHAR), 5, '0')) AS symbol, CAST(l_shipdate AS DATE) AS bar_date,
                 {price} AS p, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o,
                 l_quantity, l_discount, l_tax FROM lineitem)
    GROUP BY symbol, bar_date"""


def uniform(source: str) -> str:
    """``source`` (a SELECT with seed and k) plus ``u``, the counter-based uniform number, in steps of
    unsigned 64-bit arithmetic."""
    m = "4294967296::UBIGINT"
    return f"""(SELECT *, xor(t2, t2 >> 14)::DOUBLE/4294967296 AS u FROM (
      SELECT *, xor(t1, (t1 + (xor(t1, t1 >> 7)*(t1 | 61::UBIGINT)) % {m}) % {m}) AS t2 FROM (
        SELECT *, (xor(a0, a0 >> 15)*(a0 | 1::UBIGINT)) % {m} AS t1 FROM (
          SELECT *, (seed::UBIGINT % {m} + ((k::UBIGINT + 1) % {m} * 1831565813::UBIGINT) % {m}) % {m} AS a0 FROM ({source})))))"""


def bits(x: str) -> str:
    """Text that names the bits of a double: whole mantissa, p, negated power of two."""
    k = f"(52 - CAST(floor(log2(abs({x}))) AS INTEGER))"
    m = f"({x} * pow(2.0::DOUBLE, {k} // 2) * pow(2.0::DOUBLE, {k} - {k} // 2))"
    return f"""CASE WHEN {x} IS NULL THEN '~' WHEN {x} = 0 THEN '0'
      WHEN abs({m}) >= 9007199254740992 THEN CAST({m}/2 AS BIGINT) || 'p' || ({k} - 1)
      WHEN abs({m}) < 4503599627370496 THEN CAST({m}*2 AS BIGINT) || 'p' || ({k} + 1) ELSE CAST({m} AS BIGINT) || 'p' || {k} END"""


def digests(source: str, keys: str, columns: str) -> str:
    """Rows and summed parts of row hashes by group; ``columns`` are texts."""
    sums = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT)::HUGEINT AS s{i}" for i in range(4))
    return f"SELECT {keys}, count(*) AS rows, {sums} FROM (SELECT {keys}, sha256(concat_ws('|', {columns})) AS h FROM {source}) GROUP BY {keys}"


BAR_BITS = ", ".join(bits(x) for x in ("open", "high", "low", "close", "adj_close"))

PARTS: dict[str, str] = {
    "bars": _bars("100*(1+l_discount-l_tax)+l_quantity/100",
                  "CASE WHEN right(symbol, 1) IN ('3', '8') AND bar_date < DATE '1997-07-01' THEN 2.0::DOUBLE ELSE 1.0 END"),
    "raw_bars": _bars("l_extendedprice/l_quantity"),
    "provider_rows": """
    SELECT symbol, strftime(bar_date, '%Y-%m-%d') AS date, open, high, low, close, adj_close,
           volume::DOUBLE AS volume FROM bars
    UNION ALL
    SELECT CASE WHEN day(bar_date)=31 THEN '' ELSE symbol END,
           CASE WHEN day(bar_date)=27 THEN strftime(bar_date, '%Y-') || ltrim(strftime(bar_date, '%m-%d'), '0')
                WHEN day(bar_date)=24 THEN strftime(bar_date, '%Y-%m-') || '39' ELSE strftime(bar_date, '%Y-%m-%d') END,
           open, CASE WHEN day(bar_date)=30 THEN low-1 ELSE high END, low,
           CASE WHEN day(bar_date)=29 THEN 0.0::DOUBLE ELSE close END, adj_close,
           CASE WHEN day(bar_date)=26 THEN volume+0.5::DOUBLE WHEN day(bar_date)=25 THEN -volume::DOUBLE ELSE volume::DOUBLE END
    FROM bars WHERE day(bar_date) >= 24""",
    "checked_rows": """
    SELECT *, array_to_string(list_filter([
        CASE WHEN trim(symbol) = '' THEN 'symbol' END,
        CASE WHEN NOT (regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(date AS DATE) IS NOT NULL) THEN 'date' END,
        CASE WHEN least(open, high, low, close, adj_close) <= 0 THEN 'price' END,
        CASE WHEN volume < 0 OR volume <> floor(volume) THEN 'volume' END,
        CASE WHEN high < low THEN 'range' END], lambda x: x IS NOT NULL), ',') AS problems FROM provider_rows""",
    "adjusted": """
    SELECT symbol, bar_date, open*f AS open, high*f AS high, low*f AS low, adj_close AS close, adj_close, volume
    FROM (SELECT *, CASE WHEN close <> 0 THEN adj_close/close ELSE 1 END AS f FROM bars)""",
    "market": """
    SELECT role, bar_date, close FROM (
      SELECT bar_date, round(sum(close), 6) AS i, round(max(high)-min(low), 6) AS v FROM adjusted
      WHERE isodow(bar_date) <= 5 GROUP BY bar_date),
      LATERAL (SELECT 'index' AS role, i AS close UNION ALL SELECT 'volatility', v)""",
    "folds": """
    SELECT 'fold-' || (y-1994) AS fold, make_date(y,1,1) AS start, make_date(y,12,31) AS "end"
    FROM (SELECT CAST(unnest(range(min(year(bar_date)), max(year(bar_date))+1)) AS INTEGER) AS y FROM bars)""",
    "seq": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS seq FROM adjusted",
    "feat": """
    SELECT *, round(avg(close) OVER w20, 8) AS mean20, lag(close) OVER w AS previous_close,
       lead(open) OVER w AS next_open, lead(high) OVER w AS next_high, lead(low) OVER w AS next_low, lead(close) OVER w AS next_close
    FROM seq WINDOW w AS (PARTITION BY symbol ORDER BY bar_date), w20 AS (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "fired": """
    SELECT *, unnest(list_filter([
       CASE WHEN close < 0.97::DOUBLE*mean20 THEN {'strategy':'dip','side':'long','confidence':(30+seq%60)::DOUBLE}
            WHEN close > 1.05::DOUBLE*mean20 THEN {'strategy':'dip','side':'short','confidence':(30+seq%60)::DOUBLE} END,
       CASE WHEN close < 0.95::DOUBLE*mean20 THEN {'strategy':'deep','side':'long',
            'confidence':CASE WHEN seq%4<>0 THEN (30+seq%60)::DOUBLE/100 END} END,
       CASE WHEN close > previous_close AND close < 0.98::DOUBLE*mean20 THEN {'strategy':'turn','side':'long',
            'confidence':CASE WHEN seq%4<>0 THEN (30+seq%60)::DOUBLE/100 END} END
    ], lambda x: x IS NOT NULL)) AS f FROM feat WHERE seq >= 90""",
    "signals": """
    SELECT f.strategy AS strategy, symbol, bar_date AS signal_date, seq, f.side AS side,
       close*0.99::DOUBLE AS entry_min, close*1.01::DOUBLE AS entry_max,
       close*(CASE WHEN f.side='long' THEN 0.95::DOUBLE ELSE 1.05::DOUBLE END) AS stop_loss,
       CASE WHEN day(bar_date)%5<>0 THEN close*(CASE WHEN f.side='long' THEN 1.06::DOUBLE ELSE 0.94::DOUBLE END) END AS target,
       CAST(1+seq%10 AS INTEGER) AS max_hold_days,
       CASE WHEN close < 0.95::DOUBLE*mean20 THEN 'deep' ELSE 'shallow' END AS setup,
       CASE WHEN volume >= 30 THEN 'busy' ELSE 'quiet' END AS regime, f.confidence AS confidence,
       next_open, next_high, next_low, next_close
    FROM fired""",
    "economics": """
    SELECT *, CASE WHEN side='long' THEN entry_max ELSE entry_min END AS worst_entry,
      CASE WHEN side='long' THEN entry_max-stop_loss ELSE stop_loss-entry_min END AS risk,
      CASE WHEN side='long' THEN (target-entry_max)/(entry_max-stop_loss) ELSE (entry_min-target)/(stop_loss-entry_min) END AS rr,
      CASE WHEN confidence > 1 THEN confidence/100 ELSE confidence END AS conf
    FROM signals""",
    # --- outcomes -----------------------------------------------------------------
    "filled": """
    SELECT s.*, b.bar_date AS entry_date, greatest(s.entry_min, least(s.entry_max, b.open)) AS raw_entry
    FROM signals s JOIN seq b ON b.symbol=s.symbol AND b.seq=s.seq+1
    WHERE s.side='long' AND NOT (b.high < s.entry_min OR b.low > s.entry_max) AND b.open > s.stop_loss""",
    "path": """
    SELECT f.*, greatest(1, f.max_hold_days-1) AS last_offset, CAST(b.seq-f.seq-1 AS INTEGER) AS "offset", b.seq AS bar_seq,
           b.bar_date, b.open, b.high, b.low, b.close
    FROM filled f JOIN seq b ON b.symbol=f.symbol AND b.seq BETWEEN f.seq+1 AND f.seq+1+greatest(1, f.max_hold_days-1)""",
    "stops": """
    SELECT *, greatest(stop_loss, coalesce(max(new_stop) OVER b, stop_loss)) AS stop_now,
      CASE WHEN count(new_stop) OVER b > 0 THEN
        (last_value(CASE WHEN new_stop IS NOT NULL THEN {'t': new_target} END IGNORE NULLS) OVER b).t ELSE target END AS target_now,
      coalesce(lag(asks_exit) OVER o, false) AS exit_pending
    FROM (SELECT p.*, CASE WHEN p."offset">=1 AND n.side='long' THEN n.stop_loss END AS new_stop,
             CASE WHEN p."offset">=1 AND n.side='long' THEN n.target END AS new_target,
             p."offset">=1 AND coalesce(n.side='short', false) AS asks_exit
          FROM path p LEFT JOIN signals n ON n.strategy=p.strategy AND n.symbol=p.symbol AND n.seq=p.bar_seq)
    WINDOW o AS (PARTITION BY strategy, symbol, seq ORDER BY "offset"),
           b AS (PARTITION BY strategy, symbol, seq ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "exits": """
    SELECT strategy, symbol, seq,
      coalesce(arg_min(bar_date, "offset") FILTER (hit IS NOT NULL), max(bar_date)) AS exit_date,
      coalesce(arg_min(price, "offset") FILTER (hit IS NOT NULL), arg_max(close, "offset")) AS raw_exit,
      coalesce(arg_min(hit, "offset") FILTER (hit IS NOT NULL),
               CASE WHEN arg_max(asks_exit, "offset") THEN 'Short Signal' ELSE 'open' END) AS reason,
      CAST(coalesce(min("offset") FILTER (hit IS NOT NULL), max("offset")) + 1 AS INTEGER) AS days_open
    FROM (SELECT *,
        CASE WHEN exit_pending THEN 'Short Signal' WHEN low <= stop_now THEN 'stop'
             WHEN target_now IS NOT NULL AND high >= target_now THEN 'target'
             WHEN "offset"=last_offset THEN 'time_stop' END AS hit,
        CASE WHEN exit_pending THEN open WHEN low <= stop_now THEN stop_now
             WHEN target_now IS NOT NULL AND high >= target_now THEN target_now ELSE close END AS price FROM stops)
    GROUP BY strategy, symbol, seq""",
    "priced": """
    SELECT f.*, e.exit_date, e.raw_exit, e.reason, e.days_open,
      f.raw_entry*(1+5.0::DOUBLE/10000) AS entry_price, e.raw_exit*(1-5.0::DOUBLE/10000) AS exit_price
    FROM filled f JOIN exits e USING (strategy, symbol, seq)""",
    "sized": """
    SELECT *, floor(least(10000.0::DOUBLE*rate/(entry_price-stop_loss), floor((5000.0::DOUBLE-3)/entry_price))) AS qty,
       entry_price-stop_loss AS initial_risk
    FROM priced, (SELECT unnest([0.005::DOUBLE, 0.01, 0.015, 0.02]) AS rate)""",
    "outcomes_by_rate": """
    SELECT *, 6.0::DOUBLE AS brokerage, (entry_price-raw_entry)*qty + (raw_exit-exit_price)*qty AS slippage,
       (exit_price-entry_price)*qty - 6 AS profit, ((exit_price-entry_price)*qty - 6)/(qty*initial_risk) AS r_multiple
    FROM sized WHERE qty > 0""",
    "outcomes": "SELECT * FROM outcomes_by_rate WHERE rate = 0.01::DOUBLE",
    # --- trades -------------------------------------------------------------------
    "trades": """
    SELECT p_brand AS strategy, p_type AS family, concat('S', lpad(CAST(l_suppkey AS VARCHAR), 5, '0')) AS symbol,
       'fold-' || (year(l_shipdate)-1994) AS fold, least(l_shipdate::DATE, o_orderdate::DATE) AS entry_date,
       greatest(l_shipdate::DATE, o_orderdate::DATE) AS exit_date,
       l_extendedprice*(l_discount-0.05::DOUBLE)/1000 AS profit, l_returnflag AS setup, l_linestatus AS regime
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey""",
    "equity": """
    SELECT strategy, bar_date, floor((10000.0::DOUBLE + sum(p) OVER (PARTITION BY strategy ORDER BY bar_date))*100+0.5::DOUBLE)/100 AS capital
    FROM (SELECT strategy, exit_date AS bar_date, sum(profit) AS p FROM trades GROUP BY ALL)""",
    "fold_equity": """
    SELECT strategy, fold, bar_date, floor((10000.0::DOUBLE + sum(p) OVER (PARTITION BY strategy, fold ORDER BY bar_date))*100+0.5::DOUBLE)/100 AS capital
    FROM (SELECT strategy, fold, exit_date AS bar_date, sum(profit) AS p FROM trades GROUP BY ALL)""",
    "underwater": """
    SELECT *, peak-capital AS dd, CASE WHEN peak>0 THEN 100.0::DOUBLE*(peak-capital)/peak ELSE 0 END AS dd_pct
    FROM (SELECT *, greatest(10000.0::DOUBLE, max(capital) OVER (PARTITION BY strategy ORDER BY bar_date)) AS peak FROM equity)""",
    "fold_drawdowns": """
    SELECT strategy, fold, max(100.0::DOUBLE*(peak-capital)/peak) AS drawdown_pct
    FROM (SELECT *, greatest(10000.0::DOUBLE, max(capital) OVER (PARTITION BY strategy, fold ORDER BY bar_date)) AS peak FROM fold_equity)
    GROUP BY ALL""",
    "scores": """
    SELECT strategy, final_capital, final_capital-10000 AS earned_profit, trades, wins,
       100.0::DOUBLE*wins/trades AS win_rate
    FROM (SELECT strategy, arg_max(capital, bar_date) AS final_capital FROM equity GROUP BY strategy)
    JOIN (SELECT strategy, count(*) AS trades, count(*) FILTER (profit>0) AS wins FROM trades GROUP BY strategy) USING (strategy)""",
    "fold_scores": "SELECT strategy, fold, round(sum(profit), 6) AS score FROM trades GROUP BY ALL",
    "fold_results": """
    SELECT s.strategy, s.fold, s.score, s.score AS profit, d.drawdown_pct FROM fold_scores s JOIN fold_drawdowns d USING (strategy, fold)""",
    "periods": """
    SELECT strategy, fold, i, round(c - coalesce(lag(c) OVER (PARTITION BY strategy ORDER BY i), 10000.0::DOUBLE), 2) AS profit
    FROM (SELECT s.strategy, f.fold, f.start AS i, coalesce((SELECT arg_max(capital, bar_date) FROM equity e
            WHERE e.strategy=s.strategy AND e.bar_date <= f."end"), 10000.0::DOUBLE) AS c
          FROM (SELECT DISTINCT strategy FROM equity) s CROSS JOIN folds f)""",
    "fold_counts": """
    SELECT s.strategy, f.fold, count(t.profit) AS n FROM (SELECT DISTINCT strategy FROM trades) s CROSS JOIN folds f
    LEFT JOIN trades t ON t.strategy=s.strategy AND t.fold=f.fold GROUP BY ALL""",
    "segments": """
    SELECT strategy, w-1 AS segment, CASE WHEN prev>0 THEN capital/prev-1 ELSE 0 END AS r FROM (
      SELECT e.strategy, w, capital, coalesce(lag(capital) OVER (PARTITION BY e.strategy ORDER BY w), 10000.0::DOUBLE) AS prev
      FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY bar_date) AS i,
                   count(*) OVER (PARTITION BY strategy) AS n FROM equity) e,
           (SELECT unnest([1,2,3,4,5,6]) AS w) WHERE n >= 12 AND i = floor(n*w/6))""",
    "ginis": """
    SELECT strategy, 2*sum(i*profit)/(max(w)*sum(profit)) - (max(w)+1.0::DOUBLE)/max(w) AS gini FROM (
      SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY profit) AS i, count(*) OVER (PARTITION BY strategy) AS w
      FROM trades WHERE profit > 0) GROUP BY strategy""",
    "concentration": """
    SELECT t.strategy, t.n AS trades, round(total,2) AS total_profit, round(best,2) AS best_trade_profit,
      round(total-best,2) AS profit_without_best_trade, round(pt-bf,2) AS profit_without_best_fold,
      round(total-bs,2) AS profit_without_best_symbol,
      CASE WHEN total-best<=0 OR pt-bf<=0 THEN 'killed'
           WHEN (total>0 AND best/total>0.5::DOUBLE) OR total-bs<=0 THEN 'weakened' ELSE 'survived' END AS verdict
    FROM (SELECT strategy, count(*) AS n, sum(profit) AS total, max(profit) AS best FROM trades GROUP BY strategy) t
    JOIN (SELECT strategy, max(profit) AS bf, sum(profit) AS pt FROM periods GROUP BY strategy) f USING (strategy)
    JOIN (SELECT strategy, max(p) AS bs FROM (SELECT strategy, symbol, sum(profit) AS p FROM trades GROUP BY ALL) GROUP BY strategy) s USING (strategy)""",
    "sample_audit": """
    SELECT strategy, CAST(sum(n) AS BIGINT) AS total_trades, count(*) FILTER (n=0) AS empty_folds, min(n) AS min_fold_trades,
      CASE WHEN sum(n)>=30 AND count(*) FILTER (n>0) >= ceil(count(*)/2) THEN 'survived' ELSE 'killed' END AS verdict
    FROM fold_counts GROUP BY strategy""",
    "verdicts": """
    SELECT strategy, CASE WHEN 'killed' IN (s.verdict, c.verdict) THEN 'killed' WHEN 'weakened' IN (s.verdict, c.verdict)
      THEN 'weakened' ELSE 'survived' END AS verdict FROM sample_audit s JOIN concentration c USING (strategy)""",
    "vectors": """
    SELECT strategy, string_agg(fold, ',' ORDER BY fold) AS signature, count(*) AS folds, list(score ORDER BY fold) AS scores
    FROM fold_scores GROUP BY strategy""",
    "pairs": """
    SELECT x.signature, x.strategy AS a, y.strategy AS b, x.scores AS a_scores, y.scores AS b_scores
    FROM vectors x JOIN vectors y ON x.signature=y.signature AND x.strategy < y.strategy""",
    "correlations": """
    SELECT a, b, corr(x, y) AS r FROM (SELECT a, b, unnest(a_scores) AS x, unnest(b_scores) AS y FROM pairs) GROUP BY ALL""",
    "overlap": """
    WITH k AS (SELECT DISTINCT strategy, symbol, fold, entry_date, exit_date FROM trades),
         n AS (SELECT strategy, count(*) AS n FROM k GROUP BY strategy),
         s AS (SELECT x.strategy AS a, y.strategy AS b, count(*) AS s FROM k x JOIN k y
               USING (symbol, fold, entry_date, exit_date) WHERE x.strategy < y.strategy GROUP BY ALL)
    SELECT p.a, p.b, coalesce(s, 0) AS shared_trades, coalesce(s,0)::DOUBLE/(na.n+nb.n-coalesce(s,0)) AS jaccard
    FROM pairs p LEFT JOIN s USING (a, b) JOIN n na ON na.strategy=p.a JOIN n nb ON nb.strategy=p.b""",
    "resample_picks": "SELECT resample, i, n, CAST(floor(u*n) AS BIGINT) AS idx FROM " + uniform("""
       SELECT resample, i, n, 48879 AS seed, resample*n+i AS k FROM (SELECT unnest(range(2000)) AS resample),
       (SELECT DISTINCT folds AS n FROM vectors), LATERAL (SELECT unnest(range(n)) AS i)"""),
    "intervals": """
    SELECT a, b, quantile_cont(r, 0.025) AS lower, quantile_cont(r, 0.975) AS upper, count(*) AS resamples
    FROM (SELECT a, b, resample, corr(a_scores[idx+1], b_scores[idx+1]) AS r FROM pairs JOIN resample_picks ON n = len(a_scores) GROUP BY ALL)
    WHERE isfinite(r) GROUP BY ALL""",
    "redundancy": """
    SELECT a, b, r, lower, upper, shared_trades, jaccard, coalesce(lower >= 0.9::DOUBLE, false) AND jaccard <= 0.1::DOUBLE AS flagged
    FROM correlations JOIN intervals USING (a, b) JOIN overlap USING (a, b)""",
    "families": "SELECT strategy, min(family) AS family FROM trades GROUP BY strategy",
    # --- screen and grid ----------------------------------------------------------
    "training": "SELECT * FROM feat WHERE bar_date <= DATE '1998-12-31'",
    "baseline": """
    SELECT symbol, horizon, avg(r) AS baseline_return, count(*) AS entries FROM (
      SELECT e.symbol, h AS horizon, x.close/e.open-1 AS r FROM training e, (SELECT CAST(unnest(range(1,31)) AS INTEGER) AS h)
      JOIN training x ON x.symbol=e.symbol AND x.seq=e.seq+h WHERE e.seq > 90) GROUP BY ALL""",
    "forward": """
    SELECT s.*, least(30, greatest(1, max_hold_days)) AS horizon, x.close/e.open-1 AS forward_return
    FROM signals s JOIN training t USING (symbol, seq) JOIN training e ON e.symbol=s.symbol AND e.seq=s.seq+1
    JOIN training x ON x.symbol=s.symbol AND x.seq=s.seq+1+least(30, greatest(1, max_hold_days)) WHERE side='long'""",
    "points": """
    SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS point, lookback, "drop", hold FROM (
      SELECT 4*a.i+2*b.i+c.i AS i, lookback, "drop", hold FROM
      (SELECT unnest([0,1]) AS i, unnest([10,20]) AS lookback) a, (SELECT unnest([0,1]) AS i, unnest([0.97::DOUBLE,0.98]) AS "drop") b,
      (SELECT unnest([0,1]) AS i, unnest([3,8]) AS hold) c)""",
    "grid": """
    SELECT 'dip' AS campaign, point, lookback, "drop", hold, count(*) AS signals, round(avg(r)-avg(baseline_return), 9) AS score FROM (
      SELECT p.*, s.symbol, x.close/e.open-1 AS r FROM
        (SELECT *, round(avg(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS mean10 FROM training) s
        CROSS JOIN points p JOIN training e ON e.symbol=s.symbol AND e.seq=s.seq+1
        JOIN training x ON x.symbol=s.symbol AND x.seq=s.seq+1+hold
      WHERE s.seq>=90 AND s.close < p."drop"*(CASE WHEN lookback=10 THEN s.mean10 ELSE s.mean20 END)) g
    JOIN baseline b ON b.symbol=g.symbol AND b.horizon=g.hold GROUP BY ALL""",
    "neighbours": """
    SELECT x.campaign, x.point, y.point AS neighbour, y.score AS neighbour_score FROM grid x JOIN grid y USING (campaign)
    WHERE (x.lookback<>y.lookback)::INT + (x."drop"<>y."drop")::INT + (x.hold<>y.hold)::INT <= 1""",
    # --- ensembles ----------------------------------------------------------------
    "long_signals": "SELECT * FROM economics WHERE side='long'",
    "rule_correlations": """
    SELECT a, b, r FROM (VALUES ('deep','dip',0.6::DOUBLE), ('turn','dip',0.3::DOUBLE), ('turn','deep',-0.2::DOUBLE)) v(a,b,r)""",
    "weights": """
    SELECT s.*, 1/(1+coalesce((SELECT sum(greatest(c.r,0)) FROM long_signals o JOIN rule_correlations c
        ON (c.a=s.strategy AND c.b=o.strategy) OR (c.b=s.strategy AND c.a=o.strategy)
        WHERE o.symbol=s.symbol AND o.signal_date=s.signal_date AND o.strategy<>s.strategy), 0)) AS weight FROM long_signals s""",
    "pooled": """
    SELECT symbol, signal_date, strategies, votes, anchor + (mean-anchor)*(1+0.5::DOUBLE*(votes-1)) AS evidence FROM (
      SELECT symbol, signal_date, count(*) AS strategies, sum(weight) AS votes, ln(0.45::DOUBLE/(1-0.45::DOUBLE)) AS anchor,
        coalesce(sum(weight*ln(q/(1-q)))/sum(CASE WHEN q IS NOT NULL THEN weight END), ln(0.45::DOUBLE/(1-0.45::DOUBLE))) AS mean
      FROM (SELECT *, CASE WHEN conf IS NOT NULL THEN greatest(0.001::DOUBLE, least(1-0.001::DOUBLE, conf)) END AS q FROM weights)
      GROUP BY ALL)""",
    "graded": """
    SELECT r.*, p.strategies, p.votes, p.evidence, 1/(1+exp(-p.evidence)) AS score,
       CASE WHEN r.target IS NOT NULL THEN rr/(1+exp(-p.evidence)) - (1-1/(1+exp(-p.evidence))) END AS expected_r
    FROM (SELECT * FROM long_signals QUALIFY row_number() OVER (PARTITION BY symbol, signal_date
            ORDER BY conf DESC NULLS LAST, coalesce(rr, 0) DESC, strategy) = 1) r
    JOIN pooled p USING (symbol, signal_date) WHERE r.risk > 0""",
    "liquidity": """
    SELECT symbol, bar_date AS signal_date, avg(close*volume) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS traded_value FROM adjusted""",
    "liquid": "SELECT g.*, l.traded_value FROM graded g JOIN liquidity l USING (symbol, signal_date) WHERE traded_value >= 2000",
    # --- forecasts ----------------------------------------------------------------
    "origins": """
    SELECT symbol, origin, seq, origin_price FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS i FROM (
        SELECT symbol, bar_date AS origin, seq, adj_close AS origin_price,
               lead(bar_date, 20) OVER (PARTITION BY symbol ORDER BY bar_date) AS last_date FROM seq)
      WHERE seq >= 64 AND last_date IS NOT NULL) WHERE i % 5 = 0""",
    "targets": """
    SELECT o.*, h AS horizon, b.bar_date AS target_date, b.adj_close AS actual_price
    FROM origins o, (SELECT unnest([1,5,10,20]) AS h) JOIN seq b ON b.symbol=o.symbol AND b.seq=o.seq+h""",
    "momentum": """
    SELECT t.*, origin_price*exp(horizon*(ln(origin_price/b.adj_close)/10)) AS forecast_price
    FROM targets t JOIN seq b ON b.symbol=t.symbol AND b.seq=t.seq-10""",
    "empirical": """
    SELECT * EXCLUDE (levels), list_transform(levels, lambda q: origin_price*(1+q)) AS quantiles FROM (
    SELECT t.*, quantile_cont(x.adj_close/y.adj_close-1, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS levels
    FROM targets t JOIN seq x ON x.symbol=t.symbol AND x.seq BETWEEN t.seq-63+t.horizon AND t.seq
    JOIN seq y ON y.symbol=x.symbol AND y.seq=x.seq-t.horizon GROUP BY ALL)""",
    "forecasts": """
    SELECT symbol, origin, seq, 'unchanged' AS model, horizon, target_date, origin_price, actual_price, origin_price AS forecast_price, NULL::DOUBLE[] AS quantiles FROM targets
    UNION ALL SELECT symbol, origin, seq, 'momentum', horizon, target_date, origin_price, actual_price, forecast_price, NULL FROM momentum
    UNION ALL SELECT symbol, origin, seq, 'empirical', horizon, target_date, origin_price, actual_price, quantiles[5], quantiles FROM empirical""",
    "errors": """
    SELECT *, abs(forecast_price-actual_price) AS abs_error, 100*abs(forecast_price-actual_price)/origin_price AS error_pp,
      CASE WHEN a>0.1::DOUBLE THEN 1 WHEN a < -0.1::DOUBLE THEN -1 ELSE 0 END AS ad,
      CASE WHEN p>0.1::DOUBLE THEN 1 WHEN p < -0.1::DOUBLE THEN -1 ELSE 0 END AS pd
    FROM (SELECT *, 100*(actual_price/origin_price-1) AS a, 100*(forecast_price/origin_price-1) AS p FROM forecasts)""",
    "metrics": """
    SELECT CASE WHEN grouping(symbol)=0 THEN 'symbol' WHEN grouping(y)=0 THEN 'year' ELSE 'overall' END AS "group",
      CASE WHEN grouping(symbol)=0 THEN symbol WHEN grouping(y)=0 THEN y ELSE 'all' END AS label, model, horizon, count(*) AS n,
      avg(error_pp) AS return_mae_pp, avg(abs_error) AS price_mae, count(*) FILTER (ad=pd) AS direction_hits,
      100.0::DOUBLE*count(*) FILTER (ad=pd)/count(*) AS direction_accuracy_pct,
      100*(count(*) FILTER (ad=1 AND pd=1)/nullif(count(*) FILTER (ad=1),0)
          + count(*) FILTER (ad=-1 AND pd=-1)/nullif(count(*) FILTER (ad=-1),0))/2 AS balanced_accuracy_pct,
      100.0::DOUBLE*count(*) FILTER (ad=1)/count(*) AS actual_up_pct, 100.0::DOUBLE*count(*) FILTER (ad=0)/count(*) AS actual_flat_pct,
      100.0::DOUBLE*count(*) FILTER (pd<>0)/count(*) AS predicted_nonflat_pct
    FROM (SELECT *, CAST(year(origin) AS VARCHAR) AS y FROM errors)
    GROUP BY GROUPING SETS ((model, horizon), (symbol, model, horizon), (y, model, horizon))""",
    # --- bootstraps ---------------------------------------------------------------
    "placed": """
    SELECT strategy, fold, profit, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY strategy, fold) AS n
    FROM trades WINDOW w AS (PARTITION BY strategy, fold ORDER BY exit_date, entry_date, symbol, profit)""",
    "sized_folds": """
    SELECT *, CAST(ceil(n/b) AS BIGINT) AS blocks, n - b*(CAST(ceil(n/b) AS BIGINT)-1) AS tail FROM (
      SELECT DISTINCT strategy, fold, n, greatest(1, least(10, n//2)) AS b FROM placed)""",
    "shapes": """
    SELECT *, sum(blocks) OVER (PARTITION BY strategy) AS per_draw,
      coalesce(sum(blocks) OVER (PARTITION BY strategy ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM sized_folds""",
    "circles": """
    SELECT p.strategy, p.fold, p.pos, sum(x.profit) AS full_sum, sum(x.profit) FILTER (j < tail) AS last_sum
    FROM placed p JOIN shapes s ON s.strategy=p.strategy AND s.fold=p.fold, LATERAL (SELECT unnest(range(s.b)) AS j)
    JOIN placed x ON x.strategy=p.strategy AND x.fold=p.fold AND x.pos=(p.pos+j)%p.n GROUP BY p.strategy, p.fold, p.pos""",
    "block_picks": "SELECT strategy, fold, draw, is_last, CAST(floor(u*n) AS BIGINT) AS pos FROM " + uniform("""
       SELECT strategy, fold, n, draw, block = blocks-1 AS is_last, 12648430 AS seed, draw*per_draw+earlier+block AS k
       FROM shapes, LATERAL (SELECT unnest(range(blocks)) AS block), (SELECT unnest(range(1000)) AS draw)"""),
    "bands": """
    SELECT strategy, list_sort(list(m))[901] AS q90 FROM (SELECT strategy, draw, median(s) AS m FROM (
      SELECT k.strategy, k.fold, k.draw, sum(CASE WHEN is_last THEN last_sum ELSE full_sum END) AS s
      FROM block_picks k JOIN circles c USING (strategy, fold, pos) GROUP BY ALL) GROUP BY ALL) GROUP BY strategy""",
    "medians": "SELECT strategy, median(s) AS m FROM (SELECT strategy, fold, sum(profit) AS s FROM trades GROUP BY ALL) GROUP BY strategy",
    "gate_trades": """
    SELECT strategy, fold, profit FROM trades
    UNION ALL SELECT 'new ' || strategy, fold, CASE WHEN strategy LIKE '%2' THEN abs(profit) ELSE profit END FROM trades
      WHERE NOT (strategy LIKE '%3' AND fold='fold-3')
    UNION ALL SELECT 'few', fold, profit FROM trades
      WHERE strategy='Brand#11' AND symbol='S00001' AND fold='fold-2' AND day(exit_date) <= 10""",
    "gate_folds": """
    SELECT strategy, fold, start, "end" FROM (SELECT DISTINCT strategy FROM gate_trades UNION SELECT 'few' UNION SELECT 'new idle') CROSS JOIN folds
    WHERE NOT (strategy LIKE 'new %5' AND fold='fold-7')""",
    "gate_sides": """
    SELECT *, (SELECT string_agg(d.start || ':' || d."end", ',' ORDER BY d.start) FROM gate_folds d WHERE d.strategy=s.strategy) AS ranges
    FROM (SELECT strategy, median(coalesce(p, 0)) AS m, coalesce(sum(n), 0) AS n FROM (SELECT strategy, fold FROM gate_folds)
          FULL JOIN (SELECT strategy, fold, sum(profit) AS p, count(*) AS n FROM gate_trades GROUP BY ALL) USING (strategy, fold) GROUP BY strategy) s""",
    "pool": """
    SELECT strategy, r_multiple AS r, row_number() OVER (PARTITION BY strategy ORDER BY exit_date, entry_date, symbol, seq) - 1 AS pos FROM outcomes""",
    "seeds": """
    SELECT strategy, n, rate, CASE WHEN s=0 THEN 42 ELSE s END AS seed FROM (SELECT strategy, n, rate,
      xor((abs(t) % 4294967296)::BIGINT, round(rate*1000000)::BIGINT) AS s FROM
      (SELECT strategy, count(*) AS n, sum(floor(r*1000000.0::DOUBLE+0.5::DOUBLE)::HUGEINT*(pos+1)) AS t FROM pool GROUP BY strategy),
      (SELECT unnest([0.005::DOUBLE, 0.01, 0.015, 0.02]) AS rate))""",
    "walk_picks": "SELECT strategy, rate, path, step, CAST(floor(u*n) AS BIGINT) AS pos FROM " + uniform("""
       SELECT strategy, rate, n, path, step, seed, path*n+step AS k FROM seeds, (SELECT unnest(range(500)) AS path),
       LATERAL (SELECT unnest(range(n)) AS step)"""),
    "walks": """
    SELECT strategy, rate, path, max(1 - exp(g - top)) AS dd FROM (
      SELECT *, greatest(0, max(g) OVER (PARTITION BY strategy, rate, path ORDER BY step)) AS top FROM (
        SELECT w.strategy, w.rate, w.path, w.step, sum(ln(1+w.rate*p.r)) OVER (PARTITION BY w.strategy, w.rate, w.path ORDER BY w.step) AS g
        FROM walk_picks w JOIN pool p USING (strategy, pos))) GROUP BY ALL""",
    "ruin": """
    SELECT strategy, rate, count(*) FILTER (dd >= 0.5::DOUBLE)/count(*) AS ruin_probability, list_sort(list(dd))[476] AS drawdown95
    FROM walks GROUP BY ALL""",
    "pass_equity": """
    SELECT strategy, rate, exit_date AS bar_date, floor((10000.0::DOUBLE + sum(p) OVER (PARTITION BY strategy, rate ORDER BY exit_date))*100+0.5::DOUBLE)/100 AS capital
    FROM (SELECT strategy, rate, exit_date, sum(profit) AS p FROM outcomes_by_rate GROUP BY ALL)""",
    "pass_steps": """
    SELECT *, greatest(10000.0::DOUBLE, max(capital) OVER w) AS peak, capital/lag(capital) OVER w - 1 AS r
    FROM pass_equity WINDOW w AS (PARTITION BY strategy, rate ORDER BY bar_date)""",
    "passes": """
    SELECT strategy, rate, 100*(f-10000)/10000 AS return_pct, CASE WHEN d>0 THEN (m-5.0::DOUBLE/100/252)*252/(d*sqrt(252)) ELSE 0 END AS sortino,
      max_drawdown_pct, ruin_probability, drawdown95 FROM (
      SELECT strategy, rate, arg_max(capital, bar_date) AS f, avg(r) AS m, sqrt(sum(least(0, r-5.0::DOUBLE/100/252)**2)/count(r)) AS d,
        floor(arg_max(100.0::DOUBLE*(peak-capital)/peak, (peak-capital, -epoch(bar_date)))*100+0.5::DOUBLE)/100 AS max_drawdown_pct
      FROM pass_steps GROUP BY strategy, rate) JOIN ruin USING (strategy, rate)""",
    "profile_passes": """
    SELECT *, CASE WHEN ruin_probability<=ruin_cap AND drawdown95<dd_cap THEN 1 WHEN ruin_probability<=ruin_cap THEN 2 ELSE 3 END AS tier
    FROM passes CROSS JOIN (VALUES ('conservative',0.004::DOUBLE,0.25::DOUBLE), ('moderate',0.01,0.35), ('aggressive',0.02,0.45)) v(profile, ruin_cap, dd_cap)""",
    "chosen": """
    SELECT * FROM (SELECT *, CASE WHEN profile='conservative' AND tier<3 AND sortino<=0 THEN 1 WHEN profile='moderate' AND tier<3 AND sortino < top-0.01::DOUBLE THEN 1 ELSE 0 END AS later
      FROM (SELECT *, max(sortino) OVER (PARTITION BY strategy, profile, tier) AS top FROM profile_passes))
    QUALIFY row_number() OVER (PARTITION BY strategy, profile ORDER BY tier, later,
      CASE WHEN profile='aggressive' AND tier=1 OR profile='conservative' AND later=1 THEN -return_pct ELSE 0 END,
      CASE WHEN profile='conservative' AND later=1 THEN max_drawdown_pct ELSE 0 END,
      CASE WHEN profile='conservative' AND later=1 THEN drawdown95 ELSE 0 END, CASE WHEN profile='aggressive' THEN -rate ELSE rate END) = 1""",
    "envelope_walks": """
    SELECT strategy, path, step, CASE WHEN lost > 0 THEN 0 WHEN below % 2 = 1 THEN -exp(g::DOUBLE) ELSE exp(g::DOUBLE) END AS multiple FROM (
      SELECT w.strategy, w.path, w.step, sum(CAST(CASE WHEN 1+0.01::DOUBLE*r <> 0 THEN ln(abs(1+0.01::DOUBLE*r)) ELSE 0 END AS DECIMAL(20,15))) OVER o AS g,
        sum(CASE WHEN 1+0.01::DOUBLE*r < 0 THEN 1 ELSE 0 END) OVER o AS below, sum(CASE WHEN 1+0.01::DOUBLE*r = 0 THEN 1 ELSE 0 END) OVER o AS lost
      FROM walk_picks w JOIN pool p USING (strategy, pos) WHERE rate = 0.01::DOUBLE
      WINDOW o AS (PARTITION BY w.strategy, w.path ORDER BY w.step))""",
    "envelope_paths": """
    SELECT strategy, path, band FROM (
      SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY final, path) - 1 AS i FROM (
        SELECT strategy, path, arg_max(multiple, step) AS final FROM envelope_walks GROUP BY ALL))
    JOIN (VALUES (25, 'p5'), (250, 'p50'), (475, 'p95')) v(spot, band) ON i = spot""",
    "upserted_bars": """
    SELECT b.symbol, b.bar_date, coalesce(r.open,b.open) AS open, coalesce(r.high,b.high) AS high, coalesce(r.low,b.low) AS low,
      coalesce(r.close,b.close) AS close, coalesce(r.adj_close,b.adj_close) AS adj_close, coalesce(r.volume,b.volume) AS volume
    FROM bars b LEFT JOIN (SELECT * FROM raw_bars WHERE bar_date >= DATE '2001-01-01') r ON r.symbol=b.symbol AND r.bar_date=b.bar_date""",
    "digest_leaves": digests("(SELECT *, year(bar_date) AS year FROM upserted_bars)", "symbol, year", "bar_date, " + BAR_BITS + ", volume"),
    "prints": """
    SELECT strategy, right(strategy, 1) AS rule, md5(string_agg(k, ';' ORDER BY k)) AS print FROM
      (SELECT strategy, concat_ws('|', symbol, fold, entry_date, exit_date) AS k FROM trades) GROUP BY strategy""",
    # --- events -------------------------------------------------------------------
    "calls": """
    SELECT * FROM (SELECT event_id // 2 AS call_id, CASE WHEN event_id%2=0 THEN 'start' ELSE 'end' END AS kind, ts,
      event_type AS tool, CASE WHEN event_type='error' THEN 'error' ELSE 'ok' END AS status, props AS text FROM events)
    WHERE kind='end' OR tool<>'signup'""",
    "trials": """
    SELECT ts, event_type AS source, value AS score, value>20 AS accepted,
      'run-' || user_id || '-' || event_type || '-' || strftime(ts, '%Y%m%d%H') AS run_record FROM events""",
}


def _needs(text: str) -> list[str]:
    return [name for name in PARTS if re.search(rf"(?:FROM|JOIN)\s+{name}\b", text)]


def sql(body: str, **instead: str) -> str:
    """Prefix the WITH parts that ``body`` uses, dependencies first; ``instead`` replaces some of them."""
    done: list[str] = []
    parts_of = PARTS | instead

    def visit(name: str) -> None:
        if name in done:
            return
        for other in _needs(parts_of[name]):
            if other != name:
                visit(other)
        done.append(name)

    for name in _needs(body):
        visit(name)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({parts_of[name]})" for name in done)
    return f"WITH {parts}\n{body}" if parts else body


def columns(names: str) -> str:
    """Plain columns (``a b``) and rounded ones (``~x``, or ``~x:places``)."""
    wanted = []
    for token in names.split():
        if token.startswith("~"):
            name, _, places = token[1:].partition(":")
            wanted.append(R(name, name, int(places or 6)))
        else:
            wanted.append(token)
    return ", ".join(wanted)


def _out(names: str, source: str, **instead: str) -> str:
    return sql(f"SELECT {columns(names)} FROM {source}", **instead)


CAST = f"""WITH base AS ({PARTS['trades']}), made AS (
    SELECT * FROM (VALUES ('Brand#98', 'COPY', 'Brand#11'), ('Brand#97', 'SHIFT', 'Brand#12'), ('Strong#6', 'STRONG A', 'Brand#11'),
      ('Strong#9', 'STRONG B', 'Brand#13'), ('Short#5', 'SHORT', 'Brand#15'), ('Lucky#8', 'LUCKY', 'Brand#25')) v(name, line, origin))
    SELECT * FROM base UNION ALL
    SELECT name, line, symbol, fold, CASE WHEN name = 'Brand#97' THEN entry_date - 1 ELSE entry_date END, exit_date,
      CASE WHEN name = 'Brand#97' THEN profit*1.01::DOUBLE WHEN name LIKE 'Strong%' THEN abs(profit)
           WHEN name = 'Lucky#8' AND symbol = 'S00001' AND profit > 0 THEN profit*1000 ELSE profit END, setup, regime
    FROM base JOIN made ON strategy = origin WHERE name <> 'Short#5' OR fold IN ('fold-1', 'fold-2', 'fold-3')"""


NOISY_SEQ = f"""WITH s AS ({PARTS['seq']}), n AS (SELECT symbol, row_number() OVER (ORDER BY symbol)-1 AS n FROM (SELECT DISTINCT symbol FROM s))
    SELECT replica || '|' || symbol AS symbol, bar_date, open*f AS open, high*f AS high, low*f AS low, close*f AS close, adj_close, volume, seq
    FROM (SELECT *, 1+(u*2-1)*0.002::DOUBLE AS f FROM """ + uniform("""SELECT s.*, replica, replica*100003+n*1009+17 AS seed, s.seq-1 AS k
      FROM s JOIN n USING (symbol), (SELECT unnest([1, 2]) AS replica)""") + ")"

DECISION = """SELECT *, positive_return_folds AND maximum_drawdown AND full_period_return AND full_period_drawdown AND sample_adequacy AS promotable FROM
        (SELECT strategy, count(*) FILTER (profit>0) >= ceil(count(*)*0.6::DOUBLE) AS positive_return_folds FROM periods GROUP BY strategy)
        JOIN (SELECT strategy, max(drawdown_pct)<=30 AS maximum_drawdown FROM fold_drawdowns GROUP BY strategy) USING (strategy)
        JOIN (SELECT strategy, earned_profit>0 AS full_period_return FROM scores) USING (strategy)
        JOIN (SELECT strategy, max(dd_pct)<=30 AS full_period_drawdown FROM underwater GROUP BY strategy) USING (strategy)
        JOIN (SELECT strategy, sum(n)>=30 AND count(*) FILTER (n>0) >= ceil(count(*)/2) AS sample_adequacy FROM fold_counts GROUP BY strategy) USING (strategy)"""
SUMMARY_COLUMNS = """strategy ~net_profit ~median_fold_score positive_folds ~positive_fold_rate_pct ~max_fold_drawdown_pct losing_folds ~worst_fold_score
        ~best_fold_score total_trades ~win_rate_pct ~total_profit"""
SUMMARY = """(SELECT strategy, round(earned_profit,2) AS net_profit, round(m,2) AS median_fold_score, pf AS positive_folds,
        round(100*pr,2) AS positive_fold_rate_pct, round(mx,2) AS max_fold_drawdown_pct, lf AS losing_folds, round(w,2) AS worst_fold_score, round(b,2) AS best_fold_score,
        trades AS total_trades, round(win_rate,2) AS win_rate_pct, round(tp,2) AS total_profit FROM scores
        JOIN (SELECT strategy, median(score) AS m, min(score) AS w, max(score) AS b, count(*) FILTER (score<0) AS lf, max(drawdown_pct) AS mx FROM fold_results GROUP BY strategy) USING (strategy)
        JOIN (SELECT strategy, count(*) FILTER (profit>0) AS pf, count(*) FILTER (profit>0)/count(*) AS pr FROM periods GROUP BY strategy) USING (strategy)
        JOIN (SELECT strategy, sum(profit) AS tp FROM trades GROUP BY strategy) USING (strategy))"""


BAR = "symbol bar_date open high low close adj_close volume"
ORACLE: dict[str, str] = {
    # --- sources ------------------------------------------------------------------
    "read_prices": _out(BAR, "bars WHERE symbol IN ('S00001','S00002','S00003','S00005','S00008')"),
    "upsert_prices": _out(BAR, """(SELECT b.symbol, b.bar_date, coalesce(r.open,b.open) AS open, coalesce(r.high,b.high) AS high,
        coalesce(r.low,b.low) AS low, coalesce(r.close,b.close) AS close, coalesce(r.adj_close,b.adj_close) AS adj_close,
        coalesce(r.volume,b.volume) AS volume FROM bars b LEFT JOIN (SELECT * FROM raw_bars WHERE bar_date >= DATE '2001-01-01') r
        ON r.symbol=b.symbol AND r.bar_date=b.bar_date)"""),
    "sync_newer_rows": _out(BAR, """(SELECT b.* FROM bars b LEFT JOIN (SELECT symbol, max(bar_date) AS m FROM bars
        WHERE bar_date < DATE '2000-01-01' AND symbol >= 'S00010' GROUP BY symbol) t ON t.symbol=b.symbol
        WHERE b.bar_date > greatest(coalesce(t.m, DATE '1999-06-30'), DATE '1999-06-30'))"""),
    "upsert_prices_table": sql("""SELECT symbol, bar_date, open, high, low, close, adj_close, volume, 'before' AS state FROM bars UNION ALL
        SELECT b.symbol, b.bar_date, coalesce(r.open,b.open), coalesce(r.high,b.high), coalesce(r.low,b.low), coalesce(r.close,b.close),
        coalesce(r.adj_close,b.adj_close), coalesce(r.volume,b.volume), 'after' FROM bars b LEFT JOIN
        (SELECT * FROM raw_bars WHERE bar_date >= DATE '2001-01-01' AND high >= low AND low > 0) r ON r.symbol=b.symbol AND r.bar_date=b.bar_date"""),
    "sync_prices_table": sql("""SELECT symbol, bar_date, open, high, low, close, adj_close, volume, s AS state FROM (
        SELECT b.*, b.bar_date < DATE '2000-01-01' AND b.symbol >= 'S00010' AS old,
          b.bar_date > greatest(coalesce(t.m, DATE '1999-06-30'), DATE '1999-06-30') AS new FROM bars b LEFT JOIN (SELECT symbol, max(bar_date) AS m
          FROM bars WHERE bar_date < DATE '2000-01-01' AND symbol >= 'S00010' GROUP BY symbol) t ON t.symbol=b.symbol),
        LATERAL (SELECT unnest(['before', 'after']) AS s) WHERE old OR (new AND s = 'after')"""),
    "export_training": _out("symbol bar_date ~open ~high ~low ~close volume", """(SELECT symbol, bar_date, open*f AS open, high*f AS high,
        low*f AS low, adj_close AS close, volume FROM (SELECT *, CASE WHEN close<>0 THEN adj_close/close ELSE 1 END AS f,
        count(*) OVER (PARTITION BY symbol) AS n FROM bars WHERE bar_date <= DATE '2001-06-30') WHERE n >= 500)"""),
    "export_training_forecasts": _out("symbol as_of horizon_days model ~predicted_return_pct", """(SELECT symbol, origin AS as_of,
        horizon AS horizon_days, model, 100*(forecast_price/origin_price-1) AS predicted_return_pct FROM forecasts
        WHERE horizon=10 AND origin <= DATE '1998-12-31')"""),
    "trial_ledger": _out("ts source ~score accepted run_record", """(SELECT * FROM trials WHERE ts < TIMESTAMP '2024-01-15' UNION ALL
        SELECT * FROM trials WHERE ts >= TIMESTAMP '2024-01-10' AND score IS NOT NULL AND run_record NOT IN
        (SELECT run_record FROM trials WHERE ts < TIMESTAMP '2024-01-15'))"""),
    "forecast_view": _out("symbol origin horizon ~origin_price ~forecast_price", """(SELECT * FROM momentum)"""),
    # --- column functions ---------------------------------------------------------
    "adjust_prices": _out("symbol bar_date ~open ~high ~low ~close volume", """(SELECT symbol, bar_date, open*adj_close/close AS open,
        high*(adj_close/close) AS high, low*(adj_close/close) AS low, adj_close AS close, volume FROM bars)"""),
    "validate_prices": _out("symbol date ~close ~volume problems", "checked_rows WHERE problems <> ''"),
    "validate_candle_order": sql("SELECT symbol, date, count(*) AS copies FROM provider_rows GROUP BY ALL HAVING count(*) > 1"),
    "validate_proposals": _out("strategy symbol signal_date side problems", """(SELECT *, array_to_string(list_filter([
        CASE WHEN side='long' AND stop_loss >= entry_min OR side='short' AND stop_loss <= entry_max THEN 'stop_side' END,
        CASE WHEN side='long' AND target <= entry_max OR side='short' AND target >= entry_min THEN 'target_side' END,
        CASE WHEN risk/worst_entry < 0.0025::DOUBLE THEN 'stop_distance' END,
        CASE WHEN target IS NOT NULL AND rr < 1.05::DOUBLE THEN 'reward_risk' END], lambda x: x IS NOT NULL), ',') AS problems FROM economics)"""),
    "proposal_economics": _out("strategy symbol signal_date side ~worst_entry ~risk ~reward_risk ~reward_risk_tie ~expected_r", """(SELECT *,
        CASE WHEN target IS NULL THEN 999 ELSE rr END AS reward_risk, coalesce(rr,0) AS reward_risk_tie,
        CASE WHEN target IS NOT NULL THEN coalesce(conf,0.45::DOUBLE)*rr-(1-coalesce(conf,0.45::DOUBLE)) END AS expected_r FROM economics)"""),
    "entry_fill": _out("strategy symbol signal_date ~raw_entry", """(SELECT strategy, symbol, signal_date,
        CASE WHEN NOT (next_high < entry_min OR next_low > entry_max) AND next_open > stop_loss
        THEN greatest(entry_min, least(entry_max, next_open)) END AS raw_entry FROM signals WHERE next_open IS NOT NULL)"""),
    "bar_exit": _out("strategy symbol signal_date side ~price reason", """(SELECT *, CASE reason WHEN 'stop' THEN stop_loss WHEN 'target' THEN target END AS price
        FROM (SELECT *, CASE WHEN side='long' AND next_low<=stop_loss OR side='short' AND next_high>=stop_loss THEN 'stop'
        WHEN side='long' AND next_high>=target OR side='short' AND next_low<=target THEN 'target' END AS reason
        FROM signals WHERE next_open IS NOT NULL))"""),
    "r_multiple": _out("strategy symbol signal_date side ~r", """(SELECT strategy, symbol, signal_date, side,
        CASE WHEN side='long' THEN (next_close-worst_entry)/risk ELSE (worst_entry-next_close)/risk END AS r
        FROM economics WHERE next_open IS NOT NULL)"""),
    "apply_costs": _out("strategy symbol seq ~entry_price:10 ~exit_price:10 ~brokerage ~slippage ~profit", "outcomes"),
    "size_position": _out("strategy symbol signal_date rate qty", """(SELECT strategy, symbol, signal_date, rate,
        CAST(floor(least(10000.0::DOUBLE*rate/(e-stop_loss), floor((5000.0::DOUBLE-3)/e))) AS BIGINT) AS qty FROM
        (SELECT *, worst_entry*(1+5.0::DOUBLE/10000) AS e FROM long_signals), (SELECT unnest([0.005::DOUBLE,0.01,0.015,0.02]) AS rate))"""),
    "risk_factor": _out("strategy ~ruin ~drawdown95 ~risk_factor", """(SELECT strategy, ruin, drawdown95,
        (CASE WHEN ruin IS NULL THEN 1 ELSE greatest(0.75::DOUBLE, least(1, 1-ruin*5)) END) *
        (CASE WHEN drawdown95 IS NULL THEN 1 ELSE greatest(0.75::DOUBLE, least(1, 1-greatest(0, drawdown95-0.25::DOUBLE))) END) AS risk_factor FROM
        (SELECT strategy, ruin_probability AS ruin, drawdown95 FROM ruin WHERE rate = 0.02::DOUBLE UNION ALL SELECT 'idle', NULL, NULL))"""),
    "trade_confidence": sql("""SELECT strategy, symbol, n AS trades, round(CASE WHEN n<8 THEN 0 ELSE least(1, n/20) END, 6)+0.0 AS trade_confidence
        FROM (SELECT strategy, symbol, count(*) AS n FROM trades GROUP BY ALL)"""),
    "is_improvement": _out("strategy ~score ~best improved", """(SELECT strategy, earned_profit AS score, best,
        earned_profit > best + abs(best)*0.05::DOUBLE AND max_dd <= 30 AS improved FROM (SELECT *, median(earned_profit) OVER () AS best FROM scores)
        JOIN (SELECT strategy, max(dd_pct) AS max_dd FROM underwater GROUP BY strategy) USING (strategy))"""),
    "direction_sign": sql("SELECT symbol, origin, model, horizon, ad AS actual_dir, pd AS forecast_dir FROM errors"),
    "predicted_return": _out("symbol origin model horizon ~predicted_return_pct", """(SELECT *, 100*(forecast_price/origin_price-1) AS predicted_return_pct FROM forecasts)"""),
    "confidence_norm": _out("strategy symbol signal_date ~confidence_norm ~log_odds ~back", """(SELECT *, conf AS confidence_norm,
        ln(conf/(1-conf)) AS log_odds, conf AS back FROM economics)"""),
    "time_exit": _out("strategy symbol seq days_open time_exit", """(SELECT strategy, symbol, seq, days_open, days_open >= max_hold_days AS time_exit FROM outcomes)"""),
    "adjust_open_long": _out("strategy symbol seq bar_date action ~stop_loss ~target", """(SELECT p.strategy, p.symbol, p.seq, p.bar_date,
        CASE WHEN n.side='short' THEN 'exit' ELSE 'adjust' END AS action, CASE WHEN n.side='long' THEN greatest(p.stop_loss, n.stop_loss) END AS stop_loss,
        CASE WHEN n.side='long' THEN n.target END AS target FROM path p JOIN signals n ON n.strategy=p.strategy AND n.symbol=p.symbol AND n.seq=p.bar_seq)"""),
    # --- joins --------------------------------------------------------------------
    "align_market_index": _out("symbol bar_date ~close ~index_close", """(SELECT b.symbol, b.bar_date, b.close,
        last_value(m.close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b.bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS index_close
        FROM adjusted b LEFT JOIN (SELECT * FROM market WHERE role='index') m USING (bar_date))"""),
    "market_asof": _out("symbol bar_date role ~context context_date", """(SELECT b.symbol, b.bar_date, r.role, m.close AS context, m.bar_date AS context_date
        FROM bars b CROSS JOIN (SELECT DISTINCT role FROM market) r ASOF LEFT JOIN market m ON m.role=r.role AND b.bar_date >= m.bar_date)"""),
    "market_asof_strict": _out("symbol bar_date role ~context context_date", """(SELECT b.symbol, b.bar_date, r.role, m.close AS context, m.bar_date AS context_date
        FROM bars b CROSS JOIN (SELECT DISTINCT role FROM market) r ASOF LEFT JOIN market m ON m.role=r.role AND b.bar_date > m.bar_date)"""),
    "market_asof_window": _out("symbol bar_date role points first_date ~total_close", """(SELECT b.symbol, b.bar_date, r.role, m.n AS points, m.f AS first_date, m.a AS total_close
        FROM bars b CROSS JOIN (SELECT DISTINCT role FROM market) r ASOF LEFT JOIN (SELECT *, count(*) OVER w AS n, min(bar_date) OVER w AS f, sum(close) OVER w AS a
        FROM market WINDOW w AS (PARTITION BY role ORDER BY bar_date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) m ON m.role=r.role AND b.bar_date >= m.bar_date)"""),
    "forecast_exact_join": _out("symbol bar_date as_of horizon_days ~predicted_return_pct", """(SELECT b.symbol, b.bar_date, f.origin AS as_of, f.horizon AS horizon_days,
        100*(forecast_price/origin_price-1) AS predicted_return_pct FROM bars b LEFT JOIN (SELECT * FROM forecasts WHERE model='momentum' AND horizon=10) f
        ON f.symbol=b.symbol AND f.origin=b.bar_date)"""),
    "forecast_coverage": sql("""SELECT s.symbol, f.fold, count(o.origin) AS forecasts FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN folds f
        LEFT JOIN origins o ON o.symbol=s.symbol AND o.origin BETWEEN f.start AND f."end" GROUP BY ALL"""),
    "assign_fold": _out("strategy symbol exit_date ~profit:7 fold", """(SELECT t.strategy, t.symbol, t.exit_date, t.profit, f.fold FROM trades t JOIN folds f ON t.exit_date BETWEEN f.start AND f."end")"""),
    "forward_return": _out("strategy symbol seq horizon ~forward_return", "forward"),
    "signal_path": _out('strategy symbol seq "offset" bar_date ~open ~high ~low ~close', "path"),
    "trade_outcomes": _out("strategy symbol seq entry_date exit_date reason days_open qty ~entry_price:10 ~exit_price:10 ~profit ~r_multiple",
        "(SELECT * REPLACE (CAST(qty AS BIGINT) AS qty) FROM outcomes)"),
    "trade_outcomes_market_day": _out("strategy symbol seq entry_date exit_date reason ~profit", """(SELECT o.* FROM outcomes o JOIN
        (SELECT bar_date, lead(bar_date) OVER (ORDER BY bar_date) AS nd FROM (SELECT DISTINCT bar_date FROM bars)) c ON c.bar_date=o.signal_date WHERE o.entry_date=c.nd)"""),
    "pending_windows": sql("""SELECT symbol, origin, seq FROM origins WHERE (symbol, origin) NOT IN (SELECT (symbol, origin) FROM forecasts
        WHERE model IN ('unchanged','momentum') AND NOT (model='momentum' AND horizon=20 AND year(origin)=2000) GROUP BY symbol, origin HAVING count(DISTINCT (model, horizon))=8)"""),
    "pair_lineages": sql("SELECT signature, a, b FROM pairs"),
    "trade_overlap": _out("a b shared_trades ~jaccard", "overlap"),
    "plateau_neighbours": _out("campaign point neighbour ~neighbour_score", "neighbours"),
    "ensemble_weights": _out("strategy symbol signal_date ~weight", "weights"),
    "same_basis": sql("""SELECT strategy, folds FROM (SELECT strategy, count(DISTINCT fold) AS folds, string_agg(DISTINCT fold, ',' ORDER BY fold) AS s FROM trades GROUP BY strategy)
        WHERE s = (SELECT string_agg(DISTINCT fold, ',' ORDER BY fold) FROM trades WHERE strategy='Brand#1')"""),
    # --- aggregations -------------------------------------------------------------
    "select_universe": _out("symbol ~traded_value:4 first_date bars", """(SELECT symbol, avg(close*volume) AS traded_value, min(bar_date) AS first_date, count(*) AS bars
        FROM bars WHERE bar_date <= DATE '1998-12-31' AND symbol NOT IN ('S00000','S00007') GROUP BY symbol HAVING min(bar_date) <= DATE '1995-01-31'
        ORDER BY traded_value DESC, symbol LIMIT 30)"""),
    "price_status": sql("""SELECT symbol, CAST(sum(n) AS BIGINT) AS bars, min(a) AS first_date, max(b) AS last_date,
        CASE WHEN grouping(symbol)=1 THEN 'total' WHEN sum(n)=0 THEN 'missing' ELSE 'present' END AS status FROM (
        SELECT u.symbol, coalesce(n,0) AS n, a, b FROM (SELECT concat('S', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS symbol FROM supplier
        UNION SELECT concat('M', lpad(CAST(n_nationkey AS VARCHAR), 5, '0')) FROM nation) u LEFT JOIN
        (SELECT symbol, count(*) AS n, min(bar_date) AS a, max(bar_date) AS b FROM bars GROUP BY symbol) x USING (symbol)) GROUP BY ROLLUP (symbol)"""),
    "price_quality": _out("symbol problem bar_date ~value", """(SELECT symbol, 'malformed' AS problem, NULL::DATE AS bar_date, count(*)::DOUBLE AS value FROM raw_bars
        WHERE least(open,high,low,close,adj_close)<=0 OR high<low GROUP BY symbol UNION ALL
        SELECT symbol, 'move', bar_date, s-1 FROM (SELECT symbol, bar_date, adj_close/lag(adj_close) OVER (PARTITION BY symbol ORDER BY bar_date) AS s FROM raw_bars)
        WHERE abs(s-1) > 0.5::DOUBLE)"""),
    "coverage_report": sql("""SELECT s.symbol, f.fold, count(b.bar_date) AS bars, count(b.bar_date)=0 AS empty,
        count(b.bar_date)>0 AND count(b.bar_date) < (f."end"-f.start+1)*0.4::DOUBLE AS sparse, max(t.n) AS training_rows, max(t.n)>=500 AS enough_training, max(t.l)>=DATE '1999-01-01' AS has_evaluation
        FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN folds f LEFT JOIN bars b ON b.symbol=s.symbol AND b.bar_date BETWEEN f.start AND f."end"
        JOIN (SELECT symbol, count(*) FILTER (bar_date <= DATE '1998-12-31') AS n, max(bar_date) AS l FROM bars GROUP BY symbol) t ON t.symbol=s.symbol
        GROUP BY s.symbol, f.fold, f.start, f."end" """),
    "missing_roles": sql("SELECT role FROM (SELECT DISTINCT p_type AS role FROM part UNION SELECT 'index' UNION SELECT 'volatility') WHERE role NOT IN (SELECT role FROM market)"),
    "training_range": sql("""SELECT min(bar_date) FILTER (bar_date<=DATE '1998-12-31') AS training_start, DATE '1998-12-31' AS training_end,
        min(bar_date) FILTER (bar_date>DATE '1998-12-31') AS evaluation_start, max(bar_date) FILTER (bar_date<=DATE '2001-06-30') AS latest, true AS apart FROM bars"""),
    "forward_baseline": _out("symbol horizon ~baseline_return:8 entries", "baseline"),
    "signal_screen": _out("strategy signals ~actual_mean:9 ~baseline_mean:9 ~alpha:9 applies passed", """(SELECT strategy, count(*) AS signals, avg(forward_return) AS actual_mean,
        avg(baseline_return) AS baseline_mean, avg(forward_return)-avg(baseline_return) AS alpha, count(*)>=30 AS applies,
        count(*)<30 OR avg(forward_return)>avg(baseline_return) AS passed FROM forward JOIN baseline USING (symbol, horizon) GROUP BY strategy)"""),
    "profile_score": _out("strategy ~final_capital ~earned_profit ~score trades ~win_rate", "(SELECT *, earned_profit AS score FROM scores)"),
    "concentration_factor": _out("strategy ~concentration_factor", """(SELECT s.strategy, CASE WHEN earned_profit>0 THEN greatest(0, least(1, kept/earned_profit)) ELSE 1 END AS concentration_factor
        FROM scores s JOIN (SELECT strategy, sum(CASE WHEN d <= floor(n*0.05::DOUBLE) THEN least(profit, cap) ELSE profit END) AS kept FROM
          (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY profit DESC) AS d, count(*) OVER (PARTITION BY strategy) AS n FROM trades)
          JOIN (SELECT strategy, list_sort(list(profit))[CAST(floor(count(*)/2) AS BIGINT)+1] AS cap FROM trades WHERE profit>0 GROUP BY strategy) USING (strategy)
          GROUP BY strategy) k USING (strategy))"""),
    "symbol_factor": _out("strategy ~symbol_factor", """(SELECT strategy, CASE WHEN earned_profit>0 THEN greatest(0.85::DOUBLE, least(1, (earned_profit-greatest(0,b))/earned_profit)) ELSE 1 END AS symbol_factor
        FROM scores JOIN (SELECT strategy, max(p) AS b FROM (SELECT strategy, symbol, sum(profit) AS p FROM trades GROUP BY ALL) GROUP BY strategy) USING (strategy))"""),
    "top_trade_share": _out("strategy ~top_trade_share_pct", """(SELECT strategy, 100*sum(profit) FILTER (d<=3)/sum(profit) AS top_trade_share_pct FROM
        (SELECT strategy, profit, row_number() OVER (PARTITION BY strategy ORDER BY profit DESC) AS d FROM trades WHERE profit>0) GROUP BY strategy)"""),
    "quarter_rate": _out("strategy quarters ~profitable_quarter_rate", """(SELECT strategy, count(*) AS quarters, count(*) FILTER (p>0)/count(*) AS profitable_quarter_rate FROM
        (SELECT strategy, year(exit_date), quarter(exit_date), sum(profit) AS p FROM trades GROUP BY ALL) GROUP BY strategy)"""),
    "combine_profiles": _out("strategy ~score failures", """(SELECT strategy, sum(w*s)/6 AS score, coalesce(string_agg(CASE WHEN s<0 THEN profile || ':loss' END, ',' ORDER BY profile), '') AS failures FROM
        (SELECT strategy, CASE setup WHEN 'A' THEN 'conservative' WHEN 'N' THEN 'moderate' ELSE 'aggressive' END AS profile,
        CASE setup WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 1 END AS w, sum(profit) AS s FROM trades GROUP BY ALL) GROUP BY strategy)"""),
    "positive_fold_gate": _out("strategy positive_folds total_folds minimum_positive_folds ~positive_fold_rate passed", """(SELECT strategy, count(*) FILTER (profit>0) AS positive_folds,
        count(*) AS total_folds, CAST(ceil(count(*)*0.6::DOUBLE) AS BIGINT) AS minimum_positive_folds, count(*) FILTER (profit>0)/count(*) AS positive_fold_rate,
        count(*) FILTER (profit>0) >= ceil(count(*)*0.6::DOUBLE) AS passed FROM periods GROUP BY strategy)"""),
    "sample_adequacy_gate": sql("""SELECT strategy, CAST(sum(n) AS BIGINT) AS total_trades, count(*) AS folds, count(*) FILTER (n=0) AS empty_folds, min(n) AS min_fold_trades,
        sum(n)>=30 AND count(*) FILTER (n>0) >= ceil(count(*)/2) AS passed FROM fold_counts GROUP BY strategy"""),
    "drawdown_gate": _out("strategy ~max_fold_drawdown_pct passed", "(SELECT strategy, max(drawdown_pct) AS max_fold_drawdown_pct, max(drawdown_pct)<=30 AS passed FROM fold_drawdowns GROUP BY strategy)"),
    "aggregate_folds": _out("strategy ~median_fold_score ~worst_fold_score ~best_fold_score losing_folds positive_folds folds ~max_fold_drawdown_pct gate_failures", """(
        SELECT strategy, median(score) AS median_fold_score, min(score) AS worst_fold_score, max(score) AS best_fold_score, count(*) FILTER (score<0) AS losing_folds,
        count(*) FILTER (profit>0) AS positive_folds, count(*) AS folds, max(drawdown_pct) AS max_fold_drawdown_pct,
        concat_ws(',', CASE WHEN count(*) FILTER (profit>0) < ceil(count(*)*0.6::DOUBLE) THEN 'minimum-positive-return-folds' END,
        CASE WHEN max(drawdown_pct)>30 THEN 'maximum-drawdown' END) AS gate_failures FROM fold_results GROUP BY strategy)"""),
    "promotion_decision": sql(DECISION),
    "period_profits": _out("strategy fold ~profit", "periods"),
    "evaluation_summary": _out(SUMMARY_COLUMNS, SUMMARY),
    "evaluate": sql(f"SELECT * FROM (SELECT {columns(SUMMARY_COLUMNS)} FROM {SUMMARY}) JOIN ({DECISION}) USING (strategy)", trades="""
        SELECT strategy, strategy AS family, symbol, 'fold-' || (year(exit_date)-1994) AS fold, entry_date, exit_date, profit, setup, regime FROM outcomes"""),
    "strategy_attribution": _out("strategy trades ~profit wins", "(SELECT strategy, count(*) AS trades, sum(profit) AS profit, count(*) FILTER (profit>0) AS wins FROM trades GROUP BY strategy)"),
    "audit_sample": sql("SELECT * FROM sample_audit"),
    "audit_concentration": _out("""strategy trades ~total_profit ~best_trade_profit ~profit_without_best_trade ~profit_without_best_fold ~profit_without_best_symbol verdict""", "concentration"),
    "profit_gini": _out("strategy ~profit_gini", "(SELECT strategy, gini AS profit_gini FROM ginis)"),
    "audit_verdict": sql("SELECT strategy, verdict, count(*) OVER (PARTITION BY verdict) AS strategies FROM verdicts", trades=CAST),
    "trial_summary": sql("SELECT source, count(*) AS trials, count(*) FILTER (accepted) AS accepted FROM trials GROUP BY ROLLUP (source)"),
    "forecast_metrics": _out('"group" label model horizon n ~return_mae_pp:8 ~price_mae:8 direction_hits ~direction_accuracy_pct ~balanced_accuracy_pct ~actual_up_pct ~actual_flat_pct ~predicted_nonflat_pct', "metrics"),
    "near_hits": _out("model horizon ~tolerance hits ~hit_pct", """(SELECT model, horizon, tolerance, count(*) FILTER (error_pp<=tolerance) AS hits,
        100.0::DOUBLE*count(*) FILTER (error_pp<=tolerance)/count(*) AS hit_pct FROM errors, (SELECT unnest([0.5::DOUBLE,1,2,5]) AS tolerance) GROUP BY ALL)"""),
    "quantile_calibration": sql(f"""SELECT model, horizon, count(*) AS n, {R('100.0*count(*) FILTER (quantiles[1]<=actual_price AND actual_price<=quantiles[9])/count(*)', 'interval_coverage_pct')},
        {R('avg(100*(quantiles[9]-quantiles[1])/origin_price)', 'interval_width_pp')},
        {R("avg(" + " + ".join(f"100/origin_price*greatest({i / 10}::DOUBLE*(actual_price-quantiles[{i}]), ({i / 10}::DOUBLE-1)*(actual_price-quantiles[{i}]))" for i in range(1, 10)) + ")/9", 'pinball_pp')},
        """ + ", ".join(R(f"100.0*count(*) FILTER (actual_price<=quantiles[{i}])/count(*)", f"observed_{i}0") for i in range(1, 10)) + """
        FROM forecasts WHERE quantiles IS NOT NULL GROUP BY ALL"""),
    "forecast_skill": _out("model horizon ~mae_skill_pct symbols_beating_baseline symbols ~equal_weight_symbol_mae_pp", """(SELECT m.model, m.horizon,
        max(100*(1-m.return_mae_pp/b.return_mae_pp)) FILTER (m."group"='overall') AS mae_skill_pct,
        count(*) FILTER (m."group"='symbol' AND m.return_mae_pp<b.return_mae_pp) AS symbols_beating_baseline, count(*) FILTER (m."group"='symbol') AS symbols,
        avg(m.return_mae_pp) FILTER (m."group"='symbol') AS equal_weight_symbol_mae_pp FROM (SELECT * FROM metrics WHERE model<>'unchanged' AND "group"<>'year') m
        JOIN (SELECT * FROM metrics WHERE model='unchanged') b ON b."group"=m."group" AND b.label=m.label AND b.horizon=m.horizon GROUP BY ALL)"""),
    "forecast_completeness": sql("""SELECT count(*) AS expected_windows, count(*) AS complete_windows, (SELECT count(*) FROM forecasts WHERE model<>'empirical') AS forecast_rows,
        'complete' AS status FROM origins"""),
    "fold_signature": sql("SELECT strategy, signature, folds, count(*) OVER (PARTITION BY signature) AS members, signature = (SELECT signature FROM (SELECT signature, count(*) AS c, max(folds) AS f FROM vectors GROUP BY signature) ORDER BY c DESC, f DESC, signature LIMIT 1) AS is_dominant FROM vectors", trades=CAST),
    "best_per_lineage": _out("lineage entry ~score", "(SELECT family AS lineage, arg_min(strategy, (-earned_profit, strategy)) AS entry, max(earned_profit) AS score FROM scores JOIN families USING (strategy) GROUP BY family)", trades=CAST),
    "fold_correlation": _out("a b ~r", "correlations"),
    "pbo": sql(f"""SELECT signature, max(c) AS candidates, max(folds) AS folds, count(*) AS splits, {R('CASE WHEN max(c)>=2 THEN count(*) FILTER (below/c <= 0.5::DOUBLE)/count(*) END', 'probability')} FROM (
        SELECT signature, split, max(folds) AS folds, count(*) AS c, count(*) FILTER (test<=win) AS below FROM (
          SELECT *, first_value(test) OVER (PARTITION BY signature, split ORDER BY train DESC, strategy) AS win FROM (
            SELECT signature, folds, strategy, split, sum(s) FILTER (on_train)/(folds//2) AS train, sum(s) FILTER (NOT on_train)/(folds-folds//2) AS test FROM (
              SELECT signature, folds, strategy, split, scores[i] AS s, (split >> (i-1)) & 1 = 1 AS on_train FROM vectors, LATERAL (SELECT unnest(range(0, 1 << folds)) AS split),
              LATERAL (SELECT unnest(range(1, folds+1)) AS i) WHERE bit_count(split)=folds//2 AND folds>=4) GROUP BY signature, folds, strategy, split)) GROUP BY signature, split) GROUP BY signature"""),
    # --- windows ------------------------------------------------------------------
    "bar_seq": sql("SELECT symbol, bar_date, seq FROM seq"),
    "rolling_traded_value": _out("symbol bar_date ~traded_value", "(SELECT symbol, signal_date AS bar_date, traded_value FROM liquidity)"),
    "lookback_bars": _out("symbol bar_date first_date ~mean_close volume", """(SELECT symbol, bar_date, first_date, mean_close, CAST(v AS BIGINT) AS volume FROM (SELECT symbol, bar_date, seq, min(bar_date) OVER w AS first_date, avg(close) OVER w AS mean_close,
        sum(volume) OVER w AS v FROM seq WINDOW w AS (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) WHERE seq >= 90)"""),
    "warmup_slice": sql("""SELECT symbol, x.fold AS fold, bar_date, seq, seq < x.a AS warmup FROM (
        SELECT s.symbol, s.bar_date, s.seq, unnest(m.spans) AS x FROM seq s JOIN (
          SELECT symbol, list({'fold': fold, 'a': a, 'b': b}) AS spans FROM (SELECT symbol, fold, min(seq) AS a, max(seq) AS b FROM (
            SELECT symbol, seq, 'fold-' || (year(bar_date)-1994) AS fold FROM seq) WHERE fold IN (SELECT fold FROM folds) GROUP BY ALL)
          GROUP BY symbol) m USING (symbol)) WHERE seq BETWEEN x.a-90 AND x.b"""),
    "drawdown_engine": _out("strategy ~max_drawdown ~max_drawdown_pct", """(SELECT strategy, floor(max(dd)*100+0.5::DOUBLE)/100 AS max_drawdown,
        floor(arg_max(dd_pct, (dd, -epoch(bar_date)))*100+0.5::DOUBLE)/100 AS max_drawdown_pct FROM underwater GROUP BY strategy)"""),
    "drawdown_score": _out("strategy ~max_drawdown ~drawdown_pct", "(SELECT strategy, max(dd) AS max_drawdown, max(dd_pct) AS drawdown_pct FROM underwater GROUP BY strategy)"),
    "daily_returns": _out("strategy bar_date ~daily_return:9", "(SELECT strategy, bar_date, (capital-p)/p AS daily_return FROM (SELECT *, lag(capital) OVER (PARTITION BY strategy ORDER BY bar_date) AS p FROM equity) WHERE p>0)"),
    "sortino": _out("strategy ~sortino", """(SELECT strategy, CASE WHEN d>0 THEN (m-5.0::DOUBLE/100/252)*252/(d*sqrt(252)) ELSE 0 END AS sortino FROM (
        SELECT strategy, avg(r) AS m, sqrt(sum(least(0, r-5.0::DOUBLE/100/252)**2)/count(*)) AS d FROM (SELECT strategy, (capital-p)/p AS r FROM
        (SELECT *, lag(capital) OVER (PARTITION BY strategy ORDER BY bar_date) AS p FROM equity) WHERE p>0) GROUP BY strategy))"""),
    "time_windows": _out("strategy segment ~segment_return:9", "(SELECT strategy, CAST(segment AS BIGINT) AS segment, r AS segment_return FROM segments)"),
    "time_factors": _out("strategy ~time_contribution_factor ~recency_factor ~time_factor", """(SELECT *, greatest(0.8::DOUBLE, least(1.05::DOUBLE, time_contribution_factor*recency_factor)) AS time_factor FROM (
        SELECT strategy, CASE WHEN sum(greatest(0,r))>0 THEN 0.8::DOUBLE+0.2::DOUBLE*(sum(greatest(0,r))**2/sum(greatest(0,r)**2)/6) ELSE 1 END AS time_contribution_factor,
        CASE WHEN avg(r)>0 THEN greatest(0.9::DOUBLE, least(1.05::DOUBLE, (1+sum(r*0.85::DOUBLE**(5-segment))/sum(0.85::DOUBLE**(5-segment)))/(1+avg(r)))) ELSE 1 END AS recency_factor
        FROM segments GROUP BY strategy))"""),
    "rolling_windows": _out("symbol origin seq ~origin_price", "origins"),
    "anchored_windows": _out("symbol origin seq ~origin_price fold", """(SELECT symbol, bar_date AS origin, seq, adj_close AS origin_price, fold FROM seq JOIN folds f ON bar_date BETWEEN f.start AND f."end"
        WHERE seq>=64 AND (seq-64)%5=0)"""),
    "forecast_targets": _out("symbol origin horizon target_date ~origin_price ~actual_price", "targets"),
    "baseline_unchanged": _out("symbol origin horizon ~forecast_price", "(SELECT *, origin_price AS forecast_price FROM targets)"),
    "baseline_momentum": _out("symbol origin horizon ~forecast_price", "momentum"),
    "trailing_stop": _out('strategy symbol seq "offset" ~stop_now ~target_now exit_pending', "stops"),
    "eligibility": _out("strategy setup regime pos sample_size ~expectancy_r ~win_rate ~max_drawdown_r:8 reason actionable", """(SELECT *, reason IN ('warmup','eligible') AS actionable FROM (
        SELECT *, CASE WHEN sample_size<10 THEN 'warmup' WHEN expectancy_r<=0 THEN 'negative-expectancy' WHEN win_rate<0.35::DOUBLE THEN 'low-win-rate' WHEN max_drawdown_r>5 THEN 'drawdown' ELSE 'eligible' END AS reason FROM (
        SELECT strategy, setup, regime, pos, CAST(len(l) AS INTEGER) AS sample_size, coalesce(list_sum(l)/len(l),0) AS expectancy_r, CASE WHEN len(l)>0 THEN len(list_filter(l, lambda x: x>0))/len(l) ELSE 0 END AS win_rate,
          coalesce(list_max(list_transform(range(1,len(l)+1), lambda i: greatest(0, list_max(list_transform(range(1,i+1), lambda j: list_sum(l[1:j]))))-list_sum(l[1:i]))),0) AS max_drawdown_r FROM (
        SELECT strategy, setup, regime, row_number() OVER w - 1 AS pos, coalesce(list(profit) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS l FROM trades
        WINDOW w AS (PARTITION BY strategy, setup, regime ORDER BY exit_date, entry_date, symbol, profit)))))"""),
    "equity_curve": _out("strategy bar_date ~equity:7", "(SELECT strategy, bar_date, 10000+sum(p) OVER (PARTITION BY strategy ORDER BY bar_date) AS equity FROM (SELECT strategy, exit_date AS bar_date, sum(profit) AS p FROM trades GROUP BY ALL))"),
    "fold_calendar": sql("""SELECT 'fold-' || i AS fold, CAST(s AS DATE) AS start, CAST(least(s + INTERVAL 6 MONTH - INTERVAL 1 DAY, m) AS DATE) AS "end", (SELECT count(*) FROM bars WHERE bar_date BETWEEN s AND least(s + INTERVAL 6 MONTH - INTERVAL 1 DAY, m)) AS bars
        FROM (SELECT m, unnest(range(1, 100)) AS i, TIMESTAMP '1999-01-01' + INTERVAL 6 MONTH * (unnest(range(1,100))-1) AS s FROM (SELECT max(bar_date) AS m FROM bars)) WHERE s <= m"""),
    # --- ranking and selection ------------------------------------------------------
    "daily_top_k": _out('symbol signal_date strategy ~rank_r:9 ~evidence:9 ~votes:9 "rank"', """(SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY signal_date ORDER BY round(rank_r,9) DESC, round(evidence,9) DESC, round(votes,9) DESC, traded_value DESC, symbol) AS "rank" FROM (
        SELECT g.*, coalesce(expected_r, (SELECT list_sort(list(x.expected_r))[CAST(floor(count(*)/2) AS BIGINT)+1] FROM liquid x WHERE x.signal_date=g.signal_date AND x.expected_r IS NOT NULL), 0) AS rank_r
        FROM liquid g) g) WHERE "rank" <= 2)"""),
    "ensemble_score": _out("symbol signal_date strategies ~votes ~evidence ~score", "(SELECT *, 1/(1+exp(-evidence)) AS score FROM pooled)"),
    "ensemble_representative": _out("symbol signal_date strategy ~entry_max ~stop_loss ~target", "graded"),
    "stable_parameter": _out("campaign point ~score ~stability_score neighbourhood_size", """(SELECT g.campaign, g.point, g.score, s.stability_score, s.n AS neighbourhood_size FROM grid g JOIN
        (SELECT point, median(neighbour_score) AS stability_score, count(*) AS n FROM neighbours GROUP BY point) s USING (point) ORDER BY n DESC, stability_score DESC, g.score DESC LIMIT 1)"""),
    "best_survivor": _out("strategy ~score verdict", "(SELECT strategy, earned_profit AS score, verdict FROM scores JOIN verdicts USING (strategy) WHERE verdict<>'killed' ORDER BY score DESC, strategy LIMIT 1)"),
    "diverse_partner": _out("champion partner ~r ~score", """(SELECT champion, strategy AS partner, r, score FROM (SELECT s.strategy AS champion, f.family AS cf FROM scores s JOIN verdicts v USING (strategy) JOIN families f USING (strategy)
        WHERE verdict<>'killed' AND earned_profit>0 ORDER BY earned_profit DESC, s.strategy LIMIT 1) c, (SELECT s.strategy, s.earned_profit AS score, f.family FROM scores s JOIN verdicts v USING (strategy) JOIN families f USING (strategy)
        WHERE verdict<>'killed' AND earned_profit>0) p LEFT JOIN (SELECT a AS x, b AS y, r FROM correlations UNION ALL SELECT b, a, r FROM correlations) k ON k.x=c.champion AND k.y=p.strategy
        WHERE family<>cf ORDER BY r NULLS LAST, score DESC, strategy LIMIT 1)""", trades=CAST),
    "weakest_strategy": _out("strategy ~score", "(SELECT strategy, earned_profit AS score FROM scores ORDER BY earned_profit, strategy LIMIT 1)"),
    "correlation_ci": _out("a b ~r ~lower ~upper resamples", "(SELECT a, b, r, lower, upper, CAST(resamples AS INTEGER) AS resamples FROM correlations JOIN intervals USING (a, b))"),
    "redundant_pairs": _out("a b ~r ~lower ~upper shared_trades ~jaccard flagged", "redundancy", trades=CAST),
    # --- resampling -----------------------------------------------------------------
    "counter_uniform": sql("SELECT symbol, bar_date, " + R("u", "u", 9) + " FROM " + uniform("SELECT symbol, bar_date, 42 AS seed, seq-1 AS k FROM seq")),
    "perturb_prices": _out("symbol bar_date ~open ~high ~low ~close", "(SELECT symbol, bar_date, open*f AS open, high*f AS high, low*f AS low, close*f AS close FROM (SELECT *, 1+(u*2-1)*0.002::DOUBLE AS f FROM "
        + uniform("SELECT s.*, 7*100003+n*1009+17 AS seed, s.seq-1 AS k FROM seq s JOIN (SELECT symbol, row_number() OVER (ORDER BY symbol)-1 AS n FROM (SELECT DISTINCT symbol FROM bars)) USING (symbol)") + "))"),
    "parameter_grid": sql('SELECT p.point, lookback, "drop", hold, g.signals FROM points p JOIN grid g USING (point, lookback, "drop", hold)'),
    # --- sets -----------------------------------------------------------------------
    "calendar_union": sql("SELECT DISTINCT bar_date FROM bars"),
    "window_dates": sql('SELECT DISTINCT fold, bar_date FROM bars JOIN folds f ON bar_date BETWEEN f.start AND f."end"'),
    "fold_union": sql("SELECT fold FROM folds UNION SELECT fold FROM trades"),
    "symbol_union": sql("SELECT symbol FROM bars UNION SELECT '^' || role FROM market"),
    # --- streams (batch form) and rules ------------------------------------------------
    "stream_pair_events": sql("""SELECT e.call_id, e.tool, e.status, s.ts AS started_at, e.ts AS ended_at, CAST(epoch_us(e.ts)//1000-epoch_us(s.ts)//1000 AS BIGINT) AS duration_ms,
        CASE WHEN e.status='error' THEN left(regexp_replace(e.text, '[[:space:]]+', ' ', 'g'), 240) END AS error_text
        FROM (SELECT * FROM calls WHERE kind='end') e LEFT JOIN (SELECT * FROM calls WHERE kind='start') s ON s.call_id=e.call_id AND s.ts<=e.ts AND s.ts>=e.ts-INTERVAL 1 DAY"""),
    "stream_upsert_prices": _out(BAR, """(SELECT b.symbol, b.bar_date, coalesce(r.open,b.open) AS open, coalesce(r.high,b.high) AS high,
        coalesce(r.low,b.low) AS low, coalesce(r.close,b.close) AS close, coalesce(r.adj_close,b.adj_close) AS adj_close,
        coalesce(r.volume,b.volume) AS volume FROM bars b LEFT JOIN (SELECT * FROM raw_bars WHERE bar_date >= DATE '2000-01-01' AND high >= low AND low > 0) r
        ON r.symbol=b.symbol AND r.bar_date=b.bar_date)"""),
    "stream_price_table": _out(BAR, """(SELECT b.symbol, b.bar_date, coalesce(r.open,b.open) AS open, coalesce(r.high,b.high) AS high,
        coalesce(r.low,b.low) AS low, coalesce(r.close,b.close) AS close, coalesce(r.adj_close,b.adj_close) AS adj_close,
        coalesce(r.volume,b.volume) AS volume FROM bars b LEFT JOIN (SELECT * FROM raw_bars WHERE bar_date >= DATE '2000-01-01' AND high >= low AND low > 0) r
        ON r.symbol=b.symbol AND r.bar_date=b.bar_date)"""),
    "stream_pair_events_late": sql("""SELECT e.call_id, e.tool, e.status, s.ts AS started_at, e.ts AS ended_at, CAST(epoch_us(e.ts)//1000-epoch_us(s.ts)//1000 AS BIGINT) AS duration_ms,
        CASE WHEN e.status='error' THEN left(regexp_replace(e.text, '[[:space:]]+', ' ', 'g'), 240) END AS error_text,
        CASE WHEN s.ts IS NULL THEN 'no-start' ELSE 'late-start' END AS reason
        FROM (SELECT * FROM calls WHERE kind='end') e LEFT JOIN (SELECT * FROM calls WHERE kind='start') s ON s.call_id=e.call_id AND s.ts<=e.ts"""),
    "stream_trials_late": sql("SELECT source, count(DISTINCT run_record) AS trials FROM trials GROUP BY source"),
    "stream_trials": sql("SELECT source, count(DISTINCT run_record) AS trials FROM trials GROUP BY source"),
    "signal_rule": _out("strategy symbol signal_date seq side ~entry_min ~entry_max ~stop_loss ~target max_hold_days setup regime ~confidence", "signals"),
    "ensemble_signals": _out("strategy symbol signal_date side ~confidence", "signals"),
    "forecast_scorer": _out("symbol origin horizon ~forecast_price ~low ~high", "(SELECT *, quantiles[5] AS forecast_price, quantiles[1] AS low, quantiles[9] AS high FROM empirical)"),
    # --- files, stores, bootstraps ----------------------------------------------------
    "read_prices_csv": sql("""SELECT symbol, CAST(date AS DATE) AS bar_date, open, high, low, close, adj_close, CAST(volume AS BIGINT) AS volume
        FROM checked_rows WHERE problems = ''"""),
    "read_universe": sql("""SELECT concat('S', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS symbol, s_name AS name, CAST(s_nationkey AS VARCHAR) AS sector,
        'member' AS status FROM supplier WHERE s_acctbal >= 0"""),
    "read_artifacts": sql("""SELECT strategy, symbol, fold, entry_date, exit_date, round(profit, 2) + 0.0 AS profit FROM trades
        UNION ALL SELECT DISTINCT strategy, 'unknown', 'odd', NULL::DATE, NULL::DATE, 1.5::DOUBLE FROM trades"""),
    "write_artifact": _out("strategy fold ~score", "fold_scores"),
    "forecast_store": _out("campaign symbol origin model horizon ~forecast_price", """(SELECT 'c1' AS campaign, * FROM forecasts WHERE model<>'empirical')"""),
    "plateau_replicas": sql(f"""SELECT CAST(split_part(symbol, '|', 1) AS INTEGER) AS replica, strategy, 'fold-' || (year(exit_date)-1994) AS fold, count(*) AS trades,
        {R('floor((10000.0::DOUBLE + sum(profit))*100+0.5::DOUBLE)/100 - 10000', 'score')} FROM outcomes GROUP BY ALL""", seq=NOISY_SEQ),
    "dataset_fingerprint": sql("SELECT symbol, rows, sha256(concat_ws('|', rows, s0, s1, s2, s3)) AS fingerprint FROM ("
        + digests("bars", "symbol", "bar_date, " + BAR_BITS + ", volume") + ")"),
    "dataset_digest_tree": sql("""SELECT CASE WHEN grouping(symbol)=1 THEN 'table' WHEN grouping(year)=1 THEN 'symbol' ELSE 'leaf' END AS level,
        symbol, year, CAST(sum(rows) AS BIGINT) AS rows, sha256(concat_ws('|', sum(rows), sum(s0), sum(s1), sum(s2), sum(s3))) AS fingerprint
        FROM digest_leaves GROUP BY GROUPING SETS ((symbol, year), (symbol), ())"""),
    "capital_envelope": sql("""SELECT strategy, rate, band, step, bar_date, CASE WHEN abs(capital) >= 100000000 THEN round(capital) ELSE capital END AS capital FROM (
        SELECT strategy, 0.01::DOUBLE AS rate, band, step, bar_date, floor(10000*multiple*100+0.5::DOUBLE)/100 AS capital FROM (
        SELECT strategy, band, CAST(step+1 AS BIGINT) AS step, multiple FROM envelope_walks JOIN envelope_paths USING (strategy, path)
        UNION ALL SELECT strategy, band, 0, 1.0 FROM envelope_paths) JOIN (
          SELECT strategy, exit_date AS bar_date, row_number() OVER o AS step FROM outcomes WINDOW o AS (PARTITION BY strategy ORDER BY exit_date, entry_date, symbol, seq)
          UNION ALL SELECT strategy, min(exit_date), 0 FROM outcomes GROUP BY strategy) USING (strategy, step))"""),
    "artifact_losses": sql("""SELECT strategy, list, CAST(sum(ok) AS BIGINT) AS members, CAST(sum(bad) AS BIGINT) AS dropped FROM (
        SELECT strategy, 'trades' AS list, 1 AS ok, 0 AS bad FROM trades UNION ALL
        SELECT DISTINCT strategy, 'trades', 1, 3 FROM trades UNION ALL
        SELECT strategy, unnest(['segments', 'folds']), 1, 0 FROM fold_scores UNION ALL
        SELECT DISTINCT strategy, 'segments', 0, 1 FROM trades UNION ALL
        SELECT NULL, 'line', 0, count(DISTINCT strategy) FROM trades) GROUP BY strategy, list"""),
    "scoring_basis_changed": sql("SELECT symbol, bool_or(bar_date = DATE '2000-01-03') AS changed FROM bars GROUP BY symbol"),
    "marked_equity": _out("strategy bar_date ~equity", """(SELECT strategy, bar_date, 10000 + sum(coalesce(p,0)) OVER (PARTITION BY strategy ORDER BY bar_date) + coalesce(u,0) AS equity FROM
        (SELECT strategy, exit_date AS bar_date, sum(profit) AS p FROM outcomes GROUP BY ALL) FULL JOIN
        (SELECT strategy, bar_date, sum((mark-entry_price)*qty) AS u FROM (SELECT o.strategy, o.entry_price, o.qty, c.bar_date,
           last_value(b.close IGNORE NULLS) OVER (PARTITION BY o.strategy, o.symbol, o.seq ORDER BY c.bar_date) AS mark
           FROM outcomes o JOIN (SELECT DISTINCT bar_date FROM bars) c ON c.bar_date >= o.entry_date AND c.bar_date < o.exit_date
           LEFT JOIN adjusted b ON b.symbol=o.symbol AND b.bar_date=c.bar_date) GROUP BY strategy, bar_date) USING (strategy, bar_date))"""),
    "block_bootstrap": _out("strategy ~q90", "bands"),
    "significance_gate": _out("candidate incumbent ~candidate_median ~incumbent_median ~incumbent_q90 inconclusive waived passed", """(
        SELECT *, waived OR coalesce(candidate_median > incumbent_q90, false) AS passed FROM (
          SELECT p.candidate, p.incumbent, c.m AS candidate_median, i.m AS incumbent_median,
            CASE WHEN coalesce(i.n, 0) < 8 THEN i.m ELSE b.q90 END AS incumbent_q90,
            coalesce(c.ranges = i.ranges AND c.n > 0, false) AND coalesce(i.n, 0) < 8 AS inconclusive,
            NOT coalesce(c.ranges = i.ranges AND c.n > 0, false) AS waived
          FROM (SELECT 'new ' || strategy AS candidate, incumbent FROM (SELECT DISTINCT strategy FROM trades UNION ALL SELECT 'idle'),
                (SELECT arg_max(strategy, earned_profit) AS incumbent FROM scores UNION ALL SELECT 'few' UNION ALL SELECT 'gone')) p
          LEFT JOIN gate_sides c ON c.strategy = p.candidate LEFT JOIN gate_sides i ON i.strategy = p.incumbent
          LEFT JOIN bands b ON b.strategy = p.incumbent))"""),
    "ruin_bootstrap": _out("strategy rate ~ruin_probability ~drawdown95", "ruin"),
    "choose_risk_rate": _out("strategy profile rate tier ~sortino ~ruin_probability ~drawdown95 ~return_pct", "chosen"),
    "risk_sensitivity": _out("""strategy profile ~risk_pct ~return_pct ~max_drawdown_pct ~ruin_probability_pct ~drawdown95_pct ~sortino recommended
        ruin_disqualified drawdown_disqualified""", """(SELECT strategy, profile, round(p.rate*100,2) AS risk_pct, round(p.return_pct,2) AS return_pct,
        round(p.max_drawdown_pct,2) AS max_drawdown_pct, round(p.ruin_probability*100,2) AS ruin_probability_pct, round(p.drawdown95*100,2) AS drawdown95_pct,
        round(p.sortino,2) AS sortino, p.rate=c.rate AS recommended, p.ruin_probability>p.ruin_cap AS ruin_disqualified,
        p.ruin_probability<=p.ruin_cap AND p.drawdown95>=p.dd_cap AS drawdown_disqualified FROM profile_passes p
        JOIN (SELECT strategy, profile, rate FROM chosen) c USING (strategy, profile))"""),
    "admit_candidate": sql("""SELECT strategy, CASE WHEN rule IN (SELECT rule FROM prints WHERE strategy < 'Brand#15') THEN 'same-rule'
        WHEN print IN (SELECT print FROM prints WHERE strategy < 'Brand#15') THEN 'same-trades'
        WHEN EXISTS (SELECT 1 FROM redundancy r WHERE flagged AND (r.a=p.strategy AND r.b < 'Brand#15' OR r.b=p.strategy AND r.a < 'Brand#15')) THEN 'redundant'
        ELSE 'admitted' END AS decision FROM prints p WHERE strategy >= 'Brand#15'""", trades=CAST),
    "signal_rule_pandas": _out("strategy symbol signal_date seq side ~entry_min ~entry_max ~stop_loss ~target max_hold_days setup regime ~confidence", """(
        SELECT 'deep6' AS strategy, symbol, bar_date AS signal_date, seq, 'long' AS side, close*0.99::DOUBLE AS entry_min, close*1.01::DOUBLE AS entry_max,
        close*0.95::DOUBLE AS stop_loss, close*1.06::DOUBLE AS target, 5 AS max_hold_days, 'deep' AS setup, 'any' AS regime, NULL::DOUBLE AS confidence
        FROM feat WHERE seq >= 90 AND close < 0.94::DOUBLE*mean20)"""),
    "trade_fingerprint": sql("""SELECT strategy, rows, sha256(concat_ws('|', rows, s0, s1, s2, s3)) AS fingerprint FROM (SELECT strategy, count(*) AS rows, """
        + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT)::HUGEINT AS s{i}" for i in range(4)) + """
        FROM (SELECT strategy, sha256(concat_ws('|', symbol, fold, entry_date, exit_date)) AS h FROM trades) GROUP BY strategy)"""),
}
