"""Queries of the log evidence engine over the driver's events rendered as lines, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import parse
from quarry.functions import patterns as P
from quarry.operators import evidence as E
from quarry.operators import mining
from quarry.sources import logs

LEVEL = "case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end"
_TAIL = "case when event_type = 'error' and event_id % 97 = 5 and event_id > 900 then ' request timeout exceeded' when event_id % 1231 = 7 then ' deploy finished' else '' end"
_TEXT = "' ', {level}, ' web-', {u}, ' op=', event_type, ' latency=', {lat}, 'ms shard=', {shard}, ' rid=', {id}, {tail}"


def _line(stamp: str, text: str) -> str:
    n = lambda x: f"cast({x} as {text})"
    body = _TEXT.format(level=LEVEL, u=n("user_id % 7"), lat=n("(event_id % 50) + case when event_id > 500 then event_id % 400 else 0 end + cast((event_id - event_id % 40) / 40 as bigint)"), shard=n("user_id % 5"), id=n("event_id"), tail=_TAIL)
    return f"concat({stamp}, {body})"


SPARK_LINE = _line("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "string")
#: DuckDB's prelude: the same lines, parsed with its own functions.
PRE = f"""with l as (select event_id + 1 as line_no, {_line("strftime(ts, '%Y-%m-%d %H:%M:%S')", "varchar")} as raw, case when user_id % 2 = 0 then 'a.log' else 'b.log' end as source from events),
o as (select *, octet_length(encode(raw)) + 1 as b, sum(octet_length(encode(raw)) + 1) over (order by line_no) as upto, sum(octet_length(encode(raw)) + 1) over () as total from l),
e as (select line_no, source, raw, (upto - b)::bigint as byte_off, (upto - b)::double / total::double as frac, nullif(regexp_extract(raw, '\\b(DEBUG|INFO|WARN|ERROR)\\b', 1), '') as level,
 strptime(regexp_extract(raw, '^\\d+-\\d+-\\d+ \\d+:\\d+:\\d+'), '%Y-%m-%d %H:%M:%S') as ts from o),
p as (select *, concat(level, ' ', raw) as probe, level in ('ERROR', 'WARN') as signal, least(floor(frac * 44), 43)::bigint as bucket from e),
m as (select *, array_to_string(list_transform(string_split_regex(trim(regexp_replace(probe, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}\\b', '<*>', 'g')), '[\\s|,;=]+'), lambda t: case when regexp_matches(t, '\\d') then '<*>' else t end), ' ') as template from p),
t as (select template, count(*) as cnt, min(byte_off) as first_off, min(frac) as first_frac, substring(arg_min(raw, byte_off), 1, 300) as sample from m group by template),
s as (select *, regexp_matches(lower(sample), '\\b(error|warn|timeout|exceeded|failed|5\\d\\d)\\b') as sample_signal, regexp_matches(lower(sample), '\\b(deploy)\\b') as sample_change from t)
"""


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt to all cores: the table is one small file, and what is done to its lines is work."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition(spark.sparkContext.defaultParallelism)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, line_no, raw of two interleaved sources."""
    return table(spark, sf_dir).selectExpr("event_id + 1 as line_no", f"{SPARK_LINE} as raw", "case when user_id % 2 = 0 then 'a.log' else 'b.log' end as source")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).selectExpr("'events' as source", "raw", "line_no div 4096 as split", "line_no as seq", "line_no as id")
    return logs.number_lines(rows)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.probed(E.events(numbered(spark, sf_dir), "text"))


def templates(spark, sf_dir):
    """A1 with P10-P14, F4, F5."""
    return E.templates(events(spark, sf_dir)).select("template", "cnt", "first_off", "sample", "sample_signal", "sample_change")


def density(spark, sf_dir):
    return E.density(events(spark, sf_dir))


def totals(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.agg(F.count(F.lit(1)).alias("total"), F.count_if("signal").alias("signals"), F.count_distinct(F.to_date("ts")).alias("days"))


def onset(spark, sf_dir):
    return E.onset(E.templates(events(spark, sf_dir))).select("template", "first_off")


def patterns(spark, sf_dir):
    return E.patterns(E.templates(events(spark, sf_dir))).select("template", "cnt", "is_new")


def rare(spark, sf_dir):
    return E.rare(E.templates(events(spark, sf_dir))).select("template", "cnt", F.bround("score", 6).alias("score"), "relation")


def series(spark, sf_dir):
    return E.series(events(spark, sf_dir))


def trends(spark, sf_dir):
    return E.trends(series(spark, sf_dir)).select("key", "n", F.bround("ratio", 6).alias("ratio"), "direction")


def dim_counts(spark, sf_dir):
    return E.dim_counts(events(spark, sf_dir))


def dims(spark, sf_dir):
    return E.dims(dim_counts(spark, sf_dir)).select("dim", "value", "err_n", "all_n", "value_rank")


def window_slice(spark, sf_dir):
    return E.slice_window(events(spark, sf_dir), last_seconds=E.seconds("7d")).select("line_no", "raw")


def first_last(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.agg(F.min_by("ts", "line_no").alias("first_ts"), F.max_by("ts", "line_no").alias("last_ts"))


def merge(spark, sf_dir):
    """Order of the merged lines of two sources."""
    rows = lines(spark, sf_dir).withColumn("ts", parse.time_value(parse.time_text(F.col("raw"))))
    return logs.merged(rows).select("source", "line_no", "ts_filled")


def fold(spark, sf_dir):
    """W3 on lines of which some are made continuations."""
    rows = numbered(spark, sf_dir).withColumn("raw", F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("  at "), F.substring("raw", 30, 200))).otherwise(F.col("raw")))
    return E.fold(rows).groupBy("head_no").agg(F.count(F.lit(1)).alias("n")).filter("head_no is not null")


def tail(spark, sf_dir):
    return E.tail(lines(spark, sf_dir)).select("line_no", "raw")


def shapes(spark, sf_dir):
    return E.shapes(lines(spark, sf_dir))


def vocabulary(spark, sf_dir):
    return E.vocabulary(lines(spark, sf_dir))


def health(spark, sf_dir):
    return E.health(lines(spark, sf_dir)).select("lines", "ts_pct", "level_pct")


def redacted(spark, sf_dir):
    return E.redact(lines(spark, sf_dir)).select("line_no", "redacted")


def sparkline(spark, sf_dir):
    return E.sparkline(series(spark, sf_dir))


def services(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("svc", parse.matched(F.col("raw"), r"web-\d"))
    return E.service_counts(ev.selectExpr("svc", "level = 'ERROR' as is_error", "line_no > 900 as post")).withColumn("lift", F.bround("lift", 6))


def median_latency(spark, sf_dir):
    return E.upper_median(series(spark, sf_dir).filter("key = 'latency'"), "num")


def accuracy(spark, sf_dir):
    """Templates against the event's own type."""
    ev = events(spark, sf_dir).withColumn("truth", parse.matched(F.col("raw"), "op=([a-z]+)", 1)).withColumn("predicted", parse.template(F.col("probe")))
    return E.grouping_accuracy(ev.select("predicted", "truth"))


def mined(spark, sf_dir):
    """Templates of the trained miner."""
    ev = events(spark, sf_dir)
    return mining.match(ev, mining.train(ev)).groupBy("template").agg(F.count(F.lit(1)).alias("cnt"), F.min("line_no").alias("first_line"))


def decimated(spark, sf_dir):
    """A21 with a stride that brings each key to 100 points at most."""
    return E.decimated(series(spark, sf_dir))


QUERIES = {f.__name__: f for f in (templates, density, totals, onset, patterns, rare, series, trends, dim_counts, dims, window_slice, first_last, merge, fold, tail, shapes, vocabulary, health, redacted, sparkline, services, median_latency, accuracy, mined, decimated)}

_PAIRS = r"select line_no, signal, regexp_extract(x, '^([^=]+)=', 1) as key, regexp_extract(x, '=(\d+(?:\.\d+)?)', 1)::double as num from (select line_no, signal, unnest(regexp_extract_all(raw, '\b[a-zA-Z_][a-zA-Z_0-9]{2,30}=\d+(?:\.\d+)?(?:ms|MB|GB|%|s|k)?\b')) as x from p) where regexp_extract(x, '^([^=]+)=', 1) not in ('rid', 'id', 'txid', 'commit', 'status', 'retry')"
_SERIES = f"(select line_no, key, num from ({_PAIRS}))"
_DIMS = r"(select dim, value, count(*) as all_n, count(*) filter (where signal) as err_n from (select signal, regexp_extract(x, '^([^=]+)=', 1) as dim, regexp_extract(x, '=(.*)$', 1) as value from (select signal, unnest(regexp_extract_all(raw, '\b[a-zA-Z][\w.\-]{1,30}=[\w.:\-/]{1,60}')) as x from p)) where dim not in ('latency', 'rid') and (not regexp_matches(value, '^\d+$') or dim in ('shard')) group by dim, value)"
_RANKED = f"(select *, row_number() over (partition by key order by line_no) as rn, count(*) over (partition by key) as n, min(line_no) over (partition by key) as f from {_SERIES})"
_MEANS = f"(select key, n, avg(num) filter (where rn <= greatest(n // 4, 1)) as h, avg(num) filter (where rn > n - greatest(n // 4, 1)) as t from {_RANKED} where n >= 12 group by key, n)"
ORACLE_SQL = {
    "templates": PRE + "select template, cnt, first_off, sample, sample_signal, sample_change from s",
    "density": PRE + "select r.range as bucket, count(p.line_no) as n from range(44) r left join p on p.bucket = r.range and p.signal group by 1",
    "totals": PRE + "select count(*) as total, count(*) filter (where signal) as signals, count(distinct ts::date) as days from p",
    "onset": PRE + "select template, first_off from s where first_frac > 0.03 and sample_signal order by first_off limit 1",
    "patterns": PRE + "select template, cnt, first_frac > 0.03 as is_new from s where sample_signal order by cnt desc, first_off limit 18",
    "rare": PRE + """, z as (select min(first_frac) as onset from s where first_frac > 0.03 and sample_signal), n as (select count(*) as total from p),
g as (select s.*, onset - first_frac as gap from s, z, n where cnt <= greatest(3, floor(total * 0.002)))
select template, cnt, round_even(3.0 / (cnt + 1) + case when gap >= 0 and gap < 0.35 then 3 * (1 - gap / 0.35) when gap < 0 then 0.4 else 0 end + case when sample_change then 1.5 else 0 end - case when sample_signal then 0.8 else 0 end, 6) as score,
case when gap >= 0 then 'before' when gap < 0 then 'after' end as relation from g order by score desc, first_off limit 18""",
    "series": PRE + f"select key, line_no, num from {_SERIES}",
    "trends": PRE + f"select key, n, round_even((t + 1e-9) / (h + 1e-9), 6) as ratio, case when t > h then 'GREW' else 'DROPPED' end as direction from {_MEANS} where (t + 1e-9) / (h + 1e-9) >= 1.5 or (t + 1e-9) / (h + 1e-9) <= 0.66",
    "dim_counts": PRE + f"select * from {_DIMS}",
    "dims": PRE + f"select dim, value, err_n, all_n, value_rank from (select *, row_number() over (partition by dim order by err_n desc, value) as value_rank, count(*) over (partition by dim) as kinds, sum(err_n) over (partition by dim) as t from {_DIMS}) where kinds between 2 and 50 and t >= 10 and value_rank <= 4 and err_n > 0",
    "window_slice": PRE + "select line_no, raw from p where ts >= (select max(ts) from p) - interval 7 day",
    "first_last": PRE + "select arg_min(ts, line_no) as first_ts, arg_max(ts, line_no) as last_ts from p",
    "merge": PRE + "select source, line_no, ts as ts_filled from p",
    "fold": "select head_no, count(*) as n from (select max(case when line_no % 5 <> 0 then line_no end) over (order by line_no) as head_no from (select row_number() over (order by event_id) as line_no from events)) where head_no is not null group by 1",
    "tail": PRE + "select line_no, raw from l order by line_no desc limit 30",
    "shapes": PRE + r"select regexp_replace(regexp_replace(regexp_replace(substring(raw, 1, 80), '\p{L}+', 'A', 'g'), '\d+', '9', 'g'), '\s+', ' ', 'g') as shape, count(*) as n from l group by 1 order by n desc, shape limit 5",
    "vocabulary": PRE + r"select word from (select lower(unnest(regexp_extract_all(raw, '[A-Za-z][A-Za-z0-9_.\-]{2,}'))) as word from l) group by word having count(*) >= 20 union select unnest(['error','warn','warning','info','debug','fatal','critical','trace','exception','timeout','failed','failure','refused','connection','pool','true','false','null','none','and','the','for','with','from','not'])",
    "health": PRE + "select count(*) as lines, 100.0::double * count(ts) / count(*) as ts_pct, 100.0::double * count(level) / count(*) as level_pct from p",
    "services": PRE + r", c as (select regexp_extract(raw, 'web-\d') as svc, count(*) as all_n, count(*) filter (where level = 'ERROR') as err_n, count(*) filter (where line_no > 900) as post_n, count(*) filter (where line_no > 900 and level = 'ERROR') as post_err_n from p group by 1) select *, round_even((err_n / (sum(err_n) over ())) / (all_n / (sum(all_n) over ())), 6) as lift from c",
    "median_latency": PRE + f"select num as median from {_SERIES} where key = 'latency' order by num limit 1 offset (select count(*) // 2 from {_SERIES} where key = 'latency')",
    "decimated": PRE + f"select key, line_no, num from {_RANKED} where (rn - 1) % pow(2, ceil(greatest(log2(n / 100.0), 0)))::bigint = 0",
    "sparkline": PRE + f""", k as (select key, rn - 1 as i, n, num from {_RANKED}), w as (select key, range as b, avg(num) as v from k, range(24) where i >= (range * n) // 24 and i < greatest((range * n) // 24 + 1, ((range + 1) * n) // 24) group by 1, 2),
x as (select *, min(v) over (partition by key) as mn, max(v) over (partition by key) as mx from w) select key, b, case when mx > mn then floor((v - mn) / (mx - mn) * 7.999)::bigint else 0 end as level from x""",
    "redacted": PRE + r""", voc as (select list(word) as vs from (select word from (select lower(unnest(regexp_extract_all(raw, '[A-Za-z][A-Za-z0-9_.\-]{2,}'))) as word from l) group by word having count(*) >= 20
 union select unnest([WORDS]))),
r as (select line_no, regexp_extract(raw, '^[\d\-/:T. +]{8,32}') as head, regexp_replace(raw, '^[\d\-/:T. +]{8,32}', '') as rest from l)
select line_no, head || array_to_string(list_transform(list_zip(string_split_regex(rest, '[A-Za-z][A-Za-z0-9_.\-]{2,}'), regexp_extract_all(rest, '[A-Za-z][A-Za-z0-9_.\-]{2,}')),
 lambda x: regexp_replace(x[1], '\d', '9', 'g') || case when x[2] is null then '' when list_contains(vs, lower(x[2])) then regexp_replace(x[2], '\d', '9', 'g') else '<w>' end), '') as redacted from r, voc""".replace(
        "WORDS", ", ".join(f"'{w}'" for w in P.KEEP_WORDS)
    ),
    "accuracy": PRE + r", q as (select template as predicted, regexp_extract(raw, 'op=([a-z]+)', 1) as truth from m), a as (select predicted, count(distinct truth) as k, min(truth) as truth, count(*) as n from q group by 1), b as (select truth, count(*) as n from q group by 1) select sum(case when k = 1 and a.n = b.n then a.n else 0 end)::double / sum(a.n)::double as accuracy from a join b using (truth)",
}
