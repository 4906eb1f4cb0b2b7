"""Queries over the input forms and the remaining operators, with their SQL for DuckDB.

Lines are rendered from the events table in each form and read back by the engine; the SQL takes
what must come out from the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import parse
from quarry.operators import evidence as E
from quarry.plans.evidence import LEVEL, PRE, SPARK_LINE, events, lines, numbered, table


def _numbered(rows: DataFrame) -> DataFrame:
    """source, line_no, raw with offsets left out: enough for what is read from single lines."""
    return rows.select(F.lit("events").alias("source"), (F.col("event_id") + 1).alias("line_no"), "raw").withColumns({"byte_off": F.col("line_no"), "total_bytes": F.col("line_no"), "head_no": F.col("line_no")})


def _json(spark, sf_dir):
    rendered = f"to_json(named_struct('@timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Level', lower({LEVEL}), 'event', event_type, 'time', 'x', 'message', concat('m ', event_type), 'ctx', named_struct('user', user_id, 'deep', named_struct('shard', user_id % 5, 'ok', user_id % 2 = 0)), 'list', array(1, 2)))"
    return _numbered(table(spark, sf_dir).selectExpr("event_id", f"{rendered} as raw"))


def _logfmt(spark, sf_dir):
    rendered = f"concat('ts=', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), ' level=', lower({LEVEL}), ' msg=\"', event_type, ' done\" user=', user_id, ' user=', user_id + 1, ' empty=\"\" shard=', user_id % 5)"
    return _numbered(table(spark, sf_dir).selectExpr("event_id", f"{rendered} as raw"))


def json_events(spark, sf_dir):
    """Role keys that were picked go, others of their kind stay."""
    ev = E.events(_json(spark, sf_dir), "json")
    return ev.select("line_no", "level", "msg", "ts", F.explode("fields").alias("key", "value"))


def logfmt_events(spark, sf_dir):
    """P5: quotes go, the last of equal keys wins."""
    ev = E.events(_logfmt(spark, sf_dir), "logfmt")
    return ev.select("line_no", "level", "msg", "ts", F.explode("fields").alias("key", "value"))


def _wrapped(spark, sf_dir, docker: bool) -> DataFrame:
    stamp = "date_format(ts + interval 1 hour, \"yyyy-MM-dd'T'HH:mm:ss\")"
    if docker:
        raw = f"to_json(named_struct('log', concat({SPARK_LINE}, '\\n'), 'stream', if(user_id % 2 = 0, 'stdout', 'stderr'), 'time', if(event_id % 3 = 0, 'none', concat({stamp}, '.123456789Z'))))"
    else:
        raw = f"concat(if(event_id % 3 = 0, 'none', concat({stamp}, '.123456789+02:00')), if(user_id % 2 = 0, ' stdout F ', ' stderr P '), {SPARK_LINE})"
    return _numbered(table(spark, sf_dir).selectExpr("event_id", f"{raw} as raw"))


def docker_events(spark, sf_dir):
    """The wrapper's time wins, and where it can't be read the line's counts."""
    return E.events(_wrapped(spark, sf_dir, True), "text").select("line_no", F.col("raw").alias("line"), "ts", "level")


def cri_events(spark, sf_dir):
    """P1, P9."""
    return E.events(_wrapped(spark, sf_dir, False), "text").select("line_no", F.col("raw").alias("line"), "ts", "level")


#: As rendered by Spark; the epoch is apart.
FORMATS = {
    "iso": "yyyy-MM-dd'T'HH:mm:ss.SSS", "bgl": "yyyy-MM-dd-HH.mm.ss.SSSSSS", "compact": "yyyyMMdd-HH:mm:ss:SSS", "slash2": "yy/MM/dd HH:mm:ss", "clf": "dd/MMM/yyyy:HH:mm:ss", "ctime": "EEE MMM d HH:mm:ss yyyy",
    "syslog": "MMM d HH:mm:ss", "hdfs": "yyMMdd HHmmss", "md": "MM-dd HH:mm:ss.SSS", "dotmd": "MM.dd HH:mm:ss",
}


def time_kinds(spark, sf_dir):
    """The eleven forms in turn; kinds without a year take the year 2000."""
    rows = table(spark, sf_dir).withColumn("nth", F.col("event_id") % 11)
    text = F.coalesce(*[F.when(F.col("nth") == i, F.date_format("ts", f)) for i, f in enumerate(FORMATS.values())], F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    lead = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("- x "))
    found = rows.select((F.col("event_id") + 1).alias("line_no"), parse.time_text(F.concat(lead, text, F.lit(" INFO x"))).alias("found"))
    return found.select("line_no", F.col("found.kind").alias("kind"), parse.time_value(F.col("found")).alias("ts"))


def sniffed(spark, sf_dir):
    """P10, K8: what each rendering is taken for."""
    kinds = [(name, E.sniff(rows)) for name, rows in (("json", _json(spark, sf_dir)), ("logfmt", _logfmt(spark, sf_dir)), ("lines", lines(spark, sf_dir)))]
    return spark.createDataFrame(kinds, "form string, kind string")


def _folded(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir).selectExpr("event_id", f"if((event_id + 1) % 5 in (0, 4), concat('  at frame ', event_id), {SPARK_LINE}) as raw")
    return E.fold(_numbered(rows).drop("head_no"))


def samples(spark, sf_dir):
    """Heads with their continuations."""
    return E.samples(_folded(spark, sf_dir)).select("line_no", "sample")


def onset_context(spark, sf_dir):
    """The lines around the first new signal template."""
    raw = numbered(spark, sf_dir)
    first = E.onset(E.templates(events(spark, sf_dir))).collect()
    at = raw.filter(F.col("byte_off") == first[0].first_off).first().line_no if first else None
    return E.context(raw, at, source="events").select("line_no", "raw")


def sortedness(spark, sf_dir):
    """W9, over two sources, one of which is turned round."""
    rows = lines(spark, sf_dir).withColumn("ts", parse.time_value(parse.time_text(F.col("raw"))))
    n = rows.count() + 1
    return E.is_sorted(rows.unionByName(rows.withColumn("line_no", n - F.col("line_no")).withColumn("source", F.concat(F.lit("back-"), "source"))), run=1000)


def change_markers(spark, sf_dir):
    """W12."""
    return E.change_markers(events(spark, sf_dir))


def level_histogram(spark, sf_dir):
    """Commonest levels over all lines."""
    top = E.health(lines(spark, sf_dir)).select(F.posexplode("levels").alias("nth", "x"))
    return top.select((F.col("nth") + 1).cast("long").alias("nth"), "x.level", "x.n")


def slice_between(spark, sf_dir):
    """F8: both bounds inclusive."""
    return E.slice_window(events(spark, sf_dir), since="2024-01-10 00:00:00", until="2024-01-20 00:00:00").select("line_no", "raw")


def normalised(spark, sf_dir):
    """P11."""
    rows = table(spark, sf_dir).selectExpr("event_id + 1 as line_no", "concat(' id ', if(event_id % 2 = 0, concat(substring(md5(cast(event_id as string)), 1, 8), '-', 'aaaa-bbbb-cccc-', substring(md5(cast(event_id as string)), 1, 12)), 'a-b-c'), ' took ', user_id, 'ms ') as raw")
    return rows.groupBy(parse.normalised(F.col("raw")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


def trend_lineitem(spark, sf_dir):
    """A5 over a long numeric series."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_returnflag as key", "(l_orderkey * 8 + l_linenumber) * 100000 + l_partkey as line_no", "l_quantity * (1 + l_orderkey % 1000 * if(l_returnflag = 'R', l_orderkey, 1)) as num")
    return E.trends(rows.groupBy("key", "line_no").agg(F.max("num").alias("num"))).select("key", "n", F.bround("ratio", 6).alias("ratio"), "direction")


def _cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir).select(F.concat(F.lit("case-"), F.col("line_no") % 3).alias("case_id"), parse.matched(F.col("raw"), r"web-\d").alias("svc"), "ts", "msg")
    cases = spark.createDataFrame([("case-0", "web-1"), ("case-1", "web-2"), ("case-2", "web-3")], "case_id string, truth string").withColumn("inject", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return rows, cases


def post_injection(spark, sf_dir):
    """Counts of a case's services in the time after its injection."""
    rows, cases = _cases(spark, sf_dir)
    return E.post_injection(rows, cases, 86_400).groupBy("case_id", "truth", "svc").agg(F.count_if("post").alias("post_n"), F.count_if("is_error").alias("err_n"), F.count_if(F.col("post") & F.col("is_error")).alias("post_err_n"))


def baselines(spark, sf_dir):
    """What the model-free guesses say."""
    rows, cases = _cases(spark, sf_dir)
    return E.baselines(E.post_injection(rows, cases, 86_400)).withColumn("chance", F.bround("chance", 6))


def baseline_hits(spark, sf_dir):
    """A14, A16, A20."""
    rows, cases = _cases(spark, sf_dir)
    return E.hits(E.baselines(E.post_injection(rows, cases, 86_400))).withColumn("expected", F.bround("expected", 6))


def case_sample(spark, sf_dir):
    """K9."""
    return E.sampled_cases(table(spark, sf_dir).selectExpr("concat('c', lpad(cast(user_id as string), 9, '0')) as case_id").distinct(), 3, 20)


def sweep(spark, sf_dir):
    """One row on a corpus."""
    ev = events(spark, sf_dir)
    return E.sweep(lines(spark, sf_dir), ev, E.templates(ev)).withColumn("compression", F.bround("compression", 6))


QUERIES = {
    f.__name__: f
    for f in (
        json_events, logfmt_events, docker_events, cri_events, time_kinds, sniffed, samples, onset_context, sortedness, change_markers, level_histogram, slice_between, normalised, trend_lineitem,
        post_injection, baselines, baseline_hits, case_sample, sweep,
    )
}

_SECOND = "date_trunc('second', ts)::timestamp"
_LOWER = "lower(level)"
_CASES = PRE + r""", k as (select concat('case-', (line_no % 3)::varchar) as case_id, regexp_extract(raw, 'web-\d') as svc, ts, regexp_matches(raw, '(?i)\b(error|fatal|critical|warn|exception|traceback|panic|refused|timeout|timed out|failed|failure|rejected|exceeded|aborted|unavailable|5\d\d)\b') as is_error,
 ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-11' as post from e),
g as (select case_id, 'web-' || (substring(case_id, 6, 1)::int + 1)::varchar as truth, svc, count(*) as all_n, count(*) filter (where is_error) as err_n, count(*) filter (where post) as post_n, count(*) filter (where post and is_error) as post_err_n from k group by 1, 2, 3),
h as (select *, (err_n / sum(err_n) over (partition by case_id)) / (all_n / sum(all_n) over (partition by case_id)) as lift from g),
w as (select case_id, truth, first(svc order by err_n desc, svc) as by_errors, first(svc order by post_err_n desc, svc) as by_post_errors, first(svc order by lift desc, svc) as by_lift, 1.0::double / count(*) as chance from h group by 1, 2)
"""
_BASE = f"(select *, event_id + 1 as line_no, {LEVEL} as level, {_SECOND} as sec from events)"
_FIELDS = "select line_no, {level} as level, {msg} as msg, sec as ts, unnest([{keys}]) as key, unnest([{values}]) as value from " + _BASE
_INNER = PRE + "select l.line_no, l.raw as line, case when event_id % 3 = 0 then date_trunc('second', ts) else date_trunc('second', ts) + interval 1 hour end::timestamp as ts, " + f"{LEVEL} as level from l join events on event_id + 1 = l.line_no"
ORACLE_SQL = {
    "json_events": _FIELDS.format(level="level", msg="'m ' || event_type", keys="'@timestamp', 'event', 'ctx.user', 'ctx.deep.shard', 'ctx.deep.ok'", values="strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type, user_id::varchar, (user_id % 5)::varchar, case when user_id % 2 = 0 then 'True' else 'False' end"),
    "logfmt_events": _FIELDS.format(level="level", msg="event_type || ' done'", keys="'user', 'empty', 'shard'", values="(user_id + 1)::varchar, '', (user_id % 5)::varchar"),
    "docker_events": _INNER,
    "cri_events": _INNER,
    "time_kinds": "select event_id + 1 as line_no, ['iso', 'bgl', 'compact', 'slash2', 'clf', 'ctime', 'syslog', 'hdfs', 'md', 'dotmd', 'epoch'][event_id % 11 + 1] as kind,"
    " case when event_id % 11 in (6, 8, 9) then make_timestamp(2000, month(ts), day(ts), hour(ts), minute(ts), second(ts)::double) else date_trunc('second', ts)::timestamp end as ts from events",
    "sniffed": "select * from (values ('json', 'json'), ('logfmt', 'logfmt'), ('lines', 'text')) as t(form, kind)",
    "samples": PRE + ", h as (select line_no, case when line_no % 5 in (0, 4) then '  at frame ' || (line_no - 1)::varchar else raw end as raw, max(case when line_no % 5 not in (0, 4) then line_no end) over (order by line_no) as head_no from l)"
    " select head_no as line_no, substring(max(case when line_no = head_no then raw end) || coalesce(' | ' || string_agg(trim(raw), ' | ' order by line_no) filter (where line_no > head_no), ''), 1, 300) as sample from h where head_no is not null group by head_no",
    "onset_context": PRE + ", a as (select e.line_no as o, byte_off as off from e, (select first_off from s where first_frac > 0.03 and sample_signal order by first_off limit 1) f where e.byte_off = f.first_off)"
    " select line_no, raw from e, a where line_no between o - 15 and o + 14 and byte_off >= off - 4000",
    "sortedness": PRE + ", b as (select source, line_no, ts from e union all select 'back-' || source, (select count(*) from e) + 1 - line_no, ts from e), x as (select *, lag(ts) over (partition by source order by line_no) as prev from b)"
    " select source, bool_and(prev is null or ts >= prev) as sorted, count(*) as dated from x group by source",
    "change_markers": PRE + r"select r.range as bucket, coalesce(bool_or(regexp_matches(raw, '(?i)\b(deploy|migrat|config|version|commit|applied)\b')), false) as marked from range(44) r left join p on p.bucket = r.range group by 1",
    "level_histogram": PRE + "select row_number() over (order by n desc, f) as nth, level, n from (select level, count(*) as n, min(line_no) as f from e group by level) order by nth limit 6",
    "slice_between": PRE + "select line_no, raw from e where ts between timestamp '2024-01-10' and timestamp '2024-01-20'",
    "normalised": "select 'id ' || case when even then '<uuid>' else 'a-b-c' end || ' took ms' as line, count(*) as n from (select event_id % 2 = 0 as even from events) group by even",
    "trend_lineitem": """with v as (select l_returnflag as key, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey as line_no, max(l_quantity * (1 + l_orderkey % 1000 * case when l_returnflag = 'R' then l_orderkey else 1 end)) as num from lineitem group by 1, 2),
r as (select *, row_number() over (partition by key order by line_no) as rn, count(*) over (partition by key) as n from v),
m as (select key, n, avg(num) filter (where rn <= n // 4) as h, avg(num) filter (where rn > n - n // 4) as t from r group by 1, 2)
select key, n, round_even((t + 1e-9) / (h + 1e-9), 6) as ratio, case when t > h then 'GREW' else 'DROPPED' end as direction from m where t / h >= 1.5 or t / h <= 0.66""",
    "post_injection": _CASES + 'select case_id, truth, svc, post_n, err_n, post_err_n from g',
    "baselines": _CASES + 'select case_id, truth, by_errors, by_post_errors, by_lift, round_even(chance, 6) as chance from w',
    "baseline_hits": _CASES + "select count(*) as cases, count(*) filter (where by_errors = truth) as by_errors, count(*) filter (where by_post_errors = truth) as by_post_errors, count(*) filter (where by_lift = truth) as by_lift, round_even(sum(chance), 6) as expected from w",
    "case_sample": "select case_id from (select case_id, row_number() over (order by case_id) - 1 as nth from (select distinct 'c' || lpad(user_id::varchar, 9, '0') as case_id from events)) where nth % 3 = 0 order by case_id limit 20",
    "sweep": PRE + ", f as (select 100.0::double * count(ts) / count(*) as ts_pct from (select ts from e order by line_no limit 5000)) select (select count(*) from e) as lines, count(*) as templates, count(*) filter (where cnt <= 3) as rare, (select ts_pct from f) as ts_pct, round_even((select count(*) from e) / count(*), 6) as compression from t",
}
