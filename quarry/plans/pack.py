"""The evidence pack: all operators over one log or several, formatted last; and what an agent asks for."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import parse
from quarry.operators import evidence as E
from quarry.operators import mining
from quarry.sources import logs

FOOTER = "Distribution only: a large share does not make a value the cause."
#: Characters of a pack's text, and of each part of raw lines in it.
MOST, MOST_CONTEXT, MOST_TAIL = 26_000, 7_000, 5_000
#: How bounds may be written; those without a year, or a day, take the log's.
WHEN = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d/%b/%Y:%H:%M:%S", "%b %d %H:%M:%S", "%H:%M:%S", "%H:%M")


def when(text: str, log_day: dt.datetime | None = None) -> dt.datetime:
    """A bound of time given as text."""
    text = text.strip().strip("[]")
    for form in WHEN:
        try:
            # the year is read with the text, so that a leap day is one
            got = dt.datetime.strptime(text if "%Y" in form else f"2000 {text}", form if "%Y" in form else f"%Y {form}")
        except ValueError:
            continue
        if "%Y" in form or log_day is None:
            return got
        day = log_day if "%b" not in form else log_day.replace(month=got.month, day=got.day)
        return got.replace(year=day.year, month=day.month, day=day.day)
    raise ValueError(f"bad time {text!r}: use 2026-08-04T02:00, 2026-08-04 02:00:00 or 02:00")


def read(spark: SparkSession, path) -> DataFrame:
    """Lines of a log; several paths are merged in order of time."""
    paths = [path] if isinstance(path, str) else list(path)
    if len(paths) == 1:
        return logs.read_lines(spark, paths[0])
    merged = logs.read_sources([logs.read_lines(spark, p) for p in paths])
    # one log from here on, numbered anew in its order
    ranked = merged.select(F.lit("merged").alias("source"), F.lit(0).alias("split"), "raw", F.struct("ts_filled", "nth", "source", "line_no").alias("seq"))
    return logs.number_lines(ranked)


def analyze(spark: SparkSession, path, last: str | None = None, since=None, until=None, year: int = 2000) -> dict:
    """Typed evidence of a log, or of several; at most some hundred rows reach the driver."""
    return pack(read(spark, path), last, since, until, year)


def _bounds(ev: DataFrame, since, until) -> tuple:
    if not isinstance(since, str) and not isinstance(until, str):
        return since, until
    day = ev.agg(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("t")).first().t
    return tuple(when(x, day) if isinstance(x, str) else x for x in (since, until))


def pack(lines: DataFrame, last: str | None = None, since=None, until=None, year: int = 2000) -> dict:
    kind = E.sniff(lines)
    ev = E.events(lines, kind, year)
    if last or since or until:
        since, until = _bounds(ev, since, until)
        ev = E.slice_window(ev, since, until, E.seconds(last) if last else None)
    ev = E.probed(ev).persist()
    total, signals, kept = lines.count(), ev.filter("signal").count(), ev.count()
    tpl = E.templates(mining.match(ev, mining.train(ev)), F.col("template")).persist()
    first = E.onset(tpl).collect()
    at = ev.filter(F.col("byte_off") == first[0].first_off).select("line_no", "source").first() if first else None
    series = E.series(ev)
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = {
        "format": kind, "total_lines": total, "signal_lines": signals, "templates": tpl.count(),
        "patterns": rows(E.patterns(tpl)), "rare": rows(E.rare(tpl)), "trends": rows(E.trends(series)),
        "dims": rows(E.dims(E.dim_counts(ev))), "density": [r.n for r in E.density(ev).orderBy("bucket").collect()], "onset": first[0].asDict() if first else None,
        "markers": [r.marked for r in E.change_markers(ev).orderBy("bucket").collect()],
        "context": [r.raw for r in E.context(lines, at and at.line_no, source=at and at.source).collect()], "tail": [r.raw for r in reversed(E.tail(lines).collect())],
    }
    out["compression"] = kept / max(1, out["templates"])
    ev.unpersist(), tpl.unpersist()
    return out


def _cut(lines: list[str], most: int) -> str:
    text = "\n".join(lines)
    return text if len(text) <= most else text[: most - 4] + "\n..."


def to_prompt(p: dict, most: int = MOST) -> str:
    """The pack as text. Raw lines are cut first, then the longest sections, so that each section is there."""
    parts = [f"LINES {p['total_lines']:,}  SIGNAL {p['signal_lines']:,}  TEMPLATES {p['templates']:,}  FORMAT {p['format']}"]
    parts.append("PATTERNS\n" + "\n".join(f"{x['cnt']:>8,}  {'new ' if x['is_new'] else ''}{x['template']}" for x in p["patterns"]))
    parts.append("RARE\n" + "\n".join(f"{x['score']:.2f}  x{x['cnt']}  {x['relation'] or '-'}  {x['template']}" for x in p["rare"]))
    parts.append("TRENDS\n" + "\n".join(f"{x['key']} {x['direction']} {x['head_avg']:.1f} -> {x['tail_avg']:.1f} ({x['n']} samples)" for x in p["trends"]))
    parts.append("DIMENSIONS\n" + "\n".join(f"{x['dim']}={x['value']} {x['err_pct']:.0f}% of errors, {x['base_pct']:.0f}% of all" for x in p["dims"]) + "\n" + FOOTER)
    parts.append("CONTEXT\n" + _cut(p["context"], MOST_CONTEXT))
    parts.append("TAIL\n" + _cut(p["tail"], MOST_TAIL))
    room = most - 2 * (len(parts) - 1)
    while sum(map(len, parts)) > room:
        longest = max(range(len(parts)), key=lambda i: len(parts[i]))
        over = sum(map(len, parts)) - room
        parts[longest] = parts[longest][: max(len(parts[longest]) // 2, len(parts[longest]) - over - 4)] + "\n..."
    return "\n\n".join(parts)


def read_log_evidence(spark: SparkSession, path, last: str | None = None, since=None, until=None) -> str:
    """The evidence of a log as text."""
    return to_prompt(analyze(spark, path, last, since, until))


def inspect_log_file(spark: SparkSession, path: str) -> dict:
    """What a file is, from its first bytes; raises UnreadableLog where it is no log."""
    name, size, encoding = logs.probe(spark, path)
    gzip = name.endswith(".gz")
    return {"path": name, "bytes": size, "encoding": encoding or "UTF-8", "gzip": gzip, "lines": None if gzip else logs.line_estimate(spark, path)}


def log_parse_diagnostics(spark: SparkSession, path) -> dict:
    """How well a log is understood, without its content."""
    lines = read(spark, path)
    h, p = E.health_report(lines).first(), analyze(spark, path)
    out = {
        "format": h.format, "lines": h.lines, "ts_pct": h.ts_pct, "level_pct": h.level_pct, "levels": [tuple(x) for x in h.levels], "shapes": [tuple(x) for x in h.shapes],
        "templates": p["templates"], "compression": p["compression"], "signal_lines": p["signal_lines"], "rare": len(p["rare"]), "trends": len(p["trends"]),
    }
    out["warnings"] = [
        text for bad, text in (
            ((h.ts_pct or 0) < 50, "few timestamps parsed: ordering and onset are weak"), (p["compression"] < 2, "templates barely compress: lines aren't grouped"), (not p["rare"], "no rare events: state changes may be missing"),
        ) if bad
    ]
    return out


def write_metrics(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Results as lines of JSON."""
    spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def first_year(lines: DataFrame) -> int | None:
    """The year of a log's first line with a whole date; for kinds of time without one."""
    found = parse.time_text(F.col("raw"))
    whole = lines.filter(~F.coalesce(found["kind"].isin("syslog", "md", "dotmd"), F.lit(True))).orderBy("line_no").limit(1)
    row = whole.select(F.year(parse.time_value(found)).alias("y")).first()
    return row.y if row else None
